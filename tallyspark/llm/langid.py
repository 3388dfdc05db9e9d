"""Language identification by multilingual mixtures of byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, raw_texts

#: Hashed n-gram bins, n-grams whose likelihoods count as one observation, additive smoothing, EM rounds.
BINS, RUN, SMOOTH, ROUNDS = 1 << 16, 24, 0.05, 40


def _bins(text: bytes):
    """Hashed trigrams of a text's bytes with A-Z lowered and a space at either end, in pieces of whole RUNs; none is cut."""
    padded = b" " + text.lower() + b" "
    for at in range(0, max(1, len(padded) - 2), RUN << 15):
        a = np.frombuffer(padded[at : at + (RUN << 15) + 2], np.uint8).astype(np.uint32)
        yield ((a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def is_held_out(id_col: str = "doc_id") -> Column:
    """True where crc32(id as text) mod 4 is 2; a null id is held out too (it is never learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bin by language) over all training rows with text and label.

    Counts are summed in Spark; the driver gets BINS numbers for each language.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for t, lang in zip(raw_texts(batch.column(0)), langs):
                if lang not in total:
                    total[lang] = np.zeros(BINS, np.int64)
                for x in _bins(t):
                    total[lang] += np.bincount(x, minlength=BINS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bin", "n"])

    rows = training.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    got = rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((BINS, len(langs)))
    table[got["bin"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy().astype(str))] = got["n"].to_numpy()
    table += SMOOTH
    return [str(x) for x in langs], np.log(table / table.sum(axis=0)).astype(np.float32) if langs else np.zeros((BINS, 0), np.float32)


def mixture(loglik: np.ndarray, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of one document from log likelihoods (observation x language).

    Expectation-maximisation gives proportions over all languages; by falling
    proportion, languages join the set as long as the log likelihood refitted on
    the set gains more than half the log of the number of observations.
    """
    n, k = loglik.shape
    top = loglik.max(axis=1, keepdims=True)
    like = np.exp(loglik - top)

    def fit(cols):
        x, w = like[:, cols], np.full(len(cols), 1 / len(cols))
        for _ in range(rounds):
            r = x * w
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            new = r.mean(axis=0)
            if np.abs(new - w).max() < 1e-4:
                w = new
                break
            w = new
        return w, float((np.log(np.maximum(x @ w, 1e-300)) + top[:, 0]).sum())

    order = list(np.argsort(-fit(list(range(k)))[0], kind="stable"))
    best = [int(np.argmax(loglik.sum(axis=0)))]
    w, ll = fit(best)
    for lang in order:
        if lang in best:
            continue
        w2, ll2 = fit([*best, lang])
        if ll2 - ll <= 0.5 * np.log(max(n, 2)):
            break
        best, w, ll = [*best, int(lang)], w2, ll2
    return best, w


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score, languages (map of the chosen set's proportions).

    A text that is null or has no letter, or anything if no language was
    learned, is ``und`` with score 0 and no proportions.
    """
    sent = keep if text_col in keep else [*keep, text_col]
    at_text = sent.index(text_col)

    def one(t: bytes):
        if not langs or next(filter(str.isalpha, t.decode("utf-8", "replace")), None) is None:
            return "und", 0.0, []
        parts = [np.add.reduceat(table[x], np.arange(0, len(x), RUN), axis=0) for x in _bins(t)]
        own, w = mixture(np.concatenate(parts).astype(np.float64))
        i = int(np.argmax(w))
        return langs[own[i]], float(min(1.0, w[i])), [(langs[j], float(p)) for j, p in zip(own, w)]

    def run(batches):
        for batch in pieces(batches):
            pred, score, sets = zip(*map(one, raw_texts(batch.column(at_text))))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names=[*keep, "lang_pred", "score", "languages"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*sent).mapInArrow(run, f"{kinds}, lang_pred string, score double, languages map<string,double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each input row: id, held_out, lang_pred, score, languages.

    Learns from the text and label of rows that are not held out, and predicts
    from text alone. Repeated rows are each counted and predicted, repeated and null ids too (a null id is held out);
    very long texts are read whole, with no n-gram cut; bytes that aren't UTF-8 are n-grams like others. Without
    anything learned all is ``und``. Other columns are not read and may have any name. An empty table gives no rows.
    """
    langs, table = learn(docs.where(~is_held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__t"))
    return predict(rows, langs, table, [id_col, "held_out"], "__t")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is in some learned language: those predicted ``und`` (null, empty or without a letter) go.

    Columns unchanged, whatever their names; cases are as in ``identify``.
    """
    langs, table = learn(docs.where(~is_held_out(id_col)), text_col, lang_col)
    names = [f"__{i}" for i in range(len(docs.columns))]
    kept = predict(docs.toDF(*names), langs, table, names, names[docs.columns.index(text_col)]).where("lang_pred <> 'und'")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
