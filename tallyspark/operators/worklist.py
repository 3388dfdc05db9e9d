"""Work lists, response cache, and progress of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import labels as L
from . import sequence

KEY = ("model_id", "scenario_id", "intervention", "prompt_hash")


def work_list(models: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every model with every scenario: the work itself is that product. The models ride along as one array."""
    names = models.agg(F.array_sort(F.collect_set("model_id")).alias("__m"))
    return scenarios.join(F.broadcast(names)).select(F.explode("__m").alias("model_id"), *scenarios.columns)


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done.select("model_id", "scenario_id"), ["model_id", "scenario_id"], "left_anti")


def _same_key(a: DataFrame, b: DataFrame):
    out = None
    for k in KEY:
        c = a[k].eqNullSafe(b[k])
        out = c if out is None else out & c
    return out


def probe(work: DataFrame, cache: DataFrame) -> DataFrame:
    """The work with ``hit`` and the cached response; null interventions and hashes match null ones."""
    c = cache.select(*KEY, F.col("response").alias("__response"), F.lit(True).alias("__hit"))
    j = work.join(c, _same_key(work, c), "left")
    return j.select(*[work[x] for x in work.columns], F.coalesce("__hit", F.lit(False)).alias("hit"), F.col("__response").alias("response"))


def cache_stats(probed: DataFrame) -> DataFrame:
    """One row: hits, misses, hit_rate, saved_percent (each miss is a call made)."""
    t = probed.agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.sum((~F.col("hit")).cast("int")).alias("misses"))
    rate = F.coalesce(F.try_divide(F.col("hits") * 1.0, F.col("hits") + F.col("misses")), F.lit(0.0))
    return t.select("hits", "misses", rate.alias("hit_rate"), (rate * 100).alias("saved_percent"))


def cache_entries(cache: DataFrame) -> DataFrame:
    """Entries and different scenarios by model; scenarios are the ids themselves."""
    return cache.groupBy("model_id").agg(F.count("*").alias("entries"), F.count_distinct("scenario_id").alias("scenarios"))


def upsert(cache: DataFrame, new: DataFrame, at: str = "cached_at") -> DataFrame:
    """The cache with new entries; of one key the latest stays, of equal times the larger response."""
    both = cache.unionByName(new)
    latest = both.groupBy(*KEY).agg(F.max(F.struct(at, "response")).alias("__l"))
    return latest.select(*KEY, F.col(f"__l.{at}").alias(at), F.col("__l.response").alias("response"))


def manifest_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("total"), F.count_if(F.col("failed") == 0).alias("successful"), F.count_if(F.col("failed") == 1).alias("failed"))


def progress(calls: DataFrame, planned: int) -> DataFrame:
    """By model: processed, share of the planned calls in percent, parse rate, remaining."""
    n = F.count("*")
    ok = F.sum(1 - F.col("failed"))
    return calls.groupBy("model_id").agg(n.alias("processed"), (n * 100.0 / planned).alias("percent"), (ok / n).alias("parse_rate"), (F.lit(planned) - n).alias("remaining"))


def milestones(calls: DataFrame, planned: int, step: float = 0.05, order: str = "seq") -> DataFrame:
    """(model_id, milestone, seq): the call at which each model passes each ``step`` of the planned calls; its calls are numbered by ranges of ``order``."""
    x = sequence.numbered(calls.select("model_id", F.col(order).alias("seq")), "model_id", "seq")
    x = x.select("model_id", "seq", F.floor(F.col("position") / F.lit(planned * step)).alias("milestone"))
    return x.where("milestone > 0").groupBy("model_id", "milestone").agg(F.min("seq").alias("seq"))


def success_rate(calls: DataFrame) -> DataFrame:
    t = calls.agg(F.count("*").alias("total"), F.sum(1 - F.col("failed")).alias("successful"))
    return t.withColumn("success_rate", F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("total")), F.lit(0.0)))


def circuit_breaker(calls: DataFrame, most: int = 100, order: str = "seq") -> DataFrame:
    """By model: longest run of consecutive failures, whether that drops it, and the call at which it does.

    Runs are found in ranges of ``order`` and joined up across them, so no task sees all calls of a model.
    """
    x = sequence.runs(calls.select("model_id", F.col(order).alias("seq"), "failed"), "model_id", "seq", "failed")
    longest = F.max("run").cast("int")
    return x.groupBy("model_id").agg(longest.alias("longest"), (longest >= most).alias("dropped"), F.min(F.when(F.col("run") == most, F.col("seq"))).alias("dropped_at"))


def cost_estimate(config: DataFrame, per_call: float = 0.0008) -> DataFrame:
    """(plan, calls, cost) of rows (plan, models, scenarios, variants, extra): scenarios x models x (1 + variants) + extra x models."""
    calls = F.col("models") * F.col("scenarios") * (1 + F.col("variants")) + F.col("extra") * F.col("models")
    return config.select("plan", calls.alias("calls"), (calls * per_call).alias("cost"))


def predict(prompts: DataFrame, model, schema: str, provider: str = "provider", at_once: int = 8) -> DataFrame:
    """Model hook: ``model`` maps an iterator of pandas frames of prompts to frames of ``schema``.

    Rows are dealt over ``at_once`` partitions for each provider, which bounds the calls at once.
    """
    dealt = prompts.repartition(at_once, provider, F.pmod(F.xxhash64(*prompts.columns), F.lit(at_once)))
    return dealt.mapInPandas(model, schema)


def _delay(attempt: int, base: float, most: float, jitter: float, u: float) -> float:
    """Seconds before a retry, as ``labels.backoff`` has them; u is a number from 0 to 1."""
    return max(0.1, min(base * 2.0**attempt, most) * (1 + jitter * (2 * u - 1)))


def call_limited(prompts: DataFrame, call: Callable[[dict], str], limits: dict[str, int] | None = None, tries: int = 3, base: float = 2.0, most: float = 60.0, jitter: float = 0.25, give_up: int = 100, provider: str = "provider", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The prompts with response, attempts, waited (seconds) and error of calling ``call`` on each row as a dict.

    A provider's rows are dealt over as many slots as it allows calls at once (``limits``; else its usual ceiling), a slot lies in one partition, and a
    partition calls one by one: so a provider never has more calls at once than that, however many tasks run. A
    call that raises is tried again after a growing pause, ``tries`` times in all; then its error is kept and response is null. After
    ``give_up`` rows in a row have failed for a provider in a partition, its remaining rows there aren't called (error ``circuit open``, no attempts).

    Null providers share one slot. A task that is run again calls again: switch speculation off, and write the result before anything reads it twice.
    """
    usual = L.provider_limit(F.coalesce(F.col(provider), F.lit("")))
    ceiling = usual if limits is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.coalesce(F.col(provider), F.lit(""))), F.lit(1)) if limits else F.lit(1)
    ceiling = F.when(F.col(provider).isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), ceiling))
    hashed = F.xxhash64(*[c for c, t in prompts.dtypes if not t.startswith("map")])
    parts = sum(limits.values()) + 1 if limits else sum(L.PROVIDER_LIMITS.values()) + 1
    dealt = prompts.withColumn("__h", hashed).withColumn("__slot", F.pmod("__h", ceiling)).repartition(parts, provider, "__slot")
    schema = StructType(prompts.schema.fields + StructType.fromDDL("response string, attempts int, waited double, error string").fields)

    def run(batches):
        failed: dict = {}
        for b in batches:
            out = []
            rows = b.drop_columns(["__h", "__slot"]).to_pylist()
            for row, h in zip(rows, b.column("__h").to_pylist()):
                response, error, waited, attempt = None, None, 0.0, 0
                who = row[provider]
                if failed.get(who, 0) >= give_up:
                    error = "circuit open"
                while error is None or 0 < attempt < tries:
                    try:
                        attempt += 1
                        response, error = call(row), None
                        break
                    except Exception as problem:  # whatever the call raises is the row's error
                        error = f"{type(problem).__name__}: {problem}"
                        if attempt < tries:
                            pause = _delay(attempt - 1, base, most, jitter, (h * 31 + attempt) % (1 << 20) / (1 << 20))
                            sleep(pause)
                            waited += pause
                failed[who] = failed.get(who, 0) + 1 if error else 0
                out.append(row | {"response": response, "attempts": attempt, "waited": waited, "error": error})
            if out:
                kept = b.drop_columns(["__h", "__slot"]).schema
                more = pa.schema([*kept, ("response", pa.string()), ("attempts", pa.int32()), ("waited", pa.float64()), ("error", pa.string())])
                yield pa.RecordBatch.from_pylist(out, more)

    return dealt.mapInArrow(run, schema)


def mock_predictions(prompts: DataFrame, labels: tuple[str, ...], key: str = "prompt") -> DataFrame:
    """A label for each prompt by its hash; the same in every run."""
    i = F.pmod(F.xxhash64(key), F.lit(1000))
    table = F.array(*[F.lit(x) for x in labels])
    return prompts.withColumn("emotion", F.element_at(table, (i % len(labels) + 1).cast("int"))).withColumn("confidence", 0.5 + i / 2000.0)
