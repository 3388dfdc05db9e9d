"""Validation, repair and retry planning of stored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import EMOTIONS, LABEL_MAP, SUBTYPES, label_action, mapped_label, mapping_reason, normalise

FIELDS = ("subtype", "emotion", "valence", "arousal", "dominance")
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def _severity_rank(c: str):
    out = F.lit(9)
    for name, k in RANK.items():
        out = F.when(F.col(c) == name, k).otherwise(out)
    return out


def unnest(files: DataFrame, text: str = "value") -> DataFrame:
    """Responses of whole JSON files: a list, {predictions: []}, {responses: []} or one object.

    (file, at, response variant, parse_failed); a file that can't be parsed gives one row.
    """
    v = F.try_parse_json(text)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.predictions", "array<variant>"), F.try_variant_get(v, "$.responses", "array<variant>"), F.array(v))
    x = files.select("file", v.isNull().alias("parse_failed"), F.posexplode_outer(items).alias("at", "response"))
    return x.select("file", F.coalesce("at", F.lit(0)).alias("at"), "response", "parse_failed")


def validate(responses: DataFrame) -> DataFrame:
    """One row an error: scenario_id, model_id, error_type, severity, field, actual.

    ``responses`` has scenario_id, model_id, the five fields and confidence; null
    counts as missing. A row without any field is one ``empty_response``. Labels are
    compared as they stand, so case and blanks matter. NaN is out of range.
    """
    return responses.select("scenario_id", "model_id", F.explode(_errors()).alias("e")).select("scenario_id", "model_id", "e.*")


def _errors():
    """The array of errors of a response."""
    empty = ~F.greatest(*[F.col(f).isNotNull() for f in (*FIELDS, "confidence")])

    def error(when, kind, severity, field, actual=None):
        made = F.struct(F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), (F.lit(None) if actual is None else actual).cast("string").alias("actual"))
        return F.when(F.coalesce(when, F.lit(False)), made)

    checks = [error(F.col(f).isNull(), "schema_missing_field", "medium", f) for f in FIELDS]
    checks += [error((F.col(f) != "") & ~F.col(f).isin(*ok), f"invalid_{f}", "medium", f, F.col(f)) for f, ok in (("subtype", SUBTYPES), ("emotion", EMOTIONS))]
    # a zero is dropped from the actual value, as any falsy one is
    checks += [error(~F.col(f).between(-1.0, 1.0), "vad_out_of_range", "medium", f, F.round(F.col(f), 6)) for f in FIELDS[2:]]
    checks.append(error(~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range", "low", "confidence", F.round(F.col("confidence"), 6)))
    return F.when(empty, F.array(error(F.lit(True), "empty_response", "high", None))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def summary(responses: DataFrame, limit: float = 5.0) -> DataFrame:
    """One row: total, valid, invalid, error_rate in percent, status. A response is invalid if it has any error."""
    t = responses.agg(F.count("*").alias("total"), F.count_if(F.size(_errors()) > 0).alias("invalid"))
    rate = F.coalesce(F.try_divide(F.col("invalid") * 100.0, F.col("total")), F.lit(0.0))
    return t.select("total", (F.col("total") - F.col("invalid")).alias("valid"), "invalid", rate.alias("error_rate"), F.when(rate > limit, "FAILED").otherwise("PASSED").alias("status"))


def errors_by(errors: DataFrame, *by: str) -> DataFrame:
    return errors.groupBy(*by).agg(F.count("*").alias("n"))


def model_rates(responses: DataFrame, errors: DataFrame, limit: float = 10.0) -> DataFrame:
    """Errors of each model per hundred of its own responses, and whether that warns."""
    t = responses.groupBy("model_id").agg(F.count("*").alias("total"))
    e = errors.groupBy("model_id").agg(F.count("*").alias("errors"))
    j = t.join(e, "model_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return j.withColumn("rate", F.col("errors") * 100.0 / F.col("total")).withColumn("warns", F.col("rate") > limit)


def model_error_share(errors: DataFrame, total: int | DataFrame) -> DataFrame:
    """Errors of each model over an equal share of the total: total // models with errors."""
    per = errors.groupBy("model_id").agg(F.count("*").alias("errors"))
    if isinstance(total, int):
        per = per.withColumn("total", F.lit(total).cast("bigint"))
    else:
        per = per.join(F.broadcast(total.select("total")))
    share = F.floor(F.col("total") / F.count("*").over(Window.partitionBy()))  # over models
    return per.select("model_id", "errors", share.alias("share"), F.coalesce(F.try_divide(F.col("errors") * 1.0, share), F.lit(0.0)).alias("rate"))


def invalid_labels(manifest: DataFrame) -> DataFrame:
    """(scenario_id, model_id, label) of invalid_emotion rows; the message's prefix goes."""
    return manifest.where("error_type = 'invalid_emotion'").select("scenario_id", "model_id", F.regexp_replace("message", "^Invalid emotion: ", "").alias("label"))


def repair(responses: DataFrame) -> DataFrame:
    """Responses with mapped labels rewritten; original_emotion, repair_action and reason say what was done."""
    return responses.select(
        *[c for c in responses.columns if c != "emotion"],
        F.col("emotion").alias("original_emotion"),
        F.coalesce(mapped_label("emotion"), "emotion").alias("emotion"),
        label_action("emotion").alias("repair_action"),
        mapping_reason("emotion").alias("reason"),
    )


def repair_join(manifest: DataFrame, responses: DataFrame) -> DataFrame:
    """Manifest rows with the response they name; ``found`` is false where there is none."""
    r = responses.select("scenario_id", "model_id", "emotion").dropDuplicates(["scenario_id", "model_id"]).withColumn("__found", F.lit(True))
    j = manifest.join(r, ["scenario_id", "model_id"], "left")
    return j.withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def repair_counts(repaired: DataFrame) -> DataFrame:
    """By model: how many (scenario, model) had each action."""
    one = repaired.select("scenario_id", "model_id", "repair_action").distinct()
    return one.groupBy("model_id").agg(*[F.sum((F.col("repair_action") == a).cast("int")).alias(f"n_{a}") for a in ("valid", "mapped", "retry", "unknown")])


def repair_rate(repaired: DataFrame, limit: float = 5.0) -> DataFrame:
    """One row: share still wrong after repair in percent; valid and mapped labels are right."""
    ok = F.col("repair_action").isin("valid", "mapped")
    t = repaired.agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("usable"))
    rate = F.coalesce(F.try_divide((F.col("total") - F.col("usable")) * 100.0, F.col("total")), F.lit(0.0))
    return t.select("total", "usable", rate.alias("post_repair_rate"), F.when(rate <= limit, "PASSED").otherwise("FAILED").alias("status"))


def retry_plan(errors: DataFrame, total: int | None = None, share: float = 0.10) -> DataFrame:
    """(scenario_id, model_id, error_types, priority): the worst int(total * share) pairs.

    Order: least severity rank, then scenario and model (our tie rule). Priority is that rank plus one.
    """
    per = errors.withColumn("r", _severity_rank("severity")).groupBy("scenario_id", "model_id").agg(F.array_sort(F.collect_set("error_type")).alias("error_types"), F.min("r").alias("r"))
    # ranks are few: whole ranks before the last one that fits go in, and only the next is put in order
    size = per.groupBy("r").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.lit(total) if total is not None else F.sum("m").over(Window.partitionBy())
    left = size.select(F.col("r").alias("__r"), "m", (F.floor(all_ * F.lit(share)).cast("bigint") - before).alias("left")).where("left > 0")  # as many rows as ranks
    ranked = per.join(F.broadcast(left), F.col("r") == F.col("__r"))
    part = ranked.where("left < m")
    # within that rank, buckets by first characters are numbered by themselves and offset by those before them
    part = part.withColumn("__b", F.substring(F.col("scenario_id").cast("string"), 1, 4))
    sizes = part.groupBy("__b").agg(F.count("*").alias("__m"))
    offset = sizes.select(F.col("__b").alias("__p"), F.coalesce(F.sum("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy("scenario_id", "model_id")) + F.col("__o")
    some = part.join(offset, F.col("__b").eqNullSafe(F.col("__p"))).withColumn("__at", at).where(F.col("__at") <= F.col("left"))
    out = ranked.where("left >= m").select("scenario_id", "model_id", "error_types", "r").unionByName(some.select("scenario_id", "model_id", "error_types", "r"))
    return out.select("scenario_id", "model_id", "error_types", (F.col("r") + 1).alias("priority"))


def retry_fallback(manifest: DataFrame) -> DataFrame:
    """Retry items straight from an error table: error types by (scenario, model), rows without usable ids left out."""
    usable = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin("", "unknown")
    return manifest.where(usable("scenario_id") & usable("model_id")).groupBy("scenario_id", "model_id").agg(F.array_sort(F.collect_list("error_type")).alias("error_types"))


def retry_filter(items: DataFrame, rates: DataFrame, exclude: list[str] = (), models: list[str] = (), all_invalid: bool = False, limit: float = 0.05) -> DataFrame:
    """Which retry items run: excluded models never; then named models; else all; else models over the rate; else all."""
    kept = items.where(~F.col("model_id").isin(*exclude)) if exclude else items
    if models:
        return kept.where(F.col("model_id").isin(*models))
    if all_invalid:
        return kept
    over = rates.where(F.col("rate") > limit).select("model_id")
    some = over.agg(F.count("*").alias("__n"))
    j = kept.join(over.withColumn("__over", F.lit(True)), "model_id", "left").join(F.broadcast(some))
    return j.where("__over or __n = 0").drop("__over", "__n")


def mapping_stats(spark) -> DataFrame:
    """(target, sources): which labels are mapped to each."""
    rows = [(k, v[0]) for k, v in LABEL_MAP.items()]
    return spark.createDataFrame(rows, "source string, target string").groupBy("target").agg(F.concat_ws(",", F.array_sort(F.collect_list("source"))).alias("sources"), F.count("*").alias("n"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["normalise"]
