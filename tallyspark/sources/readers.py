"""Readers and writers of gold annotations, stored predictions and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import power_relation

PREDICTION = "scenario_id string, model_id string, success boolean, prediction struct<subtype: string, emotion: string, valence: double, arousal: double, dominance: double, confidence: double>, gold_emotion string, predicted_emotion string, latency_ms double, timestamp string"
MEASURES = {"label": "sl_plutchik_primary_", "valence": "sl_v_", "arousal": "sl_a_", "dominance": "sl_d_", "confidence": "sl_confidence_"}


def _by_prefix(columns: list[str]) -> dict[str, dict[str, str]]:
    return {m: {c[len(p) :]: c for c in columns if c.startswith(p)} for m, p in MEASURES.items()}


def gold_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios of aggregate_<subtype>.csv files: one row each, annotators folded into maps.

    Files whose name holds ``key`` or ``flagged`` are skipped, and rows without id or utterance.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", "aggregate_*.csv").csv(folder)
    named = raw.withColumn("__file", F.col("_metadata.file_name")).where(~F.col("__file").rlike("key|flagged"))
    found = _by_prefix(raw.columns)
    t = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in raw.columns else F.lit("")
    as_map = lambda m: F.create_map(*[x for a, c in found[m].items() for x in (F.lit(a), F.trim(c))]) if found[m] else F.create_map().cast("map<string,string>")
    vad = F.create_map(*[x for a in found["valence"] for x in (F.lit(a), F.struct(*[(F.trim(found[m][a]) if a in found[m] else F.lit(None).cast("string")).alias(m) for m in ("valence", "arousal", "dominance")]))]) if found["valence"] else F.create_map().cast("map<string,struct<valence:string,arousal:string,dominance:string>>")
    subtype = F.regexp_extract("__file", r"^aggregate_(.*)\.csv$", 1)
    kept = named.where((t("id") != "") & (t("sd_utterance") != ""))
    return kept.select(
        F.concat(subtype, F.lit("_"), t("id")).alias("id"),
        t("id").alias("original_id"),
        subtype.alias("subtype"),
        t("sd_situation").alias("situation"),
        t("sd_utterance").alias("utterance"),
        t("sd_speaker_role").alias("speaker_role"),
        t("sd_listener_role").alias("listener_role"),
        power_relation(t("sd_speaker_role"), t("sd_listener_role"), "gold").alias("power_relation"),
        t("gold_standard").alias("gold_emotion"),
        t("Notes").alias("notes"),
        as_map("label").alias("annotator_labels"),
        vad.alias("annotator_vad"),
        as_map("confidence").alias("annotator_confidence"),
    )


def gold_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """(file, id, reason) of the rows that ``gold_scenarios`` leaves out or can't read: no id, no utterance, or more fields than the header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("pathGlobFilter", "aggregate_*.csv")
    columns = reader.csv(folder).columns
    bad = "__bad"
    raw = reader.schema(", ".join(f"`{c}` string" for c in [*columns, bad])).option("columnNameOfCorruptRecord", bad).csv(folder)
    t = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in columns else F.lit("")
    reason = F.when(F.col(bad).isNotNull(), "malformed").when(t("id") == "", "no id").when(t("sd_utterance") == "", "no utterance")
    found = raw.select(F.col("_metadata.file_name").alias("file"), t("id").alias("id"), reason.alias("reason"))
    return found.where("reason is not null").where(~F.col("file").rlike("key|flagged"))


def gold_labels(scenarios: DataFrame) -> DataFrame:
    return scenarios.select(F.col("id").alias("scenario_id"), F.lower(F.trim("gold_emotion")).alias("gold")).where("gold <> ''")


def long_ratings(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, annotator, measure, value) of the annotator maps."""
    part = lambda m, e: scenarios.select(F.col("id").alias("scenario_id"), F.explode(e).alias("annotator", "value")).select("scenario_id", "annotator", F.lit(m).alias("measure"), "value")
    parts = [part("label", "annotator_labels"), part("confidence", "annotator_confidence")]
    field = lambda m: lambda _, v: v[m]
    parts += [part(m, F.transform_values("annotator_vad", field(m))) for m in ("valence", "arousal", "dominance")]
    return reduce(DataFrame.unionByName, parts)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """<model>/<scenario>.json files: ids from the path, the label nested or at the top; unreadable files are left out."""
    raw = spark.read.schema(PREDICTION + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    out = raw.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("model_dir"), F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.json$", "").alias("file_stem"))
    out = out.where(F.col("_corrupt_record").isNull() & ~F.col("file_stem").isin("batch_manifest", "stats"))
    return out.drop("_corrupt_record").withColumn("emotion", F.coalesce("prediction.emotion", "predicted_emotion"))


def response_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file, value): whole JSON files, but those named manifest, metadata, checkpoint or config."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(folders), wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value").where(~F.lower(F.regexp_extract("file", r"([^/]+)$", 1)).rlike("manifest|metadata|checkpoint|config"))


def error_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("scenario_id string, model_id string, error_type string, severity string, field string, message string").csv(path)


def write(df: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> None:
    """Write json, csv or parquet; Spark's commit makes it whole or absent. Existing output is never overwritten unasked."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    getattr(writer, kind)(path)


def stored_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value): whole JSON reports of a folder by file name without its ending."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"), F.try_parse_json("value").alias("value"))


def dated(path: str) -> str:
    """A path beside ``path`` that names the moment, for output that must not replace older output."""
    from datetime import datetime, timezone

    return f"{path.rstrip('/')}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"


def markdown(metrics: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of an aggregated frame, of at most ``most`` rows; a longer one is refused."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report; aggregate first")
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows) + "\n"
