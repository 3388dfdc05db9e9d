"""Canonical views over the star-schema test tables, in Spark and as the same CTEs in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .files import write_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, scenario_id, predicted, gold, subtype, power_relation, confidence, latency_ms, correct.

    Orders meet customers and lineitem meets suppliers first, so that what comes of them is
    shuffled once, by order; suppliers stay small enough for Spark to broadcast by their measured size.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_discount", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("cr"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("sr"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    li = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    predicted = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("P")
    return j.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model_id"),
        F.col("o_orderkey").alias("scenario_id"),
        predicted.alias("predicted"),
        F.col("o_orderstatus").alias("gold"),
        F.col("o_orderpriority").alias("subtype"),
        F.when(F.col("cr") == F.col("sr"), "peer").when(F.col("cr") > F.col("sr"), "higher_to_lower").otherwise("lower_to_higher").alias("power_relation"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_extendedprice").alias("latency_ms"),
        (predicted == F.col("o_orderstatus")).cast("int").alias("correct"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, rater (1-3), cat: the first three lines of orders that have three."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return li.withColumn("rater", F.row_number().over(order)).withColumn("m", F.count("*").over(w)).where("rater <= 3 and m >= 3").select(F.col("l_orderkey").alias("subject"), "rater", F.col("l_returnflag").alias("cat"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, base, treat, truth from the labels table; truth is 1 where the row's source id is even."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("base"), F.col("toxic").cast("int").alias("treat"), (F.col("doc_id") % 2).cast("int").alias("truth"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario_id, utterance, speaker_role, listener_role: each turn that has a next one."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "department manager").when(F.col("role") == "assistant", "junior assistant").otherwise("colleague")
    c = c.select("conv_id", "turn", "text", role.alias("speaker_role"))
    return c.withColumn("listener_role", F.lead("speaker_role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("listener_role is not null").select(F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("scenario_id"), F.col("text").alias("utterance"), "speaker_role", "listener_role")


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subtype"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, seq, failed, ts."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("model_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("failed"), "ts")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario_id, model_id and prediction fields, some missing, out of range or outside the label set."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select(
        F.concat(F.lit("s"), (F.col("event_id") % 1000).cast("string")).alias("scenario_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_id"),
        F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 5 == 1, "Sarcasm").otherwise("mixed_signals").alias("subtype"),
        F.when(F.col("event_type") == "click", "joy").when(F.col("event_type") == "error", "guilt").when(F.col("event_type") == "purchase", "unknown").when(F.col("event_type") == "signup", "Trust ").otherwise("melancholy").alias("emotion"),
        (F.col("value") / 50).alias("valence"),
        F.lit(0.5).alias("arousal"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.lit(-0.25)).alias("dominance"),
        (F.col("value") / 100).alias("confidence"),
    )


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y for each customer: mean discount and mean quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.avg("l_discount"), 6).alias("x"), F.round(F.avg("l_quantity"), 6).alias("y")).select("x", "y")


def exact_metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As metric_pairs, with exact sums of values of at most six decimals: equal means stay equal in any order of rows, so they tie in ranks."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")

    def mean(c):
        total = F.sum(F.round(F.col(c) * 1_000_000).cast("long")).cast("decimal(20,0)")
        return (F.round(F.try_divide(total, F.count(c).cast("decimal(12,0)")), 0).cast("double") / 1_000_000).alias("x" if c == "l_discount" else "y")

    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(mean("l_discount"), mean("l_quantity")).select("x", "y")


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p = 1 / (1 + events of the user)."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.lit(1.0) / (1 + F.count("*"))).alias("p"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


SQL = {
    "pred": """pred AS (
  SELECT 'm' || (l_suppkey % 4)::varchar AS model_id, o_orderkey AS scenario_id,
    CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END AS predicted, o_orderstatus AS gold, o_orderpriority AS subtype,
    CASE WHEN cn.n_regionkey = sn.n_regionkey THEN 'peer' WHEN cn.n_regionkey > sn.n_regionkey THEN 'higher_to_lower' ELSE 'lower_to_higher' END AS power_relation,
    l_discount * 10 AS confidence, l_extendedprice AS latency_ms,
    (CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END = o_orderstatus)::int AS correct
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey)""",
    "ratings": """ratings AS (
  SELECT subject, rater, cat FROM (SELECT l_orderkey AS subject, l_returnflag AS cat, count(*) OVER (PARTITION BY l_orderkey) AS m,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rater FROM lineitem)
  WHERE rater <= 3 AND m >= 3)""",
    "pairs": """pairs AS (SELECT doc_id AS key, quality::int AS base, toxic::int AS treat, (doc_id % 2)::int AS truth FROM labels)""",
    "utterances": """utterances AS (
  SELECT * FROM (SELECT 'conv_' || conv_id::varchar || '_' || turn::varchar AS scenario_id, text AS utterance, speaker_role,
    lead(speaker_role) OVER (PARTITION BY conv_id ORDER BY turn) AS listener_role
    FROM (SELECT *, CASE role WHEN 'user' THEN 'department manager' WHEN 'assistant' THEN 'junior assistant' ELSE 'colleague' END AS speaker_role FROM conversations))
  WHERE listener_role IS NOT NULL)""",
    "strata": "strata AS (SELECT o_orderkey AS id, o_orderpriority AS subtype FROM orders)",
    "calls": "calls AS (SELECT user_id::varchar AS model_id, event_id AS seq, (event_type = 'error')::int AS failed, ts FROM events)",
    "responses": """responses AS (
  SELECT 's' || (event_id % 1000)::varchar AS scenario_id, 'm' || (user_id % 7)::varchar AS model_id,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'Sarcasm' ELSE 'mixed_signals' END AS subtype,
    CASE event_type WHEN 'click' THEN 'joy' WHEN 'error' THEN 'guilt' WHEN 'purchase' THEN 'unknown' WHEN 'signup' THEN 'Trust ' ELSE 'melancholy' END AS emotion,
    value / 50 AS valence, 0.5::double AS arousal, CASE WHEN k % 3 = 0 THEN NULL ELSE -0.25::double END AS dominance, value / 100 AS confidence
  FROM (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events))""",
    "metric_pairs": "metric_pairs AS (SELECT round(avg(l_discount), 6) AS x, round(avg(l_quantity), 6) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)",
    "pvalues": "pvalues AS (SELECT user_id AS id, 1.0::double / (1 + count(*)) AS p FROM events GROUP BY user_id)",
    "prompts": "prompts AS (SELECT doc_id AS id, text FROM documents)",
}


def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): a stored prediction for each supplier, some torn, some without a label, one manifest for each model."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("balance"))
    key, model = F.col("s_suppkey"), F.concat(F.lit("m"), (F.col("s_nationkey") % 4).cast("string"))
    label = F.when(key % 3 == 0, "joy").when(key % 3 == 1, "fear").otherwise("anger")
    inner = F.struct(F.lit("deflection").alias("subtype"), F.when(key % 5 != 0, label).alias("emotion"), ((key % 100) / 100).alias("confidence"))
    told = F.to_json(F.struct(F.concat(F.lit("s_"), key.cast("string")).alias("scenario_id"), model.alias("model_id"), (key % 2 == 0).alias("success"), inner.alias("prediction"), F.when(key % 10 == 0, "trust").alias("predicted_emotion"), F.col("balance").alias("latency_ms")))
    content = F.when(key % 7 == 0, F.substring(told, 1, 20)).otherwise(told)
    files = s.select(F.concat(model, F.lit("/s_"), key.cast("string"), F.lit(".json")).alias("name"), content.alias("content"))
    return files.unionByName(s.select(F.concat(model, F.lit("/batch_manifest.json")).alias("name"), F.lit("{}").alias("content")).distinct())


def gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): an annotation file for each of five subtypes, a row for each supplier, some without id or utterance; and an answer key."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    key = F.col("s_suppkey")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    utterance = F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit(" He said \"well\",\nagain: "), "s_name", F.lit(" ")))
    fields = [F.when(key % 13 == 0, "").otherwise(key.cast("string")), utterance, F.lit("senior manager"), F.lit("intern"), F.when(key % 2 == 0, " Joy ").otherwise("anger")]
    line = F.concat_ws(",", *[quoted(f) for f in fields])
    lines = s.groupBy((F.col("s_nationkey") % 5).alias("k")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    head = F.lit("id,sd_utterance,sd_speaker_role,sd_listener_role,gold_standard\n")
    files = lines.select(F.concat(F.lit("aggregate_sub"), F.col("k").cast("string"), F.lit(".csv")).alias("name"), F.concat(head, F.array_join("x", "\n"), F.lit("\n")).alias("content"))
    return files.unionByName(lines.limit(1).select(F.lit("aggregate_answer_key.csv").alias("name"), F.concat(head, F.lit("9,x,a,b,joy\n")).alias("content")))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): an error manifest for each nation, a line for each of its suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    even = F.col("s_suppkey") % 2 == 0
    message = F.concat(F.lit('"Invalid: ""'), "s_name", F.lit('"", mostly"'))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.lit("m"), F.when(even, "invalid_emotion").otherwise("empty_response"), F.lit("medium"), F.when(even, "emotion").otherwise(""), message)
    lines = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    head = F.lit("scenario_id,model_id,error_type,severity,field,message\n")
    return lines.select(F.concat(F.lit("manifest-"), F.col("s_nationkey").cast("string"), F.lit(".csv")).alias("name"), F.concat(head, F.array_join("x", "\n"), F.lit("\n")).alias("content"))


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the session's scratch folder."""
    folder = scratch(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, files: DataFrame, name: str) -> str:
    """Write rows (name, content) as files of a new folder; its path."""
    path = new_folder(spark, name)
    write_files(files, path)
    return path


def with_views(*names: str, more: str = "") -> str:
    """The WITH clause that defines these views (and more CTEs)."""
    return "WITH " + ",\n".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
