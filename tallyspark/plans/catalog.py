"""The registered queries: each operator on a canonical view, with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import accuracy, agreement, composition, effects, efficiency, hypothesis, listeners, quality, resampling, splitting, worklist
from ..sources import arrays, files, readers, store
from ..sources import bindings as B
from ..session import kept
from ..sources.bindings import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: engines differ in the last bits."""
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


PRED, PAIRS, UTTER, RATE, RESP = (with_views(n) for n in ("pred", "pairs", "utterances", "ratings", "responses"))
Q = lambda xs: ", ".join(f"'{x}'" for x in xs)


# --- projections and scalar functions


@query("norm_label", "SELECT event_id, lower(trim(event_type)) AS label FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE '  ' || upper(event_type) || ' ' END AS event_type FROM events)")
def _(s, d):
    e = B.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("t"))
    return e.select("event_id", L.normalise("t").alias("label"))


_MAP_CASE = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v[0]}'" for k, v in L.LABEL_MAP.items()) + " END"
_ACTION = f"CASE WHEN x = '' THEN 'unknown' WHEN x IN ({Q(L.EMOTIONS)}) THEN 'valid' WHEN x = 'unknown' THEN 'retry' WHEN x IN ({Q(L.LABEL_MAP)}) THEN 'mapped' ELSE 'unknown' END"


@query("map_label", RESP + f"SELECT emotion, {_ACTION} AS action, CASE WHEN x IN ({Q(L.EMOTIONS)}) THEN x ELSE {_MAP_CASE} END AS mapped, count(*) AS n FROM (SELECT emotion, lower(trim(emotion)) AS x FROM responses) GROUP BY ALL")
def _(s, d):
    return B.responses(s, d).groupBy("emotion", L.label_action("emotion").alias("action"), L.mapped_label("emotion").alias("mapped")).agg(F.count("*").alias("n"))


@query("mapping_stats", f"SELECT target, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n FROM (VALUES {', '.join(f"('{k}', '{v[0]}')" for k, v in L.LABEL_MAP.items())}) t(source, target) GROUP BY target")
def _(s, d):
    return quality.mapping_stats(s)


def _sql_count(words, text="lower(utterance)"):
    return " + ".join(f"contains({text}, '{w}')::int" for w in words)


_VALENCE = f"CASE WHEN ({_sql_count(L.POSITIVE)}) > ({_sql_count(L.NEGATIVE)}) THEN 'positive' WHEN ({_sql_count(L.NEGATIVE)}) > ({_sql_count(L.POSITIVE)}) THEN 'negative' ELSE 'neutral' END"


@query("utterance_valence", UTTER + f"SELECT scenario_id, ({_sql_count(L.POSITIVE)}) AS n_positive, ({_sql_count(L.NEGATIVE)}) AS n_negative, {_VALENCE} AS valence FROM utterances")
def _(s, d):
    p, n = L.marker_counts("utterance")
    return B.utterances(s, d).select("scenario_id", p.alias("n_positive"), n.alias("n_negative"), L.valence("utterance").alias("valence"))


def _power_sql(vocabulary, s="speaker_role", o="listener_role"):
    high, low = L.ROLE_WORDS[vocabulary]
    has = lambda c, ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
    sh, sl, oh, ol = has(s, high), has(s, low), has(o, high), has(o, low)
    if vocabulary == "gold":
        return f"CASE WHEN {sh} AND {ol} THEN 'higher_to_lower' WHEN {sl} AND {oh} THEN 'lower_to_higher' WHEN {sh} AND NOT {oh} THEN 'higher_to_lower' WHEN {oh} AND NOT {sh} THEN 'lower_to_higher' ELSE 'peer' END"
    return f"CASE WHEN {sl} AND {oh} THEN 'lower_to_higher' WHEN {sh} AND {ol} THEN 'higher_to_lower' ELSE 'peer' END"


for _name, _vocabulary in (("power_gold", "gold"), ("power_rsa", "rsa"), ("power_eff", "efficiency"), ("power_comp", "composition")):

    @query(_name, UTTER + f"SELECT speaker_role, listener_role, {_power_sql(_vocabulary)} AS power_relation, count(*) AS n FROM utterances GROUP BY ALL")
    def _(s, d, v=_vocabulary):
        return B.utterances(s, d).groupBy("speaker_role", "listener_role", L.power_relation("speaker_role", "listener_role", v).alias("power_relation")).agg(F.count("*").alias("n"))


_FIELD = "CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(o, '$.{0}') AS double), 0) ELSE 0 END AS {0}"
_BADNUM = " OR ".join(f"(json_extract_string(o, '$.{f}') IS NOT NULL AND TRY_CAST(json_extract_string(o, '$.{f}') AS double) IS NULL)" for f in ("valence", "arousal", "dominance"))


@query("parse_response", r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"emotion": "joy", "valence": ' || round(value, 2)::varchar || '}' || chr(10) || '```'
  WHEN 1 THEN '{"a": {"emotion": "fear"}}' WHEN 2 THEN props ELSE '{"emotion": "trust", "valence": "high"}' END AS t FROM events),
f AS (SELECT event_id, t, regexp_extract(t, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1) AS f FROM t),
o AS (SELECT event_id, regexp_extract(CASE WHEN f <> '' THEN f ELSE trim(t) END, '(?s)(\{[^{}]*\})', 1) AS o FROM f),
v AS (SELECT event_id, o, o <> '' AND json_valid(o) AND NOT (""" + _BADNUM + ") AS ok FROM o) SELECT event_id, CASE WHEN ok THEN coalesce(json_extract_string(o, '$.subtype'), json_extract_string(o, '$.emotion'), 'unknown') ELSE 'unknown' END AS subtype, CASE WHEN ok THEN coalesce(json_extract_string(o, '$.emotion'), 'unknown') ELSE 'unknown' END AS emotion, " + ", ".join(_FIELD.format(f) for f in ("valence", "arousal", "dominance")) + ", CASE WHEN ok THEN TRY_CAST(json_extract_string(o, '$.confidence') AS double) END AS confidence FROM v")
def _(s, d):
    rows = B.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('Sure:\n```json\n{"emotion": "joy", "valence": '), F.round("value", 2).cast("string"), F.lit("}\n```"))).when(F.col("event_id") % 4 == 1, F.lit('{"a": {"emotion": "fear"}}')).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.lit('{"emotion": "trust", "valence": "high"}')).alias("t"))
    return rows.select("event_id", L.parsed_response("t").alias("r")).select("event_id", "r.*")


def _render_sql(t):
    out = "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, c in (("situation", "scenario_id"), ("speaker_role", "speaker_role"), ("listener_role", "listener_role"), ("utterance", "utterance")):
        out = f"replace({out}, '{{{name}}}', {c})"
    return out


def _scenarios(s, d):
    return B.utterances(s, d).withColumn("situation", F.col("scenario_id"))


@query("render_prompt", UTTER + f"SELECT scenario_id, {_render_sql(composition.PROMPTS['plain'])} AS prompt FROM utterances")
def _(s, d):
    return composition.rendered_prompts(_scenarios(s, d))


@query("prompt_fanout", UTTER + " UNION ALL ".join(f"SELECT scenario_id, '{k}' AS intervention, sha256({_render_sql(t)}) AS digest FROM utterances" for k, t in composition.PROMPTS.items()))
def _(s, d):
    return composition.prompt_fanout(_scenarios(s, d)).select("scenario_id", "intervention", F.sha2("prompt", 256).alias("digest"))


@query("prompt_hash", "SELECT doc_id AS id, sha256(text) AS prompt_hash FROM documents")
def _(s, d):
    return B.prompts(s, d).select("id", L.prompt_hash("text").alias("prompt_hash"))


@query("cache_path", "SELECT doc_id AS id, replace(replace(source || '/v' || lang, '/', '_'), chr(92), '_') || '/scenario_' || doc_id::varchar || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_INT-' || (doc_id % 3)::varchar END || CASE WHEN doc_id % 2 = 0 THEN '_' || substr(sha256(text), 1, 8) ELSE '' END || '.json' AS path FROM documents")
def _(s, d):
    t = B.table(s, d, "documents")
    i = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("INT-"), (F.col("doc_id") % 3).cast("string")))
    return t.select(F.col("doc_id").alias("id"), L.cache_path(F.concat("source", F.lit("/v"), "lang"), "doc_id", i, F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256))).alias("path"))


@query("scenario_type", UTTER + "SELECT scenario_id, CASE WHEN contains(scenario_id, '_') THEN regexp_extract(scenario_id, '^(.*)_[^_]*$', 1) ELSE 'unknown' END AS scenario_type FROM utterances")
def _(s, d):
    return B.utterances(s, d).select("scenario_id", L.scenario_type("scenario_id").alias("scenario_type"))


@query("effect_band", PRED + "SELECT model_id, round(avg(confidence) - 0.1, 6) AS d, CASE WHEN abs(avg(confidence) - 0.1) < 0.2 THEN 'negligible' WHEN abs(avg(confidence) - 0.1) < 0.5 THEN 'small' WHEN abs(avg(confidence) - 0.1) < 0.8 THEN 'medium' ELSE 'large' END AS band FROM pred GROUP BY model_id")
def _(s, d):
    return B.predictions(s, d).groupBy("model_id").agg((F.avg("confidence") - 0.1).alias("d")).withColumn("band", L.effect_band("d"))


@query("kappa_band", "SELECT x::double / 20 - 0.2 AS k, CASE WHEN x < 4 THEN 'poor' WHEN x < 8 THEN 'slight' WHEN x < 12 THEN 'fair' WHEN x < 16 THEN 'moderate' WHEN x < 20 THEN 'substantial' ELSE 'almost perfect' END AS band FROM range(0, 25) t(x) WHERE x % 4 <> 0")
def _(s, d):
    return s.range(25).where("id % 4 <> 0").select((F.col("id") / 20.0 - 0.2).alias("k")).withColumn("band", L.kappa_band("k"))


def _band_sql(x, cuts, names):
    return "CASE " + " ".join(f"WHEN {x} < {c} THEN '{n}'" for c, n in zip(cuts, names)) + f" ELSE '{names[-1]}' END"


_SIZES = ("negligible", "small", "medium", "large")


@query("bands", f"SELECT x, {_band_sql('x', (0.1, 0.3, 0.5), _SIZES)} AS v, {_band_sql('x', (0.3, 0.5), _SIZES[1:])} AS v_bias, {_band_sql('abs(x - 0.5)', (0.3, 0.6), ('weak', 'moderate', 'strong'))} || CASE WHEN x > 0.5 THEN ' positive' ELSE ' negative' END AS correlation, {_band_sql('x', (0.001, 0.01, 0.05), ('***', '**', '*', ''))} AS stars, {_band_sql('x', (0.05, 0.15), ('well calibrated', 'moderately calibrated', 'poorly calibrated'))} AS ece, CASE WHEN x > 0.5::double + 0.1 THEN 'literal' WHEN 0.5 > x + 0.1::double THEN 'pragmatic' ELSE 'mixed' END AS listener, {_band_sql('x', (0.147, 0.33, 0.474), _SIZES)} AS delta FROM (SELECT i / 100.0::double AS x FROM range(0, 101) t(i))")
def _(s, d):
    x = s.range(101).select((F.col("id") / 100.0).alias("x"))
    return x.select("x", L.v_band("x").alias("v"), L.v_band("x", "bias").alias("v_bias"), L.correlation_band(F.col("x") - 0.5).alias("correlation"), L.p_stars("x").alias("stars"), L.ece_band("x").alias("ece"), L.listener_band("x", F.lit(0.5)).alias("listener"), L.effect_band("x", "delta").alias("delta"))


@query("backoff", "SELECT a::int AS attempt, greatest(0.1::double, least(2.0::double * pow(2.0::double, a), 60.0::double)) AS delay FROM range(0, 10) t(a)")
def _(s, d):
    return s.range(10).select(F.col("id").cast("int").alias("attempt")).withColumn("delay", L.backoff("attempt"))


_PROVIDER = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(m), '{w}')" for w in ws)} THEN '{p}'" for p, ws in L.PROVIDERS) + " ELSE 'mock' END"
_LIMIT = "CASE p " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.PROVIDER_LIMITS.items()) + f" ELSE {L.DEFAULT_LIMIT} END"
_MODELS = ("GPT-x", "o1-y", "Claude-z", "gemini-q", "grok-w", "accounts/fireworks/a", "QwEn-b", "meta-llama/c", "google/gemma-d", "other")


@query("provider", f"SELECT m AS model, p AS provider, {_LIMIT} AS at_once, n FROM (SELECT m, {_PROVIDER} AS p, n FROM (SELECT CASE user_id % 10 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS))} END AS m, count(*) AS n FROM events GROUP BY 1))")
def _(s, d):
    m = F.element_at(F.array(*[F.lit(x) for x in _MODELS]), (F.col("user_id") % 10 + 1).cast("int"))
    g = B.table(s, d, "events").groupBy(m.alias("model")).agg(F.count("*").alias("n")).withColumn("provider", L.provider("model"))
    return g.select("model", "provider", L.provider_limit("provider").alias("at_once"), "n")


@query("sentiment_band", "SELECT CASE WHEN c >= 0.5 THEN 'joy' WHEN c >= 0.1 THEN 'trust' WHEN c <= -0.5 THEN 'anger' WHEN c <= -0.1 THEN 'sadness' ELSE 'anticipation' END AS emotion, count(*) AS n, round(sum(abs(c)), 6) AS arousal FROM (SELECT c_acctbal / 10000 AS c FROM customer) GROUP BY 1")
def _(s, d):
    c = B.table(s, d, "customer").select((F.col("c_acctbal") / 10000).alias("c"))
    return c.groupBy(L.sentiment_band("c").alias("emotion")).agg(F.count("*").alias("n"), F.sum(F.abs("c")).alias("arousal"))


@query("cost_estimate", "SELECT plan, (m * s * (1 + v) + e * m)::bigint AS calls, round((m * s * (1 + v) + e * m) * 0.0008::double, 6) AS cost FROM (SELECT s_nationkey::varchar AS plan, count(*) AS m, 300 AS s, s_nationkey % 5 AS v, 600 * (s_nationkey % 2) AS e FROM supplier GROUP BY s_nationkey)")
def _(s, d):
    c = B.table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("models"))
    return worklist.cost_estimate(c.select(F.col("s_nationkey").cast("string").alias("plan"), "models", F.lit(300).alias("scenarios"), (F.col("s_nationkey") % 5).alias("variants"), (600 * (F.col("s_nationkey") % 2)).alias("extra")))


# --- joins


@query("join_gold", "SELECT l_returnflag AS predicted, o_orderstatus AS gold, (lower(CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' END) IS NOT DISTINCT FROM lower(o_orderstatus))::int AS correct, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(s, d):
    p = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_returnflag"), F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").alias("predicted"))
    g = B.table(s, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderstatus").alias("gold"))
    return accuracy.score(p, g).groupBy(F.col("l_returnflag").alias("predicted"), "gold", "correct").agg(F.count("*").alias("n"))


@query("scored_predictions", RESP + f"SELECT model_id, predicted, gold, count(*) AS n FROM (SELECT model_id, lower(emotion) AS predicted, lower(coalesce(g, CASE WHEN confidence > 0.5 THEN 'Fear' END)) AS gold FROM responses LEFT JOIN (SELECT 's' || o_orderkey::varchar AS sid, lower(trim(o_orderpriority)) AS g FROM orders WHERE o_orderstatus <> 'F') ON scenario_id = sid WHERE valence < 1 AND emotion IS NOT NULL) WHERE predicted <> '' AND gold <> '' GROUP BY ALL")
def _(s, d):
    r = B.responses(s, d).withColumn("success", F.col("valence") < 1).withColumn("gold_emotion", F.when(F.col("confidence") > 0.5, "Fear"))
    g = B.table(s, d, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("scenario_id"), F.col("o_orderpriority").alias("gold"))
    return accuracy.scored_predictions(r, g).groupBy("model_id", "predicted", "gold").agg(F.count("*").alias("n"))


@query("zip_join", "SELECT a.doc_id AS doc_id, b.o_orderkey AS o_orderkey, a.r::bigint AS position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) b ON a.r = b.r")
def _(s, d):
    return accuracy.zip_join(B.table(s, d, "documents").select("doc_id"), B.table(s, d, "orders").select("o_orderkey"), ["doc_id"], ["o_orderkey"]).select("doc_id", "o_orderkey", F.col("position").cast("bigint").alias("position"))


def _models(s, d):
    return B.table(s, d, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 4).cast("string")).alias("model_id"))


@query("work_list", "SELECT model_id, doc_id AS scenario_id FROM (SELECT DISTINCT 'm' || (s_suppkey % 4)::varchar AS model_id FROM supplier), documents")
def _(s, d):
    return worklist.work_list(_models(s, d), B.table(s, d, "documents").select(F.col("doc_id").alias("scenario_id")))


_DONE = "SELECT 'm' || (doc_id % 4)::varchar AS model_id, doc_id AS scenario_id FROM labels"


@query("pending_work", f"SELECT model_id, doc_id AS scenario_id FROM (SELECT DISTINCT 'm' || (s_suppkey % 4)::varchar AS model_id FROM supplier), documents WHERE (model_id, doc_id) NOT IN ({_DONE})")
def _(s, d):
    done = B.table(s, d, "labels").select(F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("model_id"), F.col("doc_id").alias("scenario_id"))
    return worklist.pending(worklist.work_list(_models(s, d), B.table(s, d, "documents").select(F.col("doc_id").alias("scenario_id"))), done)


def _work(s, d):
    return B.table(s, d, "documents").select(F.col("source").alias("model_id"), F.col("doc_id").alias("scenario_id"), F.when(F.col("doc_id") % 2 == 0, "INT-2").alias("intervention"), F.sha2("text", 256).alias("prompt_hash"))


def _cache(s, d):
    keys = B.table(s, d, "labels").select(F.col("doc_id").alias("scenario_id"), F.col("quality").cast("string").alias("response"))
    return _work(s, d).join(keys, "scenario_id")


_PROBE = """w AS (SELECT source AS model_id, doc_id AS scenario_id, CASE WHEN doc_id % 2 = 0 THEN 'INT-2' END AS intervention, sha256(text) AS prompt_hash FROM documents),
c AS (SELECT w.*, quality::varchar AS response FROM w JOIN labels ON scenario_id = doc_id),
p AS (SELECT w.*, c.scenario_id IS NOT NULL AS hit, c.response FROM w LEFT JOIN c ON w.model_id IS NOT DISTINCT FROM c.model_id AND w.scenario_id IS NOT DISTINCT FROM c.scenario_id AND w.intervention IS NOT DISTINCT FROM c.intervention AND w.prompt_hash IS NOT DISTINCT FROM c.prompt_hash)
"""


@query("cache_probe", "WITH " + _PROBE + "SELECT * FROM p")
def _(s, d):
    return worklist.probe(_work(s, d), _cache(s, d))


@query("cache_stats", "WITH " + _PROBE + "SELECT sum(hit::int)::bigint AS hits, sum((NOT hit)::int)::bigint AS misses, round(avg(hit::int), 6) AS hit_rate, round(avg(hit::int) * 100, 6) AS saved_percent FROM p")
def _(s, d):
    return worklist.cache_stats(worklist.probe(_work(s, d), _cache(s, d)))


@query("cache_entries", "WITH " + _PROBE + "SELECT model_id, count(*) AS entries, count(DISTINCT scenario_id) AS scenarios FROM c GROUP BY model_id")
def _(s, d):
    return worklist.cache_entries(_cache(s, d))


def _versions(s, d, odd):
    e = B.table(s, d, "events").where(F.col("event_id") % 2 == int(odd))
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"), (F.col("event_id") % 300).alias("scenario_id"), F.when(F.col("event_id") % 3 == 0, "INT-3").alias("intervention"), F.lit(None).cast("string").alias("prompt_hash"), F.col("ts").alias("cached_at"), F.col("event_type").alias("response"))


_LATEST = "SELECT model_id, scenario_id, intervention, NULL::varchar AS prompt_hash, epoch_us(cached_at) AS cached_at, response FROM (SELECT 'm' || (user_id % 5)::varchar AS model_id, event_id % 300 AS scenario_id, CASE WHEN event_id % 3 = 0 THEN 'INT-3' END AS intervention, ts AS cached_at, event_type AS response FROM events) QUALIFY row_number() OVER (PARTITION BY model_id, scenario_id, intervention ORDER BY cached_at DESC, response DESC) = 1"


@query("cache_upsert", _LATEST)
def _(s, d):
    return worklist.upsert(_versions(s, d, False), _versions(s, d, True)).withColumn("cached_at", F.unix_micros(F.col("cached_at").cast("timestamp")))


def _cache_store(s, d):
    """The cache stored in versions: the even events, then the odd ones in two upserts."""
    folder, odd = B.new_folder(s, "cache"), _versions(s, d, True)
    for part in (_versions(s, d, False), odd.where("scenario_id < 100"), odd.where("scenario_id >= 100")):
        store.upsert(part, folder, worklist.upsert, list(worklist.KEY))
    return folder


@query("cache_store", _LATEST)
def _(s, d):
    return store.read(s, _cache_store(s, d)).withColumn("cached_at", F.unix_micros(F.col("cached_at").cast("timestamp")))


@query("cache_store_lookup", "SELECT l.* FROM (" + _LATEST + ") l SEMI JOIN (SELECT 'm' || (l_suppkey % 5)::varchar AS model_id, l_orderkey % 400 AS scenario_id, CASE WHEN l_linenumber = 1 THEN 'INT-3' END AS intervention FROM lineitem) w ON l.model_id = w.model_id AND l.scenario_id = w.scenario_id AND l.intervention IS NOT DISTINCT FROM w.intervention")
def _(s, d):
    wanted = B.table(s, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model_id"), (F.col("l_orderkey") % 400).alias("scenario_id"), F.when(F.col("l_linenumber") == 1, "INT-3").alias("intervention"), F.lit(None).cast("string").alias("prompt_hash"))
    return store.lookup(wanted, _cache_store(s, d)).withColumn("cached_at", F.unix_micros(F.col("cached_at").cast("timestamp")))


@query("repair_join", RESP + "SELECT m.scenario_id, m.model_id, r.scenario_id IS NOT NULL AS found, count(*) AS n FROM (SELECT 's' || (o_orderkey % 1100)::varchar AS scenario_id, 'm' || (o_orderkey % 8)::varchar AS model_id FROM orders) m LEFT JOIN (SELECT DISTINCT scenario_id, model_id FROM responses) r USING (scenario_id, model_id) GROUP BY ALL")
def _(s, d):
    m = B.table(s, d, "orders").select(F.concat(F.lit("s"), (F.col("o_orderkey") % 1100).cast("string")).alias("scenario_id"), F.concat(F.lit("m"), (F.col("o_orderkey") % 8).cast("string")).alias("model_id"))
    return quality.repair_join(m, B.responses(s, d)).groupBy("scenario_id", "model_id", "found").agg(F.count("*").alias("n"))


_CLASS = RATE.rstrip() + """,
cc AS (SELECT subject, max(n) AS most, sum(n) AS raters FROM (SELECT subject, cat, count(*) AS n FROM ratings GROUP BY ALL) GROUP BY subject),
cls AS (SELECT subject, CASE WHEN most = raters THEN 'full' WHEN most > 1 THEN 'partial' ELSE 'none' END AS agreement, CASE WHEN most = raters THEN 100 WHEN most > 1 THEN 50 ELSE 0 END AS percent FROM cc)
"""


@query("quadrant", _CLASS.replace("WITH ", "WITH " + B.SQL["pred"] + ",\n", 1) + "SELECT subtype, CASE WHEN percent >= 50 THEN 'easy for humans' ELSE 'hard for humans' END || CASE WHEN coalesce(acc, 50) >= 50 THEN ', easy for models' ELSE ', hard for models' END AS quadrant, count(*) AS n FROM cls JOIN strata ON subject = id LEFT JOIN (SELECT subtype, avg(correct) * 100 AS acc FROM pred WHERE subtype <> '1-URGENT' GROUP BY subtype) USING (subtype) GROUP BY ALL".replace("strata", "(SELECT o_orderkey AS id, o_orderpriority AS subtype FROM orders)"))
def _(s, d):
    acc = accuracy.accuracy_by(B.predictions(s, d).where("subtype <> '1-URGENT'"), "subtype")
    return efficiency.quadrant(acc, agreement.agreement_class(B.ratings(s, d)).join(B.strata(s, d).withColumnRenamed("id", "subject"), "subject"))


# --- aggregations


@query("accuracy_gsets", PRED + "SELECT grouping(model_id, subtype, power_relation)::bigint AS gset, model_id, subtype, power_relation, count(*) AS total, sum(correct)::bigint AS n_correct, round(avg(correct), 6) AS accuracy FROM pred GROUP BY GROUPING SETS ((model_id), (subtype), (power_relation), ())")
def accuracy_gsets(s, d):
    return accuracy.accuracy_sets(B.predictions(s, d))


@query("accuracy_by_model", PRED + "SELECT model_id, count(*) AS total, sum(correct)::bigint AS n_correct, round(avg(correct), 6) AS accuracy FROM pred GROUP BY model_id")
def _(s, d):
    return accuracy.accuracy_by(B.predictions(s, d), "model_id")


@query("confusion", PRED + ", c AS (SELECT gold, predicted, count(*) AS n, (sum(count(*)) OVER ())::bigint AS all_predictions FROM pred GROUP BY ALL) SELECT gold, predicted, n, (sum(n) OVER (PARTITION BY gold))::bigint AS gold_total, round(sum(CASE WHEN gold = predicted THEN n ELSE 0 END) OVER (PARTITION BY gold) / sum(n) OVER (PARTITION BY gold), 6) AS gold_accuracy, all_predictions FROM c WHERE gold IN ('F', 'O') AND predicted IN ('F', 'O')")
def _(s, d):
    return accuracy.confusion(B.predictions(s, d), ("F", "O"))


@query("confusion_all", PRED + "SELECT coalesce(gold, 'unknown') AS gold, coalesce(predicted, 'unknown') AS predicted, count(*) AS n FROM pred GROUP BY 1, 2")
def _(s, d):
    return accuracy.confusion_all(B.predictions(s, d))


@query("confusion_pct", PRED + "SELECT gold, predicted, round(count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY gold), 6) AS pct FROM pred GROUP BY gold, predicted")
def _(s, d):
    return accuracy.confusion_percent(accuracy.confusion_all(B.predictions(s, d)))


@query("label_dist", PRED + "SELECT 'subtype' AS dimension, subtype AS value, count(*) AS n FROM pred GROUP BY 2 UNION ALL SELECT 'power_relation', power_relation, count(*) FROM pred GROUP BY 2 UNION ALL SELECT 'gold', gold, count(*) FROM pred GROUP BY 2")
def _(s, d):
    return accuracy.label_distribution(B.predictions(s, d), ("subtype", "power_relation", "gold"))


@query("agreement_rate", RATE + "SELECT count(*) AS subjects, sum((most >= 0.5 * raters)::int)::bigint AS agreeing, round(avg((most >= 0.5 * raters)::int), 6) AS agreement_rate FROM (SELECT subject, max(n) AS most, sum(n) AS raters FROM (SELECT subject, cat, count(*) AS n FROM ratings GROUP BY ALL) GROUP BY subject) WHERE raters >= 2")
def _(s, d):
    return agreement.agreement_rate(B.ratings(s, d))


@query("agreement_class", _CLASS + "SELECT subject, agreement, percent FROM cls")
def _(s, d):
    return agreement.agreement_class(B.ratings(s, d))


@query("majority_vote", RATE + "SELECT subject, cat AS label, n AS votes FROM (SELECT subject, cat, count(*) AS n FROM ratings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, cat) = 1")
def _(s, d):
    return agreement.majority_vote(B.ratings(s, d))


def _errors_sql(where="responses"):
    fields = ("subtype", "emotion", "valence", "arousal", "dominance")
    parts = [f"SELECT scenario_id, model_id, 'schema_missing_field' AS error_type, 'medium' AS severity, '{f}' AS field, NULL::varchar AS actual FROM {where} WHERE {f} IS NULL" for f in fields]
    parts += [f"SELECT scenario_id, model_id, 'invalid_{f}', 'medium', '{f}', {f} FROM {where} WHERE {f} <> '' AND {f} NOT IN ({Q(ok)})" for f, ok in (("subtype", L.SUBTYPES), ("emotion", L.EMOTIONS))]
    parts += [f"SELECT scenario_id, model_id, 'vad_out_of_range', 'medium', '{f}', NULL FROM {where} WHERE NOT {f} BETWEEN -1 AND 1" for f in fields[2:]]
    parts.append(f"SELECT scenario_id, model_id, 'confidence_out_of_range', 'low', 'confidence', NULL FROM {where} WHERE NOT confidence BETWEEN 0 AND 1")
    return " UNION ALL ".join(parts)


@query("qa_validate", RESP + f"SELECT scenario_id, model_id, error_type, severity, field, count(*) AS n FROM ({_errors_sql()}) GROUP BY ALL")
def _(s, d):
    return quality.errors_by(quality.validate(B.responses(s, d)), "scenario_id", "model_id", "error_type", "severity", "field")


_BAD = f"(subtype IS NULL OR dominance IS NULL OR emotion IS NULL OR valence IS NULL OR (subtype <> '' AND subtype NOT IN ({Q(L.SUBTYPES)})) OR (emotion <> '' AND emotion NOT IN ({Q(L.EMOTIONS)})) OR NOT valence BETWEEN -1 AND 1 OR NOT confidence BETWEEN 0 AND 1)"


@query("qa_summary", RESP + f"SELECT count(*) AS total, sum((NOT {_BAD})::int)::bigint AS valid, sum({_BAD}::int)::bigint AS invalid, round(avg({_BAD}::int) * 100, 6) AS error_rate, CASE WHEN avg({_BAD}::int) * 100 > 5 THEN 'FAILED' ELSE 'PASSED' END AS status FROM responses")
def _(s, d):
    return quality.summary(B.responses(s, d))


@query("qa_model_rate", RESP + f"SELECT model_id, total, coalesce(errors, 0) AS errors, round(coalesce(errors, 0) * 100.0::double / total, 6) AS rate, coalesce(errors, 0) * 100.0 / total > 10 AS warns FROM (SELECT model_id, count(*) AS total FROM responses GROUP BY 1) LEFT JOIN (SELECT model_id, count(*) AS errors FROM ({_errors_sql()}) GROUP BY 1) USING (model_id)")
def _(s, d):
    r = B.responses(s, d)
    return quality.model_rates(r, quality.validate(r))


@query("model_error_share", RESP + f"SELECT model_id, errors, share::bigint AS share, round(errors * 1.0::double / share, 6) AS rate FROM (SELECT model_id, count(*) AS errors, floor((SELECT count(*) FROM responses) / count(*) OVER ()) AS share FROM ({_errors_sql()}) GROUP BY model_id)")
def _(s, d):
    r = B.responses(s, d)
    return quality.model_error_share(quality.validate(r), r.agg(F.count("*").alias("total")))


@query("repair", RESP + f"SELECT scenario_id, model_id, emotion AS original_emotion, CASE WHEN x IN ({Q(L.EMOTIONS)}) THEN x ELSE coalesce({_MAP_CASE}, emotion) END AS emotion, {_ACTION} AS repair_action, count(*) AS n FROM (SELECT *, lower(trim(emotion)) AS x FROM responses) GROUP BY ALL")
def _(s, d):
    return quality.repair(B.responses(s, d)).groupBy("scenario_id", "model_id", "original_emotion", "emotion", "repair_action").agg(F.count("*").alias("n"))


@query("repair_counts", RESP + f"SELECT model_id, {', '.join(f"sum((a = '{a}')::int)::bigint AS n_{a}" for a in ('valid', 'mapped', 'retry', 'unknown'))} FROM (SELECT DISTINCT scenario_id, model_id, {_ACTION} AS a FROM (SELECT *, lower(trim(emotion)) AS x FROM responses)) GROUP BY model_id")
def _(s, d):
    return quality.repair_counts(quality.repair(B.responses(s, d)))


@query("repair_rate", RESP + f"SELECT count(*) AS total, sum(ok::int)::bigint AS usable, round((count(*) - sum(ok::int)) * 100.0::double / count(*), 6) AS post_repair_rate, CASE WHEN (count(*) - sum(ok::int)) * 100.0 / count(*) <= 5 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT ({_ACTION}) IN ('valid', 'mapped') AS ok FROM (SELECT lower(trim(emotion)) AS x FROM responses))")
def _(s, d):
    return quality.repair_rate(quality.repair(B.responses(s, d)))


_CALLS = with_views("calls")


@query("progress", _CALLS + "SELECT model_id, count(*) AS processed, round(count(*) * 100.0::double / 200, 6) AS percent, round(sum(1 - failed) / count(*), 6) AS parse_rate, 200 - count(*) AS remaining FROM calls GROUP BY model_id")
def _(s, d):
    return worklist.progress(B.calls(s, d), 200)


@query("milestones", _CALLS + "SELECT model_id, milestone, min(seq) AS seq FROM (SELECT model_id, seq, floor(row_number() OVER (PARTITION BY model_id ORDER BY seq) / 10.0)::bigint AS milestone FROM calls) WHERE milestone > 0 GROUP BY ALL")
def _(s, d):
    return worklist.milestones(B.calls(s, d), 200)


@query("manifest_totals", _CALLS + "SELECT count(*) AS total, count_if(failed = 0)::bigint AS successful, count_if(failed = 1)::bigint AS failed FROM calls")
def _(s, d):
    return worklist.manifest_totals(B.calls(s, d))


@query("retry_rate", _CALLS + "SELECT count(*) AS total, sum(1 - failed)::bigint AS successful, round(sum(1 - failed) * 100.0::double / count(*), 6) AS success_rate FROM calls")
def _(s, d):
    return worklist.success_rate(B.calls(s, d))


_STRATIFIED = PRED + "SELECT grouping(power_relation, subtype)::bigint AS gset, power_relation, subtype, count(*) AS n, round(avg(correct), 6) AS accuracy FROM pred GROUP BY GROUPING SETS ((power_relation), (power_relation, subtype), ())"


@query("power_stratified", _STRATIFIED)
def _(s, d):
    return efficiency.power_stratified(B.predictions(s, d)).select("gset", "power_relation", "subtype", "n", "accuracy")


@query("power_comparisons")
def _(s, d):
    return efficiency.power_comparisons(B.predictions(s, d))


@query("top_models", PRED + "SELECT model_id, count(*) AS total, sum(correct)::bigint AS n_correct, round(avg(correct), 6) AS accuracy FROM pred GROUP BY model_id ORDER BY avg(correct) DESC, model_id LIMIT 3")
def _(s, d):
    return accuracy.top_models(B.predictions(s, d), 3)


# --- hypothesis tests and effects

_GRID = """, cells AS (SELECT subtype AS x, power_relation AS y, count(*) AS o FROM pred GROUP BY ALL), mx AS (SELECT x, sum(o) AS nx FROM cells GROUP BY x), my AS (SELECT y, sum(o) AS ny FROM cells GROUP BY y),
g AS (SELECT coalesce(o, 0) AS o, nx::double * ny / (SELECT sum(o) FROM cells) AS e FROM mx CROSS JOIN my LEFT JOIN cells USING (x, y)), k AS (SELECT (SELECT count(*) FROM mx) AS r, (SELECT count(*) FROM my) AS c, (SELECT sum(o) FROM cells)::bigint AS n)
"""


@query("chi2_contingency", PRED + _GRID + "SELECT max(n) AS n, max((r - 1) * (c - 1)) AS df, round(sum(pow(abs(o - e) - CASE WHEN (r - 1) * (c - 1) = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 6) AS chi2, round(sqrt(sum(pow(abs(o - e) - CASE WHEN (r - 1) * (c - 1) = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) / (max(n) * max(least(r, c) - 1))), 6) AS v FROM g, k")
def _(s, d):
    return hypothesis.chi2_contingency(B.predictions(s, d), "subtype", "power_relation")


@query("chi2_yates", PAIRS + ", cells AS (SELECT base AS x, treat AS y, count(*) AS o FROM pairs GROUP BY ALL), mx AS (SELECT x, sum(o) AS nx FROM cells GROUP BY x), my AS (SELECT y, sum(o) AS ny FROM cells GROUP BY y), g AS (SELECT coalesce(o, 0) AS o, nx::double * ny / (SELECT sum(o) FROM cells) AS e FROM mx CROSS JOIN my LEFT JOIN cells USING (x, y)) SELECT sum(o)::bigint AS n, 1::bigint AS df, round(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) AS chi2, round(sqrt(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) / sum(o)), 6) AS v FROM g")
def _(s, d):
    return hypothesis.chi2_contingency(B.pairs(s, d), "base", "treat")


_FIT = "SELECT sum(o)::double AS n, count(*) - 1 AS df, round(sum((o - e) * (o - e) / e), 6) AS chi2, round(sqrt(sum((o - e) * (o - e) / e) / sum(o)), 6) AS v FROM"


@query("chi2_gof", PRED + _FIT + " (SELECT count(*) AS o, avg(count(*)) OVER () AS e FROM pred GROUP BY subtype)")
def _(s, d):
    return hypothesis.chi2_fit(B.predictions(s, d).groupBy("subtype").agg(F.count("*").alias("observed")))


@query("chi2_bonf", PRED + "SELECT sum(o)::double AS n, count(*) - 1 AS df, round(sum((o - e) * (o - e) / e), 6) AS chi2, round(sqrt(sum((o - e) * (o - e) / e) / (sum(o) * (count(*) - 1))), 6) AS v, round(0.05::double / 3, 6) AS alpha_corrected FROM (SELECT o, e * sum(o) OVER () / sum(e) OVER () AS e FROM (SELECT count(*) AS o, sum(confidence) AS e FROM pred GROUP BY subtype))")
def _(s, d):
    return hypothesis.chi2_bonferroni(B.predictions(s, d).groupBy("subtype").agg(F.count("*").alias("observed"), F.sum("confidence").alias("e")), "e", 3)


@query("bias_chi2", PRED + "SELECT total_wrong, n, hits, round(n / 2.0, 6) AS expected_hits, round(chi, 6) AS chi2, round(sqrt(chi / n), 6) AS v, NULL::varchar AS error FROM (SELECT *, pow(hits - n / 2.0, 2) / (n / 2.0) + pow(n - hits - n / 2.0, 2) / (n / 2.0) AS chi FROM (SELECT count(*) AS total_wrong, count_if(gold <> 'F')::bigint AS n, count_if(gold <> 'F' AND predicted = 'F')::bigint AS hits FROM pred WHERE correct = 0))")
def _(s, d):
    return hypothesis.bias_test(B.predictions(s, d), "F", 3)


@query("bias_by_gold", PRED + "SELECT gold, count(*) AS wrong, sum((predicted = 'F')::int)::bigint AS hits, round(avg((predicted = 'F')::int), 6) AS rate FROM pred WHERE correct = 0 AND gold <> 'F' GROUP BY gold")
def _(s, d):
    return hypothesis.bias_by_gold(B.predictions(s, d), "F")


@query("group_diff", PRED + ", g AS (SELECT count(*) AS n, sum(correct) AS k FROM pred GROUP BY model_id), x AS (SELECT n, k, n * sum(k) OVER () / sum(n) OVER () AS e FROM g), c AS (SELECT count(*) AS groups, sum(n)::bigint AS total, sum(pow(k - e, 2) / e) AS chi FROM x) SELECT groups, total, round(chi, 6) AS chi, round(greatest(0.001, 1 - least(chi / (10 * (groups - 1)), 0.999)), 6) AS p_crude FROM c")
def _(s, d):
    return hypothesis.group_difference(B.predictions(s, d), "model_id")


@query("mcnemar", PAIRS + "SELECT n, b, c, round(pow(abs(b - c) - 1, 2) / (b + c), 6) AS chi2, round(improvement, 6) AS improvement FROM (SELECT count(*) AS n, count_if(base = 1 AND treat = 0)::bigint AS b, count_if(base = 0 AND treat = 1)::bigint AS c, avg(treat) - avg(base) AS improvement FROM pairs)")
def _(s, d):
    return hypothesis.mcnemar(B.pairs(s, d), "base", "treat")


_PV = with_views("pvalues")


@query("bonferroni", _PV + "SELECT id, round(p, 6) AS p, round(least(p * count(*) OVER (), 1), 6) AS p_adjusted, p < 0.05 / count(*) OVER () AS significant FROM pvalues")
def _(s, d):
    return hypothesis.bonferroni(B.p_values(s, d))


@query("bh_fdr", _PV + "SELECT id, round(p, 6) AS p, rank::int AS rank, round(least(min(p * m / rank) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS p_adjusted, least(min(p * m / rank) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) < 0.05 AS significant FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS rank FROM pvalues)")
def _(s, d):
    return hypothesis.benjamini_hochberg(B.p_values(s, d))


_MP = with_views("metric_pairs")


@query("pearson_spearman", _MP + "SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::double AS ry FROM metric_pairs)")
def _(s, d):
    return hypothesis.correlations(B.exact_metric_pairs(s, d))


@query("linreg", _MP + "SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, round(sqrt((1 - pow(corr(x, y), 2)) * regr_syy(y, x) / ((count(*) - 2) * regr_sxx(y, x))), 6) AS stderr FROM metric_pairs")
def _(s, d):
    return hypothesis.linear_regression(B.metric_pairs(s, d))


#: Sums of series in SQL: of the lower incomplete gamma function, and of the incomplete beta function of (1/2, a) at y.
_CHI2_P = "SELECT test, round(CASE WHEN df <= 0 THEN 1 WHEN x > 6000 THEN 0 ELSE greatest(0, 1 - (SELECT sum(exp(-x / 2 + (df / 2 + n) * ln(x / 2) - lgamma(df / 2 + n + 1))) FROM range(0, 4500) t(n))) END, 6) AS p_value FROM chi"
_R_P = "SELECT test, round(CASE WHEN a * y > 700 THEN 0 ELSE greatest(0, 1 - (SELECT sum(exp(0.5 * ln(y) + a * ln(1 - y) + lgamma(a + 0.5 + n) - lgamma(a) - lgamma(1.5 + n) + n * ln(y))) FROM range(0, 4500) t(n))) END, 6) AS p_value FROM cor"


def _oracle(name):
    return ORACLES[name].rstrip()


def _tests(s, d):
    """(test, p_value) of the test statistics."""
    # one pass over the predictions, one over the customers' pairs: each test is of these counts
    cells = kept(B.predictions(s, d).groupBy("subtype", "power_relation", "gold", "predicted", "correct").agg(F.count("*").alias("n")))
    pairs = kept(B.metric_pairs(s, d))
    fit = cells.groupBy("subtype").agg(F.sum("n").alias("observed"))
    chi = [("contingency", rounded(hypothesis.chi2_contingency(cells, "subtype", "power_relation", "n")).select("chi2", "df")), ("yates", QUERIES["chi2_yates"](s, d).select("chi2", "df")), ("fit", rounded(hypothesis.chi2_fit(fit)).select("chi2", "df"))]
    chi += [("bias", rounded(hypothesis.bias_test(cells, "F", 3, "n")).select("chi2", F.lit(1).alias("df"))), ("mcnemar", QUERIES["mcnemar"](s, d).select("chi2", F.lit(1).alias("df")))]
    out = hypothesis.with_correlation_p(rounded(hypothesis.correlations(pairs))).select(F.explode(F.array(F.struct(F.lit("pearson").alias("test"), F.col("pearson_p").alias("p_value")), F.struct(F.lit("spearman").alias("test"), F.col("spearman_p").alias("p_value")))).alias("x")).select("x.*")
    out = out.unionByName(hypothesis.with_slope_p(rounded(hypothesis.linear_regression(pairs))).select(F.lit("slope").alias("test"), "p_value"))
    for name, x in chi:
        out = out.unionByName(hypothesis.with_p(x).select(F.lit(name).alias("test"), "p_value"))
    return out


@query("test_p_values", "WITH chi AS (" + " UNION ALL ".join(f"SELECT '{t}' AS test, chi2::double AS x, {df}::double AS df FROM ({_oracle(q)})" for t, q, df in (("contingency", "chi2_contingency", "df"), ("yates", "chi2_yates", "df"), ("fit", "chi2_gof", "df"), ("bias", "bias_chi2", "1"), ("mcnemar", "mcnemar", "1"))) + "), cor AS (SELECT 'pearson' AS test, (n - 2) / 2.0::double AS a, pearson * pearson AS y FROM (" + _oracle("pearson_spearman") + ") UNION ALL SELECT 'spearman', (n - 2) / 2.0::double, spearman * spearman FROM (" + _oracle("pearson_spearman") + ") UNION ALL SELECT 'slope', (n - 2) / 2.0::double, pow(slope / stderr, 2) / (n - 2 + pow(slope / stderr, 2)) FROM (" + _oracle("linreg") + ")) " + _CHI2_P + " UNION ALL " + _R_P)
def _(s, d):
    return _tests(s, d)


@query("permutation")
def _(s, d):
    return hypothesis.permutation_binary(B.predictions(s, d), "power_relation", "correct", "peer", "lower_to_higher")


_TWO = "FROM (SELECT latency_ms AS v, power_relation AS g FROM pred WHERE power_relation IN ('peer', 'lower_to_higher'))"
_D = "(avg(v) FILTER (g = 'peer') - avg(v) FILTER (g <> 'peer'))"


def _pooled(f):
    na, nb = "count(*) FILTER (g = 'peer')", "count(*) FILTER (g <> 'peer')"
    return f"sqrt((({na} - 1) * {f}(v) FILTER (g = 'peer') + ({nb} - 1) * {f}(v) FILTER (g <> 'peer')) / ({na} + {nb} - 2))"


@query("cohens_d", PRED + f"SELECT count(*) FILTER (g = 'peer') AS n_a, count(*) FILTER (g <> 'peer') AS n_b, round({_D} / {_pooled('var_samp')}, 6) AS d {_TWO}")
def _(s, d):
    return effects.cohens_d(B.predictions(s, d), "power_relation", "latency_ms", "peer", "lower_to_higher")


@query("cohens_d_safe", PRED + "SELECT count_if(power_relation = 'peer')::bigint AS n_a, 0::bigint AS n_b, 0::double AS d FROM pred")
def _(s, d):
    return effects.cohens_d_safe(B.predictions(s, d), "power_relation", "latency_ms", "peer", "nobody")


@query("power_gap", PRED + f"SELECT n_a, n_b, round(gap, 6) AS gap, round(gap - 0.05, 6) AS ci_lower, round(gap + 0.05, 6) AS ci_upper, round(gap / sd, 6) AS d, round(gap / sd - 0.2, 6) AS d_lower, round(gap / sd + 0.2, 6) AS d_upper FROM (SELECT count(*) FILTER (g = 'peer') AS n_a, count(*) FILTER (g <> 'peer') AS n_b, {_D} AS gap, {_pooled('var_pop')} AS sd FROM (SELECT correct AS v, power_relation AS g FROM pred WHERE power_relation IN ('peer', 'lower_to_higher')))")
def _(s, d):
    return effects.power_gap(B.predictions(s, d))


@query("cliffs_delta", PRED + ", h AS (SELECT latency_ms AS v, count_if(power_relation = 'peer') AS na, count_if(power_relation = 'lower_to_higher') AS nb FROM pred WHERE power_relation <> 'higher_to_lower' GROUP BY 1), c AS (SELECT *, coalesce(sum(nb) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h) SELECT sum(na)::bigint AS n_a, sum(nb)::bigint AS n_b, round((sum(na::double * (2 * below + nb)) - sum(na)::double * sum(nb)) / (sum(na)::double * sum(nb)), 6) AS delta FROM c")
def _(s, d):
    return effects.cliffs_delta(B.predictions(s, d), "power_relation", "latency_ms", "peer", "lower_to_higher")


@query("paired_d", PAIRS + "SELECT count(*) AS n, round(avg(base - treat), 6) AS mean_diff, round(avg(base - treat) / stddev_samp(base - treat), 6) AS d FROM pairs")
def _(s, d):
    return effects.paired_d(B.pairs(s, d), "base", "treat")


# --- agreement


@query("fleiss", RATE + ", pc AS (SELECT subject, cat, count(*) AS n FROM ratings GROUP BY ALL), sj AS (SELECT subject, sum(n * n) AS sq FROM pc GROUP BY subject), o AS (SELECT count(*) AS subjects, avg((sq - 3) / 6.0::double) AS po FROM sj), e AS (SELECT sum(p * p) AS pe FROM (SELECT sum(n) / sum(sum(n)) OVER () AS p FROM pc GROUP BY cat)) SELECT subjects, 3::bigint AS raters, round(po, 6) AS p_observed, round(pe, 6) AS p_expected, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'poor' WHEN (po - pe) / (1 - pe) < 0.2 THEN 'slight' WHEN (po - pe) / (1 - pe) < 0.4 THEN 'fair' WHEN (po - pe) / (1 - pe) < 0.6 THEN 'moderate' WHEN (po - pe) / (1 - pe) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS interpretation FROM o, e")
def _(s, d):
    return agreement.fleiss_kappa(B.ratings(s, d))


_SIMPLE = _CLASS.rstrip() + """, sk AS (SELECT grouping(subtype)::bigint AS overall, subtype, count(*) AS total, sum((agreement = 'full')::int)::bigint AS "full", sum((agreement = 'partial')::int)::bigint AS partial
FROM cls JOIN (SELECT o_orderkey AS id, o_orderpriority AS subtype FROM orders) ON subject = id GROUP BY GROUPING SETS ((subtype), ())),
kk AS (SELECT *, (CASE WHEN overall = 1 THEN "full" / total ELSE ("full" + 0.5 * partial) / total END - 0.125) / 0.875 AS kappa FROM sk)
"""


def _simple(s, d):
    return agreement.simple_kappa(agreement.agreement_class(B.ratings(s, d)).join(B.strata(s, d).withColumnRenamed("id", "subject"), "subject"), "subtype")


@query("kappa_simple", _SIMPLE + 'SELECT overall, subtype, total, "full", partial, round(kappa, 6) AS kappa FROM kk')
def _(s, d):
    return _simple(s, d)


@query("kappa_extremes", _SIMPLE + "SELECT round(min(kappa), 6) AS min_kappa, round(max(kappa), 6) AS max_kappa, arg_min(subtype, kappa) AS lowest, arg_max(subtype, kappa) AS highest FROM kk WHERE overall = 0")
def _(s, d):
    return agreement.kappa_extremes(_simple(s, d), "subtype")


@query("cohen_kappa", PRED + ", t AS (SELECT count(*) AS n, avg(correct) AS po FROM pred), e AS (SELECT sum(nx::double * ny) AS s FROM (SELECT predicted AS l, count(*) AS nx FROM pred GROUP BY 1) JOIN (SELECT gold AS l, count(*) AS ny FROM pred GROUP BY 1) USING (l)) SELECT n, round(po, 6) AS p_observed, round(s / (n::double * n), 6) AS p_expected, round((po - s / (n::double * n)) / (1 - s / (n::double * n)), 6) AS kappa FROM t, e")
def _(s, d):
    return agreement.cohen_kappa(B.predictions(s, d), "predicted", "gold")


# --- domain metrics


@query("efficiency_ratio", PRED + "SELECT count(*) AS n, round(avg(correct), 6) AS model_accuracy, 0.82::double AS human_accuracy, 0.78::double AS human_lower, 0.86::double AS human_upper, round(avg(correct) / 0.82::double, 6) AS ratio FROM pred")
def _(s, d):
    return efficiency.efficiency_ratio(B.predictions(s, d))


@query("efficiency_interval")
def _(s, d):
    return efficiency.efficiency_interval(B.predictions(s, d))


@query("anchoring_shift", PAIRS + "SELECT count(*) AS n, round(avg((base <> treat)::int), 6) AS sensitivity, round(1 - avg((base <> treat)::int), 6) AS anchoring FROM pairs")
def _(s, d):
    p = B.pairs(s, d)
    return efficiency.anchoring(p.select("key", F.col("base").alias("label")), p.select("key", F.col("treat").alias("label")))


_EDGES = ", ".join(f"({i}, {a!r}::double, {b!r}::double)" for i, (a, b) in enumerate(zip(efficiency.calibration_bins(10), efficiency.calibration_bins(10)[1:])))


@query("ece", PRED + f", b AS (SELECT * FROM (VALUES {_EDGES}) t(bin, lo, hi)), s AS (SELECT sum(n * abs(a - c)) AS s FROM (SELECT bin, count(*) AS n, avg(correct) AS a, avg(confidence) AS c FROM pred JOIN b ON confidence > lo AND confidence <= hi GROUP BY bin)) SELECT (SELECT count(*) FROM pred) AS n, round(s / (SELECT count(*) FROM pred), 6) AS ece FROM s")
def _(s, d):
    return efficiency.expected_calibration_error(B.predictions(s, d))


@query("calibration", PRED + f", b AS (SELECT * FROM (VALUES {_EDGES}) t(bin, lo, hi)) SELECT bin, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, round(abs(avg(correct) - avg(confidence)), 6) AS gap FROM pred JOIN b ON confidence > lo AND confidence <= hi GROUP BY bin")
def _(s, d):
    return efficiency.calibration(B.predictions(s, d))


_LIK = ", ".join(f"('{v}', '{e}', {i}, {listeners.LIKELIHOOD[e][k]}::double)" for k, v in enumerate(("positive", "negative", "neutral")) for i, e in enumerate(L.EMOTIONS))
_PRI = ", ".join(f"('{r}', '{e}', {f.get(e, 1.0)}::double)" for r, f in listeners.PRIOR.items() for e in L.EMOTIONS)
_RSA = f"""lik AS (SELECT v, e, o, l / sum(l) OVER (PARTITION BY v) AS l0 FROM (VALUES {_LIK}) t(v, e, o, l)),
pri AS (SELECT r, e, p / sum(p) OVER (PARTITION BY r) AS p FROM (VALUES {_PRI}) t(r, e, p)),
tab AS (SELECT v, r, e, o, l0, l0 * p / sum(l0 * p) OVER (PARTITION BY v, r) AS l1 FROM lik JOIN pri USING (e)),
u AS (SELECT scenario_id, {_VALENCE} AS v, {_power_sql('rsa')} AS r FROM utterances)
"""
_RSA_WITH = with_views("utterances", more=_RSA)


@query("rsa_l0", _RSA_WITH + "SELECT scenario_id, e AS emotion, o AS ord, round(l0, 6) AS l0 FROM u JOIN lik USING (v)")
def _(s, d):
    return listeners.literal(B.utterances(s, d))


@query("rsa_prior", _RSA_WITH + "SELECT r AS power_relation, e AS emotion, round(p, 6) AS prior FROM pri")
def _(s, d):
    return listeners.priors(s)


@query("rsa_l1", _RSA_WITH + "SELECT scenario_id, r AS power_relation, e AS emotion, o AS ord, round(l0, 6) AS l0, round(l1, 6) AS l1 FROM u JOIN tab USING (v, r)")
def _(s, d):
    return listeners.pragmatic(B.utterances(s, d))


_BEST = _RSA_WITH.rstrip() + """, best AS (SELECT DISTINCT v, r, first(e) OVER (PARTITION BY v, r ORDER BY round(l0, 12) DESC, o) AS l0_label, first(e) OVER (PARTITION BY v, r ORDER BY round(l1, 12) DESC, o) AS l1_label FROM tab),
lab AS (SELECT scenario_id, l0_label, l1_label, CASE strlen(scenario_id) % 3 WHEN 0 THEN 'sadness' WHEN 1 THEN 'trust' ELSE 'unknown' END AS emotion FROM u JOIN best USING (v, r))
"""


def _kappa_sql(c, i):
    return f"(SELECT count(*) AS n, avg((emotion = {c})::int) AS l{i}_agreement, (avg((emotion = {c})::int) - max(pe)) / (1 - max(pe)) AS l{i}_kappa FROM lab, (SELECT coalesce(sum(a * b), 0) / pow((SELECT count(*) FROM lab), 2) AS pe FROM (SELECT emotion AS x, count(*) AS a FROM lab GROUP BY 1) JOIN (SELECT {c} AS x, count(*) AS b FROM lab GROUP BY 1) USING (x)))"


@query("rsa_alignment", _BEST + f"SELECT a.n AS n, round(l0_kappa, 6) AS l0_kappa, round(l0_agreement, 6) AS l0_agreement, round(l1_kappa, 6) AS l1_kappa, round(l1_agreement, 6) AS l1_agreement FROM {_kappa_sql('l0_label', 0)} a, {_kappa_sql('l1_label', 1)} b")
def _(s, d):
    u = B.utterances(s, d)
    p = u.select("scenario_id", F.when(F.length("scenario_id") % 3 == 0, "sadness").when(F.length("scenario_id") % 3 == 1, "trust").alias("emotion"))
    return listeners.alignment(p, u)


_STRATA = with_views("strata")
_NUM = _STRATA.rstrip() + """, num AS (SELECT subtype, id, row_number() OVER (PARTITION BY subtype ORDER BY id) - 1 AS i FROM strata), sz AS (SELECT subtype, count(*) AS n FROM strata GROUP BY 1)
"""
_PICK = "('0x' || substr(md5('42|' || {0} || '|' || {1}), 1, 8))::bigint % {2}"


@query("recombine_strat", _NUM.rstrip() + ", g AS (SELECT a.subtype AS ss, b.subtype AS cs, d::int AS draw, " + _PICK.format("a.subtype || '/' || b.subtype || '/u'", "d::varchar", "a.n") + " AS ui, " + _PICK.format("a.subtype || '/' || b.subtype || '/c'", "d::varchar", "b.n") + " AS ci FROM sz a JOIN sz b ON a.subtype <> b.subtype, range(0, 10) t(d)) SELECT ss AS source_subtype, cs AS context_subtype, draw, u.id AS utterance_id, c.id AS context_id FROM g JOIN num u ON u.subtype = ss AND u.i = ui JOIN num c ON c.subtype = cs AND c.i = ci")
def _(s, d):
    return composition.stratified_recombinations(B.strata(s, d))


@query("recombine", _NUM.rstrip() + ", l AS (SELECT list(subtype ORDER BY subtype) AS s, list(n ORDER BY subtype) AS n, count(*) AS k FROM sz), p AS (SELECT d, s, n, k, " + _PICK.format("'first'", "d::varchar", "k") + " AS f, " + _PICK.format("'second'", "d::varchar", "(k - 1)") + " + 1 AS st FROM l, range(0, 100) t(d)), g AS (SELECT d::int AS draw, s[f + 1] AS ss, s[(f + st) % k + 1] AS cs, " + _PICK.format("'u'", "d::varchar", "n[f + 1]") + " AS ui, " + _PICK.format("'c'", "d::varchar", "n[(f + st) % k + 1]") + " AS ci FROM p) SELECT ss AS source_subtype, cs AS context_subtype, draw, u.id AS utterance_id, c.id AS context_id FROM g JOIN num u ON u.subtype = ss AND u.i = ui JOIN num c ON c.subtype = cs AND c.i = ci")
def _(s, d):
    return composition.recombinations(B.strata(s, d))


@query("role_swap_gen", UTTER + f"SELECT scenario_id, listener_role AS speaker_role, speaker_role AS listener_role, {_power_sql('composition')} AS original_power, {_power_sql('composition', 'listener_role', 'speaker_role')} AS swapped_power FROM utterances")
def _(s, d):
    return composition.swap_roles(B.utterances(s, d))


_REC = PRED.rstrip() + ", rec AS (SELECT subtype || '->' || power_relation AS pair, correct, (predicted = gold)::int AS u, (predicted = CASE WHEN scenario_id % 2 = 0 THEN 'F' ELSE 'O' END)::int AS c FROM pred), r2 AS (SELECT *, greatest(u, c) AS e FROM rec)\n"


@query("compositional", _REC + 'SELECT grouping(pair)::bigint AS overall, pair, count(*) AS n, round(avg(correct), 6) AS original_accuracy, round(avg(u), 6) AS utterance_rate, round(avg(c), 6) AS context_rate, round(avg(e), 6) AS recombined_accuracy, round(avg(correct) - avg(e), 6) AS "drop", round(coalesce(avg(e) / nullif(avg(correct), 0), 0), 6) AS score FROM r2 GROUP BY GROUPING SETS ((pair), ())')
def _(s, d):
    p = B.predictions(s, d).select(F.col("subtype").alias("source_subtype"), F.col("power_relation").alias("context_subtype"), F.col("correct").alias("original_correct"), "predicted", F.col("gold").alias("utterance_gold"), F.when(F.col("scenario_id") % 2 == 0, "F").otherwise("O").alias("context_gold"))
    out = composition.compositional(p)
    return out.select("overall", "pair", "n", "original_accuracy", "utterance_rate", "context_rate", "recombined_accuracy", "drop", "score")


@query("role_swap", PAIRS + "SELECT grouping(t)::bigint AS overall, t AS transition, count(*) AS n, round(avg((base = truth)::int), 6) AS original_accuracy, round(avg((treat = truth)::int), 6) AS swapped_accuracy, round(avg((base <> treat)::int), 6) AS change_rate, round(avg((base = truth)::int) - avg((treat = truth)::int), 6) AS \"drop\" FROM (SELECT *, 'p' || (key % 3)::varchar || '->p' || (key % 2)::varchar AS t FROM pairs) GROUP BY GROUPING SETS ((t), ())")
def _(s, d):
    p = B.pairs(s, d).select(F.concat(F.lit("p"), (F.col("key") % 3).cast("string")).alias("original_power"), F.concat(F.lit("p"), (F.col("key") % 2).cast("string")).alias("swapped_power"), F.col("base").alias("original"), F.col("treat").alias("swapped"), "truth")
    return composition.role_swap_effects(p).select("overall", "transition", "n", "original_accuracy", "swapped_accuracy", "change_rate", "drop")


@query("intervention_effects", PAIRS + "SELECT intervention, n, round(ba, 6) AS baseline_accuracy, round(ta, 6) AS treated_accuracy, b, c, round(ta - ba, 6) AS improvement, round(coalesce(pow(abs(b - c) - 1, 2) / nullif(b + c, 0), 0), 6) AS chi2 FROM (SELECT 'INT-' || (key % 3)::varchar AS intervention, count(*) AS n, avg(base) AS ba, avg(treat) AS ta, count_if(base = 1 AND treat = 0)::bigint AS b, count_if(base = 0 AND treat = 1)::bigint AS c FROM pairs GROUP BY 1)")
def _(s, d):
    p = B.pairs(s, d).select(F.concat(F.lit("INT-"), (F.col("key") % 3).cast("string")).alias("intervention"), F.col("base").alias("baseline"), F.col("treat").alias("treated"))
    return composition.intervention_effects(p).select("intervention", "n", "baseline_accuracy", "treated_accuracy", "b", "c", "improvement", "chi2")


@query("peak_layer", PRED + ", l AS (SELECT model_id, scenario_id % 12 AS layer, avg(correct) AS accuracy FROM pred GROUP BY ALL) SELECT model_id, layer AS peak_layer, round(accuracy, 6) AS accuracy, round(layer / last::double, 6) AS position FROM (SELECT *, max(layer) OVER (PARTITION BY model_id) AS last FROM l) QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY accuracy DESC, layer) = 1")
def _(s, d):
    return efficiency.relative_layers(B.predictions(s, d).groupBy("model_id", (F.col("scenario_id") % 12).alias("layer")).agg(F.avg("correct").alias("accuracy")))


# --- resampling


def _boot_rows(s, d):
    return B.pairs(s, d).select((F.col("key") % 4).cast("string").alias("g"), "key", "base")


_BOOT = PAIRS.rstrip() + """, num AS (SELECT (key % 4)::varchar AS g, base::double AS v, row_number() OVER (PARTITION BY key % 4 ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY key % 4) AS n FROM pairs),
boot AS (SELECT p.g, p.draw, avg(num.v) AS m FROM (SELECT g, d AS draw, """ + _PICK.format("d::varchar", "i::varchar", "n") + """ AS pick FROM num, range(0, 100) t(d)) p JOIN num ON num.g = p.g AND num.i = p.pick GROUP BY ALL)
"""


@query("boot_ci_idx", _BOOT + "SELECT g, round(s[(floor(0.025 * len(s)) + 1)::int], 6) AS ci_lower, round(s[(floor(0.975 * len(s)) + 1)::int], 6) AS ci_upper FROM (SELECT g, list(m ORDER BY m) AS s FROM boot GROUP BY g)")
def _(s, d):
    return resampling.interval(resampling.hash_bootstrap(_boot_rows(s, d), "g", "base", "key"), "g")


@query("boot_ci_pct", _BOOT + "SELECT g, round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper FROM boot GROUP BY g")
def _(s, d):
    return resampling.interval(resampling.hash_bootstrap(_boot_rows(s, d), "g", "base", "key"), "g", kind="percentile")


def _stat_sql(f):
    return _BOOT.replace("avg(num.v) AS m", f + "(num.v) AS m").replace("base::double AS v", "(key % 97)::double AS v") + "SELECT g, round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper FROM boot GROUP BY g"


for _name, _f in (("median", "median"), ("std", "stddev_pop")):

    @query(f"boot_{_name}", _stat_sql(_f))
    def _(s, d, st=_name):
        rows = B.pairs(s, d).select((F.col("key") % 4).cast("string").alias("g"), "key", (F.col("key") % 97).alias("v"))
        return resampling.interval(resampling.hash_bootstrap(rows, "g", "v", "key", statistic=st), "g", kind="percentile")


for _name, _f in (("mean", "avg"), ("median", "median")):

    @query(f"permutation_{_name}", PAIRS.rstrip() + f""", x AS (SELECT base = 1 AS a, (key % 97)::double AS v, key::varchar AS k FROM pairs), z AS (SELECT count(*) FILTER (a) AS na FROM x),
o AS (SELECT {_f}(v) FILTER (a) - {_f}(v) FILTER (NOT a) AS d0 FROM x),
r AS (SELECT d AS round, v, row_number() OVER (PARTITION BY d ORDER BY md5('42|' || d::varchar || '|' || k), k) <= na AS f FROM x, z, range(0, 100) t(d)),
p AS (SELECT round, {_f}(v) FILTER (f) - {_f}(v) FILTER (NOT f) AS d FROM r GROUP BY round)
SELECT round(max(d0), 6) AS difference, round(avg((abs(d) >= abs(d0) - 1e-12)::int), 6) AS p_value FROM p, o""")
    def _(s, d, st=_name):
        rows = B.pairs(s, d).select(F.col("base").cast("string").alias("g"), "key", (F.col("key") % 97).alias("v"))
        return resampling.hash_permutation(rows, "g", "v", "key", "1", "0", statistic=st)


#: Statistics and the measure each is taken of, by trees of value counts.
_TREE = (("mean", "confidence"), ("std", "confidence"), ("median", "latency_ms"))
_TREE_SQL = {"mean": "avg", "std": "stddev_pop", "median": "median"}


def _measured(s, d, by):
    """(by, measure, v, n): rows of each value of each measure, from one pass over the predictions that all statistics share."""
    each = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in sorted({v for _, v in _TREE})])
    return kept(B.predictions(s, d).select(by, F.explode(each).alias("x")).groupBy(by, "x.measure", "x.v").agg(F.count("*").alias("n")))


def _tree_intervals(s, d, draws):
    rows, out = _measured(s, d, "model_id"), None
    for st, v in _TREE:
        x = splitting.value_interval(rows.where(F.col("measure") == v), ["model_id"], "v", st, draws, n="n").withColumn("statistic", F.lit(st))
        out = x if out is None else out.unionByName(x)
    return out


def _tree_relabelling(s, d, rounds):
    rows, out = _measured(s, d, "power_relation"), None
    for st, v in _TREE:
        x = splitting.relabelled(rows.where(F.col("measure") == v), "power_relation", "v", "peer", "lower_to_higher", st, rounds, n="n").withColumn("statistic", F.lit(st))
        out = x if out is None else out.unionByName(x)
    return out


@query("tree_intervals")
def _(s, d):
    return _tree_intervals(s, d, 200)


@query("tree_intervals_exact", PRED + " UNION ALL ".join(f"SELECT model_id, '{st}' AS statistic, round({_TREE_SQL[st]}({v}::double), 4) AS estimate FROM pred GROUP BY model_id" for st, v in _TREE))
def _(s, d):
    return _tree_intervals(s, d, 2).select("model_id", "statistic", F.round("estimate", 4).alias("estimate"))


@query("tree_relabelling")
def _(s, d):
    return _tree_relabelling(s, d, 200)


@query("tree_relabelling_exact", PRED + " UNION ALL ".join(f"SELECT '{st}' AS statistic, count(*) FILTER (power_relation = 'peer') AS n_a, count(*) FILTER (power_relation = 'lower_to_higher') AS n_b, round({_TREE_SQL[st]}({v}::double) FILTER (power_relation = 'peer') - {_TREE_SQL[st]}({v}::double) FILTER (power_relation = 'lower_to_higher'), 4) AS difference FROM pred" for st, v in _TREE))
def _(s, d):
    return _tree_relabelling(s, d, 2).select("statistic", "n_a", "n_b", F.round("difference", 4).alias("difference"))


@query("relabelled_means")
def _(s, d):
    return resampling.relabelled_means(B.predictions(s, d), "power_relation", "latency_ms", "peer", "lower_to_higher", 200)


@query("all_metrics", PRED + f""", b AS (SELECT * FROM (VALUES {_EDGES}) t(bin, lo, hi)), g AS (SELECT {_D} AS gap, {_pooled('var_pop')} AS sd, count(*) AS n FROM (SELECT correct AS v, power_relation AS g FROM pred WHERE power_relation IN ('peer', 'lower_to_higher')))
SELECT 'efficiency_ratio' AS metric, round(avg(correct) / 0.82::double, 6) AS value, count(*) AS n FROM pred
UNION ALL SELECT 'ece', round(sum(n * abs(a - c)) / (SELECT count(*) FROM pred), 6), (SELECT count(*) FROM pred) FROM (SELECT bin, count(*) AS n, avg(correct) AS a, avg(confidence) AS c FROM pred JOIN b ON confidence > lo AND confidence <= hi GROUP BY bin)
UNION ALL SELECT 'power_gap', round(gap, 6), n FROM g UNION ALL SELECT 'power_gap_d', round(gap / sd, 6), n FROM g
UNION ALL SELECT concat_ws('/', 'accuracy', coalesce(power_relation, 'all'), subtype), round(avg(correct), 6), count(*) FROM pred GROUP BY GROUPING SETS ((power_relation), (power_relation, subtype), ()), power_relation, subtype""".replace(" GROUP BY GROUPING SETS ((power_relation), (power_relation, subtype), ()), power_relation, subtype", " GROUP BY GROUPING SETS ((power_relation), (power_relation, subtype), ())"))
def _(s, d):
    return efficiency.all_metrics(B.predictions(s, d))


@query("boot_binary")
def _(s, d):
    return resampling.binary_bootstrap(B.predictions(s, d), ["model_id"], "correct")


@query("boot_numeric")
def _(s, d):
    return resampling.numeric_bootstrap(B.predictions(s, d), ["model_id"], "latency_ms", 200)


@query("cohens_d_ci")
def _(s, d):
    return resampling.difference_bootstrap(B.predictions(s, d), "power_relation", "correct", "peer", "lower_to_higher")


@query("drop_ci")
def _(s, d):
    return resampling.difference_bootstrap(B.predictions(s, d), "model_id", "correct", "m0", "m1")


@query("paired_d_ci")
def _(s, d):
    return resampling.paired_bootstrap(B.pairs(s, d), "base", "treat")


@query("paired_bootstrap")
def _(s, d):
    return resampling.paired_bootstrap(B.pairs(s, d), "treat", "base").select("n", "difference", "p_value", "ci_lower", "ci_upper")


# what those intervals hold besides their draws: counts, means and effects, which SQL can check


@query("boot_binary_exact", PRED + "SELECT model_id, count(*) AS n, round(avg(correct), 6) AS mean FROM pred GROUP BY 1")
def _(s, d):
    return resampling.binary_bootstrap(B.predictions(s, d), ["model_id"], "correct", 10).select("model_id", "n", F.round("mean", 6).alias("mean"))


_BINARY_D = "SELECT n_a, n_b, round(m_a - m_b, 6) AS difference, round((m_a - m_b) / sqrt((n_a * m_a * (1 - m_a) + n_b * m_b * (1 - m_b)) / (n_a + n_b - 2)), 6) AS d FROM (SELECT count(*) FILTER ({0}) AS n_a, count(*) FILTER ({1}) AS n_b, avg(correct) FILTER ({0}) AS m_a, avg(correct) FILTER ({1}) AS m_b FROM pred)"
_exact = lambda df, *more: df.select(*more, "n_a", "n_b", F.round("difference", 6).alias("difference"), F.round("d", 6).alias("d"))


@query("cohens_d_ci_exact", PRED + _BINARY_D.format("power_relation = 'peer'", "power_relation = 'lower_to_higher'"))
def _(s, d):
    return _exact(resampling.difference_bootstrap(B.predictions(s, d), "power_relation", "correct", "peer", "lower_to_higher", 10))


@query("power_comparisons_exact", PRED + " UNION ALL ".join("SELECT '" + a + "' AS first, '" + b + "' AS second, * FROM (" + _BINARY_D.format(f"power_relation = '{a}'", f"power_relation = '{b}'") + ")" for a, b in (("peer", "higher_to_lower"), ("peer", "lower_to_higher"), ("higher_to_lower", "lower_to_higher"))))
def _(s, d):
    return _exact(efficiency.power_comparisons(B.predictions(s, d)), "first", "second")


@query("relabelled_means_exact", PRED + "SELECT n_a, n_b, round(m_a - m_b, 4) AS difference FROM (SELECT count(*) FILTER (power_relation = 'peer') AS n_a, count(*) FILTER (power_relation = 'lower_to_higher') AS n_b, avg(latency_ms::double) FILTER (power_relation = 'peer') AS m_a, avg(latency_ms::double) FILTER (power_relation = 'lower_to_higher') AS m_b FROM pred)")
def _(s, d):
    return resampling.relabelled_means(B.predictions(s, d), "power_relation", "latency_ms", "peer", "lower_to_higher", 10).select("n_a", "n_b", F.round("difference", 4).alias("difference"))


@query("paired_bootstrap_exact", PAIRS.rstrip() + " SELECT count(*) AS n, round(avg(base - treat), 6) AS difference, round(avg(base - treat) / stddev_samp(base - treat), 6) AS d FROM pairs")
def _(s, d):
    return resampling.paired_bootstrap(B.pairs(s, d), "treat", "base", 10).select("n", F.round("difference", 6).alias("difference"), F.round("d", 6).alias("d"))


# --- retry planning, manifests, breakers


@query("manifest_filter", "SELECT scenario_id, model_id, label, count(*) AS n FROM (SELECT 's' || (event_id % 100)::varchar AS scenario_id, 'm' || (user_id % 7)::varchar AS model_id, event_type AS label FROM events WHERE event_id % 3 = 0) GROUP BY ALL")
def _(s, d):
    e = B.table(s, d, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string")).alias("scenario_id"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_id"), F.when(F.col("event_id") % 3 == 0, "invalid_emotion").otherwise("invalid_subtype").alias("error_type"), F.concat(F.lit("Invalid emotion: "), "event_type").alias("message"))
    return quality.invalid_labels(e).groupBy("scenario_id", "model_id", "label").agg(F.count("*").alias("n"))


def _manifest(s, d):
    e = B.table(s, d, "events")
    return e.select(F.when(F.col("event_id") % 50 == 0, "").when(F.col("event_id") % 50 == 1, "Unknown").otherwise(F.concat(F.lit("s"), (F.col("event_id") % 400).cast("string"))).alias("scenario_id"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_id"), F.col("event_type").alias("error_type"))


@query("retry_fallback", "SELECT scenario_id, model_id, string_agg(error_type, ',' ORDER BY error_type) AS error_types FROM (SELECT CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'Unknown' ELSE 's' || (event_id % 400)::varchar END AS scenario_id, 'm' || (user_id % 7)::varchar AS model_id, event_type AS error_type FROM events) WHERE lower(trim(scenario_id)) NOT IN ('', 'unknown') GROUP BY ALL")
def _(s, d):
    return quality.retry_fallback(_manifest(s, d)).withColumn("error_types", F.concat_ws(",", "error_types"))


@query("retry_plan", RESP + f", er AS ({_errors_sql()}), g AS (SELECT scenario_id, model_id, string_agg(DISTINCT error_type, ',' ORDER BY error_type) AS error_types, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS r FROM er GROUP BY ALL) SELECT scenario_id, model_id, error_types, (r + 1)::int AS priority FROM g QUALIFY row_number() OVER (ORDER BY r, scenario_id, model_id) <= floor((SELECT count(*) FROM g) * 0.10)")
def _(s, d):
    return quality.retry_plan(quality.validate(B.responses(s, d))).withColumn("error_types", F.concat_ws(",", "error_types"))


@query("retry_filter", _CALLS + ", r AS (SELECT model_id, avg(failed) AS rate FROM calls GROUP BY 1) SELECT model_id, count(*) AS n FROM calls WHERE model_id <> '1' AND (model_id IN (SELECT model_id FROM r WHERE rate > 0.15) OR NOT EXISTS (SELECT 1 FROM r WHERE rate > 0.15)) GROUP BY 1")
def _(s, d):
    c = B.calls(s, d)
    return quality.retry_filter(c, c.groupBy("model_id").agg(F.avg("failed").alias("rate")), exclude=["1"], limit=0.15).groupBy("model_id").agg(F.count("*").alias("n"))


@query("circuit_breaker", _CALLS + ", i AS (SELECT *, sum(1 - failed) OVER (PARTITION BY model_id ORDER BY seq) AS isl FROM calls), f AS (SELECT model_id, seq, row_number() OVER (PARTITION BY model_id, isl ORDER BY seq) AS run FROM i WHERE failed = 1), g AS (SELECT model_id, max(run) AS longest, min(seq) FILTER (run = 3) AS dropped_at FROM f GROUP BY 1) SELECT m.model_id, coalesce(longest, 0)::int AS longest, coalesce(longest >= 3, false) AS dropped, coalesce(dropped_at, -1) AS dropped_at FROM (SELECT DISTINCT model_id FROM calls) m LEFT JOIN g USING (model_id)")
def _(s, d):
    return worklist.circuit_breaker(B.calls(s, d), 3).withColumn("dropped_at", F.coalesce("dropped_at", F.lit(-1)))


@query("qa_unnest", """WITH f AS (SELECT event_id::varchar AS file, CASE event_id % 5 WHEN 0 THEN '[' || props || ',' || props || ']' WHEN 1 THEN '{"predictions": [' || props || ']}' WHEN 2 THEN '{broken' ELSE props END AS value FROM events),
x AS (SELECT file, NOT json_valid(value) AS parse_failed, CASE WHEN NOT json_valid(value) THEN [NULL::json] WHEN json_type(value) = 'ARRAY' THEN json_extract(value, '$[*]') WHEN json_exists(value, '$.predictions') THEN json_extract(value, '$.predictions[*]') ELSE [value::json] END AS r FROM f)
SELECT file, (i - 1)::int AS "at", parse_failed, coalesce(json_extract_string(r[i], '$.k')::int, -1) AS k FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM x)""")
def _(s, d):
    f = B.table(s, d, "events").select(F.col("event_id").cast("string").alias("file"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"predictions": ['), "props", F.lit("]}"))).when(F.col("event_id") % 5 == 2, F.lit("{broken")).otherwise(F.col("props")).alias("value"))
    return quality.unnest(f).select("file", "at", "parse_failed", F.coalesce(F.try_variant_get("response", "$.k", "int"), F.lit(-1)).alias("k"))


@query("array_codec", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) AS total, round(embedding[1]::double, 4) AS first FROM embeddings WHERE embedding IS NOT NULL")
def _(s, d):
    text = B.table(s, d, "embeddings").where("embedding is not null").select("vec_id", arrays.array_to_json("embedding").alias("t"))
    v = arrays.array_from_json("t")
    return text.select("vec_id", F.size(v).cast("bigint").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.element_at(v, 1), 4).alias("first"))


@query("mock_predict")
def _(s, d):
    return worklist.mock_predictions(B.prompts(s, d).select("id", F.col("text").alias("prompt")), L.EMOTIONS).groupBy("emotion").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


# --- files: written from the tables, read back by the readers


_FILED = """WITH f AS (SELECT *, 'm' || (s_nationkey % 4) AS model_dir, CASE WHEN s_suppkey % 10 = 0 THEN 'trust' WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'joy' WHEN s_suppkey % 3 = 1 THEN 'fear' ELSE 'anger' END AS emotion, CASE WHEN s_suppkey % 7 = 0 THEN 'not JSON' WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN 'no label' END AS problem FROM supplier)
"""


@query("scan_predictions", _FILED + "SELECT model_dir, emotion, count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS succeeded, round(sum((s_suppkey % 100) / 100.0::double), 4) AS confidence, round(sum(s_acctbal::double), 4) AS latency_ms FROM f WHERE problem IS NULL GROUP BY ALL")
def _(s, d):
    x = files.scan_predictions(s, B.stored(s, B.prediction_files(s, d), "predictions")).where("problem is null")
    return x.groupBy("model_dir", "emotion").agg(F.count("*").alias("n"), F.count_if("success").alias("succeeded"), F.round(F.sum("confidence"), 4).alias("confidence"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"))


@query("scan_quarantine", _FILED + "SELECT model_dir, 's_' || s_suppkey AS file_stem, problem FROM f WHERE problem IS NOT NULL")
def _(s, d):
    return files.quarantined(files.scan_predictions(s, B.stored(s, B.prediction_files(s, d), "predictions")))


_GOLD = """WITH g AS (SELECT 'sub' || (s_nationkey % 5) AS subtype, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE s_suppkey::varchar END AS id, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'He said "well",' || chr(10) || 'again: ' || s_name END AS utterance, CASE WHEN s_suppkey % 2 = 0 THEN 'joy' ELSE 'anger' END AS gold FROM supplier)
"""


@query("gold_csv", _GOLD + "SELECT subtype || '_' || id AS id, subtype, utterance, 'higher_to_lower' AS power_relation FROM g WHERE id <> '' AND utterance <> ''")
def _(s, d):
    return readers.gold_scenarios(s, B.stored(s, B.gold_files(s, d), "gold")).select("id", "subtype", "utterance", "power_relation")


@query("gold_csv_labels", _GOLD + "SELECT subtype || '_' || id AS scenario_id, gold FROM g WHERE id <> '' AND utterance <> ''")
def _(s, d):
    return readers.gold_labels(readers.gold_scenarios(s, B.stored(s, B.gold_files(s, d), "gold")))


@query("gold_csv_quarantine", _GOLD + "SELECT 'aggregate_' || subtype || '.csv' AS file, id, CASE WHEN id = '' THEN 'no id' ELSE 'no utterance' END AS reason FROM g WHERE id = '' OR utterance = ''")
def _(s, d):
    return readers.gold_quarantine(s, B.stored(s, B.gold_files(s, d), "gold"))


@query("response_files_json", _FILED + "SELECT model_dir, count(*) AS files, count(*) FILTER (problem = 'not JSON') AS torn FROM f GROUP BY model_dir")
def _(s, d):
    x = readers.response_files(s, B.stored(s, B.prediction_files(s, d), "responses"))
    torn = F.count_if(F.try_parse_json("value").isNull())
    return x.groupBy(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("model_dir")).agg(F.count("*").alias("files"), torn.alias("torn"))


@query("error_manifest_csv", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'invalid_emotion' ELSE 'empty_response' END AS error_type, CASE WHEN s_suppkey % 2 = 0 THEN 'emotion' END AS field, count(*) AS n, sum(length('Invalid: \"' || s_name || '\", mostly')) AS chars FROM supplier GROUP BY ALL")
def _(s, d):
    x = readers.error_manifest(s, B.stored(s, B.manifest_files(s, d), "manifest"))
    return x.groupBy("error_type", "field").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"))
