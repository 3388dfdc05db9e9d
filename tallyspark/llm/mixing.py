"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

WORD = r"[^\x20\x09-\x0D]+"
#: Units that meet in one node of the reduction tree, on average.
FAN_IN = 32
#: Mass below this is rounding error of doubles.
TINY = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in order of code points, null last, take ``weights`` in turn and
    share ``share`` times all words; a target stops at ``most`` times its
    source's words and the excess goes to the others by weight. The water
    level is the last one that still fills every source below it, found by
    running sums over the sources (one row each).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    by_r = Window.orderBy("r", F.col("source").isNull(), F.encode("source", "UTF-8"))
    whole, below = Window.partitionBy(), by_r.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # with all sources of smaller r full, the first source whose cap the level doesn't reach sets the level
    per = per.withColumn("rank", F.row_number().over(by_r))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("rank", "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _uniform(*on) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pivot(units: Column) -> Column:
    """Fold units (in order) by pivotal rounding.

    The accumulator holds one unit whose mass is still fractional. It meets the
    next: words move from one to the other, so that size times mass is kept in
    sum and each mass keeps its expectation, until one of the two is 0 or 1.
    That one is settled; the other goes on.
    """

    def meet(acc, x):
        a, b = acc["open"], x
        # how far words can move from b to a, and from a to b, before a mass reaches 0 or 1
        up = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])
        down = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
        move = F.when(b["u"] * (up + down) < down, up).otherwise(-down)
        p, q = a["p"] + move / a["s"], b["p"] - move / b["s"]
        p = F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p)
        q = F.when(q < TINY, 0.0).when(q > 1 - TINY, 1.0).otherwise(q)
        fixed = (p == 0) | (p == 1)
        a2, b2 = a.withField("p", p), b.withField("p", q)
        step = F.struct(F.array_append(acc["done"], F.when(fixed, a2).otherwise(b2)).alias("done"), F.when(fixed, b2).otherwise(a2).alias("open"))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("open"))).otherwise(step)

    first = F.struct(F.slice(units, 1, 0).alias("done"), F.element_at(units, 1).alias("open"))
    folded = F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), first, meet)
    return folded


def unit_copies(units: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, size, rows, row_hash, copies) of rows (id, source, size, rows, x) and row_hash, 0 if there is none.

    x is the wanted mass of each of a unit's equal rows, copies the rounding of all they want together.
    Whole copies are certain, and one fraction of a copy is left of a unit whatever its rows. Fractions are rounded along a tree: units of a
    source meet in nodes of about ``fan_in``, chosen by hash; each node settles
    all but one, which goes to the next level, until a source is one node. Every
    level shrinks ``fan_in`` times, is one narrow aggregation, and is
    written to the shared folder. The last fraction of a source is settled by
    its own probability.
    """
    if "row_hash" not in units.columns:
        units = units.withColumn("row_hash", F.lit(0).cast("bigint"))
    units = units.withColumn("x", F.col("x") * F.col("rows"))
    units = units.withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.floor("x"))
    units = units.withColumn("whole", F.when(F.col("p") > 1 - TINY, F.col("whole") + 1).otherwise(F.col("whole"))).withColumn("p", F.when((F.col("p") > 1 - TINY) | (F.col("p") < TINY), 0.0).otherwise(F.col("p")))
    columns = ["id", "source", "size", "rows", "row_hash", "whole", "p"]
    idle = (F.col("p") == 0) | (F.col("size") == 0)
    settled = units.where(idle).select(*columns[:6], F.lit(0.0).alias("p"))
    open_ = written(units.where(~idle).select(*columns), "mix-open")
    n = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while n:
        nodes = max(1, -(-n // fan_in))
        last = nodes == 1
        unit = F.struct(F.xxhash64(F.lit(level), "id", "source", "size", "row_hash").alias("o"), "id", "size", "rows", "row_hash", "whole", F.col("size").cast("double").alias("s"), "p", _uniform(F.lit(-1 - level), "id", "source", "size", "row_hash").alias("u"))
        met = open_.groupBy("source", F.pmod(F.xxhash64(F.lit(level), F.lit("node"), "id", "size", "row_hash"), F.lit(nodes)).alias("node")).agg(F.array_sort(F.collect_list(unit)).alias("us"))
        met = met.select("source", _pivot(F.col("us")).alias("f"))
        done = F.transform("f.done", lambda x: x.withField("fractional", F.lit(False)))
        rest = F.array(F.col("f.open").withField("fractional", (F.col("f.open.p") > 0) & (F.col("f.open.p") < 1)))
        out = written(met.select("source", F.explode(F.concat(done, rest)).alias("y")).select("y.id", "source", "y.size", "y.rows", "y.row_hash", "y.whole", "y.p", "y.fractional"), f"mix-level-{level}")
        settled = settled.unionByName(out.where(~F.col("fractional")).select(*columns))
        open_ = out.where("fractional").select(*columns)
        level += 1
        if last:
            settled = settled.unionByName(open_.withColumn("p", (_uniform(F.lit("last"), "id", "source", "size", "row_hash") < F.col("p")).cast("double")))
            break
        n = nodes  # no source has more open units than nodes
    return settled.select("id", "source", "size", "rows", "row_hash", (F.col("whole") + F.col("p").cast("bigint")).alias("copies"))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row, but maps, which have none."""
    return F.xxhash64(*[docs[f.name] for f in docs.schema if f.dataType.typeName() != "map"])


def mixed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, rows, row_hash, source_size, target, copies), one row for each distinct row; copies of all its rows together."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), _row_hash(docs).alias("row_hash"))
    units = written(sized.groupBy("id", "source", "size", "row_hash").agg(F.count("*").alias("rows")), "mix-units")
    targets = written(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most), "mix-targets")
    t = targets.select(F.col("source").alias("src"), "source_size", "target")
    on = F.col("source").eqNullSafe(F.col("src"))
    x = units.join(t, on).select("id", "source", "size", "rows", "row_hash", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("x"))
    return unit_copies(x).join(t, on).drop("src")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row for each input row: doc_id, size, source_size, target, taken, copies.

    Null text has size 0 and is never taken. Rows equal in all columns are one
    unit whose copies are spread evenly over them; rows that share an id but differ are
    decided each for itself. A null source is
    a source of its own, last in order. Empty documents take 0 words; an
    empty table gives no rows. Very long texts are only counted. Other columns may have any name.
    Decisions hang on hashes of the rows alone, so reruns agree whatever the partitioning.
    """
    u = mixed_units(docs, **how)
    u = u.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).withColumn("copies", F.expr("i * copies div rows - (i - 1) * copies div rows"))
    return u.select(F.col("id").alias(how.get("id_col", "doc_id")), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns unchanged.

    Nulls, empty texts, repeats and an empty table are as in ``mix``: null and empty texts are never taken.
    """
    u = mixed_units(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("copies > 0")
    u = u.select(F.col("id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("row_hash").alias("__h"), F.col("rows").alias("__r"), F.col("copies").alias("__c"))
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("bigint")
    taken = docs.join(u, docs[id_col].eqNullSafe(F.col("__i")) & docs[source_col].eqNullSafe(F.col("__s")) & (size == F.col("__n")) & (_row_hash(docs) == F.col("__h")))
    own = [docs[c] for c in docs.columns]
    single = taken.where("__r = 1").select(*own, "__c")
    # equal rows stand for each other: one of them is taken as often as all are
    unit = ["__i", "__s", "__n", "__h", "__c"]
    several = taken.where("__r > 1").groupBy(*unit).agg(F.first(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])).alias("r"))
    several = several.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)], "__c")
    every = single.unionByName(several)
    return every.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__c")))).select(*docs.columns)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
