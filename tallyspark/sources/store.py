"""Stored tables in versions: buckets by key that only change where they must, and a commit that is there whole or not at all.

<folder>/_versions/<number>.json names the parts of a version; the highest number is the present one. Data lie in <folder>/data/<number>-<id>, a folder for
each bucket. A commit writes its data first and its version file last, by renaming it into place: a write that fails leaves the version before,
readers hold the version they opened, and of two commits at once the second finds the number taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import kept

BUCKETS = 64
#: Column of a stored row's key hash: rows of a bucket are sorted by it, and Parquet keeps a Bloom filter of it.
HASH = "__key_hash"


def place(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = place(spark, path)
    return fs.exists(p)


def get_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a file; None if there is no file, or no whole object in it."""
    fs, p = place(spark, path)
    if not fs.exists(p):
        return None
    scanner = spark._jvm.java.util.Scanner(fs.open(p), "UTF-8").useDelimiter("\\A")
    try:
        return json.loads(scanner.next()) if scanner.hasNext() else None
    except ValueError:
        return None
    finally:
        scanner.close()


def put_json(spark: SparkSession, path: str, found: dict) -> None:
    """Write an object to a file that must not be there yet: it is renamed into place."""
    fs, p = place(spark, path)
    _, part = place(spark, f"{path}.part-{spark._jvm.java.util.UUID.randomUUID().toString()}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def drop(spark: SparkSession, path: str) -> bool:
    fs, p = place(spark, path)
    return fs.delete(p, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = place(spark, f"{folder}/_versions")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """What a version consists of; the present one if none is named, None where nothing was ever committed."""
    known = versions(spark, folder)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version} in {folder}; there are {known}")
    return get_json(spark, f"{folder}/_versions/{known[-1] if version is None else version:09d}.json")


def _hash(key: list[str]) -> Column:
    return F.xxhash64(*key)


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(_hash(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, folder: str, number: int, key: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket as the data of a version; where each bucket lies."""
    spark = rows.sparkSession
    dealt = rows.withColumn(HASH, _hash(key)).withColumn("__bucket", _bucket(key, buckets))
    dealt = dealt.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", HASH)
    name = f"{number:09d}-{uuid.uuid4().hex[:12]}"  # a rival's data lie elsewhere
    top = f"{folder}/data/{name}"
    dealt.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{HASH}", "true").partitionBy("__bucket").parquet(top)
    fs, p = place(spark, top)
    names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    return {n.partition("=")[2]: f"data/{name}/{n}" for n in names if n.startswith("__bucket=")}


def _commit(spark: SparkSession, folder: str, number: int, found: dict) -> int:
    put_json(spark, f"{folder}/_versions/{number:09d}.json", found | {"version": number})
    return number


def commit(rows: DataFrame, folder: str, key: list[str], buckets: int = BUCKETS) -> int:
    """Store ``rows`` as a new version that holds nothing else; its number. Earlier versions stay readable."""
    spark = rows.sparkSession
    number = max(versions(spark, folder), default=0) + 1
    parts = _write(rows, folder, number, key, buckets)
    return _commit(spark, folder, number, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "parts": parts})


def _read(spark: SparkSession, folder: str, found: dict, chosen: list[int] | None) -> DataFrame:
    schema = StructType.fromJson(json.loads(found["schema"]))
    parts = [f"{folder}/{p}" for b, p in sorted(found["parts"].items()) if chosen is None or int(b) in chosen]
    stored = StructType([*schema.fields]).add(HASH, "long")
    return spark.read.schema(stored).parquet(*parts) if parts else spark.createDataFrame([], stored)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the present one if none is named."""
    found = manifest(spark, folder, version)
    if found is None:
        raise ValueError(f"nothing is stored in {folder}")
    return _read(spark, folder, found, None).drop(HASH)


def _touched(rows: DataFrame, found: dict) -> list[int]:
    """The buckets that rows fall into: at most as many as there are buckets."""
    return sorted(r[0] for r in rows.select(_bucket(found["key"], found["buckets"])).distinct().collect())


def upsert(new: DataFrame, folder: str, merge, key: list[str], buckets: int = BUCKETS) -> int:
    """Commit a version in which ``merge(old, new)`` replaces the rows of the buckets that new rows fall into; its number.

    Only these buckets are read and written; the others' files go on into the new version. ``merge`` must keep each row's key.
    Without new rows nothing is committed.
    """
    spark = new.sparkSession
    found = manifest(spark, folder)
    if found is None:
        return commit(merge(new.limit(0), new), folder, key, buckets)
    if found["key"] != key:
        raise ValueError(f"the table is stored by {found['key']}")
    new = kept(new)
    touched = _touched(new, found)
    if not touched:
        return found["version"]
    old = _read(spark, folder, found, touched).drop(HASH)
    merged = merge(old, new)
    number = found["version"] + 1
    made = _write(merged.select(*old.columns), folder, number, key, found["buckets"])
    rest = {b: p for b, p in found["parts"].items() if int(b) not in touched}
    return _commit(spark, folder, number, {k: found[k] for k in ("key", "buckets", "schema")} | {"parts": rest | made})


def lookup(wanted: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """The stored rows whose key is among ``wanted``'s, nulls being equal: other buckets are not read, and rows meet by key hash first.

    Spark may turn a small ``wanted`` into a filter on the hash, which Parquet's statistics and Bloom filters answer by row group.
    """
    spark = wanted.sparkSession
    found = manifest(spark, folder, version)
    if found is None:
        raise ValueError(f"nothing is stored in {folder}")
    key = found["key"]
    asked = wanted.select(*key).distinct()
    stored = _read(spark, folder, found, _touched(asked, found))
    asked = asked.select(_hash(key).alias("__h"), *[F.col(k).alias(f"__w_{k}") for k in key])
    on = F.col(HASH) == F.col("__h")
    for k in key:
        on = on & stored[k].eqNullSafe(F.col(f"__w_{k}"))
    return stored.join(asked, on, "left_semi").drop(HASH)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Delete all versions but the last ``keep``, and the bucket folders that only they used; what was deleted. Readers of deleted versions fail."""
    if keep < 1:
        raise ValueError("one version must stay")
    known = versions(spark, folder)
    old, stay = known[:-keep], known[-keep:]
    used = {p for v in stay for p in manifest(spark, folder, v)["parts"].values()}
    gone = sorted({p for v in old for p in manifest(spark, folder, v)["parts"].values()} - used)
    for v in old:
        drop(spark, f"{folder}/_versions/{v:09d}.json")
    for p in gone:
        drop(spark, f"{folder}/{p}")
    return gone
