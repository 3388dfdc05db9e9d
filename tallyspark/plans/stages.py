"""Named stages over DataFrames, run by a mode, with Parquet checkpoints between them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField

from ..sources.store import drop, exists, get_json, put_json

#: The file beside a stage's outputs that says what they were made from.
RECORD = "_made_from.json"
Step = Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass(frozen=True)
class Stage:
    name: str
    run: Step
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    enabled: bool = True
    #: What else its outputs depend on, as plain values of JSON: options, versions, tables it reads by itself.
    settings: dict = field(default_factory=dict)


@dataclass
class Registry:
    stages: dict[str, Stage] = field(default_factory=dict)

    def register(self, stage: Stage, replace: bool = False) -> Stage:
        if stage.name in self.stages and not replace:
            raise ValueError(f"stage exists: {stage.name}")
        self.stages[stage.name] = stage
        return stage

    @property
    def order(self) -> list[str]:
        return list(self.stages)

    def plan(self, mode: str) -> list[str]:
        """full, stage:x, from:x, to:x or range:a:b, as names in order."""
        names = self.order
        m = re.fullmatch(r"(full)|(stage|from|to):([^:]+)|range:([^:]+):([^:]+)", mode)
        if not m:
            raise ValueError(f"unknown mode: {mode}")
        for asked in filter(None, m.group(3, 4, 5)):
            if asked not in names:
                raise ValueError(f"unknown stage: {asked}; there are {names}")
        if m[1]:
            return names
        if m[2]:
            i = names.index(m[3])
            return {"stage": names[i : i + 1], "from": names[i:], "to": names[: i + 1]}[m[2]]
        a, b = names.index(m[4]), names.index(m[5])
        if a > b:
            raise ValueError(f"{m[4]} comes after {m[5]}")
        return names[a : b + 1]


def _hashable(f: StructField) -> Column:
    """A column as it can be hashed: maps have no hash and no order, so what holds one goes by its entries or its JSON."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, MapType) and "map<" not in f.dataType.valueType.simpleString():
        return F.array_sort(F.map_entries(c))
    return F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c


def fingerprint(df: DataFrame) -> dict:
    """Rows, schema and content of a table, whatever its order and partitioning: exact sums of two row hashes, so that repeats count.

    One pass over all columns, partial sums in each task. Tables of equal fingerprint are taken for equal.
    """
    columns = [_hashable(f) for f in df.schema.fields]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("string") for seed in (0, 1)]
    n, a, b = df.agg(F.count(F.lit(1)), *sums).first()
    return {"rows": n, "schema": df.schema.simpleString(), "content": [a or "0", b or "0"]}


def record(spark: SparkSession, folder: str, stage: str) -> dict | None:
    """What is known of a stage's last whole run: fingerprints of its inputs and outputs, its settings and the mode; None if there was none."""
    return get_json(spark, f"{folder}/{stage}/{RECORD}")


def _put_record(spark: SparkSession, folder: str, stage: str, found: dict | None) -> None:
    """The record is there as a whole or not at all: it is renamed into place, after the outputs are written."""
    path = f"{folder}/{stage}/{RECORD}"
    drop(spark, path)
    if found is not None:
        put_json(spark, path, found)


def _whole(spark: SparkSession, folder: str, stage: Stage) -> bool:
    return bool(stage.produces) and all(exists(spark, f"{folder}/{stage.name}/{out}/_SUCCESS") for out in stage.produces)


class _Prints:
    """Fingerprints of the tables of a run, each computed once; those of stored outputs come from their stage's record."""

    def __init__(self, spark: SparkSession, registry: Registry, folder: str):
        self.known: dict[str, dict] = {}
        self.spark, self.registry, self.folder = spark, registry, folder

    def of(self, name: str, tables: dict[str, DataFrame], given: bool) -> dict:
        if name not in self.known:
            maker = None if given else next((s for s in self.registry.stages.values() if name in s.produces), None)
            kept = maker and record(self.spark, self.folder, maker.name)
            self.known[name] = (kept or {}).get("outputs", {}).get(name) or fingerprint(tables[name])
        return self.known[name]


def stale(spark: SparkSession, registry: Registry, inputs: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """done, stale, partial or open for each stage: stale if what it was made from isn't what it would be made from now, or was made by a stale stage."""
    prints, out, old = _Prints(spark, registry, folder), {}, set()
    for name, stage in registry.stages.items():
        kept, there = record(spark, folder, name), [exists(spark, f"{folder}/{name}/{x}/_SUCCESS") for x in stage.produces]
        if kept is None or not all(there):
            out[name] = "partial" if any(there) else "open"
        else:
            same = not old & set(stage.requires) and kept["settings"] == stage.settings and all(
                (r not in inputs and kept["inputs"].get(r) is not None) or (r in inputs and kept["inputs"].get(r) == prints.of(r, inputs, True)) for r in stage.requires
            )
            out[name] = "done" if same else "stale"
        if out[name] != "done":
            old |= set(stage.produces)
    return out


def run(spark: SparkSession, registry: Registry, mode: str, inputs: dict[str, DataFrame], folder: str, resume: bool = True) -> dict[str, DataFrame]:
    """Run the stages of ``mode``; each output is written to <folder>/<stage>/<output> and read again.

    Beside its outputs a stage leaves a record of what they were made from: fingerprints of all it requires, and its settings.
    When resuming, a stage is skipped only if its outputs are whole and its record says the same of the tables it would be given now; so a changed input, also
    one of another folder, runs what depends on it again, and a rerun that gives the same output leaves later stages alone. A stage that fails
    leaves no record and stops the run. Given inputs win over stored ones of their name. What a stage reads beside
    ``requires`` isn't seen: name it in ``settings``.
    """
    known, prints = dict(inputs), _Prints(spark, registry, folder)
    planned = registry.plan(mode)
    for name in registry.order:  # outputs of earlier runs
        for out in registry.stages[name].produces:
            path = f"{folder}/{name}/{out}"
            if out not in known and name not in planned and exists(spark, f"{path}/_SUCCESS"):
                known[out] = spark.read.parquet(path)
    for name in planned:
        stage = registry.stages[name]
        if not stage.enabled:
            continue
        paths = {out: f"{folder}/{name}/{out}" for out in stage.produces}
        missing = [r for r in stage.requires if known.get(r) is None]
        kept = record(spark, folder, name) if resume and _whole(spark, folder, stage) else None
        if missing:
            raise ValueError(f"{name} needs {missing}")
        made_from = {r: prints.of(r, known, r in inputs) for r in stage.requires}
        if kept is None or kept["inputs"] != made_from or kept["settings"] != stage.settings:
            _put_record(spark, folder, name, None)
            made = stage.run(spark, known)
            for out, path in paths.items():
                made[out].write.mode("overwrite").parquet(path)
            outputs = {out: fingerprint(spark.read.parquet(path)) for out, path in paths.items()}
            _put_record(spark, folder, name, {"inputs": made_from, "outputs": outputs, "settings": stage.settings, "mode": mode})
            for out in paths:
                if out not in inputs:
                    prints.known[out] = outputs[out]
        known |= {out: spark.read.parquet(p) for out, p in paths.items() if out not in inputs}
    return known


def clear(spark: SparkSession, folder: str) -> bool:
    """Remove the checkpoints of a run."""
    return drop(spark, folder)
