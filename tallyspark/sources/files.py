"""Trees of small named files as data sources of Spark: a sink that writes rows as files, and a scan of stored predictions by model folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files of one input partition.
FILES = 1000
#: Files of a run's own that lie among the predictions; fixed names of the format.
NOT_PREDICTIONS = ("batch_manifest", "stats")
SCANNED = "model_dir string, file_stem string, scenario_id string, model_id string, success boolean, subtype string, emotion string, valence double, arousal double, dominance double, confidence double, latency_ms double, timestamp string, problem string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path: a URI that Arrow knows, or a path of this machine's shared mounts."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    staged: str
    names: list[str]


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, top = _open(self.path)
        staged, names = f"{top}/_staged-{self.run}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name below the folder: {name!r}")
            place = f"{staged}/{name}"
            store.create_dir(place.rpartition("/")[0], recursive=True)
            with store.open_output_stream(place) as out:
                out.write((row["content"] or "").encode())
            names.append(name)
        return _Written(staged, names)

    def commit(self, messages: list) -> None:
        store, top = _open(self.path)
        if self.overwrite and store.get_file_info(top).type == fs.FileType.Directory:
            for x in store.get_file_info(fs.FileSelector(top)):
                if not x.base_name.startswith("_staged-"):
                    (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        for folder in {n.rpartition("/")[0] for m in messages if m for n in m.names}:
            store.create_dir(f"{top}/{folder}", recursive=True)
        for m in messages:
            for n in m.names if m else ():
                store.move(f"{m.staged}/{n}", f"{top}/{n}")
        store.create_dir(top, recursive=True)
        store.open_output_stream(f"{top}/_SUCCESS").close()
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        store, top = _open(self.path)
        if store.get_file_info(f"{top}/_staged-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/_staged-{self.run}")


class NamedFiles(DataSource):
    """Sink of rows (name, content): each a file below the folder. Tasks write aside; files move to their places when all tasks are done, and _SUCCESS comes last."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"], overwrite)


@dataclass
class _Folder(InputPartition):
    model_dir: str
    files: list[str]


class PredictionReader(DataSourceReader):
    """Partitions are up to ``FILES`` files of one model folder; conditions on model_dir choose the folders that are listed at all."""

    def __init__(self, path: str):
        self.path, self.asked = path.rstrip("/"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if found is None or f.attribute != ("model_dir",):
                yield f
            else:
                self.asked = found if self.asked is None else self.asked & found

    def folders(self, store: fs.FileSystem, top: str) -> list[str]:
        if self.asked is None:
            return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.Directory and not x.base_name.startswith("_"))
        known = sorted(str(a) for a in self.asked if a)
        return [a for a, x in zip(known, store.get_file_info([f"{top}/{a}" for a in known])) if x.type == fs.FileType.Directory]

    def partitions(self) -> list[InputPartition]:
        store, top = _open(self.path)
        out: list[InputPartition] = []
        for folder in self.folders(store, top):
            files = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(f"{top}/{folder}")) if x.type == fs.FileType.File and x.base_name.endswith(".json"))
            files = [f for f in files if f[:-5] not in NOT_PREDICTIONS]
            out += [_Folder(folder, files[i : i + FILES]) for i in range(0, len(files), FILES)]
        return out or [_Folder("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, top = _open(self.path)
        schema = _arrow()
        rows = []
        for f in partition.files:
            with store.open_input_stream(f"{top}/{partition.model_dir}/{f}") as x:
                rows.append({"model_dir": partition.model_dir, "file_stem": f[:-5], **_parsed(x.read())})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCANNED.split(", "))])


def _parsed(raw: bytes) -> dict:
    """Fields of a stored prediction; ``problem`` says why they can't be had. Values of the wrong kind count as missing."""
    try:
        found = json.loads(raw)
    except ValueError:
        return {"problem": "not JSON"}
    if not isinstance(found, dict):
        return {"problem": "not an object"}
    inner = found.get("prediction")
    inner = inner if isinstance(inner, dict) else {}
    text = lambda x: x if isinstance(x, str) else None
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    out = {n: text(found.get(n)) for n in ("scenario_id", "model_id", "timestamp")}
    out |= {"success": found["success"] if isinstance(found.get("success"), bool) else None, "latency_ms": number(found.get("latency_ms")), "subtype": text(inner.get("subtype"))}
    out |= {n: number(inner.get(n)) for n in ("valence", "arousal", "dominance", "confidence")}
    out["emotion"] = text(inner.get("emotion")) or text(found.get("predicted_emotion"))
    return out | {"problem": None if out["emotion"] else "no label"}


class PredictionTree(DataSource):
    """Scan of <model>/<scenario>.json files, good and bad: a row each, bad ones with a ``problem``."""

    @classmethod
    def name(cls) -> str:
        return "prediction_tree"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema: StructType) -> DataSourceReader:
        return PredictionReader(self.options["path"])


def write_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, content) as files below ``path``; null content is an empty file, and of equal names one stays."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("named_files").mode(mode).save(path)


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The stored predictions below ``path`` as a frame: folders are pruned by conditions on model_dir, and files are read in tasks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PredictionTree)
    return spark.read.format("prediction_tree").load(path)


def quarantined(scanned: DataFrame) -> DataFrame:
    """(model_dir, file_stem, problem) of the files that hold no prediction."""
    return scanned.where("problem is not null").select("model_dir", "file_stem", "problem")
