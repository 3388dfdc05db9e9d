"""Readers, stages, streaming monitors and the driver's contract."""

import csv
import json
import random
import subprocess
import sys
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import quality
from tallyspark.plans import catalog, stages
from tallyspark.sources import arrays, bindings, files, readers, store
from tallyspark.streaming import breaker

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_gold_csv(spark, tmp_path):
    head = ["id", "sd_situation", "sd_utterance", "sd_speaker_role", "sd_listener_role", "gold_standard", "sl_plutchik_primary_ann", "sl_v_ann", "sl_confidence_ann", "Notes"]
    with open(tmp_path / "aggregate_sarcasm-irony.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(head)
        w.writerow(["1", "multi\nline, \"quoted\"", " Sure. ", "senior manager", "intern", " Joy ", "joy", "very pleasant", "sure", ""])
        w.writerow(["2", "s", "", "a", "b", "joy", "joy", "", "", ""])
        w.writerow(["", "s", "u", "a", "b", "joy", "joy", "", "", ""])
    (tmp_path / "aggregate_answer_key.csv").write_text("id,sd_utterance\n9,x\n")
    rows = readers.gold_scenarios(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.utterance, r.power_relation, r.annotator_labels, r.annotator_vad["ann"].valence) == ("sarcasm-irony_1", "Sure.", "higher_to_lower", {"ann": "joy"}, "very pleasant")
    assert '"quoted"' in r.situation and "\n" in r.situation
    g = readers.gold_scenarios(spark, str(tmp_path))
    assert [tuple(x) for x in readers.gold_labels(g).collect()] == [("sarcasm-irony_1", "joy")]
    assert {x.measure for x in readers.long_ratings(g).collect()} == {"label", "confidence", "valence", "arousal", "dominance"}


def test_prediction_files(spark, tmp_path):
    d = tmp_path / "org_model"
    d.mkdir()
    (d / "s_1.json").write_text(json.dumps({"scenario_id": "s_1", "model_id": "org/model", "success": True, "prediction": {"emotion": "joy", "valence": 0.5}}, indent=1))
    (d / "s_2.json").write_text(json.dumps({"scenario_id": "s_2", "model_id": "org/model", "success": True, "predicted_emotion": "fear"}))
    (d / "s_3.json").write_text("{broken")
    (d / "batch_manifest.json").write_text("{}")
    got = sorted((r.model_dir, r.file_stem, r.emotion) for r in readers.predictions(spark, str(tmp_path)).collect())
    assert got == [("org_model", "s_1", "joy"), ("org_model", "s_2", "fear")]
    files = readers.response_files(spark, str(tmp_path))
    assert files.count() == 3
    un = quality.unnest(files).collect()
    assert sum(r.parse_failed for r in un) == 1


def test_manifest_and_report(spark, tmp_path):
    (tmp_path / "e.csv").write_text('scenario_id,model_id,error_type,severity,field,message\n1,m,invalid_emotion,medium,emotion,"Invalid emotion: guilt, mostly"\n')
    got = quality.invalid_labels(readers.error_manifest(spark, str(tmp_path / "e.csv"))).collect()
    assert [tuple(r) for r in got] == [("1", "m", "guilt, mostly")]
    readers.write(spark.range(3), str(tmp_path / "out"), "csv")
    with pytest.raises(Exception):
        readers.write(spark.range(3), str(tmp_path / "out"), "csv")
    assert readers.markdown(spark.range(1).withColumn("x", F.lit(0.5)), "T").endswith("| 0 | 0.5000 |\n")
    with pytest.raises(ValueError):
        readers.markdown(spark.range(20), "T", 5)


def test_stage_modes_and_resume(spark, tmp_path):
    ran = []

    def step(name, needs, factor):
        def run(s, known):
            ran.append(name)
            if name == "c" and len(ran) < 4:
                raise RuntimeError("lost")
            return {name: known[needs].withColumn("id", F.col("id") * factor)}

        return stages.Stage(name, run, (needs,), (name,))

    reg = stages.Registry()
    for args in (("a", "raw", 2), ("b", "a", 3), ("c", "b", 5)):
        reg.register(step(*args))
    assert reg.plan("full") == ["a", "b", "c"] and reg.plan("from:b") == ["b", "c"] and reg.plan("to:b") == ["a", "b"] and reg.plan("stage:b") == ["b"] and reg.plan("range:a:b") == ["a", "b"]
    for bad in ("nothing", "stage:z", "range:c:a"):
        with pytest.raises(ValueError):
            reg.plan(bad)
    with pytest.raises(ValueError):
        reg.register(step("a", "raw", 1))
    folder, raw = str(tmp_path / "run"), {"raw": spark.range(3)}
    with pytest.raises(RuntimeError):
        stages.run(spark, reg, "full", raw, folder)
    out = stages.run(spark, reg, "full", raw, folder)  # only the failed stage runs again
    assert ran == ["a", "b", "c", "c"] and sorted(r.id for r in out["c"].collect()) == [0, 30, 60]
    assert sorted(r.id for r in stages.run(spark, reg, "stage:c", {}, folder, resume=False)["c"].collect()) == [0, 30, 60]
    with pytest.raises(ValueError):
        stages.run(spark, reg, "stage:b", {}, str(tmp_path / "other"))
    assert stages.clear(spark, folder)


class TestFiles:
    def tree(self, spark, top, models=("a", "b", "c")):
        good = json.dumps({"scenario_id": "s", "success": True, "prediction": {"emotion": "joy", "confidence": 1, "valence": "high"}, "latency_ms": True})
        rows = [(f"{m}/s_{i}.json", good) for m in models for i in range(3)]
        rows += [("a/top.json", '{"predicted_emotion": "fear", "prediction": null}'), ("a/torn.json", '{"prediction": {'), ("b/list.json", "[1]"), ("b/empty.json", None), ("c/none.json", "{}"), ("c/stats.json", "{}"), ("c/notes.txt", "x"), ("d.json", good)]
        files.write_files(spark.createDataFrame(rows, "name string, content string").repartition(3), top)

    def test_scan(self, spark, tmp_path):
        top = str(tmp_path / "tree")
        self.tree(spark, top)
        assert (tmp_path / "tree/_SUCCESS").exists() and not list((tmp_path / "tree").glob("_staged*"))
        found = files.scan_predictions(spark, top)
        rows = {(r.model_dir, r.file_stem): r for r in found.collect()}
        assert len(rows) == 9 + 5
        r = rows["a", "s_1"]
        assert (r.emotion, r.confidence, r.valence, r.latency_ms, r.success, r.problem) == ("joy", 1.0, None, None, True, None) and rows["a", "top"].emotion == "fear"
        assert {(r.file_stem, r.problem) for r in files.quarantined(found).collect()} == {("torn", "not JSON"), ("list", "not an object"), ("empty", "not JSON"), ("none", "no label")}
        files.write_files(spark.createDataFrame([("z/s_1.json", "{}")], "name string, content string"), top, "overwrite")
        assert [r.model_dir for r in files.scan_predictions(spark, top).collect()] == ["z"]
        (tmp_path / "nothing").mkdir()
        assert files.scan_predictions(spark, str(tmp_path / "nothing")).count() == 0

    @pytest.mark.parametrize(("condition", "want"), [("model_dir = 'b'", {"b"}), ("model_dir in ('a', 'c', 'x')", {"a", "c"}), ("model_dir in ('a', 'b') and model_dir = 'b' and emotion = 'joy'", {"b"}), ("model_dir > 'a'", {"b", "c"}), ("model_dir = '..'", set())])
    def test_conditions_on_the_model(self, spark, tmp_path, condition, want):
        self.tree(spark, str(tmp_path / "t"))
        found = files.scan_predictions(spark, str(tmp_path / "t")).where(condition)
        assert {r.model_dir for r in found.collect()} == want

    def test_only_asked_folders_are_listed(self, spark, tmp_path, monkeypatch):
        from pyspark.sql.datasource import EqualTo, GreaterThan, In

        self.tree(spark, str(tmp_path))
        listed, real = [], files._open

        class Watching:
            def __init__(self, store):
                self.store = store

            def __getattr__(self, name):
                return getattr(self.store, name)

            def get_file_info(self, what):
                if not isinstance(what, list):
                    listed.append(what.base_dir.rsplit("/", 1)[-1])
                return self.store.get_file_info(what)

        monkeypatch.setattr(files, "_open", lambda path: (Watching(real(path)[0]), real(path)[1]))
        reader = files.PredictionReader(str(tmp_path))
        other = GreaterThan(("confidence",), 0.5)
        assert list(reader.pushFilters([In(("model_dir",), ("a", "c")), other, EqualTo(("model_dir",), "c")])) == [other]
        assert [p.model_dir for p in reader.partitions()] == ["c"] and listed == ["c"]
        monkeypatch.setattr(files, "FILES", 2)
        assert [len(p.files) for p in reader.partitions()] == [2, 2]

    def test_writes_are_whole_or_absent(self, spark, tmp_path):
        top = str(tmp_path / "t")
        for bad in ("../out.json", "/abs.json", ""):
            with pytest.raises(Exception, match="not a name"):
                files.write_files(spark.createDataFrame([("good.json", "1"), (bad, "2")], "name string, content string").coalesce(1), top)
            assert not (tmp_path / "t/good.json").exists() and not list(tmp_path.glob("t/_staged*")) and not (tmp_path / "t/_SUCCESS").exists()

    def test_gold_quarantine(self, spark, tmp_path):
        (tmp_path / "aggregate_x.csv").write_text('id,sd_utterance\n1,fine\n,no one\n3,\n4,a,b,c\n"5","two\nlines"\n')
        (tmp_path / "aggregate_key.csv").write_text("id,sd_utterance\n,x\n")
        got = sorted((r.file, r.id, r.reason) for r in readers.gold_quarantine(spark, str(tmp_path)).collect())
        assert got == [("aggregate_x.csv", "", "no id"), ("aggregate_x.csv", "3", "no utterance"), ("aggregate_x.csv", "4", "malformed")]


class TestStore:
    KEY = ["k", "g"]

    def latest(self, old, new):
        both = old.unionByName(new).groupBy(*self.KEY).agg(F.max(F.struct("at", "v")).alias("x"))
        return both.select(*self.KEY, "x.at", "x.v")

    def rows(self, spark, n, at, every=1):
        return spark.range(0, n, every).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "g").alias("g"), F.lit(at).alias("at"), F.concat(F.lit(f"v{at}-"), F.col("id")).alias("v"))

    def test_only_touched_buckets_change(self, spark, tmp_path):
        folder = str(tmp_path / "s")
        assert store.upsert(self.rows(spark, 500, 1), folder, self.latest, self.KEY, 16) == 1
        before = store.manifest(spark, folder)
        assert len(before["parts"]) == 16
        two = self.rows(spark, 500, 2).where("k in (7, 9)")
        assert store.upsert(two, folder, self.latest, self.KEY) == 2
        after = store.manifest(spark, folder)
        changed = {b for b in after["parts"] if after["parts"][b] != before["parts"][b]}
        assert 1 <= len(changed) <= 2
        got = {r.k: r.v for r in store.read(spark, folder).collect()}
        assert len(got) == 500 and got[7] == "v2-7" and got[9] == "v2-9" and got[8] == "v1-8"
        assert {r.v[:3] for r in store.read(spark, folder, 1).collect()} == {"v1-"}  # the version before is still there
        assert store.upsert(two.where("false"), folder, self.latest, self.KEY) == 2
        older = self.rows(spark, 520, 0)
        assert store.upsert(older, folder, self.latest, self.KEY) == 3 and store.read(spark, folder).where("at = 0").count() == 20
        gone = store.vacuum(spark, folder)
        assert len(gone) == 16 + len(changed) and store.read(spark, folder).count() == 520 and store.versions(spark, folder) == [3]
        with pytest.raises(ValueError):
            store.read(spark, folder, 1)
        with pytest.raises(ValueError):
            store.upsert(two, folder, self.latest, ["k"])

    def test_failed_and_rival_commits(self, spark, tmp_path):
        folder = str(tmp_path / "s")
        store.commit(self.rows(spark, 50, 1), folder, self.KEY, 4)

        def broken(old, new):
            return old.unionByName(new).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

        with pytest.raises(Exception, match="lost"):
            store.upsert(self.rows(spark, 50, 2), folder, broken, self.KEY)
        assert store.versions(spark, folder) == [1] and {r["at"] for r in store.read(spark, folder).collect()} == {1}
        store.upsert(self.rows(spark, 50, 3), folder, self.latest, self.KEY)
        with pytest.raises(FileExistsError):
            store.put_json(spark, f"{folder}/_versions/000000002.json", {})
        assert store.manifest(spark, folder)["version"] == 2 and not list((tmp_path / "s/_versions").glob("*.part*"))

    def test_lookup(self, spark, tmp_path):
        folder = str(tmp_path / "s")
        store.commit(self.rows(spark, 300, 1), folder, self.KEY, 8)
        wanted = spark.createDataFrame([(3, "g"), (4, None), (5, "g"), (999, None), (4, None), (None, None)], "k long, g string")
        assert sorted(r.k for r in store.lookup(wanted, folder).collect()) == [3, 4]
        assert store.lookup(wanted.where("false"), folder).count() == 0
        one = store.lookup(wanted.where("k = 3"), folder)
        assert len(one.inputFiles()) == 1  # of eight buckets
        with pytest.raises(ValueError):
            store.read(spark, str(tmp_path / "none"))


class TestResume:
    """What a stage was made from decides whether it runs again."""

    def registry(self, ran, factor=2):
        def step(name, f):
            def run(s, known):
                ran.append(name)
                return {name: f(known)}

            return run

        reg = stages.Registry()
        reg.register(stages.Stage("double", step("double", lambda k: k["raw"].select((F.col("id") * factor).alias("id"))), ("raw",), ("double",), settings={"factor": factor}))
        reg.register(stages.Stage("parity", step("parity", lambda k: k["double"].select((F.col("id") % 2).alias("p")).distinct()), ("double",), ("parity",)))
        reg.register(stages.Stage("count", step("count", lambda k: k["parity"].groupBy().count()), ("parity",), ("count",)))
        reg.register(stages.Stage("other", step("other", lambda k: k["side"]), ("side",), ("other",)))
        return reg

    def test_changed_tables_run_again(self, spark, tmp_path):
        ran, folder = [], str(tmp_path / "run")
        reg = self.registry(ran)
        side = spark.createDataFrame([("a", {"k": 1, "l": 2}, [1.0]), (None, None, None)], "s string, m map<string,int>, v array<double>")
        a = {"raw": spark.range(10), "side": side}
        stages.run(spark, reg, "full", a, folder)
        assert ran == ["double", "parity", "count", "other"]
        # the same rows in another order and partitioning
        same = {"raw": spark.range(10).repartition(3).orderBy(F.desc("id")), "side": side.orderBy("s")}
        stages.run(spark, reg, "full", same, folder)
        assert len(ran) == 4 and set(stages.stale(spark, reg, same, folder).values()) == {"done"}
        # other rows: what depends on them runs again, as far as its own input changes
        b = {"raw": spark.range(12), "side": side}
        assert stages.stale(spark, reg, b, folder) == {"double": "stale", "parity": "stale", "count": "stale", "other": "done"}
        out = stages.run(spark, reg, "full", b, folder)
        assert ran[4:] == ["double", "parity"] and out["double"].count() == 12  # its parities are as before, so count rests
        # repeated rows are other rows; another name, type or setting as well
        for changed in ({"raw": spark.range(12).union(spark.range(1))}, {"raw": spark.range(12).select(F.col("id").cast("int").alias("id"))}):
            before = len(ran)
            stages.run(spark, reg, "stage:double", b | changed, folder)
            assert ran[before:] == ["double"]
        before = len(ran)
        stages.run(spark, self.registry(ran, 3), "full", b, folder)
        assert ran[before:] == ["double", "parity", "count"]

    def test_failures_and_lost_records(self, spark, tmp_path):
        ran, folder = [], str(tmp_path / "run")
        reg = self.registry(ran)
        stages.run(spark, reg, "to:parity", {"raw": spark.range(4)}, folder)

        def broken(s, known):
            raise RuntimeError("lost")

        reg.register(stages.Stage("parity", broken, ("double",), ("parity",)), replace=True)
        with pytest.raises(RuntimeError):
            stages.run(spark, reg, "to:parity", {"raw": spark.range(5)}, folder)
        # outputs of the failed stage lie there from before, but are not taken for new ones
        assert stages.record(spark, folder, "parity") is None and (tmp_path / "run/parity/parity/_SUCCESS").exists()
        stages.run(spark, self.registry(ran), "to:parity", {"raw": spark.range(5)}, folder)
        assert ran[-1] == "parity" and ran.count("double") == 2
        # stored outputs feed a later stage by their records; a torn record counts as none
        stages.run(spark, self.registry(ran), "stage:count", {}, folder)
        stages.run(spark, self.registry(ran), "stage:count", {}, folder)
        assert ran.count("count") == 1
        (tmp_path / "run/double" / stages.RECORD).write_text('{"inputs": {')
        stages.run(spark, self.registry(ran), "to:parity", {"raw": spark.range(5)}, folder)
        assert ran.count("double") == 3 and ran.count("parity") == 2

    def test_fingerprints(self, spark):
        df = spark.createDataFrame([(1, None, {"b": [1], "a": [2]}), (1, None, {"b": [1], "a": [2]}), (None, "x", None)], "i int, s string, m map<string,array<int>>")
        f = stages.fingerprint(df)
        assert f == stages.fingerprint(df.repartition(2)) and f["rows"] == 3
        assert f != stages.fingerprint(df.where("i = 1")) and stages.fingerprint(df.where("false"))["content"] == ["0", "0"]


def test_streaming(spark, tmp_path):
    rows = [("m", i, int(i in (2, 3, 4))) for i in range(8)] + [("n", i, 0) for i in range(3)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "model_id string, seq long, failed int").write.parquet(src)
    stream = spark.readStream.schema("model_id string, seq long, failed int").parquet(src)
    q = breaker.failure_runs(stream, 3).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("runs").collect()] == [("m", 4)]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    """Each query against its SQL on the smallest tables, or at least whole and stable."""
    from collections import Counter

    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows and df.columns
        return
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)

    def plain(v):
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    want = Counter(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == want


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_training_data_part(tmp_path):
    """The library and the entry import without the optional part."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_config(tmp_path):
    from tallyspark.plans import config

    (tmp_path / "c.yml").write_text("a:\n  b: 1\n  c:\n")
    c = config.load(str(tmp_path / "none.yml"), str(tmp_path / "c.yml"))
    assert config.get(c, "a.b") == 1 and config.get(c, "a.c", 5) == 5 and config.get(c, "x.y") is None and config.load(str(tmp_path / "none.yml")) == {}


def test_stage_commands(spark, tmp_path, capsys):
    from tallyspark.__main__ import main

    d, folder = "/root/testdata/sf0.001", str(tmp_path / "run")
    assert main(["stages"]) == 0 and "plan: errors -> retries" in capsys.readouterr().out
    assert main(["stage", "to:plan", "--tables", d, "--folder", folder]) == 0
    assert main(["status", "--folder", folder]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["validate: done", "plan: done", "score: open"]
    assert main(["stage", "range:score:report", "--tables", d, "--folder", folder]) == 0
    assert spark.read.parquet(f"{folder}/report/metrics").count() > 0 and spark.read.parquet(f"{folder}/plan/retries").count() > 0
    assert main(["status", "--folder", folder]) == 0 and "open" not in capsys.readouterr().out
    assert main(["stage", "stage:agreement", "--tables", d, "--folder", folder]) == 0
    assert main(["status", "--folder", folder, "--tables", d]) == 0
    assert set(capsys.readouterr().out.split()) >= {"validate:", "done"}
    other = str(tmp_path / "tables")
    for name in ("events", "lineitem", "orders", "customer", "part", "supplier", "nation", "region", "documents", "labels"):
        t = spark.read.parquet(f"{d}/{name}.parquet")
        (t.where("event_id % 2 = 0") if name == "events" else t).write.parquet(f"{other}/{name}.parquet")
    assert main(["status", "--folder", folder, "--tables", other]) == 0
    shown = dict(line.split(": ") for line in capsys.readouterr().out.strip().split("\n"))
    assert shown["validate"] == shown["plan"] == "stale" and shown["accuracy"] == "done"
    assert main(["stage", "to:plan", "--tables", other, "--folder", folder]) == 0
    assert main(["status", "--folder", folder, "--tables", other]) == 0 and "stale" not in capsys.readouterr().out
    assert main(["estimate", "--tables", d, "--variants", "2"]) == 0 and "cost" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main(["stage", "from:nowhere", "--tables", d, "--folder", folder])


def test_array_codec_and_side_store(spark, tmp_path):
    texts = ['{"__numpy__": true, "data": [1.5, -2, 0], "dtype": "float32"}', "[3, 4.25]", '{"data": [1]}', "{broken", None, '{"__numpy__": true, "data": [], "dtype": "float64"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", arrays.array_from_json("t"))
    got = {r.i: r.v for r in df.collect()}
    assert got == {0: [1.5, -2.0, 0.0], 1: [3.0, 4.25], 2: None, 3: None, 4: None, 5: []}
    back = {r.i: r.w for r in df.select("i", arrays.array_from_json(arrays.array_to_json("v", "float32")).alias("w")).collect()}
    assert back == got
    cache = spark.createDataFrame([("m", 1, None, "r1", [1.0, 2.0], [0.5]), ("m", 2, "h", "r2", None, [0.25]), ("n", 1, None, "r3", None, None)], "model_id string, scenario_id int, prompt_hash string, response string, hidden array<float>, logits array<double>")
    key, folder = ["model_id", "scenario_id", "prompt_hash"], str(tmp_path / "cache")
    arrays.write_side_store(cache, folder, key, ["hidden", "logits"])
    assert arrays.read_side_store(spark, folder, key).columns == [*key, "response"]
    got = sorted(tuple(r)[3:] for r in arrays.read_side_store(spark, folder, key, ["hidden", "logits"]).collect())
    assert got == [("r1", [1.0, 2.0], [0.5]), ("r2", None, [0.25]), ("r3", None, None)]


def test_equal_means_tie_in_any_order(spark, tmp_path):
    """Customers with the same 32 discounts, whose mean lies on a rounding tie, have one x however their rows are ordered."""
    rng, cents = random.Random(0), [c % 11 for c in range(32)]
    cents[0] += (sum(cents) + 1) % 2
    lines, floats = [], set()
    for k in range(40):
        rng.shuffle(cents)
        lines += [(k, c / 100, float(k + 1)) for c in cents]
        floats.add(sum_in_order(c / 100 for c in cents) / 32)
    assert len(floats) > 1
    spark.createDataFrame(lines, "l_orderkey long, l_discount double, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k) for k in range(40)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert {(r.x, r.y) for r in bindings.exact_metric_pairs(spark, str(tmp_path)).collect()} == {(float((Decimal(sum(cents)) / 3200).quantize(Decimal("1e-6"), ROUND_HALF_UP)), k + 1.0) for k in range(40)}
    row = catalog.QUERIES["pearson_spearman"](spark, str(tmp_path)).first()
    assert (row.n, row.pearson, row.spearman) == (40, None, None)


def sum_in_order(xs):
    total = 0.0
    for x in xs:
        total += x
    return total
