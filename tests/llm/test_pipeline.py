"""The corpus pipeline, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "tokenise"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "tokenise":
            assert out.columns == columns
            docs = out
        if name in ("language_id", "near_dedup"):
            assert 0 < out.count() <= n
    assert out.count() == docs.count()


def test_run_is_repeatable(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_odd_documents(spark):
    """Nulls in any column, empty and repeated rows, a clashing column; and no rows at all."""
    words = [f"die katze und der hund {i} laufen {'schnell ' * (i % 5)}durch den wald von dorf {i * 7}" for i in range(40)]
    rows = [(i, t, "de", "a" if i % 3 else None, len(t), 1) for i, t in enumerate(words)]
    rows += [rows[3], rows[3], (None, words[5], "de", "b", 1, 2), (50, None, None, None, None, None), (51, "", "de", "a", 0, 1), (52, " \n\t ", None, "a", 3, 1), (53, "123 456", "de", "a", 7, 1), (7, "another text of an id that is there", None, "b", 2, 1), (60, "langer text " * 20_000, "de", "c", 240_000, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tmpl int"
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema).repartition(3)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, SF), name)
            if name == "tokenise":
                assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
                break
            assert out.schema == docs.schema or out.dtypes == docs.dtypes
            got = [tuple(r) for r in out.collect()]
            if name == "language_id":
                assert len(got) == (len(table) - 4 if table else 0) and {r[0] for r in got}.isdisjoint({50, 51, 52, 53})
            if name == "near_dedup" and table:
                assert len([r for r in got if r[0] == 3]) <= 1
            docs = out
