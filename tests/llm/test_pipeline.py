"""The pipeline's stages on the same rows, and the registered queries with their SQL."""

import brute
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parchment.llm import quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path, docs, items):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items[1].coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder, docs, items, nothing):
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.collect()
        kept = stage(spark, kept, folder)
        if k < 4:
            assert kept.columns == docs.columns, name
        after = kept.collect()
        if name == "quality rules":
            assert len(after) == sum(not brute.statistics(r["text"])[-1] for r in before)
        if name == "near dedup":
            exact = {r["text"] for r in before}
            assert {r["text"] for r in after} <= exact and len(after) < len(exact)
            assert len({r["text"] for r in after}) == len(after)
        if name == "decontamination":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not brute.contamination(r["text"], items[0])[-1])
        if name == "pii":
            assert len(after) == len(before) and not any("a.b_c@" in r["text"] for r in after)
        if name == "mixing":
            assert after and all(0 < r["taken"] <= 3 * r["size"] for r in after)
        assert stage(spark, nothing, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_clean_documents_stay(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.keep_good(df).count() == 30
    assert corpus_pipeline.near_dedup(spark, df, "").count() == 30


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
