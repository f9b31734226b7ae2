"""Each query against its SQL, and the pipeline, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    columns = sorted(want.columns)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=str)
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    from graphloom.llm import common

    docs = common.table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.written(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == counts[4] and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
