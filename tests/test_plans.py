"""Every plan against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans import catalog
from graphloom.plans.exemplar import RAW


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    v = float(v)
    return None if math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    if name not in catalog.SQL:
        got.collect()
        return
    want = con.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_upsert_where_added_ids_exist(spark, tmp_path):
    """A table of over a million parts has the ids that the plan adds: both rows stay, as in the SQL."""
    spark.range(1_000_020).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "CAST(7 AS INT) AS p_size", "1.0D AS p_retailprice"
    ).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.QUERIES["s04_upsert"](spark, str(tmp_path)).filter("id >= 1000000").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = c.sql(f"SELECT * FROM ({catalog.SQL['s04_upsert']}) x WHERE id >= 1000000").fetchall()
    assert len(want) == 25 and sorted(map(tuple, got)) == sorted(want)


def test_calls_of_common_names(spark, tmp_path):
    """30,000 sites and functions of one name in two files: the join is of names, not of every site and function."""
    import time

    from graphloom.operators.joins import resolve_calls

    functions = spark.range(30_000).selectExpr("id", "'run' AS name", "concat('f', id % 2) AS file_id", "id % 3 = 2 AS is_exported")
    sites = functions.selectExpr("id AS caller_id", "file_id", "CASE WHEN id % 5 = 0 THEN 'none' ELSE name END AS callee", "CAST(1 AS INT) AS line_number")
    imports = spark.createDataFrame([("f0", "f1", ["run"])], "from_id string, to_id string, imported_symbols array<string>")
    began = time.monotonic()
    got = resolve_calls(sites, functions, imports, []).groupBy("to_id").count().collect()
    # f1's smallest exported one for callers in f0; f1's own smallest for those in f1
    assert {tuple(r) for r in got} == {(5, 12_000), (1, 12_000)}
    assert time.monotonic() - began < 30
