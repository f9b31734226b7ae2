import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.sources import files, ledger_files, tables


def test_globs(spark):
    rules = files.ignore_globs("# no\n*.log\nbuild/\n/docs/private\nsecret\n")
    paths = ["a.log", "x/y.log", "build/a", "x/build/b", "docs/private", "docs/private/z", "docs/public", "secret", "src/secret/a", "src/main.ts", "node_modules/p/i.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [r.path for r in df.filter(~files.ignored(F.col("path"), rules + files.ALWAYS_IGNORED)).collect()]
    assert kept == ["docs/public", "src/main.ts"]


def test_scan(spark, tmp_path):
    for name, text in {"src/a.ts": "a", "src/b.ts": "b", "node_modules/c.ts": "c", "src/d.py": "d"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.hash[:6] for r in files.scan(spark, str(tmp_path), "*.ts").collect()}
    assert got == {"src/a.ts": "ca9781", "src/b.ts": "3e23e8"}


def test_catalog(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path / "store"))
    assert not c.exists("t") and c.names() == []
    with pytest.raises(KeyError):
        c("t")
    row = lambda *r: spark.createDataFrame(r, "id int, v string")
    c.write_batch({"t": row((1, "a"), (2, "b"))}, {"t": ["id"]})
    c.upsert("t", row((2, "c"), (3, "d")), ["id"])
    c.append("t", row((4, "e")))
    assert {(r.id, r.v) for r in c("t").collect()} == {(1, "a"), (2, "c"), (3, "d"), (4, "e")} and c.names() == ["t"]
    c.forget("t", 1)
    assert c("t").count() == 4
    c.upsert("t", row((99, "z")), ["id"])  # numbered on, not by how many are left
    c.append("t", row((100, "y")))
    assert {r.id for r in c("t").collect()} == {1, 2, 3, 4, 99, 100}
    c.forget("t", 1)
    assert {r.id for r in c("t").collect()} == {1, 2, 3, 4, 99, 100}
    with pytest.raises(ValueError):
        c.append("t", row((1, "a")).withColumnRenamed("v", "w"))


def test_raw_query(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert tables.raw_query(spark, "SELECT id FROM t WHERE id > :least", {"t": df}, least=1).collect() == [(2,)]
    with pytest.raises(ValueError):
        tables.raw_query(spark, "SELECT nothing FROM t", {"t": df})


def test_ledger_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "s", "view", "query", ["e"], ["f"], "{}")], ledger_files.LEDGER)
    ledger_files.export(df, str(tmp_path / "l"))
    assert ledger_files.load(spark, str(tmp_path / "l")).collect() == df.collect()


def test_schemas(spark):
    assert schemas.dangling_kinds() == []
    for name in [*schemas.NODES, *schemas.EDGES]:
        assert schemas.differences(name, spark.createDataFrame([], schemas.schema(name))) == []
    assert schemas.differences("extends", spark.createDataFrame([], "from_id string")) == ["to_id: absent, not string"]
