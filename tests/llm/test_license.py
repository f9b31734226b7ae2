from graphloom.llm import license as lic

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def scan(spark, rows, **more):
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumn("directory", lic.F.lit("clash"))
    return {r.id: r for r in lic.scan(files, **more).collect()}


def test_inheritance_from_the_nearest_directory(spark):
    got = scan(
        spark,
        [
            (1, "LICENSE", MIT), (2, "a/LICENSE.txt", APACHE), (3, "a/b/x.py", "code"), (4, "c/y.py", "more code"), (5, "a/b/z.py", "many other words here " * 9 + "\n" + MIT + "\ncode"),
            (6, "a/COPYING", "nothing known"), (7, None, "code"), (8, "a/b/n.py", None), (9, "q.py", ""), (10, "ab/x.py", "code"),
        ],
    )
    license_ = {i: r.license for i, r in got.items()}
    assert license_ == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "MIT", 5: "MIT", 6: "Apache-2.0", 7: None, 8: "Apache-2.0", 9: "MIT", 10: "MIT"}
    assert got[3].inherited_from == "a" and got[4].inherited_from == "" and got[5].inherited_from is None
    assert got[1].is_file and not got[5].is_file and got[5].similarity >= 0.6


def test_near_wordings_and_ties(spark):
    rows = [(1, "x", "Licensed under the Apache License, Version 2.0 (the License)"), (2, "y", "mit"), (3, "z", "the license"), (4, "w", (MIT + " ") * 200)]
    rows += [(i, f"n{i}", "plain words about the weather") for i in range(10, 60)]
    got = scan(spark, rows)
    assert got[1].own == "Apache-2.0" and got[4].own == "MIT" and got[10].own is None


def test_nothing_to_scan(spark):
    assert scan(spark, []) == {}
    assert scan(spark, [(1, "a/b", None)])[1].license is None


def test_rows_without_and_with_the_same_id(spark):
    files = spark.createDataFrame(
        [(None, "p/x", MIT), (7, "p/y", MIT), (7, "q/z", "no notice here"), (None, "q/w", None)], "id long, path string, text string"
    ).withColumn("key", lic.F.lit("clash")).withColumn("own", lic.F.lit("clash")).withColumn("similarity", lic.F.lit(0.1))
    got = sorted((str(r.id), str(r.own), str(r.license)) for r in lic.scan(files).collect())
    assert got == [("7", "MIT", "MIT"), ("7", "None", "None"), ("None", "MIT", "MIT"), ("None", "None", "None")]


def test_a_header_is_found_at_any_size():
    frequency = {"mit": 20, "license": 30, "released": 20, "the": 900, "under": 40, "apache": 10, "version": 15, "2.0": 11, "licensed": 12}
    header = b"Copyright 2020 Jane Doe. This file was released under the MIT license, see below\nfor more"
    for times in (1, 1000, 10_000_000):
        w = lic.Weights(lic.TEMPLATES, {t: k * times for t, k in frequency.items()}, 1000 * times, 0.6)
        name, similarity, *_ = w.best(header)
        assert name == "MIT" and similarity > 0.99
        assert w.best(b"Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0.")[0] == "Apache-2.0"
        assert w.best(b"the weather is mild under the trees and all is well with the river")[0] is None


def test_whole_texts_and_changed_holders(spark):
    texts = dict(lic.TEMPLATES[::-1])  # the first of each name last, so notices win; take texts below
    body = next(t for n, t in lic.TEMPLATES if n == "BSD-3-Clause" and len(t) > 500).replace("the copyright holder nor", "ACME Corp nor")
    rows = [(1, "lib/any.txt", "Copyright (c) 2019 ACME\n\n" + body.replace(". ", ".\n")), (2, "lib/a.c", "int x"), (3, "d/b.c", "int y")]
    rows += [(i, f"n/{i}", "plain words about the weather") for i in range(10, 60)]
    got = scan(spark, rows)
    assert len(texts) >= 20 and len(lic.TEMPLATES) > 30
    assert got[1].own == got[1].license == got[2].license == "BSD-3-Clause" and got[1].is_file and got[3].license is None


def test_hot_directories_are_cut(spark, monkeypatch):
    rows = [(i, f"hot/{i}", "x") for i in range(300)] + [(1000, "hot/LICENSE", MIT), (1001, "cold/y", "x")]
    want = {r.id: r.license for r in scan(spark, rows).values()}
    monkeypatch.setattr(lic, "if_few", lambda rows: rows)
    got = {r.id: r.license for r in scan(spark, rows).values()}
    assert got == want and got[5] == "MIT" and got[1001] is None
