"""Small documents with every oddity that the operators promise to handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, score double, fp string, shard string, root string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randint(1, 6))) for _ in range(n))


def documents(spark, seed: int = 1, n: int = 30):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(0, 60)) for _ in range(n)]
    passage = words(rng, 45)
    texts = [
        None, "", "   \t\n ", "\x0b\x0c", "one", "one two", "ONE TWO", "a b c d", "é ́x É", "<|endoftext|> x<|startoftext|>y", "123 !!!",
        "x" * 40_000, ("long text " * 30_000), *base, *base[:5], base[0] + " tail", passage, "p " + passage + " q", passage + " " + passage,
    ]
    langs, sources = ["en", "fr", None], ["a", "b", "ü", None]
    rows = [(i, t, langs[i % 3], sources[i % 4], None, 7, 0.5, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[20], (None, base[3], "en", "a", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vectors(spark, n: int = 300, size: int = 8, seed: int = 2):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1), 3) for _ in range(size)], i % 3, "x") for i in range(n)]
    hot = [0.5] * size
    rows += [(n + i, hot, 0, "x") for i in range(120)]
    odd = [None, [], [None] * size, [float("nan")] * size, [float("inf")] + [0.0] * (size - 1), [0.0] * size, [-0.0] * size]
    rows += [(1000 + i, v, 0, "x") for i, v in enumerate(odd)]
    rows += [rows[20]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
