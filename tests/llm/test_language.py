"""Languages of texts of several MB."""

import random

import pytest

from graphloom.llm import language

LETTERS = {"de": "eeeennniissrrattdhuäöüßwzkk", "en": "eeettaaooiinnsshhrrdlwyfg", "es": "eeaaooossrrnniiddlctuñóáqj", "fr": "eeeessaaiittnnrruuloéèàçqx"}


def prose(lang, n, seed):
    """About n bytes of words drawn anew, so that nearly every gram of the letters turns up in a long text."""
    rng = random.Random(f"{lang}{seed}")
    words = [" ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 9))) for _ in range(4000)) for _ in range(1 + n // 25_000)]
    return " ".join(words)[:n]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(k, 1500, i), k) for i, k in enumerate(list(LETTERS) * 60)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("size", [100_000, 3_000_000])
def test_long_texts_keep_their_language(model, size):
    texts = [prose(k, size, -1).encode() for k in LETTERS]
    assert language.predict(model, texts)[0] == list(LETTERS)


def test_only_long_texts_to_learn_from(spark):
    rows = [(i, prose(k, 70_000, i), k) for i, k in enumerate(["de", "en"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()} == {i: k for i, _, k in rows}


def test_stretches_cover_the_text():
    data = ("é" * 50_001 + "x").encode()
    parts = language.stretches(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= language.STRETCH + 3 and all(p.decode() for p in parts)
    assert language.stretches(b"1 " * 40_000 + b"word " * 8000)[-1].endswith(b"word ") and language.stretches(b"") == [b""]


def test_stage_drops_low_scores(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*(prose(k, 900, -2) for k in LETTERS), "1 2", None, "x", "漢字"])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in language.identify(docs, model).collect()}
    assert max(scores[6], scores[7]) < language.LEAST
    assert {r.doc_id for r in language.accepted(docs, model).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in language.accepted(docs, model, 0.0).collect()} == {0, 1, 2, 3, 6, 7}


def test_stage_without_a_model_keeps_letters(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert language.train(docs) is None
    assert {r.doc_id for r in language.accepted(docs, None).collect()} == {1, 4}
