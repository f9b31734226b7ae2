"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams, lower-cased, for n from 1 to 4, hashed to a fixed
number of columns: presence, not counts.  The kernel of two texts is the number of
columns they share over the root of the product of how many each has.  Nyström: the
kernel is represented by its values against landmark texts, whitened by their own kernel
matrix; one ridge regression for each language against the rest is fitted on these
features.  Scoring multiplies a batch's presence matrix by the landmarks' and the result
by the weights.

The set of a very long text would be nearly all columns, in any language.  So a text is cut
into equal stretches of at most 8 KB, and its row is the mean of theirs; as all that
follows is linear, its scores are the means of its stretches' scores.  Stretches without a
letter don't count where another has one.

Training reads a bounded sample of labelled rows, as many for each language (``sample`` and
``landmarks`` are parameters), each whole; prediction reads every text whole.  A text that is null
or has no letter is ``und`` with score 0.  Other scores are the softmax of the regressions.
Languages are compared by score, ties go to the first by code point.  Repeated rows give
repeated rows.  With no labelled row to learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, release

COLUMNS = 1 << 12
LONGEST_GRAM = 4
BATCH = 512
STRETCH = 1 << 13
#: Sharpness of the softmax that turns regression outputs, about 0 and 1, into a score.
SHARPNESS = 6.0
#: Least score of a text that ``accepted`` keeps: its language is as likely as all others together.
LEAST = 0.5
_FACTORS = [np.uint32(int(x) | 1) for x in np.random.default_rng(3).integers(1 << 30, 1 << 32, LONGEST_GRAM)]
_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(data: bytes) -> bool:
    if len(data.translate(None, _LETTERS)) < len(data):
        return True
    return any(map(str.isalpha, data.decode(errors="replace")))


def presence(data: bytes) -> np.ndarray:
    """A flag for each column: whether the text has an n-gram that hashes to it."""
    out = np.zeros(COLUMNS, bool)
    if not data.isascii():
        data = data.decode(errors="replace").lower().encode()
    raw = np.frombuffer(data.translate(_ASCII), np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (COLUMNS.bit_length() - 1))
    code = raw
    for n in range(LONGEST_GRAM):
        if n:
            code = (code[:-1] << np.uint32(8)) | raw[n:]
        if not len(code):
            break
        out[(code * _FACTORS[n] + _FACTORS[n]) >> shift] = True
    return out


def stretches(data: bytes) -> list[bytes]:
    """Equal parts that together are the text, cut between characters; those with letters, if any has one."""
    n = -(-len(data) // STRETCH)
    if n <= 1:
        return [data]
    cuts = [0]
    for k in range(1, n):
        at = k * len(data) // n
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(at)
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return [p for p in parts if has_letter(p)] or parts


def matrix(texts: list[bytes]) -> np.ndarray:
    """Normalised presence, the mean of a text's stretches: products of rows are (mean) kernel values."""
    m = np.zeros((len(texts), COLUMNS), np.float32)
    for row, t in zip(m, texts, strict=True):
        parts = stretches(t)
        for part in parts:
            flags = presence(part)
            row[flags] += 1.0 / (len(parts) * np.sqrt(max(1, np.count_nonzero(flags))))
    return m


def _packed(data: bytes) -> bytes:
    """The row of a text for the driver: the flags as bits where one stretch is all, else the numbers."""
    return np.packbits(presence(data)).tobytes() if len(data) <= STRETCH else matrix([data])[0].tobytes()


def _unpacked(row: bytes) -> np.ndarray:
    if len(row) > COLUMNS // 8:
        return np.frombuffer(row, np.float32)
    flags = np.unpackbits(np.frombuffer(row, np.uint8)).astype(np.float32)
    return flags / np.float32(np.sqrt(max(1, np.count_nonzero(flags))))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # (columns, landmarks)
    weights: np.ndarray  # (landmarks, languages), whitening folded in
    bias: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = (matrix(texts) @ self.landmarks) @ self.weights + self.bias
        e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def fit(m: np.ndarray, languages: list[str], landmarks: int = 160, ridge: float = 1e-2) -> Model:
    """From the rows of texts, as in ``matrix``, and their languages."""
    names = sorted(set(languages), key=lambda x: x.encode())
    # Landmarks in turn from each language, in the order given.
    of = {n: [i for i, x in enumerate(languages) if x == n] for n in names}
    chosen = [of[n][k] for k in range(len(m)) for n in names if k < len(of[n])][:landmarks]
    marks = m[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    features = (m @ marks.T).astype(np.float64) @ white
    wanted = np.array([[float(x == n) for n in names] for x in languages])
    # Every language weighs the same, however many texts it has.
    weight = np.array([len(m) / (len(names) * len(of[x])) for x in languages])[:, None]
    mean, aim = (weight * features).sum(0) / weight.sum(), (weight * wanted).sum(0) / weight.sum()
    centred = features - mean
    solved = np.linalg.solve(
        centred.T @ (weight * centred) + ridge * len(m) * np.eye(centred.shape[1]) / 100,
        centred.T @ (weight * (wanted - aim)),
    )
    return Model(
        names, np.ascontiguousarray(marks.T), (white @ solved).astype(np.float32), (aim - mean @ solved).astype(np.float32)
    )


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, sample: int = 1500, landmarks: int = 160) -> Model | None:
    """Fit on ``sample`` labelled texts in all, in equal parts for each language, the first by a hash of doc_id and text.

    The languages come from all labelled rows, one row each to the driver.  A text is taken
    whole, whatever its size; only its row of the kernel, at most 16 KB, leaves its task.
    Rows that repeat count once.
    """
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 40))
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder(3) != 1).withColumn("_h", spread)
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    if not counts:
        return None
    part = max(1, sample // len(counts))
    # A threshold on the hash, with room to spare, stands for the order, so only the sample is sorted.
    bounds = [c for k, n in counts.items() for c in (F.lit(k), F.lit(int(min(1.0, (1.4 * part + 40) / n) * (1 << 40)) + 1))]
    chosen = labelled.filter(F.col("_h") < F.element_at(F.create_map(*bounds), F.col("lang")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = arrow_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array([_packed(t) for t in texts], pa.binary())], names=["lang", "h", "row"])
            release()

    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "row"))
    rows = (
        chosen.select("lang", F.col("_h").alias("h"), "text")
        .mapInArrow(each, "lang string, h long, row binary")
        .distinct()
        .withColumn("at", first)  # over the sample
        .filter(F.col("at") <= part)
        .orderBy("at", "lang")
        .collect()
    )
    return fit(np.stack([_unpacked(r.row) for r in rows]), [r.lang for r in rows], landmarks)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    sc = docs.sparkSession.sparkContext
    # Landmarks x columns floats, a few MB by the parameters of the fit.
    held = sc.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(held.value, [t or b"" for t in arrow_texts(b.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double")


def predict(model: Model | None, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        found = model.scores([texts[i] for i in part])
        best = found.argmax(axis=1)
        for i, k in zip(part, best.tolist(), strict=True):
            langs[i] = model.languages[k]
        scores[part] = found[np.arange(len(part)), best]
    return langs, scores


def accepted(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows of docs, unchanged, that have a language with a score of ``least`` or more.

    Those that are ``und`` go.  Without a model nothing is known but whether a text has a
    letter, and those that have one stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in arrow_texts(b.column(at))]
            if held.value is None:
                keep = [has_letter(t) for t in texts]
            else:
                langs, scores = predict(held.value, texts)
                keep = [x != "und" and s >= least for x, s in zip(langs, scores.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))
            release()

    return docs.mapInArrow(each, docs.schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score"
    )
