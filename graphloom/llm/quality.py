"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Bytes become
learned vectors; learned filters of eight bytes run over each chunk and keep their
largest response; a text is the mean of its chunks, from which a small hidden layer gives
one probability.  Training minimises cross entropy by Adam, with derivatives written out
in numpy, on a bounded sample of labelled rows; scoring reads every text whole, a fixed number of chunks at a time.

A null text counts as empty; an empty one has a single chunk of padding and so the score
that the network gives to nothing.  Repeated rows give repeated rows; rows and labels that
repeat count once in training.  Without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, release

HOP = 256  # bytes from a chunk's start to the next one's
STEP = 4  # bytes from a filter's place to the next one's
REACH = 2 * STEP  # bytes that a filter sees; chunks overlap by REACH - STEP
VECTOR, FILTERS, HIDDEN = 8, 32, 24
THRESHOLD = 0.7
#: Chunks that are scored at once, and that a text of the training sample gives.
CHUNKS = 1024
TRAINED = 64


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, padded with zero bytes, and the row at which each text starts."""
    size = HOP + REACH - STEP
    counts = np.array([max(1, -(-len(t) // HOP)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros((int(counts.sum()), size), np.uint8)
    for t, at, n in zip(texts, starts.tolist(), counts.tolist(), strict=True):
        flat = np.zeros(n * HOP + size - HOP, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(flat, (n, size), (HOP, 1))
    return out, starts


def spread(data: bytes, most: int = TRAINED) -> bytes:
    """A text of at most ``most`` chunks, or so many of its chunks, evenly over all of it, one after another."""
    n = -(-len(data) // HOP)
    if n <= most:
        return data
    return b"".join([data[k * n // most * HOP : k * n // most * HOP + HOP] for k in range(most)])


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "bytes": normal(256, VECTOR, scale=0.5),
            "filters": normal(2, STEP * VECTOR, FILTERS, scale=0.2),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=0.4),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=0.4),
            "out_shift": np.zeros(1, np.float32),
        }

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors by group of STEP bytes, and each filter's response at each place."""
        p = self.p
        x = p["bytes"][chunks].reshape(len(chunks), -1, STEP * VECTOR)
        both = x @ np.concatenate([p["filters"][0], p["filters"][1]], axis=1)
        return x, both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:] + p["shift"]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [
                np.maximum(self.responses(chunks[at : at + CHUNKS])[1].max(axis=1), 0)
                for at in range(0, len(chunks), CHUNKS)
            ]
        )

    def combine(self, means: np.ndarray) -> np.ndarray:
        p = self.p
        h = np.maximum(means @ p["hidden"] + p["hidden_shift"], 0)
        return 1 / (1 + np.exp(-np.clip((h @ p["out"] + p["out_shift"][0]).astype(np.float64), -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        chunks, starts = chunked(texts)
        counts = np.diff([*starts, len(chunks)])
        return self.combine(np.add.reduceat(self.pooled(chunks), starts, axis=0) / counts[:, None])

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of a batch and its derivative by each parameter."""
        p = self.p
        chunks, starts = chunked(texts)
        counts = np.diff([*starts, len(chunks)])
        of = np.repeat(np.arange(len(texts)), counts)
        x, r = self.responses(chunks)
        best = r.argmax(axis=1)
        top = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0]
        means = np.add.reduceat(np.maximum(top, 0), starts, axis=0) / counts[:, None]
        a = means @ p["hidden"] + p["hidden_shift"]
        h = np.maximum(a, 0)
        y = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_shift"][0], -30, 30)))
        loss = -np.mean(np.log(np.where(labels == 1, y, 1 - y) + 1e-9))
        dz = ((y - labels) / len(texts)).astype(np.float32)
        g = {"out": h.T @ dz, "out_shift": dz.sum(keepdims=True)}
        da = dz[:, None] * p["out"] * (a > 0)
        g["hidden"], g["hidden_shift"] = means.T @ da, da.sum(0)
        dtop = (da @ p["hidden"].T / counts[:, None])[of] * (top > 0)  # (chunks, filters)
        g["shift"] = dtop.sum(0)
        # Only the place of the largest response passes anything back.
        g["filters"], dx = np.zeros_like(p["filters"]), np.zeros_like(x)
        rows = np.arange(len(chunks))
        for f in range(FILTERS):
            for half in (0, 1):
                seen = x[rows, best[:, f] + half]
                g["filters"][half, :, f] = dtop[:, f] @ seen
                dx[rows, best[:, f] + half] += dtop[:, f, None] * p["filters"][half, :, f]
        touched = np.abs(dx).sum(axis=2) > 0
        letters = chunks.reshape(len(chunks), -1, STEP)[touched].ravel()
        g["bytes"] = np.zeros_like(p["bytes"])
        np.add.at(g["bytes"], letters, dx[touched].reshape(-1, VECTOR))
        return float(loss), g


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps, total = 0, max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, g = net.gradients([texts[i] for i in rows], labels[rows])
            steps += 1
            now = rate * (1 - 0.9 * steps / total)
            for k, v in net.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                v -= now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return net


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, chunks: int = TRAINED) -> Network | None:
    """Fit on at most ``sample`` labelled texts, the first by a hash, of ``chunks`` chunks each at most.

    Both bounds are parameters.  A longer text gives chunks from all of it; scoring reads
    every text whole.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(remainder(4) != 2).select("doc_id", "quality").distinct()
    n = known.count()
    if not n:
        return None
    # A threshold on a hash, with room to spare, stands for the order, so only the sample is sorted.
    by_hash = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    bound = int(min(1.0, 1.3 * sample / n + 100 / n) * (1 << 40)) + 1
    chosen = known.select("doc_id", "quality", by_hash.alias("h")).filter(F.col("h") < bound).orderBy("h", "doc_id", "quality").limit(2 * sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spread(t or b"", chunks) for t in arrow_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "doc_id", "quality")), pa.array(found, pa.binary())], names=["h", "doc_id", "quality", "data"])
            release()

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows of three numbers
        .select("h", F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
        .mapInArrow(cut, "h long, doc_id long, quality int, data binary")
        .distinct()
        .orderBy("h", "doc_id", "quality", "data")
        .limit(sample)
        .collect()
    )
    return fit([bytes(r.data) for r in rows], np.array([r.quality for r in rows], np.float32)) if rows else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some 15 KB

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            texts = [t or b"" for t in arrow_texts(b.column("text"))]
            out, at = np.full(len(texts), 0.5), 0
            while net is not None and at < len(texts):  # about 2 MB of text at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 2 << 20):
                    size += len(texts[end])
                    end += 1
                out[at:end] = net.scores(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, train(docs, labels)).select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
