"""Substring dedup: words of a 20-word window that starts earlier elsewhere are removed.

The suffixes of the corpus, one for each word, are cut at 20 words and merged into the
top of a suffix tree.  Its internal nodes at that depth are the windows that occur more
than once; every occurrence but the first of such a node is a repeat, and the union of
the words they cover is what goes.

Three steps find them without a suffix ever travelling with its words:

1. Pruning.  A window can only repeat if its least 8-word prefix (by hash, over the 13
   that it holds) does, so blocks of documents exchange only these, about one for seven
   words, and learn which of them other blocks hold too.
2. Subtrees.  A suffix that survives becomes the path of two edges, the hash of its
   8-word prefix and that of the 12 words below.  Prefixes of variable length split the
   suffixes into groups that fit in memory: the leading bits of the first edge, and for a
   group that stays too large also bits of the second.  Each group sorts its suffixes,
   which lines up the leaves of every node.  A block has merged its own suffixes before,
   so the most frequent passage has one leaf for each block.
3. Removal.  Blocks are ranges of doc_id, so the lowest block of a node has the first
   occurrence.  The others are told the node, and each block marks its words.

The two hashes together have 128 bits.  Nulls and empty texts have no words.  Rows with
equal doc_id, or none, stand in the order of XXH64 of their texts, then of the texts, and
may lie in several blocks.  A row is removed from, never
removed: each gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import arrow_texts, mix64, of_group, of_groups, range_blocks

WINDOW = 20
PREFIX = 8
#: Suffixes that one group may hold before its prefix grows.
GROUP_SUFFIXES = 1 << 21
_BASES = [np.uint64(int(x) | 1) for x in np.random.default_rng(8).integers(1 << 62, 1 << 63, 2)]
#: Windows that are hashed at once.
TOGETHER = 1 << 19
#: Text bytes of a block, and blocks whose keys a bucket should take.
BLOCK_BYTES, BLOCKS_A_BUCKET = 6 << 20, 4
#: Bytes whose word hashes are computed at once.
SEGMENT = 1 << 18
_BYTE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2^64, at least n of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SEGMENT + 1), base % (1 << 64), np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps)
    return known


def _space(raw: np.ndarray) -> np.ndarray:
    return (raw - np.uint8(9) < 5) | (raw == 32)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all words of some bytes: polynomials of the bytes, from prefix sums."""
    inverse = pow(_BYTE, -1, 1 << 64)
    hashes, places = [], []
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and not _space(raw[end - 1 : end])[0]:  # end behind white space
            back = np.flatnonzero(_space(raw[at:end]))
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                end = min(n, end + SEGMENT)
        part = raw[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_space(part)
        turn = np.diff(inside)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE, len(part))[: len(part)], out=sums[1:])
        value = (sums[last] - sums[first]) * _powers(inverse, len(part))[first]
        hashes.append(mix64(value + (last - first).astype(np.uint64) * _BASES[0]))
        places.append(first + at)
        at = end
    none = np.zeros(0, np.uint64)
    return np.concatenate([*hashes, none]), np.concatenate([*places, none.astype(np.int64)])


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one space; a part of the text at a time is held as words."""
    kept, at, word = [], 0, 0
    while at < len(text):
        cut = _SPACE.search(text, at + SEGMENT)
        end = cut.end() if cut else len(text)
        words = text[at:end].split()  # at the same bytes as _words
        flags = gone[word : word + len(words)]
        if flags.any():
            part = b" ".join([w for w, g in zip(words, flags.tolist(), strict=True) if not g])
        else:
            part = b" ".join(words)
        if part:
            kept.append(part)
        at, word = end, word + len(words)
    return b" ".join(kept)


def _rolled(w: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` words, built by doubling."""
    out, have, done = None, w, 0
    power, size = base, 1
    while length:
        if length & size:
            if out is None:
                out, done = have, size
            else:
                n = min(len(out), len(have) - done) if len(have) > done else 0
                out, done = out[:n] * power + have[done : done + n], done + size
            length ^= size
        if length:
            have = have[: len(have) - size] * power + have[size:] if len(have) > size else have[:0]
            power, size = np.uint64(int(power) ** 2 % (1 << 64)), size * 2
    return out


class Block:
    """The documents of a block and the hashes of all their windows.

    ``pruning`` asks for the least prefixes too, which removal doesn't need.
    """

    def __init__(self, group: pa.Table, pruning: bool = True):
        ids, places, texts = group.column("doc_id").to_pylist(), group.column("place").to_pylist(), []
        for b in group.select(["text"]).to_batches():
            texts += arrow_texts(b.column("text"))
        late = 1 << 63
        rows = sorted(range(len(ids)), key=lambda i: (late if ids[i] is None else ids[i], places[i], texts[i] or b""))
        self.order = rows
        self.ids = [ids[i] for i in rows]
        self.texts = [texts[i] or b"" for i in rows]
        lengths = np.array([len(t) + 1 for t in self.texts], np.int64)
        w, places = _words(np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8))
        #: Where each document's words start among those of the block.
        self.starts = np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths)]))
        del places
        n = max(0, len(w) - WINDOW + 1)
        inside = np.ones(n, bool)  # windows that don't leave their document
        for end in self.starts[1:-1]:
            inside[max(0, end - WINDOW + 1) : end] = False
        self.at = np.flatnonzero(inside)
        self.top, self.below = np.empty(len(self.at), np.uint64), np.empty(len(self.at), np.uint64)
        self.least = np.empty(len(self.at) if pruning else 0, np.uint64)
        done = 0
        for low in range(0, n, TOGETHER):  # windows that start in so many words, at a time
            part = w[low : low + TOGETHER + WINDOW - 1]
            here = np.flatnonzero(inside[low : low + TOGETHER])
            to = done + len(here)
            prefix = mix64(_rolled(part, PREFIX, _BASES[0]))
            self.top[done:to] = prefix[here]
            self.below[done:to] = mix64(_rolled(part, WINDOW - PREFIX, _BASES[1]))[here + PREFIX]
            if pruning:
                least, size, span = prefix, 1, WINDOW - PREFIX + 1
                while size * 2 <= span:
                    least, size = np.minimum(least[:-size], least[size:]), size * 2
                if size < span:
                    least = np.minimum(least[: size - span], least[span - size :])
                self.least[done:to] = mix64(least[here] * _BASES[1])  # least ones are small; spread them evenly again
            done = to

    def pruning(self) -> np.ndarray:
        return np.unique(self.least)

    def suffixes(self, shared: np.ndarray) -> np.ndarray:
        """Distinct windows (n, 2) whose pruning key other blocks hold too."""
        keep = np.isin(self.least, shared)
        top, below = self.top[keep], self.below[keep]
        first = _first_flags(top, below)
        return np.stack([top[first], below[first]], axis=1)

    def repeats(self, foreign: np.ndarray) -> np.ndarray:
        """A flag for each word: whether a window covers it that starts earlier here or in a lower block."""
        again = ~_first_flags(self.top, self.below)
        if len(foreign):
            # Hashed to a table of bits first: most windows of the block are nowhere else.
            foreign = foreign[np.lexsort((foreign[:, 1], foreign[:, 0]))]
            wide = np.uint64(64 - max(10, int(len(foreign) * 16).bit_length()))
            there = np.zeros(1 << int(np.uint64(64) - wide), bool)
            there[(foreign[:, 1] * _BASES[0]) >> wide] = True
            maybe = np.flatnonzero(~again & there[(self.below * _BASES[0]) >> wide])
            top, below = self.top[maybe], self.below[maybe]
            at = np.searchsorted(foreign[:, 0], top)
            while len(maybe):  # several nodes can share their first edge
                at = np.minimum(at, len(foreign) - 1)
                same = foreign[at, 0] == top
                again[maybe[same & (foreign[at, 1] == below)]] = True
                go = same & (foreign[at, 1] < below) & (at + 1 < len(foreign))
                maybe, top, below, at = maybe[go], top[go], below[go], at[go] + 1
        edge = np.zeros(self.starts[-1] + 1, np.int32)
        edge[self.at[again]] += 1  # every window has a place of its own
        edge[self.at[again] + WINDOW] -= 1
        return np.cumsum(edge)[:-1] > 0


def _first_flags(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Whether each pair stands first among its equals."""
    first = np.ones(len(top), bool)
    if not len(top):
        return first
    # Both edges in one number: where that is unique so is the pair.
    key = top ^ (below * _BASES[1])
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if len(same):
        rows = np.unique(np.concatenate([order[same], order[same + 1]]))
        pairs = np.stack([top[rows], below[rows]], axis=1)
        first[rows] = False
        first[rows[_first_of_each(pairs)]] = True
    return first


def _first_of_each(pairs: np.ndarray) -> np.ndarray:
    """Rows at which each distinct pair stands first."""
    if not len(pairs):
        return np.zeros(0, np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))  # stable: equal pairs stay in order
    s = pairs[order]
    return order[np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])]


def _packed(rows: list[tuple[int, ...]], blobs: list[bytes], names: list[str]) -> pa.Table:
    columns = [pa.array(c, pa.int32()) for c in (zip(*rows, strict=True) if rows else [[]] * (len(names) - 1))]
    return pa.Table.from_arrays([*columns, pa.array(blobs, pa.binary())], names=names)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of sorted keys by equal ranges of their (first) value."""
    lead = keys if keys.ndim == 1 else keys[:, 0]
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(lead, bounds), [len(lead)]])
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), keys[at[b] : at[b + 1]]


def _shared(groups: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """From (block, its distinct keys): (block, those in several blocks, the lowest block of each)."""
    block = np.concatenate([np.full(len(k), b, np.int64) for b, k in groups])
    keys = np.concatenate([k for _, k in groups])
    columns = keys.reshape(len(keys), -1)
    order = np.lexsort((block, *columns.T[::-1]))
    columns, block = columns[order], block[order]
    new = np.concatenate([[True], (columns[1:] != columns[:-1]).any(axis=1)])
    node = np.cumsum(new) - 1
    several = np.bincount(node)[node] > 1
    lowest = block[new][node]
    rows = np.flatnonzero(several)
    rows = rows[np.argsort(block[rows], kind="stable")]
    parts = np.split(rows, np.flatnonzero(np.diff(block[rows])) + 1) if len(rows) else []
    return [(int(block[p[0]]), columns[p], lowest[p]) for p in parts]


def remove_repeats(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; ``whole`` adds kept and rest.

    kept_sha256 is of the kept words joined by one space; so is kept, but for texts that lose
    nothing, which come back as they are.  rest is the struct of all columns but text.
    """
    blocks = range_blocks(docs, BLOCK_BYTES, whole)
    buckets = 1 + (blocks.agg(F.max("block")).first()[0] or 0) // BLOCKS_A_BUCKET

    def scan(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        rows, blobs = [], []
        for bucket, keys in _by_bucket(Block(group).pruning(), buckets):
            rows.append((bucket, block))
            blobs.append(keys.tobytes())
        return _packed(rows, blobs, ["bucket", "block", "keys"])

    def prune(group: pa.Table) -> pa.Table:
        parts = [
            (b, np.frombuffer(k, np.uint64))
            for b, k in zip(group.column("block").to_pylist(), group.column("keys").to_pylist(), strict=True)
        ]
        found = _shared(parts)
        return _packed([(b,) for b, _, _ in found], [k.tobytes() for _, k, _ in found], ["block", "keys"])

    shared = (
        blocks.groupBy("block")
        .applyInArrow(of_group(scan), "bucket int, block int, keys binary")
        .groupBy("bucket")
        .applyInArrow(of_group(prune), "block int, keys binary")
    )

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, blobs = [], []
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            known = np.concatenate([np.frombuffer(k, np.uint64) for k in right.column("keys").to_pylist()])
            pairs = Block(left).suffixes(known)
            for bucket, part in _by_bucket(pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], buckets):
                rows.append((bucket, block))
                blobs.append(part.tobytes())
        return _packed(rows, blobs, ["bucket", "block", "keys"])

    def subtree(group: pa.Table) -> pa.Table:
        parts = [
            (b, np.frombuffer(k, np.uint64).reshape(-1, 2))
            for b, k in zip(group.column("block").to_pylist(), group.column("keys").to_pylist(), strict=True)
        ]
        total = sum(len(k) for _, k in parts)
        split = max(1, -(-total // GROUP_SUFFIXES))  # longer prefixes where the group is too large
        told: list[tuple[int, np.ndarray]] = []
        for s in range(split):
            some = [(b, k[k[:, 1] % np.uint64(split) == s]) for b, k in parts] if split > 1 else parts
            told += [(b, k[low != b]) for b, k, low in _shared(some)]
        told = [(b, k) for b, k in told if len(k)]
        return _packed([(b,) for b, _ in told], [np.ascontiguousarray(k).tobytes() for _, k in told], ["block", "keys"])

    nodes = (
        blocks.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInArrow(of_groups(suffixes), "bucket int, block int, keys binary")
        .groupBy("bucket")
        .applyInArrow(of_group(subtree), "block int, keys binary")
    )

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, pruning=False)
        blobs = right.column("keys").to_pylist()
        foreign = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
        gone = block.repeats(foreign)
        out: list[list] = [[], [], [], [], []]
        for i, (doc_id, text) in enumerate(zip(block.ids, block.texts, strict=True)):
            mine = gone[block.starts[i] : block.starts[i + 1]]
            lost = int(np.count_nonzero(mine))
            kept = _kept(text, mine)
            row = (doc_id, len(mine), lost, hashlib.sha256(kept).hexdigest(), (kept if lost else text).decode())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        found = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        if not whole:
            return found.drop_columns(["kept"])
        return found.append_column("rest", left.column("rest").take(pa.array(block.order, pa.int64())))

    kind = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if whole:
        kind = kind.add("kept", "string").add("rest", blocks.schema["rest"].dataType)
    return blocks.groupBy("block").cogroup(nodes.groupBy("block")).applyInArrow(of_groups(remove), kind)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs without their repeats: text, and n_chars where there is one, are new if words went."""
    found = remove_repeats(docs)
    lost = F.col("n_removed") > 0

    def column(name: str) -> F.Column:
        if name == "text":
            return F.col("kept").alias("text")
        old = F.col("rest").getField(name)
        if name == "n_chars":
            return F.when(lost, F.length("kept")).otherwise(old).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return old.alias(name)

    return found.select(*[column(c) for c in docs.columns])


def op10_substring(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return remove_repeats(table(spark, sf_dir, "documents"), whole=False)
