"""BPE encoding and decoding with content-defined chunk reuse.

Every text is cut into chunks where a rolling hash of its bytes says so, so equal
passages give equal chunks wherever they stand.  Each distinct chunk of the corpus is
encoded once: one that several blocks of documents hold by the lowest of these blocks,
whose ids travel to the others, and any other by its block.  The cut may fall inside a
word, so each join is repaired by encoding its surroundings anew until they agree with
what either chunk gave.

Where a tokenizer's words never span white space agreement is certain at white space: the
run of characters from the last one before the cut to the first one after it is encoded
anew, and grows over the next chunk where a chunk has none.  For all other tokenizers the
window grows on both sides, word by word, until its first word is one of the left chunk
and its last but one is one of the right chunk, with the same characters and ids, both
further from the cut than the longest special token.  Tokenizers that change the text
before they part it in ways that leave no trace of places are refused.

Nulls and empty texts have no ids and decode to the empty text.  Repeated rows give
repeated rows.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, hash_blocks, of_groups, release, single_thread

#: A cut follows each byte where the low bits of the rolling hash are zero: every 2 KB on average.
CUT_MASK = (1 << 11) - 1
#: Bytes that no chunk exceeds (but for the rest of a character).
LONGEST = 1 << 14
#: Runs that a process remembers; past that it starts afresh.
REMEMBERED = 250_000

#: How a tokenizer parts words for which a run of letters and the signs behind it encode apart.
_PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_AND_SIGNS = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")

_SPACES = b" \t\n\r\x0b\x0c"
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, the last of them its length.

    The hash at a byte covers the 32 bytes up to it: sums of shifted gear values,
    doubled in reach five times.
    """
    n = len(data)
    if n <= 64:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for reach in (1, 2, 4, 8, 16):
        moved = h[:-reach] << np.uint32(reach)
        h = h.copy()
        h[reach:] += moved
    # The high bits have seen all 32 bytes.
    ends = np.flatnonzero((h >> np.uint32(20)) & np.uint32(CUT_MASK) == 0) + 1
    out, at = [], 0
    for end in [*ends.tolist(), n]:
        while end - at > LONGEST:
            at = _whole(raw, at + LONGEST, n)
            out.append(at)
        end = _whole(raw, end, n)
        if end > at:
            out.append(end)
            at = end
    return out


def _whole(raw: np.ndarray, at: int, n: int) -> int:
    """The next place at which a character starts."""
    while at < n and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_hash(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


#: Where a word starts and ends, in characters, and its ids.
Word = tuple[int, int, tuple[int, ...]]


class Codec:
    """A tokenizer that keeps the ids of runs (what stands between white space)."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        probe = ["Don't", "naïve—x", "10%", "<|endoftext|>"]
        #: Whether words never span white space.
        self.spaced = all(self._ids(space.join(probe)) == sum(map(self._ids, probe), []) for space in " \t\n\r\x0b\x0c")
        if not self.spaced:
            self._untrimmed()
            self.words("  ".join(probe) + " \n\n ä")
        #: Characters that the longest special token takes.
        self.reach = max([len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()], default=0)
        settings = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (settings["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: Then "Word", "word" and "word.)" share what has been learnt of "word".
        self.parted = kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [_PARTED]
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.digits = [str(i) for i in range(size)]

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _untrimmed(self) -> None:
        """Places of words with the white space that belongs to them."""
        from tokenizers import processors

        if json.loads(self.tokenizer.to_str())["post_processor"] is not None:
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def words(self, text: str) -> list[Word]:
        """The words that the tokenizer parts a text into, which together are the text."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        out: list[Word] = []
        last = None
        for i, (start, end), word in zip(found.ids, found.offsets, found.word_ids, strict=True):
            if out and word is not None and word == last:
                out[-1] = (out[-1][0], max(end, out[-1][1]), (*out[-1][2], i))
            else:
                out.append((start, end, (i,)))
            last = word
        if [w[0] for w in out] != [0, *(w[1] for w in out)][: len(out)] or (out[-1][1] if out else 0) != len(text):
            raise ValueError("the tokenizer's words don't tile the text; chunks can't be joined exactly")
        return out

    def learn(self, runs: Iterable[bytes]) -> None:
        """Encode the runs that aren't known yet, all in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {r for r in runs if r not in self.known}
        parts = {}
        if self.parted:
            for r in new:
                if m := _WORD_AND_SIGNS.fullmatch(r):
                    parts[r] = (m[1].lower(), m[2])
            self.known.setdefault(b"", b"")
            new = new.difference(parts).union(*parts.values())
        order = [r for r in new if r not in self.known]
        if order:
            found = self.tokenizer.encode_batch_fast([r.decode() for r in order], add_special_tokens=False)
            self.known.update((r, np.array(e.ids, self.dtype).tobytes()) for r, e in zip(order, found, strict=True))
        for r, (word, signs) in parts.items():
            self.known[r] = self.known[word] + self.known[signs]

    def runs(self, runs: list[bytes]) -> bytes:
        """The ids of runs that white space parts, as packed integers."""
        known = self.known
        try:
            return b"".join([known[r] for r in runs])
        except KeyError:
            self.learn(runs)
            return b"".join([self.known[r] for r in runs])

    def decode(self, ids: list[int]) -> str:
        """As the library's decode() that keeps special tokens; joined here if it has no decoder of its own."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        names = self.names
        return " ".join([names[i] for i in ids])


def edges(chunk: bytes) -> tuple[int, int]:
    """Lengths of the run that the chunk begins with and of the one that it ends with.

    Both are the whole length if it has no white space.
    """
    words = chunk.split(None, 1)
    if not words:
        return 0, 0
    head = 0 if chunk[0] in _SPACES else len(words[0])
    if head == len(chunk):
        return head, head
    return head, 0 if chunk[-1] in _SPACES else len(chunk.rsplit(None, 1)[-1])


def encode_chunk(codec: Codec, chunk: bytes) -> tuple[bytes, int, int]:
    """Packed ids of a chunk taken by itself, and the bytes of them that its first and last run take.

    For tokenizers whose words may span white space the ids stand behind the ends and the
    lengths of all words, and the two numbers are how many words and ids there are.
    """
    if not codec.spaced:
        words = codec.words(chunk.decode())
        ids = [i for w in words for i in w[2]]
        shape = np.array([*(w[1] for w in words), *(len(w[2]) for w in words), *ids], np.uint32)
        return shape.tobytes(), len(words), len(ids)
    ids = codec.runs(chunk.split())
    head, tail = edges(chunk)
    return (
        ids,
        len(codec.runs([chunk[:head]])) if head else 0,
        len(codec.runs([chunk[len(chunk) - tail :]])) if tail else 0,
    )


def join_chunks(codec: Codec, parts: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Packed ids of a text from (chunk, its ids, ids of the first run, ids of the last run).

    ``pending`` is the text of a run that reached the end of what has been joined.
    """
    if not codec.spaced:
        found = join_words(codec, [(chunk.decode(), _words_of(packed, n)) for chunk, packed, n, _ in parts])
        return np.array(found, codec.dtype).tobytes()
    out: list[bytes] = []
    pending = b""
    for chunk, ids, first, last in parts:
        head, tail = edges(chunk)
        if head == len(chunk) and chunk:  # no white space: the run goes on
            pending += chunk
            continue
        if pending and head:
            out.append(codec.runs([pending + chunk[:head]]))
        else:
            if pending:
                out.append(codec.runs([pending]))
            out.append(ids[:first])
        out.append(ids[first : len(ids) - last])
        pending = chunk[len(chunk) - tail :] if tail else b""
    if pending:
        out.append(codec.runs([pending]))
    return b"".join(out)


def _words_of(packed: bytes, n: int) -> list[Word]:
    numbers = np.frombuffer(packed, np.uint32).tolist()
    ends, lengths, ids = numbers[:n], numbers[n : 2 * n], numbers[2 * n :]
    out, start, at = [], 0, 0
    for end, k in zip(ends, lengths, strict=True):
        out.append((start, end, tuple(ids[at : at + k])))
        start, at = end, at + k
    return out


def join_words(codec: Codec, parts: list[tuple[str, list[Word]]]) -> list[int]:
    """The ids of a text from its chunks and their words.

    ``now`` are the words of the text ``held`` that may still change at its end.
    """
    out: list[int] = []
    held, now = "", []
    for text, words in parts:
        if not now:
            held, now = text, words
            continue
        left, right = len(now) - 1, 0
        step = 2
        while True:
            while left > 0 and (len(now) - left < step or len(held) - now[left][0] < codec.reach):
                left -= 1
            while right < len(words) and (right < step or words[right - 1][1] < codec.reach):
                right += 1
            start, cut = now[left][0], len(held) - now[left][0]
            whole = right == len(words)
            window = codec.words(held[start:] + (text if whole else text[: words[right - 1][1]]))
            agrees = left == 0 or (window[0][1], window[0][2]) == (now[left][1] - start, now[left][2])
            own = {w: i for i, w in enumerate(words[: right - 1])}
            met = next(
                ((k, own[w]) for k, (a, b, ids) in enumerate(window[:-1]) if a - cut >= codec.reach and (w := (a - cut, b - cut, ids)) in own), None
            )
            if agrees and (met or whole):
                break
            step *= 2
        for _, _, ids in now[:left]:
            out += ids
        if met:
            for _, _, ids in window[: met[0]]:
                out += ids
            held, now = text, words[met[1] :]
        else:
            held, now = held[start:] + text, window
    for _, _, ids in now:
        out += ids
    return out


def _split(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    for b in batches:
        yield from zip(
            b.column("doc_id").to_pylist(), (t or b"" for t in arrow_texts(b.column("text"))), strict=True
        )


def encode(docs: DataFrame, path: str, with_ids: bool = True, encoded: Accumulator | None = None) -> DataFrame:
    """doc_id, text and one row out for each in: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.

    ids (array of int) is left out if ``with_ids`` is false.  A null text counts as empty.
    ``encoded`` counts the chunks that were encoded.

    The texts are shuffled once, by block; all passes read that one exchange.  Between
    passes go hashes of chunks, 20 bytes each, and the ids of shared chunks.
    """
    blocks = hash_blocks(docs)

    def hashed(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, block = set(), 0
        for b in group:
            block = b.column("block")[0].as_py() if b.num_rows else block
            for _, data in _texts([b]):
                found.update(map(chunk_hash, _split(data)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array([block] * len(found), pa.int32())], names=["chunk", "block"]
        )
        release()

    # One row for each chunk and block: a block has merged its own copies, so the hottest
    # chunk has as many rows as there are blocks.
    by_chunk = Window.partitionBy("chunk")
    shared = (
        blocks.groupBy("block")
        .applyInArrow(hashed, "chunk binary, block int")
        .select("chunk", "block", F.min("block").over(by_chunk).alias("owner"), F.count("*").over(by_chunk).alias("n"))
        .filter("n > 1")
    )

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        codec = Codec.load(path)
        wanted = set(right.column("chunk").to_pylist())
        rows = []
        for _, data in _texts(left.to_batches()) if wanted else ():
            for chunk in _split(data):
                if (h := chunk_hash(chunk)) in wanted:
                    wanted.discard(h)
                    if encoded is not None:
                        encoded.add(1)
                    rows.append((h, *encode_chunk(codec, chunk)))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "ids", "first", "last"]
        )

    once = (
        blocks.groupBy("block")
        .cogroup(shared.filter("block = owner").groupBy("block"))
        .applyInArrow(of_groups(own), "chunk binary, ids binary, first int, last int")
    )
    given = shared.select("chunk", "block").join(once, "chunk")

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        codec = Codec.load(path)
        have = dict(
            zip(
                right.column("chunk").to_pylist(),
                zip(*(right.column(c).to_pylist() for c in ("ids", "first", "last")), strict=True),
                strict=True,
            )
        )
        out: list[list] = [[], [], [], []]
        packed: list[bytes] = []
        for doc_id, data in _texts(left.to_batches()):
            parts = []
            for chunk in _split(data):
                h = chunk_hash(chunk)
                if (got := have.get(h)) is None:
                    got = have[h] = encode_chunk(codec, chunk)
                    if encoded is not None:
                        encoded.add(1)
                parts.append((chunk, *got))
            ids = np.frombuffer(raw := join_chunks(codec, parts), codec.dtype).tolist()
            digits = codec.digits
            for column, value in zip(
                out,
                (
                    doc_id,
                    len(ids),
                    hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest(),
                    hashlib.sha256(codec.decode(ids).encode()).hexdigest(),
                ),
                strict=True,
            ):
                column.append(value)
            if with_ids:
                packed.append(raw)
        arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            flat = np.frombuffer(b"".join(packed), codec.dtype).astype(np.int32)
            ends = np.cumsum([0, *(len(p) // codec.dtype.itemsize for p in packed)])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            names.append("ids")
        return pa.Table.from_arrays(arrays, names=names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(of_groups(whole), kind)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) to doc_id and text; null ids give a null text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for b in batches:
            found = [None if x is None else codec.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(texts, "doc_id long, text string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
