"""Text operators against brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import bpe, common, language, mixing, quality, sharding, simhash, substring
from tests.llm.helpers import documents, empty, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(common.hash_blocks, "__defaults__", (20_000,))


# --- BPE


def test_bpe_matches_the_library(spark, small_blocks):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = documents(spark).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(documents(spark), PATH).collect())
    want = []
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_bpe_round_trip_and_empty(spark):
    assert bpe.encode(empty(spark), PATH).collect() == []
    docs = spark.createDataFrame([(1, "Hello  World"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {1: "hello</w> world</w>", 2: ""}


def test_chunks_cover_and_repeat():
    rng = random.Random(3)
    data = bytes(rng.randrange(32, 127) for _ in range(60_000))
    ends = bpe.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= bpe.LONGEST
    inner = data[5000:50_000]
    shared = {data[a:b] for a, b in zip(ends, ends[1:])} & {inner[a:b] for a, b in zip(bpe.cuts(inner), bpe.cuts(inner)[1:])}
    assert len(shared) >= len(bpe.cuts(inner)) - 4
    umlauts = ("ä" * 30_000).encode()
    at = 0
    for end in bpe.cuts(umlauts):
        umlauts[at:end].decode()
        at = end


def test_joins_of_any_cut_are_exact():
    codec = bpe.Codec.load(PATH)
    text = "it's naïve: don't re-encode 1234 <|endoftext|>x  ünïcödé\tabc" * 3
    data = text.encode()
    want = codec._ids(text)
    rng = random.Random(5)
    for _ in range(60):
        places = sorted(rng.sample([i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80], 6))
        parts = [data[a:b] for a, b in zip([0, *places], [*places, len(data)])]
        joined = bpe.join_chunks(codec, [(p, *bpe.encode_chunk(codec, p)) for p in parts])
        assert np.frombuffer(joined, codec.dtype).tolist() == want


def test_each_distinct_chunk_is_encoded_once(spark, small_blocks):
    rng = random.Random(11)
    passage = words(rng, 3000)
    docs = spark.createDataFrame([(i, f"{words(rng, 20)} {passage} {words(rng, 400)}") for i in range(12)], "doc_id long, text string")
    chunks = [c for r in docs.collect() for c in bpe._split(r.text.encode())]
    count = spark.sparkContext.accumulator(0)
    bpe.encode(docs, PATH, encoded=count).collect()
    assert count.value == len(set(chunks)) < 0.7 * len(chunks)


def test_tokenizers_that_join_over_white_space(spark, small_blocks):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    codec = bpe.Codec.load(path)
    assert not codec.spaced
    rng = random.Random(5)
    text = "it's  naïve: don't\n\n\n re-encode   1234 <|endoftext|>x  ünïcödé\t漢字 abc's   \n" * 3
    for _ in range(200):
        places = sorted(rng.sample(range(1, len(text)), 6))
        parts = [text[a:b].encode() for a, b in zip([0, *places], [*places, len(text)])]
        joined = bpe.join_chunks(codec, [(p, *bpe.encode_chunk(codec, p)) for p in parts])
        assert np.frombuffer(joined, codec.dtype).tolist() == t.encode(text, add_special_tokens=False).ids
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.encode(documents(spark), path).collect())
    want = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in documents(spark).collect()]
    assert got == sorted((str(i), len(ids), sha(" ".join(map(str, ids)))) for i, ids in want)


# --- SimHash


def brute_fingerprint(text):
    import xxhash

    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(spark):
    rows = documents(spark).collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    groups = brute_groups(fps)
    least = {}
    for r, g in zip(rows, groups):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == want


def test_simhash_stage_keeps_one_of_each(spark):
    docs = documents(spark)
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    assert simhash.one_of_each(empty(spark)).collect() == [] and simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [4, 7])
def test_balls_find_all_links(bits):
    rng = random.Random(bits)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
    fps = np.array(sorted(fps), np.uint64)
    left, right = [], []
    for bucket in range(1 << bits):
        some = fps[np.bitwise_count((fps >> np.uint64(64 - bits)) ^ np.uint64(bucket)) <= 2]
        a, b = simhash.stars(some, bucket, bits)
        left += a.tolist()
        right += b.tolist()
    place = {f: i for i, f in enumerate(fps.tolist())}
    got = simhash._components(np.array([place[x] for x in left]), np.array([place[x] for x in right]), len(fps))
    groups = brute_groups(fps.tolist())
    assert len(set(zip(got.tolist(), groups))) == len(set(groups)) == len(set(got.tolist()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(500, 500)]
    found = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: i - i % 50 for i in range(200) if i % 50}


# --- substring dedup


def brute_substring(rows):
    import xxhash

    def place(i):
        data = (rows[i].text or "").encode()
        h = xxhash.xxh64_intdigest(data, 42)  # as Spark's, signed
        return (rows[i].doc_id is None, rows[i].doc_id or 0, h - (h >> 63 << 64), data)

    order = sorted(range(len(rows)), key=place)
    seen, out = set(), {}
    for i in order:
        w = (rows[i].text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (str(rows[i].doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


@pytest.mark.parametrize("size", [12 << 20, 3000])
def test_substring(spark, monkeypatch, size):
    monkeypatch.setattr(substring, "BLOCK_BYTES", size)
    docs = documents(spark)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, whole=False).collect())
    assert got == brute_substring(docs.collect())


def test_substring_without_ids(spark, monkeypatch):
    """Nine of ten rows have no doc_id, one id repeats, one text is long: blocks stay even and nothing is lost."""
    monkeypatch.setattr(substring, "BLOCK_BYTES", 40_000)
    rng = random.Random(12)
    shared = [words(rng, 30) for _ in range(20)]
    text = lambda: " ".join([words(rng, rng.randint(0, 30)), rng.choice(shared), words(rng, 5)])
    rows = [(None if i % 10 else 7 if i % 20 else i, text()) for i in range(600)] + [(3, " ".join(text() for _ in range(700)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, whole=False).collect())
    assert got == brute_substring(docs.collect())
    counts = {r.block: r["count"] for r in common.range_blocks(docs, 40_000).groupBy("block").count().collect()}
    assert len(counts) > 8 and max(counts.values()) < 200


def test_substring_stage(spark):
    docs = documents(spark)
    out = substring.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    lost = {str(r.doc_id): r.n_removed for r in substring.remove_repeats(docs, whole=False).collect()}
    texts = {str(r.doc_id): r.text or "" for r in docs.collect()}
    for r in out.collect():
        if not lost[str(r.doc_id)] and r.doc_id is not None:
            assert r.text == texts[str(r.doc_id)]
    assert substring.remove_repeats(empty(spark)).collect() == [] and substring.cleaned(empty(spark)).collect() == []


# --- language, quality


def test_language(spark):
    en, fr = "the cat sat on the mat with this and that ", "le chat est dans la maison avec une autre "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 4), "en" if i % 2 else "fr") for i in range(80)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 34 !!", None), (103, en, None), (104, fr * 2000, None), (None, fr, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", language.F.lit("x"))
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[100].score == 0
    assert got[103].lang_pred == "en" and got[104].lang_pred == got[None].lang_pred == "fr"
    assert all(got[i].lang_pred == r for i, _, r in rows[:80]) and all(0 <= r.score <= 1 for r in got.values())
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = spark.createDataFrame([], docs.schema)
    assert language.train(none) is None and language.identify(none, model).collect() == []
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_from_long_and_repeated_rows(spark):
    """One language has only long texts, one row repeats 3000 times: all languages are learnt; held-out rows tell."""
    en, fr, de = "the cat sat on the mat with this and that ", "le chat est dans la maison avec une autre ", "der hund und die katze sind in dem haus "
    rows = [(i, de * 2500, "de") for i in range(12)] + [(5000, en, "en")] * 3000
    rows += [(100 + i, (en, fr)[i % 2] * (1 + i % 5), ("en", "fr")[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample=60)
    assert model.languages == ["de", "en", "fr"]
    held = docs.filter(language.remainder(3) == 1)
    got = {r.doc_id: r.lang_pred for r in language.identify(held, model).collect()}
    assert len(got) > 20 and all(got[r.doc_id] == r.lang for r in held.collect())
    long_only = docs.filter("lang = 'de'")
    assert {r.lang_pred for r in language.identify(long_only, language.train(long_only)).collect()} == {"de"}


def test_quality_held_out(spark):
    """Bad parts far inside long texts are learnt; repeated labels and rows and odd columns change nothing."""
    rng = random.Random(5)
    good = lambda n: " ".join(rng.choice(["quiet", "river", "stone", "light", "under"]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["###", "$$$", "!!", "x%%"]) for _ in range(n))
    texts = [good(4000) + " " + (good(6000) if i % 2 else bad(6000)) for i in range(160)]
    rows = [(i, t, "s", 0.5, 1) for i, t in enumerate(texts)] + [(1, texts[1], "s", 0.5, 1)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double, h int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(1, 1)] * 500, "doc_id long, quality int")
    held = docs.filter(quality.remainder(4) == 2)
    got = {r.doc_id: r.score for r in quality.score(held, quality.train(docs, labels)).collect()}
    assert len(got) > 20 and np.mean([(s >= quality.THRESHOLD) == (i % 2 == 1) for i, s in got.items()]) > 0.95


def test_presence_matches_sets():
    text = b"ab\xc3\xa9Ab"
    low = "abéab".encode()
    want = set()
    for n in range(1, 5):
        for i in range(len(low) - n + 1):
            code = int.from_bytes(low[i : i + n], "big")
            f = int(language._FACTORS[n - 1])
            want.add(((code * f + f) % (1 << 32)) >> (32 - 12))
    assert set(np.flatnonzero(language.presence(text)).tolist()) == want


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["quiet", "river", "stone", "light", "under"]) for _ in range(rng.randint(5, 80)))
    bad = lambda: " ".join(rng.choice(["###", "$$$", "!!", "x%%"]) for _ in range(rng.randint(5, 80)))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(300, None), (301, ""), (302, good() * 300), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(200)]) > 0.97 and got[302] > 0.5
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.Network()).collect() == []


def test_network_derivatives():
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, labels = [b"hello world this is" * 20, b"", b"XX !! YY" * 50], np.array([1, 0, 1.0])
    _, g = net.gradients(texts, labels)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        i = (ord("h"), 3) if k == "bytes" else tuple(rng.integers(0, s) for s in v.shape)
        v[i] += 1e-5
        up = net.gradients(texts, labels)[0]
        v[i] -= 2e-5
        down = net.gradients(texts, labels)[0]
        v[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5


def test_chunks_of_the_network_cover_all_bytes():
    text = bytes(range(256)) * 5 + b"tail"
    chunks, starts = quality.chunked([b"", text])
    assert starts.tolist() == [0, 1] and not chunks[0].any()
    seen = b"".join(bytes(c[: quality.HOP]) for c in chunks[1:])
    assert seen[: len(text)] == text and bytes(chunks[1][quality.HOP :]) == text[quality.HOP : quality.HOP + 4]


# --- mixing, sharding


def test_mixing(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, free, target = 1.5 * sum(sizes.values()), dict(weights), {}
    while True:  # reshare the excess until nothing stops any more
        left = total - sum(target.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 2 * sizes[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.pop(s)
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty(spark)).collect() == [] and mixing.mixed(empty(spark)).collect() == []


def test_mixing_stage(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = {}
    for r in mixing.mix(docs).collect():
        k = (r.doc_id, r.source, r.copy)
        times[k] = times.get(k, 0) + (-(-r.taken // r.size) if r.size else 0)
    assert out.count() == sum(times.values())


def test_mixing_stage_keeps_other_columns(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "fr", "s"), (2, "d e", "en", "s"), (3, "x " * 40, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    times = {r.doc_id: 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += -(-r.taken // r.size)
    out = [(r.doc_id, r.lang) for r in mixing.mixed(docs).collect()]
    assert len(out) == sum(times.values()) and abs(out.count((1, "en")) - out.count((1, "fr"))) <= 1 and out.count((1, "en")) + out.count((1, "fr")) == times[1]


def test_best_fit_enters_the_tightest_bin():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fits:
            r, b = min(fits)
        else:
            b = len(rooms)
            rooms.append(100)
        rooms[b] -= s
        want.append(b)
    assert sharding.best_fit(sizes, 100) == want


def test_even_shards():
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 1000) for _ in range(5000)), reverse=True)
    loads = np.bincount(sharding.even_shards(sizes, 24), weights=sizes, minlength=24)
    assert loads.max() - loads.min() <= loads.mean() * 0.001
    giant = sharding.even_shards([10_000, *sizes[:100]], 4)
    assert giant.count(giant[0]) >= 1 and len(set(giant)) == 4
    assert sharding.even_shards([], 24) == []


def test_sharding(spark):
    import zlib

    docs = documents(spark)
    got = sharding.shard(docs, 5).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    texts = {str(r.doc_id): r.text or "" for r in docs.collect() if r.doc_id is not None}
    where = {}
    for r in got:
        if r.doc_id is not None:
            data = texts[str(r.doc_id)].encode()
            assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
            assert where.setdefault(data, r.shard) == r.shard
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty(spark), 5).collect() == []


def test_substring_long_text_in_parts(spark):
    """A text of several parts, with a word longer than a part, loses the same words as by one split."""
    import numpy as np

    from graphloom.llm import substring

    rng = np.random.default_rng(3)
    text = b" \n".join([b"w%d" % i for i in range(120_000)] + [b"x" * (2 * substring.SEGMENT)] + [b"v%d" % i for i in range(1000)]) + b"\t"
    words = text.split()
    for gone in (np.zeros(len(words), bool), np.ones(len(words), bool), rng.random(len(words)) < 0.3):
        assert substring._kept(text, gone) == b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    assert substring._kept(b"", np.zeros(0, bool)) == b"" and substring._kept(b" \n ", np.zeros(0, bool)) == b""
