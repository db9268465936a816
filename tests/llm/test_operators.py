"""Each operator against a brute-force version or its library, on small tables with every odd case."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quadrille.llm import common, flac, langid, minhash, packing, quality, repeats, slots, spcodec, sptransducer, vectors
from quadrille.llm.components import components, merged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, rep long, shard int, bucket int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = [w + x for w in ("ra", "lo", "mi", "tu", "se") for x in ("n", "den", "k", "sta", "ver", "po")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list:
    rng = random.Random(4)
    base = [prose(rng, rng.randint(8, 120)) for _ in range(25)]
    passage = prose(rng, 30)
    long = prose(rng, 20_000)
    return [
        None, "", " ", "\n\t ", "a", "a b", "a b c", base[0], base[0], base[0] + " extra", base[1].upper(), *base,
        base[2] + " " + passage + " " + base[3], passage + base[4], long, long, long[:60_000], "é漢🙂 " * 30, "▁ ▁▁ x▁y  z ", "<|endoftext|> <s> a<|endoftext|>b", "  two  spaces  ", "\x00\x00 zero \x00",
        "ab" * 60, "ab" * 60 + "c",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 0.5, 1, 2, 3, 4) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def data(t) -> bytes:
    return (t or "").encode()


# ------------------------------------------------------------------ 1 FLAC


def test_flac_features(docs, empty):
    got = {r.doc_id: r for r in flac.media_features(flac.encode_texts(docs)).collect()}
    for i, t in enumerate(texts()):
        payload = data(t) + bytes(-len(data(t)) % 64 or (0 if data(t) else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data(t)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7].feature == got[8].feature and got[7].media_sha256 == got[8].media_sha256
    assert flac.media_features(flac.encode_texts(empty)).count() == 0


def test_pcm_blocks_are_seekable(docs):
    media = flac.encode_texts(docs)
    blocks = flac.pcm_blocks(media).collect()
    by = defaultdict(list)
    for b in blocks:
        by[b.doc_id].append(b)
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, own in by.items():
        own.sort(key=lambda b: b.block)
        assert [b.first_sample for b in own] == list(np.cumsum([0, *(b.n_samples for b in own[:-1])]))
        for b in own[:3]:
            assert flac.read_range(stored[i], b.first_sample, b.n_samples)[0].astype(np.int8).tobytes() == bytes(b.pcm)


@pytest.mark.parametrize("depth", [8, 16])
def test_flac_round_trip(depth):
    rng = np.random.default_rng(1)
    top = 1 << depth - 1
    sizes = (1, 2, 3, 16, 64, 100, 256, 4096, 4097, 9000)
    signals = [rng.integers(-top, top, n) for n in sizes] + [np.full(n, -top) for n in sizes] + [np.cumsum(rng.integers(-2, 3, n)).clip(-top, top - 1) for n in sizes] + [np.where(rng.random(n) < 0.01, top - 1, -top) for n in sizes]
    streams = flac.encode_batch([s.astype(np.int16) for s in signals], depth)
    for decoded, s in zip(flac.decode_batch(streams), signals, strict=True):
        assert (np.concatenate([b[2][0] for b in decoded.blocks]) == s).all()
    # without its seek table a stream is walked frame by frame
    bare = [e[:4] + bytes([0x80]) + e[5:42] + e[46 + int.from_bytes(e[43:46], "big") :] for e in streams]
    for decoded, s in zip(flac.decode_batch(bare), signals, strict=True):
        assert (np.concatenate([b[2][0] for b in decoded.blocks]) == s).all()


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & (1 << n) - 1, f"0{n}b") if n else ""
        return self

    def done(self):
        whole = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8))


def slow_crc16(b):
    crc = 0
    for x in b:
        crc ^= x << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_flac_mid_side_wasted_bits_and_escapes():
    """A stereo frame written by hand: middle verbatim with a wasted bit, side fixed with an escaped partition."""
    left, right = [10, 14, 18, 22, 26, 30, 34, 38], [6, 6, 6, 6, 6, 6, 6, 6]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    head = BitWriter().put(0x7FFC, 15).put(0, 1).put(6, 4).put(0, 4).put(10, 4).put(1, 3).put(0, 1).put(0, 8).put(7, 8).done()
    w = BitWriter().put(0, 1).put(1, 6).put(1, 1).put(1, 1)
    for m in mid:
        w.put(m >> 1, 7)
    w.put(0, 1).put(8 + 1, 6).put(0, 1).put(side[0], 9).put(1, 2).put(0, 4).put(31, 5).put(6, 5)
    for a, b in zip(side, side[1:]):
        w.put(b - a, 6)
    frame = head + bytes([flac.crc8(head)]) + w.done()
    frame += slow_crc16(frame).to_bytes(2, "big")
    info = (8).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + frame
    block = flac.decode_batch([stream])[0].blocks[0][2]
    assert block.tolist() == [left, right]
    for at in (len(stream) - 1, len(stream) - 8, len(stream) - len(frame) + 2):
        broken = bytearray(stream)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode_batch([bytes(broken)])


# ------------------------------------------------------------------ 2, 10 classifiers


def labelled(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, rng.randint(5, 60))
        rows.append((i, t if good else " ".join(w + "###" for w in t.split()), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality(spark, docs, empty):
    rows = labelled(spark)
    model = quality.fit(rows, rows, train=common.crc_bucket("doc_id", 3) != 1)
    got = {r.doc_id: r for r in quality.score(rows, model, ["doc_id"]).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert quality.score(docs, model, ["doc_id"]).count() == len(texts())
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    blank = quality.fit(empty, rows)
    assert {r.score for r in quality.score(docs, blank, ["doc_id"]).collect()} == {0.5}


def test_interactions_equal_all_pairs():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    columns, values = np.array([3, 7, 9, 30]), np.array([0.5, 1.0, 2.0, 0.25])
    want = fm.bias + sum(fm.linear[c] * v for c, v in zip(columns, values)) + sum(fm.factors[a] @ fm.factors[b] * x * y for i, (a, x) in enumerate(zip(columns, values)) for b, y in list(zip(columns, values))[i + 1 :])
    assert np.isclose(fm.raw(columns, values, np.array([0]))[0][0], want)


def test_language(spark, empty):
    rng = random.Random(5)
    tongues = {"xx": ["kla", "brun", "ski", "vog"], "yy": ["eau", "oui", "tion", "lle"]}
    rows = []
    for i in range(200):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join(rng.choice(tongues[lang]) + rng.choice(tongues[lang]) for _ in range(rng.randint(5, 40))), lang))
    table = spark.createDataFrame([*rows, (500, None, "xx"), (501, "123 !! ½", "yy"), (502, "", None), (503, "kla brunski", None)], "doc_id long, text string, lang string")
    model = langid.fit(table, train=common.crc_bucket("doc_id", 5) != 0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "xx"
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(table, None).collect()} == {"und"}


def test_language_by_the_plain_kernel(monkeypatch):
    """Kernel values from Python sets of byte strings, the ridge solution and the shares by the formulas."""
    monkeypatch.setattr(langid, "LANDMARKS", 7)
    rng = random.Random(8)
    given = [("".join(rng.choice(("abcé ", "abdß ", "cdeé\n")[i % 3]) for _ in range(rng.randint(1, 60))), "xyz"[i % 3]) for i in range(60)] + [("a", "x"), ("", "y")]
    asked = ["abc abc", "ßd", "", "zzzz", "A\u0130é"] + [t for t, _ in given[:20]]

    def plain(text):
        b = text.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    def k(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    model = langid.KernelModel.fit([langid.grams(t) for t, _ in given], [x for _, x in given])
    assert all(len(langid.grams(t)) == len(plain(t)) for t, _ in given)
    counts, marks = defaultdict(int), []
    for t, x in given:
        counts[x] += 1
        marks += [plain(t)] * (counts[x] <= 7)
    between = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = lambda texts_: np.array([[k(plain(t), m) for m in marks] for t in texts_]) @ root
    x, y = phi([t for t, _ in given]), np.array([[1.0 if l == c else -1.0 for c in "xyz"] for _, l in given])
    w = np.array([1 / counts[l] for _, l in given])
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + langid.RIDGE * np.eye(x.shape[1]), x.T @ (w[:, None] * y))
    sums = phi(asked) @ beta
    shares = np.exp(langid.SHARPNESS * sums)
    shares /= shares.sum(axis=1, keepdims=True)
    best, share = model.score([langid.grams(t) for t in asked])
    clear = np.sort(shares, axis=1)[:, -1] - np.sort(shares, axis=1)[:, -2] > 1e-6
    assert (best[clear] == shares.argmax(axis=1)[clear]).all() and np.allclose(share, shares.max(axis=1), atol=1e-6)


def test_training_samples_stay_bounded(spark, monkeypatch):
    """An id that repeats in both tables, with one label and with two, and rows without an id."""
    monkeypatch.setattr(quality, "TRAIN_ROWS", 20)
    monkeypatch.setattr(langid, "PER_LANG", 10)
    seen = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", staticmethod(lambda rows, labels, n=0: seen.append(labels)))
    monkeypatch.setattr(langid.KernelModel, "fit", staticmethod(lambda sets, langs: seen.append(langs)))
    docs_ = spark.createDataFrame([(1, f"text {i}", "xx") for i in range(300)] + [(None, "no id", "yy")] * 5 + [(2, "two", "yy")] * 40, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    quality.fit(docs_, labels)
    langid.fit(docs_)
    assert sorted(seen[0]) == [0] * 10 + [1] * 10 and sorted(seen[1]) == ["xx"] * 10 + ["yy"] * 10


def test_repeated_rows_and_rows_without_an_id(spark):
    """Every operator that goes row by row: as many rows out as in, and equal texts, equal values."""
    rng = random.Random(17)
    some = [prose(rng, 40), None, "", prose(rng, 5)]
    rows = [(i, t, "en", 1.0, 1, 2) for i in (None, None, 7, 7, 8) for t in some]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, shard int, begins int")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    machine, kernel = quality.fit(table, labels), langid.fit(table)
    outs = [flac.media_features(flac.encode_texts(table)), quality.score(table, machine, ["doc_id"]), sptransducer.counts(table), spcodec.digest(table), langid.predict(table, kernel)]
    for out in outs:
        found = out.collect()
        assert len(found) == len(rows) and len({tuple(r)[1:] for r in found}) <= 4
        assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    packed = packing.pack_documents(table).collect()
    assert len(packed) == len(rows)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    rows_ = slots.records(table)
    parts = slots.part_sizes(rows_)
    placed = slots.place_rows(rows_, parts, slots.first_map(slots.slot_sizes(parts)), ["doc_id", "text_crc32", "size"]).collect()
    shards = defaultdict(list)
    for r in placed:
        shards[r.shard].append(r.slot)
    assert len(placed) == len(rows) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert len({r.virtual_slot for r in placed if r.doc_id is None}) == 3  # null counts as the empty text


def test_more_buckets_where_pieces_are_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 1)
    monkeypatch.setattr(packing, "BUCKET_PIECES", 100)
    rng = random.Random(4)
    table = spark.createDataFrame([(i, rng.choice([5, 5, 5, 9, 16])) for i in range(1000)], "doc_id long, length long")
    by = defaultdict(list)
    for r in packing.pack(table, ["doc_id", "length"], 16).collect():
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert sum(map(len, by.values())) == 1000


# ------------------------------------------------------------------ 3 slots


def test_first_map_is_greedy(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 5, 5, rng.randint(1, 1000)]), rng.randint(0, 3)) for i in range(300)]
    got = {r.virtual_slot: r.shard for r in slots.first_map(spark.createDataFrame(sizes, "virtual_slot int, bytes long, n_rows long"), 7).collect()}
    loads = [[0, 0, s] for s in range(7)]
    for i, b, n in sorted(sizes, key=lambda x: (x[1], x[2], x[0]), reverse=True):
        least = min(loads)
        assert got[i] == least[2]
        least[0] += b
        least[1] += n


def test_slots(spark, docs, empty):
    rows = slots.records(docs)
    parts = slots.part_sizes(rows)
    slot_map = slots.store_map(slots.first_map(slots.slot_sizes(parts)), f"{common.shared_dir(spark)}/test-map-{random.random()}")
    got = slots.place_rows(rows, parts, slot_map, ["doc_id", "text_crc32", "size"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts())))
    by = defaultdict(list)
    for r in got:
        assert r.size == len(data(texts()[r.doc_id])) + 1 and r.text_crc32 == zlib.crc32(data(texts()[r.doc_id]))
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    no = slots.records(empty)
    parts = slots.part_sizes(no)
    assert slots.place_rows(no, parts, slots.first_map(slots.slot_sizes(parts)), ["doc_id"]).count() == 0


def test_slot_map_versions(spark):
    rows = slots.records(spark.range(3000).selectExpr("id AS doc_id", "repeat('x', int(id % 90)) AS text"))
    path = f"{common.shared_dir(spark)}/test-map-{random.random()}"
    one = slots.store_map(slots.first_map(slots.slot_sizes(slots.part_sizes(rows))), path)
    loads = [r[1] for r in one.groupBy("shard").sum("bytes").collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 90
    two = slots.store_map(slots.add_shard(one), path)
    assert {r.version for r in two.collect()} == {2}
    moved = one.alias("a").join(two.alias("b"), "virtual_slot").where("a.shard != b.shard").selectExpr("b.shard").distinct().collect()
    assert [r[0] for r in moved] == [16]
    loads = [r[1] for r in two.groupBy("shard").sum("bytes").collect()]
    assert len(loads) == 17 and max(loads) < 1.15 * min(loads)
    assert {r.version for r in slots.load_map(spark, path, 1).collect()} == {1}


# ------------------------------------------------------------------ 4 packing


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts())}
    got = packing.pack_documents(docs, 64).collect()
    placed, seen = defaultdict(list), defaultdict(int)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length <= 64 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 64
        placed[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(placed) <= -(-sum(seen.values()) // 64) + 3
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("capacity", [7, 30, 200])
def test_plans_hold_every_length_once(capacity):
    for seed in range(15):
        rng = random.Random(seed)
        counts = defaultdict(int)
        for _ in range(rng.choice([1, 5, 60, 3000])):
            counts[rng.randint(1, capacity) if seed % 2 else min(capacity, max(1, int(rng.lognormvariate(np.log(capacity / 3), 1))))] += 1
        used = defaultdict(int)
        sequences = packing.plan(dict(counts), capacity)
        for lengths, n in sequences:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts


def test_exact_complements_come_first():
    assert sum(n for _, n in packing.plan({9: 2, 1: 2, 5: 1, 3: 1, 2: 1, 7: 1, 8: 1}, 10)) == 5
    # pairs, then triples, then best fit: 6+2+2, 6+2+1+1, 6+1+1+1+1
    assert sorted(packing.plan({6: 3, 2: 3, 1: 6}, 10), reverse=True) == [((6, 2, 2), 1), ((6, 2, 1, 1), 1), ((6, 1, 1, 1, 1), 1)]


# ------------------------------------------------------------------ 5 MinHash


def word_tuples(text, words):
    """The contract's set, by its words."""
    found = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    size = min(words, len(found))
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else set()


def brute_components(rows, words, percent=80):
    sets = {i: word_tuples(t, words) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, empty):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows, 4)
    assert minhash.near_duplicates(empty).count() == 0


def test_a_large_group_of_copies(spark):
    """Copies of one text with random changes: many links, chains, and outliers that only some copies reach."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 7, 8])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame([*rows, (None, "null id here with words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect()}
    assert got.pop(None)[1:] == (None, True)
    want = brute_components(rows, 4)
    assert {i: v[:2] for i, v in got.items()} == want
    assert len({v[1] for v in want.values()}) > 1


def test_shingles_of_bytes():
    words = "Straße Ärger\x0bA b\x1cc".encode().lower().split()
    assert len(words) == 4 and len(minhash.shingles("Straße Ärger\x0bA b\x1cc")) == 1
    assert (minhash.shingles("A B c d e") == minhash.shingles("a b C D E")).all() and len(minhash.shingles("Ä b c d e")) == 2
    assert minhash.shingles("Äb") != minhash.shingles("äb")


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 61)) and got[300] == got[200] == 100


def test_components_of_many_shapes(spark):
    """Hubs with large and small ids, chains in a random order, rings, grids, against plain union."""
    rng = random.Random(12)
    links = [(10_000, i) for i in range(200, 400)] + [(150, i) for i in range(500, 560)]
    chain = rng.sample(range(1000, 1300), 300)
    links += list(zip(chain, chain[1:])) + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(3000 + 10 * i + j, 3000 + 10 * i + j + d) for i in range(9) for j in range(9) for d in (1, 10)] + [(5, 5), (2000, 2001), (2001, 2000)]
    label = {x: x for pair in links for x in pair}
    for _ in range(len(label)):
        before = dict(label)
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: c for i, c in label.items() if i != 5}
    some = spark.createDataFrame([(150, 10_000), (5, 6), (560, 2000), (150, 559)], "a long, b long")
    more = dict(map(tuple, merged(components(spark.createDataFrame(links, "a long, b long")), some).collect()))
    both = dict(map(tuple, components(spark.createDataFrame([*links, (150, 10_000), (5, 6), (560, 2000)], "a long, b long")).collect()))
    assert more == both and components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_blocks_of_many_chunks(spark, monkeypatch):
    """Chunks of a few classes, in which clusters link only through further members."""
    monkeypatch.setattr(minhash, "CHUNK", 7)
    rng = random.Random(5)
    rows = []
    for k in range(4):
        base = prose(rng, 150).split()
        for i in range(60):
            w = list(base)
            for _ in range(rng.choice([2, 5, 7, 8, 9, 10])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * k + i, " ".join(w)))
    rows += [(500 + i, t) for i, t in ((0, rows[0][1]), (1, rows[3][1]))] + [(500, "other words under one id")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(table).collect()}
    want = brute_components([*rows[:-3], (500, rows[0][1]), (501, rows[3][1])], 4)
    assert all(got[i, n] == c for i, (n, c) in want.items()) and got[500, 2] == 500  # each row by its own set


# ------------------------------------------------------------------ 6 repeats


def brute_repeats(rows):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each row; rows: (id, text), ids may repeat."""
    earlier: dict[bytes, int] = {}
    for i, t in rows:
        b = data(t)
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            earlier[g] = min(earlier.get(g, i), i)
    out = []
    for i, t in rows:
        b = data(t)
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if earlier[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        rest = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_repeats(docs, empty):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs).collect())
    assert got == brute_repeats(list(enumerate(texts())))
    assert repeats.digest(empty).count() == 0
    cut = {r.doc_id: r.text for r in repeats.remove(docs).collect()}
    assert cut[0] is None and cut[8] == "" and cut[7] == texts()[7]
    assert repeats.remove(docs).columns == docs.columns


def test_repeats_of_one_line_and_of_ids(spark):
    rng = random.Random(3)
    line = prose(rng, 14)
    rows = [(i, prose(rng, 12) + "\n" + line + "\n" + prose(rng, 5) + ("\n" + line) * (i % 3)) for i in range(20)]
    rows += rows[:7]
    got = sorted(map(tuple, repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_repeats(rows)


def test_longest_previous_factors():
    """Suffixes of several sizes, with zeros in them, of documents that repeat."""
    rng = np.random.default_rng(2)
    for low in (0, 97):
        suffixes, sizes = rng.integers(low, low + 2, (300, 9)).astype(np.uint8), rng.integers(4, 10, 300)
        suffixes[np.arange(9) >= sizes[:, None]] = 0
        docs_ = rng.integers(0, 40, 300)

        def common_prefix(a, b):
            return next((i for i in range(min(sizes[a], sizes[b])) if suffixes[a, i] != suffixes[b, i]), min(sizes[a], sizes[b]))

        want = np.array([max((common_prefix(i, j) for j in range(300) if docs_[j] < docs_[i]), default=0) for i in range(300)])
        got = repeats.longest_previous(suffixes, docs_, sizes)
        # where zeros and the end of a suffix look alike, what is found is at least 4 wherever there is 4
        assert (got == want).all() if low else ((got >= 4) == (want >= 4)).all() and (got <= want).all()


def test_equal_hashes_do_not_decide(spark, monkeypatch):
    """With hashes that are all equal, bytes alone tell stretches apart."""
    monkeypatch.setattr(repeats, "_piece", lambda *a, real=repeats._piece: (*(x := real(*a))[:4], x[4] * np.uint64(0), x[5] * np.uint64(0)))
    rng = random.Random(6)
    same = prose(rng, 40)
    rows = [(i, prose(rng, 60) + (same if i % 4 == 0 else "")) for i in range(24)]
    data_ = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    a = repeats.anchors(data_, np.cumsum([0, *(len(t.encode()) for _, t in rows)]))
    assert not a.one.any()
    n = a.last - a.first + repeats.LENGTH
    assert n.max() <= repeats.WIDTH and (n >= repeats.LENGTH).all()
    pairs = [(i, j) for i in range(0, len(n), 97) for j in range(len(n)) if n[i] == n[j]]
    one, two = np.array(pairs).T
    got = repeats._same(data_, a.first[one], a.first[two], n[one])
    assert got.tolist() == [bytes(data_[a.first[i] : a.first[i] + n[i]]) == bytes(data_[a.first[j] : a.first[j] + n[j]]) for i, j in pairs]


def test_runs_of_marks():
    rng = np.random.default_rng(4)
    ids, starts, sizes = rng.integers(0, 6, 80), rng.integers(0, 900, 80), rng.integers(1, 60, 80)
    got = dict(zip(*repeats._runs(ids, starts, sizes)))
    for i in set(ids.tolist()):
        marked = np.zeros(1000, bool)
        for s, z in zip(starts[ids == i], sizes[ids == i]):
            marked[s : s + z] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(int), [0]]))).reshape(-1, 2)
        assert np.frombuffer(got[i], np.int64).reshape(-1, 2).tolist() == edges.tolist()


# ------------------------------------------------------------------ 7, 8 SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_counts(docs, empty, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in sptransducer.counts(docs).collect()}
    for i, t in enumerate(texts()):
        n = len(library.encode(t or ""))
        assert got[i] == (len(data(t)), n, n > 4096)
    assert sptransducer.counts(empty).count() == 0


def test_state_maps_compose(library, monkeypatch):
    """Chunks that begin anywhere, from states that the map did not begin with, and a prefix scan of them."""
    monkeypatch.setattr(sptransducer, "CHUNK", 23)
    monkeypatch.setattr(sptransducer, "RUN_IN", 3)
    t = sptransducer.transducer("piece_bpe_32k.model")
    rng = random.Random(1)
    for k in range(200):
        alphabet = "abcdeth in\n\t  ▁éñ漢🙂1" if k % 2 else "abcdethioné漢字语言1"
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150)))
        assert t.count(x) == len(library.encode(x)), x
        shown = "▁" + x.replace(" ", "▁")
        for end, n in zip(range(23, len(shown) + 23, 23), t.prefix_counts(x)):
            assert n == t.run(shown[:end])[1]
        at, end = sorted(rng.sample(range(len(shown) + 1), 2)) if len(shown) > 1 else (0, 1)
        chunk = sptransducer.StateMap(t, shown, at, end)
        state, before = t.run(shown[:at])
        after, n = chunk.after(state)
        assert before + n + t.run(shown[end:], after)[1] == t.run(shown)[1]
    assert t.prefix_counts("") == []


def test_texts_about_a_chunk_and_without_spaces(library):
    t = sptransducer.transducer("piece_bpe_32k.model")
    rng = random.Random(3)
    for n in (sptransducer.CHUNK - 2, sptransducer.CHUNK - 1, sptransducer.CHUNK, 3 * sptransducer.CHUNK + 5):
        for alphabet in ("abcdefghij", "漢字语言文", "a", " ", "ab  \n"):
            x = "".join(rng.choice(alphabet) for _ in range(n))
            assert t.count(x) == len(library.encode(x))


def test_codec(docs, empty, library):
    got = {r.doc_id: r for r in spcodec.digest(docs).collect()}
    spans = {r.doc_id: r for r in spcodec.encode(docs).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert spans[i].ids == ids and spans[i].begins[-1] == len(data(t)) and spans[i].begins == sorted(spans[i].begins)
    assert spcodec.digest(empty).count() == 0


def test_spans_byte_by_byte(library):
    """Spans touch, cover the text, and each piece's characters stand in its span; the whole-text way gives the same."""
    codec = spcodec.codec("piece_bpe_32k.model")
    rng = random.Random(6)
    xs = ["".join(rng.choice("abc in  ▁éñ漢🙂\x00") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    xs += ["漢字" * 40, " " * 30, "▁" * 9, "a" * 500, "  two  spaces  "]
    for x, (_, ids, begins) in zip(xs, codec.encode_batch(xs), strict=True):
        _, other, at = codec.encode(x)
        assert ids.tolist() == other.tolist() == library.encode(x) and begins.tolist() == at.tolist()
        source = x.encode()
        assert begins[-1] == len(source) and (not len(ids) or begins[0] == 0)
        for k, i in enumerate(ids.tolist()):
            span, piece = source[begins[k] : begins[k + 1]], library.id_to_piece(i)
            if library.is_byte(i):
                assert piece == f"<0x{span[0]:02X}>" and len(span) == 1
            else:
                shown = span.decode().replace(" ", "▁")
                assert shown == piece or (k == 0 and "▁" + shown == piece)


def test_parts_align_as_one_by_one():
    import public_tokenizers

    from quadrille.llm.spmodel import Model

    model = Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = ["".join(rng.choice("ab é漢🙂▁\n") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    normal, source = model.normalize_parts(parts)
    base, want = 0, []
    for p, n in zip(parts, normal):
        one, at = model.normalize(p, first=False)
        assert one == n
        want += [base + x for x in at[:-1]]
        base += len(p.encode())
    assert source.tolist() == [*want, base]


def test_memos_are_bounded():
    memo = common.Memo(len, most=3, longest=4)
    assert [memo[x] for x in ("a", "bb", "a" * 9, "ccc", "dddd")] == [1, 2, 9, 3, 4]
    assert set(memo) == {"dddd"} and len("a" * 9) not in memo


def test_character_map_against_the_library():
    import sentencepiece

    from quadrille.llm.spmodel import Model

    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    ours = Model.parse(theirs.serialized_model_proto())
    assert ours.charsmap is not None
    rng = random.Random(9)
    for _ in range(300):
        x = "".join(rng.choice("ab ①ﬁＡｶﾞ\t　 é²½ ﷺ") for _ in range(rng.randint(0, 20)))
        norm, source = ours.normalize(x)
        assert norm.decode().replace("▁", " ").strip() == theirs.normalize(x).replace("▁", " ").strip()
        assert len(source) == len(norm) + 1 and source == sorted(source) and source[-1] <= len(x.encode())


# ------------------------------------------------------------------ 9 vectors


def brute_links(rows, cosine=0.95):
    """(n_links, component, kept) by id of (id, vector), vectors of one length with each other."""
    near = np.zeros((len(rows), len(rows)), bool)
    for size in {len(v) for _, v in rows}:
        own = [k for k, (_, v) in enumerate(rows) if len(v) == size]
        x = np.array([rows[k][1] for k in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(own, own)] = x @ x.T >= cosine
    near[np.arange(len(rows)), np.arange(len(rows))] = False
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    return {i: (int(near[k].sum()), rows[root[k]][0], root[k] == k) for k, (i, _) in enumerate(rows)}


ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [None] * 16, [1.0] * 15 + [None]]


def test_vectors(spark):
    """Null ids, odd vectors, vectors of other lengths, equal ones, and extra columns with the operator's own names."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    rows = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.1, 0.2)] + [base[0]] * 5 + [base[1] * 2]
    rows = [list(map(float, np.float32(r))) for r in rows]
    rows += [r[:5] for r in rows[:30]]
    given = [(i, v, 1, 2, 3) for i, v in enumerate(rows + ODD)] + [(None, rows[0], 1, 2, 3), (None, None, 1, 2, 3)]
    table = spark.createDataFrame(given, "vec_id long, embedding array<float>, rep long, weight int, shard string")
    found, recalls = vectors.near_duplicates(table)
    every = found.collect()
    assert [tuple(r)[1:] for r in every if r.vec_id is None] == [(0, None, True)] * 2
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in every if r.vec_id is not None}
    want = brute_links(list(enumerate(rows))) | {i: (0, i, True) for i in range(len(rows), len(rows) + len(ODD))}
    assert got == want and min(recalls) >= 0.95
    assert vectors.near_duplicates(table.limit(0))[0].count() == 0


def test_double_vectors_at_the_threshold(spark):
    """Cosines a rounding of single precision away from 0.95."""
    rows = []
    for k, c in enumerate((0.95 - 1e-12, 0.95 + 1e-12, 0.95 - 1e-9, 0.95 + 1e-9)):
        x = np.zeros((2, 8))
        x[0, 2 * k], x[1, 2 * k], x[1, 2 * k + 1] = 1e200, c, np.sqrt(1 - c * c)
        rows += [(2 * k + i, list(map(float, v))) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()}
    assert [got[i] for i in range(8)] == [0, 0, 1, 1, 0, 0, 1, 1]


@pytest.mark.parametrize("centres, scale", [(2, 8), (1, 8), (6, 0)])
def test_large_shards(spark, monkeypatch, centres, scale):
    """Shards that are split by centres of their own, one that none can split, and the exact way."""
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "CENTRES", centres)
    monkeypatch.setattr(vectors, "SPLIT", 4)
    monkeypatch.setattr(vectors, "MOST_SCALE", scale)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.12, rng.normal(size=(250, 8))])
    rows = [(i, list(map(float, np.float32(v)))) for i, v in enumerate(x)]
    found, recalls = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = brute_links(rows)
    links = {r.vec_id: r.n_links for r in found.collect()}
    assert all(links[i] <= want[i][0] for i in want)
    assert sum(links.values()) >= (0.95 if scale else 1) * sum(n for n, _, _ in want.values()) and recalls[-1] >= 0.95


def test_graph_is_pruned_and_searched():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.robust_graph(x, 12, 40)
    assert graph.shape == (700, 12) and (graph != np.arange(700)[:, None]).all()
    for i, g in enumerate(graph):
        g = g[g >= 0]
        assert len(set(g.tolist())) == len(g)
        near = 1 - x[g] @ x[i]
        for a in range(len(g)):
            assert all(vectors.ALPHA * (1 - x[g[a]] @ x[g[b]]) > near[b] - 1e-5 for b in range(a + 1, len(g)))
    flat, begin = graph[graph >= 0], np.concatenate([[0], np.cumsum((graph >= 0).sum(axis=1))])
    want = x @ x.T >= 0.7
    want[np.arange(700), np.arange(700)] = False
    assert (vectors.range_search(x, begin, flat, 700, 0.7) == want).all()
    some = vectors.range_search(x, begin, flat, 30, 0.7)
    assert not (some & ~want).any() and some.sum() >= 0.9 * want.sum()
