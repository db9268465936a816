"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

A document's set is its distinct WORDS-word shingles as 64-bit hashes. One permutation sends each element to a place on
a circle, a second gives the place a rank, and coordinate k of the signature is the least rank after the circle turns by
k: two permutations give all coordinates. ROWS coordinates make a band; documents that agree in one of BANDS bands are
candidates. A pair at Jaccard 0.8 is missed with probability (1 - 0.8**ROWS)**BANDS, about 2e-5.

Equal sets are one class from the start. No bucket's pairs are listed at once:

1. in every bucket each class is compared with the bucket's smallest class, on full sets, and components are formed;
2. buckets whose classes are in one component are done. Components that share the others, directly or through further
   components, make a block of their classes in such buckets. In each block the classes outside its largest component are
   held against all of it, chunk by chunk, by their sizes and signatures, CHECKED coordinates long, and what agrees in
   ALIKE of them is compared on full sets: first the PARTNERS best, then, once components are formed again, all that are
   still apart.

Only what joins different components is ever compared, so a group of copies costs a few comparisons a copy. Sets are read
only for candidates. Defined results: texts without a word, and nulls, have no set, link with nothing and are their own
component; repeated rows of an id are one document; where texts of one id differ each row goes by its own set, and a set
whose smallest id names another set too has the links of both; a null id is kept, with a null component; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, free_shuffles, in_worker, lists, materialize, runs_of, ship_package, shuffle_parts, slices, strings, table
from .components import components, merged

WORDS = 4
PERCENT = 80
ROWS = 6
BANDS = 36
CIRCLE_BITS = 18
#: Classes of an unsettled block are held against each other by CHECKED coordinates, of which linked pairs agree in a share
#: of about 0.8 or more, give or take 0.0125: ALIKE is 4 times that below.
CHECKED = 1024
ALIKE = 0.75
#: Best partners a class (and chunk) that are compared before components are formed again and the rest follow.
PARTNERS = 16
CHUNK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_words = Memo(lambda word: xxhash.xxh64_intdigest(word, 5))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text's whole sequence is its one shingle."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


class Circulant:
    """The two permutations, made from a seed."""

    def __init__(self, coordinates: int, bits: int = CIRCLE_BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mask = np.uint64((1 << bits) - 1)
        self.place = rng.permutation(1 << bits).astype(np.int32)
        ranks = rng.permutation(1 << bits).astype(np.int32)
        # row i: the ranks of place i at every turn
        self.turns = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """All coordinates of a set that is not empty."""
        at = np.unique(self.place[(hashes & self.mask).astype(np.int64)])
        least = self.turns[at[:1024]].min(axis=0)
        for i in range(1024, len(at), 1024):
            least = np.minimum(least, self.turns[at[i : i + 1024]].min(axis=0))
        return least

    def bands(self, hashes: np.ndarray, rows: int = ROWS) -> np.ndarray:
        s = self.signature(hashes).astype(np.uint64).reshape(-1, rows)
        key = np.arange(len(s), dtype=np.uint64)
        for r in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, r])
        return key


_circles: dict[tuple, Circulant] = {}


def circulant(coordinates: int) -> Circulant:
    if coordinates not in _circles:
        _circles[coordinates] = Circulant(coordinates)
    return _circles[coordinates]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, n (set size), one and two (a 128-bit print of the set, null without a set), bands."""
    ship_package(docs.sparkSession)
    shown = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = circulant(ROWS * BANDS)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, one, two, bands = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text or "", words)
                    n.append(len(s))
                    if len(s):
                        one.append(int(_mix(s).sum(dtype=np.uint64).astype(np.int64)))
                        two.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                        bands.append(circle.bands(s).astype(np.int64))
                    else:
                        one.append(None)
                        two.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "one", "two", "bands"])

    return shown.mapInArrow(run, f"id {shown.schema['id'].dataType.simpleString()}, n long, one long, two long, bands array<long>")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """rep and its set, of rows (rep, text)."""

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = [shingles(t or "", words).astype(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["rep", "hashes"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, hashes array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), linked (their sets meet in at least percent of their union) and distance (1 - Jaccard index)."""
    first = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("set_a"))
    second = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("set_b"))
    # b first: a is the side that a hub repeats, and its join is one that adaptive execution can split
    both = pairs.join(second, "b").join(first, "a")
    sizes = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    union = F.col("total") - F.col("common")
    return sizes.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"), (1 - F.col("common") / union).alias("distance"))


def _alike(n, m, percent: int):
    """Sizes that allow the Jaccard index."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def coordinates(rows: DataFrame) -> DataFrame:
    """rep, n, block and the low byte of each of CHECKED signature coordinates, of rows (rep, hashes, block)."""

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = circulant(CHECKED)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                data, ends = lists(batch.column(1), np.int64)
                found = [circle.signature(data[i:j].view(np.uint64)).astype(np.uint8).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), batch.column(2), pa.array(found, pa.binary())], ["rep", "n", "block", "signature"])

    return rows.select("rep", "hashes", "block").mapInArrow(run, "rep long, n long, block long, signature binary")


def plausible(signed: DataFrame, labels: DataFrame, most: int, percent: int = PERCENT, alike: float = ALIKE) -> DataFrame:
    """Pairs (a, b) of a block in different components whose sizes allow a link and whose signatures agree in a share
    `alike` of the coordinates.

    A block's classes outside its largest component ask all of the block. Both sides are cut into chunks of about CHUNK
    classes, and a task holds one chunk of each at a time. most: so many best partners a class and chunk; 0: all.
    """
    rows = signed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by = rows.groupBy("block", "component").agg(F.count(F.lit(1)).alias("c"))
    by = by.groupBy("block").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("several"), F.max("c").alias("largest"), F.max_by("component", F.struct("c", "component")).alias("main")).where("several > 1")
    by = by.select("block", "main", F.ceil(F.col("size") / CHUNK).cast("int").alias("homes"), F.ceil((F.col("size") - F.col("largest")) / CHUNK).cast("int").alias("askers"))
    rows = rows.join(by, "block")
    asks = F.col("component") != F.col("main")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    told = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda k: F.struct(k.alias("asker"), own("homes").alias("home"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda k: F.struct(own("askers").alias("asker"), k.alias("home"), F.lit(True).alias("asks")))
    dealt = rows.select("block", "rep", "n", "component", "signature", F.explode(F.when(asks, F.concat(told, asked)).otherwise(told)).alias("x")).select("block", "x.asker", "x.home", "x.asks", "rep", "n", "component", "signature")

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 3):
            asks, (rep, n, component) = t.column("asks").to_numpy(), (t.column(c).to_numpy() for c in ("rep", "n", "component"))
            signature = strings(t.column("signature").combine_chunks())[0].reshape(t.num_rows, -1)
            here = np.flatnonzero(~asks)
            out_a, out_b = [], []
            for q in np.flatnonzero(asks):
                low, high = np.minimum(n[here], n[q]), np.maximum(n[here], n[q])
                other = here[(component[here] != component[q]) & (100 * low >= percent * high)]
                share = np.array([np.count_nonzero(row) for row in signature[other] == signature[q]], np.float64) / signature.shape[1]
                good = np.flatnonzero(share >= alike)
                if most and len(good) > most:
                    good = good[np.argsort(-share[good], kind="stable")[:most]]
                out_a.append(np.minimum(rep[other[good]], rep[q]))
                out_b.append(np.maximum(rep[other[good]], rep[q]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    tile = ["block", "asker", "home"]
    return dealt.repartition(shuffle_parts(signed.sparkSession), *tile).sortWithinPartitions(*tile).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id and kept. percent is at least 80 by the choice of bands."""
    sig = materialize(signatures(docs, id_col, text_col, words).withColumn("id", F.col("id").cast("long")), "signatures")
    usable = sig.where("one IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("one", "two", "n").agg(F.min("id").alias("rep"), F.min("bands").alias("bands"))
    keyed = materialize(classes.select("rep", "n", F.explode("bands").alias("key")), "bands")
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader")).where("size > 1")
    members = materialize(keyed.join(full, "key").select("key", "rep", "n", "leader"), "members")
    candidates = members.select("rep").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(candidates, "rep")
    sets = materialize(sets_of(texts, words), "sets")
    free_shuffles(docs.sparkSession)

    # 1. everyone with the smallest class of each bucket
    sizes = members.where("rep = leader").select("key", F.col("n").alias("leader_n"))
    star = members.where("rep != leader").join(sizes, "key")
    pairs = star.where(_alike(F.col("n"), F.col("leader_n"), percent)).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    distances = materialize(compared(pairs, sets, percent), "distances")
    links = distances.where("linked").select("a", "b")
    labels = components(links)

    # 2. what different components that share buckets may still link
    known = members.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = known.groupBy("key").agg(F.min("component").alias("hub"), F.max("component").alias("c1")).where("hub != c1").select("key", "hub")
    spokes = materialize(known.join(open_keys, "key").select("hub", "rep", "component").distinct(), "spokes")
    # whole components are the ends, once each
    blocks = components(spokes.select("hub", "component").distinct(), "hub", "component").select(F.col("node").alias("hub"), F.col("component").alias("block"))
    inside = spokes.select("rep", "hub").groupBy("rep").agg(F.min("hub").alias("hub")).join(blocks, "hub").select("rep", "block")
    signed = materialize(coordinates(sets.join(inside, "rep")), "signed")
    for most in (PARTNERS, 0):
        new = materialize(compared(plausible(signed, labels, most, percent), sets, percent).where("linked").select("a", "b"), "links")
        if new.limit(1).count():
            labels = merged(labels, new)

    found = classes.select("one", "two", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("one", "two", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "n", "one", "two").join(found, ["one", "two", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
