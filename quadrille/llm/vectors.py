"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one class from the start, with its number of rows as weight. Centres come from k-means on a bounded
sample (SAMPLE classes, the smallest id hashes), and each class goes to its OVERLAP nearest centres' shards, so shards
overlap. A shard of more than SHARD classes is split by centres of its own, again and again; one that its centres do not
split, as its vectors are too alike, is cut in blocks, and every two blocks make a task. So no task holds more than two
blocks, however many classes there are.

In each block a robust-pruned graph is built by insertion: new classes search the graph so far, greedily from the medoid,
keep the nearest that no kept neighbour is ALPHA times nearer to, and get links back, pruned likewise. Adjacency lists
that a class got in all its shards are joined (their union), and each class searches the union, restricted to the task's
classes, greedily from the medoid with a beam. From the classes found within range the search expands to neighbours until
none is new. Every reached pair is verified by its cosine in double precision. A pair met in several shards counts in the
first that both are in.

Recall is audited: AUDIT classes, half of them such that the search linked them, are compared with all classes by brute
force (in batches). Where fewer than LEAST of a class's links were found, on average, the search is repeated with twice
the beam, overlap and degree, and after MOST_SCALE in one shard with a beam that reaches everything, which is exact.

Null, zero and non-finite vectors, and those that hold such components, link with nothing and are their own component; so
are vectors of different lengths with each other, each length being a table of its own. Repeated rows of an id count
each; null ids are kept with a null component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, lists, materialize, runs_of, ship_package, shuffle_parts, smallest_hashes, table
from .components import components

COSINE = 0.95
SAMPLE = 8192
SHARD = 1500
OVERLAP = 2
#: Centres at first, centres of a shard that is split, and the classes that those are learned from.
CENTRES = 1024
SPLIT = 32
SPLIT_SAMPLE = 768
#: A split in which a part keeps more than this share of the shard is none.
UNSPLIT = 0.7
DEGREE = 16
BEAM = 24
ALPHA = 1.2
AUDIT = 512
LEAST = 0.95
MOST_SCALE = 8
#: Classes that are inserted, or asked for, at once.
INSERTED = 256
ASKED = 64
#: Places of the beam that are followed at once.
FOLLOWED = 4


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists are all as long, as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = lists(column, np.float64)
    values = values.reshape(len(offsets) - 1, -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    means = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        own = (sample @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), means)
    return means


# ------------------------------------------------------------------ a task's graph


def greedy(x: np.ndarray, graph: np.ndarray, asked: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (queries, beam) of the best that a greedy search from start keeps; -1 where there are fewer.
    graph: neighbours of each row, -1 for none."""
    n, q = len(x), len(asked)
    beam = min(beam, n)
    wide = min(FOLLOWED, beam)
    ids, sims, done = np.full((q, beam), -1), np.full((q, beam), -3, np.float32), np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # where there is no neighbour
    ids[:, 0], sims[:, 0], done[:, 0] = start, asked @ x[start], False
    seen[:, start] = True
    active = np.arange(q)
    while True:
        active = active[~done[active].all(axis=1)]
        if not len(active):
            return np.where(sims > -2.5, ids, -1), sims
        score = np.where(done[active], -4, sims[active])
        pick = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        rows = np.arange(len(active))[:, None]
        node = np.where(score[rows, pick] > -3.5, ids[active[:, None], pick], -1)
        done[active[:, None], pick] = True
        near = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        r, c = np.nonzero(fresh)
        # a node that two of those followed name is kept once
        key = r * (n + 1) + near[r, c]
        _, once = np.unique(key, return_index=True)
        r, c = r[once], c[once]
        s = np.full(near.shape, -3, np.float32)
        s[r, c] = np.einsum("pd,pd->p", asked[active[r]], x[near[r, c]])
        all_s = np.concatenate([sims[active], s], axis=1)
        all_i = np.concatenate([ids[active], near], axis=1)
        all_d = np.concatenate([done[active], s < -2.5], axis=1)
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(a, best, axis=1) for a in (all_s, all_i, all_d))


def pruned(x: np.ndarray, candidates: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """(rows, degree): of each row's candidates (-1: none) the nearest that no kept one is ALPHA times nearer to."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, axis=1), 1 - np.take_along_axis(sims, order, axis=1)
    vectors = x[candidates]
    between = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = candidates >= 0
    out = np.full((len(candidates), degree), -1)
    rows = np.arange(len(candidates))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = candidates[rows, pick][some]
        alive &= (ALPHA * between[rows, pick] > distance) & (candidates != candidates[rows, pick][:, None])
    return out


def robust_graph(x: np.ndarray, degree: int, beam: int, seed: int = 5) -> np.ndarray:
    """Neighbours of each row (n, degree), -1 where there are fewer, built by insertion in groups that double."""
    n = len(x)
    graph = np.full((n, degree), -1)
    if n < 2:
        return graph
    x = x.astype(np.float32)
    medoid = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    at = 1
    while at < n:
        new = order[at : at + min(at, INSERTED)]
        at += len(new)
        found, sims = greedy(x, graph, x[new], medoid, beam)
        graph[new] = pruned(x, found, sims, degree)
        # links back; of many that arrive at once the nearest 2 * degree
        source, slot = np.nonzero(graph[new] >= 0)
        to, back = graph[new[source], slot], new[source]
        near = np.einsum("pd,pd->p", x[to], x[back])
        by = np.lexsort((-near, to))
        to, back, near = to[by], back[by], near[by]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        few = rank < 2 * degree
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))
        targets = to[first]
        pool, pool_sims = np.full((len(targets), 3 * degree), -1), np.full((len(targets), 3 * degree), -3, np.float32)
        pool[:, :degree] = graph[targets]
        old = graph[targets] >= 0
        r, c = np.nonzero(old)
        pool_sims[r, c] = np.einsum("pd,pd->p", x[targets[r]], x[graph[targets[r], c]])
        pool[own[few], degree + rank[few]], pool_sims[own[few], degree + rank[few]] = back[few], near[few]
        graph[targets] = pruned(x, pool, pool_sims, degree)
    return graph


def range_search(x: np.ndarray, begin: np.ndarray, near: np.ndarray, beam: int, cosine: float) -> np.ndarray:
    """(n, n): pairs of rows with at least that cosine that a search finds from either side, by beam search from the
    medoid and expansion from what is in range. near[begin[i] : begin[i + 1]]: neighbours of row i."""
    n = len(x)
    fast = x.astype(np.float32)
    medoid = int((fast @ fast.mean(axis=0)).argmax())
    degree = np.diff(begin)
    graph = np.full((n, int(degree.max(initial=0)) + 1), -1)
    owner = np.repeat(np.arange(n), degree)
    graph[owner, np.arange(len(near)) - begin[owner]] = near
    graph[:, -1] = (np.arange(n) + 1) % n  # a ring, so that a beam wide enough reaches everything
    both, to = np.concatenate([owner, near]), np.concatenate([near, owner])
    by = np.argsort(both, kind="stable")
    to = to[by]
    at = np.searchsorted(both[by], np.arange(n + 1))
    width = np.diff(at)
    slack, linked = cosine - 1e-4, np.zeros((n, n), bool)
    for first in range(0, n, ASKED):
        asked = np.arange(first, min(first + ASKED, n))
        rows = asked - first
        ids, sims = greedy(fast, graph, fast[asked], medoid, beam)
        found = np.zeros((len(asked), n), bool)
        r, c = np.nonzero((sims >= slack) & (ids >= 0))
        found[r, ids[r, c]] = True
        found[rows, asked] = True
        r, c = np.nonzero(found)
        while len(r):
            steps = width[c]
            reached = np.zeros_like(found)
            reached[np.repeat(r, steps), to[np.repeat(at[c] - np.cumsum(steps) + steps, steps) + np.arange(int(steps.sum()))]] = True
            r, c = np.nonzero(reached & ~found)
            near_enough = np.einsum("pd,pd->p", fast[asked[r]], fast[c]) >= slack
            r, c = r[near_enough], c[near_enough]
            found[r, c] = True
        r, c = np.nonzero(found)
        if len(r) > found.size // 8:
            linked[asked] = found & (x[asked] @ x.T >= cosine)
        else:
            exact = np.einsum("pd,pd->p", x[asked[r]], x[c]) >= cosine
            linked[asked[r[exact]], c[exact]] = True
    linked |= linked.T
    linked[np.arange(n), np.arange(n)] = False
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=n)) for i in range(n)])
        new = new[new]
        if (new == label).all():
            return label
        label = new


# ------------------------------------------------------------------ shards


def _nearest(x: np.ndarray, means: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(x @ means.T), axis=1, kind="stable")[:, :overlap].astype(np.int32)


def _split(big: DataFrame, overlap: int, kind: str) -> DataFrame:
    """Rows (rep, weight, v, shard, size) of shards that are too large, dealt to centres of their own: rep, weight, v,
    shard (new) and parent."""
    parts = shuffle_parts(big.sparkSession)
    sample = smallest_hashes(big.withColumn("h", F.xxhash64("rep", F.lit(2))), "shard", SPLIT_SAMPLE, ["h", "rep"])

    @in_worker
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 1):
            x = _matrix(t.column("v"))
            means = centres(x, min(SPLIT, len(x)))
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks()[:1], pa.array([means.tobytes()], pa.binary())], ["shard", "means"])

    means = sample.select("shard", "h", "rep", "v").repartition(parts, "shard").sortWithinPartitions("shard", "h", "rep").mapInArrow(learn, "shard long, means binary")
    sizes = big.groupBy("shard").agg(F.first("size").alias("size"))
    salts = F.ceil(F.col("size") / (2 * SHARD))
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    told = means.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), none("rep", "long"), none("weight", "long"), none("v", kind), "means")
    rows = big.select("shard", F.pmod(F.xxhash64("rep", F.lit(3)), salts).alias("salt"), F.lit(1).alias("kind"), "rep", "weight", "v", none("means", "binary"))

    @in_worker
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 2):
            own = t.slice(1)
            if own.num_rows:
                x = _matrix(own.column("v"))
                near = _nearest(x, np.frombuffer(t.column("means")[0].as_py()).reshape(-1, x.shape[1]), overlap)
                row, place = np.repeat(np.arange(len(near)), near.shape[1]), pa.array(near.ravel())
                kept = own.select(["shard", "rep", "weight", "v"]).take(pa.array(row)).combine_chunks().to_batches()
                for b in kept:
                    yield pa.RecordBatch.from_arrays([*b.columns, place.slice(0, b.num_rows)], ["parent", "rep", "weight", "v", "place"])
                    place = place.slice(b.num_rows)

    key = ["shard", "salt", "kind"]
    dealt = told.unionByName(rows).repartition(parts, "shard", "salt").sortWithinPartitions(*key).mapInArrow(deal, f"parent long, rep long, weight long, v {kind}, place int")
    return dealt.select("rep", "weight", "v", F.xxhash64("parent", "place").alias("shard"), "parent")


def _shards(classes: DataFrame, means: np.ndarray, overlap: int, kind: str) -> DataFrame:
    """(rep, weight, v, shard, size): classes in shards of SHARD classes, or more that cannot be split."""

    @in_worker
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _nearest(_matrix(b.column(2)), means, overlap).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int64()))], ["rep", "weight", "v", "shards"])

    rows = classes.mapInArrow(assign, f"rep long, weight long, v {kind}, shards array<long>").select("rep", "weight", "v", F.explode("shards").alias("shard"))
    rows = materialize(rows, "shards")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, "shard").select("rep", "weight", "v", "shard", "size")
    done = rows.where(F.col("size") <= SHARD)
    rows = rows.where(F.col("size") > SHARD)
    if len(means) == 1 and overlap > 1:  # the exact way: one shard
        return done.union(rows)
    while True:
        rows = materialize(rows, "large")
        if not rows.limit(1).count():
            return done
        parts = materialize(_split(rows, overlap, kind), "split")
        sizes = parts.groupBy("parent", "shard").agg(F.count(F.lit(1)).alias("size"))
        before = rows.groupBy(F.col("shard").alias("parent")).agg(F.first("size").alias("before"))
        sizes = sizes.join(before, "parent")
        # no part may keep most of its shard
        whole = sizes.groupBy("parent").agg((F.max("size") > UNSPLIT * F.first("before")).alias("stays"))
        done = done.union(rows.join(whole.where("stays").select(F.col("parent").alias("shard")), "shard", "left_semi").select("rep", "weight", "v", "shard", "size"))
        sizes = materialize(sizes.join(whole.where("NOT stays").select("parent"), "parent", "left_semi"), "sizes")
        parts = parts.join(sizes.select("shard", "size"), "shard").select("rep", "weight", "v", "shard", "size")
        done = done.union(parts.where(F.col("size") <= SHARD))
        rows = parts.where(F.col("size") > SHARD)


def _neighbours(classes: DataFrame, means: np.ndarray, overlap: int, degree: int, beam: int, cosine: float, kind: str) -> DataFrame:
    """(rep, links, root): for each task and class, rows linked (by weight) and the smallest class linked in the task."""
    parts = shuffle_parts(classes.sparkSession)
    rows = _shards(classes, means, overlap, kind).withColumn("blocks", F.ceil(F.col("size") / SHARD).cast("int"))
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("size"), "blocks")

    @in_worker
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 2):
            rep = t.column("rep").to_numpy()
            graph = robust_graph(_matrix(t.column("v")), degree, 2 * beam)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array([rep[g[g >= 0]] for g in graph], pa.list_(pa.int64()))], ["rep", "near"])

    built = rows.select("shard", "block", "rep", "v").repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "rep").mapInArrow(build, "rep long, near array<long>")
    homes = rows.groupBy("rep").agg(F.sort_array(F.collect_list("shard")).alias("homes"))
    union = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).join(homes, "rep")
    union = materialize(union, "adjacency")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o.cast("long")).alias("i"), F.greatest("block", o.cast("long")).alias("j")))
    tasks = rows.join(union, "rep").withColumn("ij", F.explode(pairs)).select("shard", "ij.i", "ij.j", "rep", "weight", "v", "block", "homes", "near")

    @in_worker
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 3):
            shard, one = t.column("shard")[0].as_py(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
            rep, weight, block = (t.column(c).to_numpy() for c in ("rep", "weight", "block"))
            n = len(rep)
            x = _matrix(t.column("v"))
            flat, ends = lists(t.column("near").combine_chunks(), np.int64)
            place = np.minimum(np.searchsorted(rep, flat), n - 1)
            here = rep[place] == flat
            begin = np.concatenate([[0], np.cumsum(here)])[ends]
            linked = range_search(x, begin, place[here], beam, cosine)
            roots = rep[_roots(linked)]
            # a pair counts in the first shard that both are in, and there in the task of its two blocks
            home, ends = lists(t.column("homes").combine_chunks(), np.int64)
            before = np.flatnonzero(home < shard)
            _, which = np.unique(home[before], return_inverse=True)
            also = np.zeros((n, int(which.max(initial=-1)) + 1), np.float32)
            also[np.repeat(np.arange(n), np.diff(ends))[before], which] = 1
            for i in range(0, n, 512):
                linked[i : i + 512] &= also[i : i + 512] @ also.T == 0
                if not one:
                    linked[i : i + 512] &= block[i : i + 512, None] != block
            links = np.array([weight[row].sum() for row in linked], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(roots)], ["rep", "links", "root"])

    key = ["shard", "i", "j"]
    return tasks.repartition(parts, *key).sortWithinPartitions(*key, "rep").mapInArrow(search, "rep long, links long, root long")


def _true_links(classes: DataFrame, probes: list, cosine: float) -> dict[int, int]:
    """Rows that each probe (rep, vector) links with, by brute force over all classes."""
    ids = np.array([p[0] for p in probes], np.int64)
    x = np.array([p[1] for p in probes], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    @in_worker
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                hit = (x @ _matrix(b.column(2)).T >= cosine) & (ids[:, None] != b.column(0).to_numpy()[None])
                total += hit @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["rep", "links"])

    return {r[0]: r[1] for r in classes.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links")).collect()}


def _linked(classes: DataFrame, total: int, cosine: float, kind: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """(rep, links) and (rep, root) of classes whose vectors are all as long, and the audited recall of each attempt."""
    sample = [r[0] for r in classes.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()]
    sample = np.array(sample, np.float64)
    sample /= np.abs(sample).max(axis=1, keepdims=True)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    k = int(min(CENTRES, len(sample) // 4 + 1, max(1, -(-total * OVERLAP // SHARD))))
    means = centres(sample, k)
    recalls: list[float] = []
    scale = 1
    while True:
        exact = scale > MOST_SCALE
        found = _neighbours(classes, means[:1] if exact else means, OVERLAP * scale, DEGREE * scale, 2 * SHARD if exact else BEAM * scale, cosine, kind)
        found = materialize(found, "found")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        if exact:
            return links, found, [*recalls, 1.0]
        order = F.xxhash64("rep", F.lit(1))
        some = classes.select("rep").orderBy(order).limit(AUDIT // 2).union(links.where("links > 0").select("rep").orderBy(order).limit(AUDIT // 2)).distinct()
        probes = [(r[0], r[1]) for r in classes.join(F.broadcast(some), "rep").select("rep", "v").collect()]  # AUDIT rows at most
        truth = _true_links(classes, probes, cosine)
        got = {r[0]: r[1] for r in links.join(F.broadcast(some), "rep").collect()}
        shares = [min(got.get(i, 0), n) / n for i, n in truth.items() if n]
        recalls.append(sum(shares) / len(shares) if shares else 1.0)
        if recalls[-1] >= LEAST:
            return links, found, recalls
        scale *= 2


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> tuple[DataFrame, list[float]]:
    """id_col, n_links, component_id and kept of every row; and the audited recall of each attempt."""
    spark = rows.sparkSession
    ship_package(spark)
    given = rows.schema[vector_col].dataType.simpleString()
    kind = "array<float>" if given == "array<float>" else "array<double>"
    shown = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    largest = F.array_max(F.transform("v", lambda e: F.when(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")), F.lit(float("inf"))).otherwise(F.abs(e).cast("double"))))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & (largest > 0) & (largest < float("inf"))
    good = shown.where(F.coalesce(usable, F.lit(False)))
    classes = materialize(good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).select("rep", "weight", "v"), "classes")
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    recalls: list[float] = []
    named = None
    for size, total in sorted(sizes.items()):
        # an id may stand for vectors of several lengths, or for several of one length: then they share their links
        own = classes if len(sizes) == 1 else materialize(classes.where(F.size("v") == size), "lengths")
        links, found, audited = _linked(own, total, cosine, kind)
        recalls += audited
        labels = components(found.where("root != rep").select(F.col("root").alias("a"), F.col("rep").alias("b")))
        part = own.join(links, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        part = part.select("v", (F.col("links") + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
        named = part if named is None else named.union(part)
    if named is None:
        return shown.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")), recalls
    out = shown.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")), recalls


def op9_vector_graph(spark, sf_dir: str) -> DataFrame:
    """audited_recall: the share of their links that the audited vectors got."""
    found, recalls = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("audited_recall", F.lit(recalls[-1] if recalls else 1.0))
