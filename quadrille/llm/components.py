"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, materialize

#: Links that a task holds at a time.
HELD = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each component of n numbers that links a, b join."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes, at most one less than nodes for every HELD links of a task: each node of a
    task's components with the component's smallest."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = roots(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[own]]), pa.array(nodes[own])], ["a", "b"])

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= HELD:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return links.mapInArrow(run, "a long, b long")


def _edges(links: DataFrame) -> DataFrame:
    """The forests of the links' tasks, each link once, smaller end first."""
    whole = links.where("a != b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    return materialize(_forest(whole).distinct(), "edges")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of a link between two nodes reaches.

    By contraction: each round every node moves to the first of itself and its neighbours, and then to where that one
    moved; the places moved to replace the nodes, and loops and repeated links go. Each task first turns its links into
    stars. Two of three rounds order nodes by themselves, as two in a row end any star; each third by a new hash, in which
    at least a quarter of the nodes is expected to go, whatever the shape. Neighbours are pre-aggregated before a
    shuffle. Every round is written to the shared folder.
    """
    edges = _edges(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    moves: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        salt = len(moves)
        rank = lambda c, k=salt: F.struct((F.xxhash64(c, F.lit(k)) if k % 3 == 2 else F.lit(0).cast("long")).alias("rank"), F.col(c).alias("node"))
        first = both.groupBy("node").agg(F.min(rank("near")).alias("best"))
        moved = materialize(first.select("node", F.least("best", rank("node"))["node"].alias("place")), "moves")
        then = moved.select(F.col("node").alias("place"), F.col("place").alias("next"))
        jumped = moved.join(then, "place").select("node", F.col("next").alias("place"))
        moves.append(jumped)
        to = jumped.select(F.col("node").alias("a"), F.col("place").alias("pa")), jumped.select(F.col("node").alias("b"), F.col("place").alias("pb"))
        edges = _edges(edges.join(to[0], "a").join(to[1], "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    places = moves[-1]
    for moved in reversed(moves[:-1]):  # where a place of this round went in the rounds after it
        later = places.select(F.col("node").alias("place"), F.col("place").alias("end"))
        places = moved.join(later, "place", "left").select("node", F.coalesce("end", "place").alias("place"))
    places = materialize(places, "places")
    least = places.groupBy("place").agg(F.min("node").alias("component"))
    return materialize(places.join(least, "place").select("node", "component"), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of components() once further links (a, b) are drawn; only the components that these join are touched."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    known = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_of", "a").alias("pa"), F.coalesce("b_of", "b").alias("pb"))
    known = materialize(known, "joined")
    joined = components(known, "pa", "pb").select(F.col("node").alias("component"), F.col("component").alias("least"))
    nodes = labels.union(known.select("a", "pa")).union(known.select("b", "pb")).distinct()
    return materialize(nodes.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")
