"""Graph queries over statements: patterns, degrees, components, paths, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.store import release, shared_path, stored


def pattern(statements: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, predicate_iri: str | None = None) -> DataFrame:
    """Bindings of one triple pattern: s, p, o name variables (columns of terms); an unnamed slot is not bound."""
    rows = statements if predicate_iri is None else statements.where((F.col("p")["kind"] == "iri") & (F.col("p")["value"] == predicate_iri))
    return rows.select(*(F.col(c).alias(v) for c, v in (("s", s), ("p", p), ("o", o)) if v))


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join bindings on the variables that both have; how: inner, left, left_semi, left_anti."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the patterns share no variable")
    return left.join(right, shared, how)


def edges(statements: DataFrame) -> DataFrame:
    """Undirected edges (a, b) with a <= b, without repeats, by term value."""
    s, o = F.col("s")["value"], F.col("o")["value"]
    return statements.select(F.least(s, o).alias("a"), F.greatest(s, o).alias("b")).distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    return edge.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _id(node: Column, salt: int) -> Column:
    """A number for a node. Two nodes with one number are seen, and others are taken."""
    return F.xxhash64(node, F.lit(salt))


def _both(left: DataFrame) -> DataFrame:
    return left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))


def _peeled(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (node, place) of nodes with one neighbour to it, and the links of the others. Of a pair, one moves."""
    leaf = _both(left).groupBy("node").agg(F.min("near").alias("near"), F.max("near").alias("last")).where("near = last")
    ends = leaf.select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b"), (F.col("node") < F.col("near")).cast("int").alias("leaf_a"), (F.col("node") > F.col("near")).cast("int").alias("leaf_b"))
    every = left.select("a", "b", F.lit(0).alias("leaf_a"), F.lit(0).alias("leaf_b")).union(ends)
    marked = stored(every.groupBy("a", "b").agg(F.max("leaf_a").alias("leaf_a"), F.max("leaf_b").alias("leaf_b")), "marked")
    from_b = F.col("leaf_b") == 1
    moves = marked.where("leaf_a + leaf_b > 0").select(F.when(from_b, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(from_b, F.col("a")).otherwise(F.col("b")).alias("place"))
    return moves, stored(marked.where("leaf_a + leaf_b = 0").select("a", "b"), "edges")


def _contracted(left: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """Moves (node, place) of all nodes to the first of themselves and their neighbours, and then to where that one moved,
    and the links between places. Two of three rounds go by the nodes' numbers, each third by a new hash."""
    rank = (lambda c: F.xxhash64(c, F.lit(round_))) if round_ % 3 == 2 else F.col
    best = _both(left).groupBy("node").agg(F.min_by("near", rank("near")).alias("near"))
    moved = stored(best.select("node", F.when(rank("near") < rank("node"), F.col("near")).otherwise(F.col("node")).alias("place")), "moves")
    jumped = stored(moved.join(moved.select(F.col("node").alias("place"), F.col("place").alias("next")), "place").select("node", F.col("next").alias("place")), "moves")
    to = [jumped.select(F.col("node").alias(c), F.col("place").alias(f"to_{c}")) for c in "ab"]
    ends = left.join(to[0], "a").join(to[1], "b").where("to_a != to_b")
    return jumped, stored(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")


def components(edge: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches, by contraction.

    Nodes go by 64-bit numbers until the end. Nodes with one neighbour move to it, again while that ends half of the links;
    then every node moves to the first of itself and its neighbours, and links follow their ends. In each third of these
    rounds the order is a new hash, in which a constant share of the nodes is expected to go, whatever the graph's shape.
    So all rounds together cost little more than the first. Places are then put together from the last round, the
    smallest, to the first.
    """
    edge = stored(edge.select("a", "b"), "given")
    salt = 0
    while (found := _places(edge, salt)) is None:
        salt += 1
    least = stored(found.groupBy("place").agg(F.min("node").alias("component")), "least")
    return found.join(least, "place").select("node", "component")


def _places(edge: DataFrame, salt: int) -> DataFrame | None:
    """(node, place): one place for the nodes of a component; None where two nodes have one number."""
    a, b = _id(F.col("a"), salt), _id(F.col("b"), salt)
    left = edge.where("a != b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b")
    left, steps, rounds = stored(left, "edges"), [], 0
    many = left.count()
    while many:
        moves, left = _peeled(left)
        steps.append((moves, True))
        before, many = many, left.count()
        if many * 2 > before:
            moves, left = _contracted(left, rounds)
            steps.append((moves, False))
            rounds, many = rounds + 1, left.count()
    places = None
    for k in range(len(steps) - 1, -1, -1):
        moves, is_part = steps[k]
        if places is None:
            places = moves
            continue
        later = places.select(F.col("node").alias("place"), F.col("place").alias("end"))
        whole = moves.join(later, "place", "left").select("node", F.coalesce("end", "place").alias("place"))
        places = whole.union(places) if is_part else whole
        places = stored(places, "places") if k else places
    nodes = edge.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").select(_id(F.col("node"), salt).alias("id"), "node")
    nodes = nodes.groupBy("id").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    if places is None:
        nodes = nodes.withColumn("place", F.col("id"))
    else:
        nodes = nodes.join(places.select(F.col("node").alias("id"), "place"), "id", "left").withColumn("place", F.coalesce("place", "id"))
    nodes = stored(nodes.select("node", "place", (F.col("node") != F.col("last")).alias("met")), "nodes")
    return None if nodes.where("met").limit(1).count() else nodes.select("node", "place")


def shortest_path(edge: DataFrame, start: str, end: str) -> DataFrame:
    """(step, node) of a shortest path; of several, the one whose nodes before are smallest. No rows without a path.

    Breadth first, a table for each step; only what a step newly reaches is written. The way back is a chain of joins,
    so the driver sees one row a step at most.
    """
    spark = edge.sparkSession
    both = stored(edge.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edge.select("b", "a")).distinct(), "edges")
    path = shared_path(spark, "reached")
    spark.createDataFrame([(start, None)], "node string, before string").write.parquet(f"{path}/step=0")
    step = 0

    def reached(least: int = 0) -> DataFrame:
        return spark.read.schema("node string, before string, step int").option("basePath", path).parquet(path).where(F.col("step") >= least)

    while not reached(step).where(F.col("node") == end).limit(1).count():
        new = both.join(reached(step).select("node"), "node").groupBy(F.col("near").alias("to")).agg(F.min("node").alias("before"))
        new.join(reached().select(F.col("node").alias("to")), "to", "left_anti").select(F.col("to").alias("node"), "before").write.parquet(f"{path}/step={step + 1}")
        step += 1
        if not reached(step).limit(1).count():
            release(spark, [path])
            return spark.createDataFrame([], "step int, node string")
    found, at = [], end
    for k in range(step, -1, -1):  # one node a step
        found.append((k, at))
        at = reached(k).where((F.col("step") == k) & (F.col("node") == at)).head()["before"]
    release(spark, [path])
    return spark.createDataFrame(found, "step int, node string")


def induced(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    return edge.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def pairing(statements: DataFrame, first: str, second: str) -> DataFrame:
    """Both directions of (object of first, object of second) of each subject."""
    a, b = pattern(statements, s="x", o="a", predicate_iri=first), pattern(statements, s="x", o="b", predicate_iri=second)
    both = join(a, b)
    return both.select("a", "b").union(both.select("b", "a"))


def without(statements: DataFrame, predicates: list[str]) -> DataFrame:
    return statements.where(~((F.col("p")["kind"] == "iri") & F.col("p")["value"].isin(predicates)))
