"""Components against a search by hand: shapes that peel, shapes that do not, and nodes whose numbers meet."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import graph
from quadrille.plans import catalog
from quadrille.plans.mapping import CUSTOMER, DOCUMENTS, NATION, ORDERS

SF = "/root/testdata/sf0.001"


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for node in sorted(near):
        todo = [node]
        while todo:
            at = todo.pop()
            if at not in found:
                found[at] = node
                todo += near[at]
    return found


def shapes():
    draw = random.Random(7)
    n = lambda kind, i: f"{kind}{i:03d}"
    edges = [(n("path", i), n("path", i + 1)) for i in range(60)] + [(n("ring", i), n("ring", (i + 1) % 40)) for i in range(40)]
    edges += [(n("pair", 2 * i), n("pair", 2 * i + 1)) for i in range(20)] + [("loop", "loop"), ("pair000", "pair000")]
    edges += [(n("star", 0), n("star", i)) for i in range(1, 50)] + [(n("leaf", i), n("ring", i % 40)) for i in range(90)]
    edges += [(n("tree", i), n("tree", (i - 1) // 3)) for i in range(1, 120)] + [(n("any", draw.randrange(150)), n("any", draw.randrange(150))) for _ in range(140)]
    edges += edges[:30] + [(b, a) for a, b in edges[60:90]]
    draw.shuffle(edges)
    return edges


def components(spark, edges):
    rows = graph.components(spark.createDataFrame(edges, "a string, b string")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    return got


def test_shapes(spark):
    assert components(spark, shapes()) == brute(shapes())


def test_loops_and_nothing(spark):
    assert components(spark, [("x", "x")]) == {"x": "x"}
    assert components(spark, []) == {}


def test_nodes_with_one_number_are_kept_apart(spark, monkeypatch):
    salts = []

    def few(node, salt):
        salts.append(salt)
        return F.pmod(F.xxhash64(node), F.lit(16)) if salt == 0 else F.xxhash64(node, F.lit(salt))

    monkeypatch.setattr(graph, "_id", few, raising=False)
    assert components(spark, shapes()[:150]) == brute(shapes()[:150])
    assert set(salts) == {0, 1}


def test_trees_end_by_peeling(spark, monkeypatch):
    """Orders on customers on nations on regions: no round of contraction, whose joins move every link twice."""
    rounds = []
    contracted = graph._contracted
    monkeypatch.setattr(graph, "_contracted", lambda *args: rounds.append(args) or contracted(*args))
    assert catalog.QUERIES["connected_components"](spark, SF).select("component").distinct().count() == 5
    assert not rounds


@pytest.mark.parametrize("mapping", [ORDERS, CUSTOMER, NATION, DOCUMENTS])
def test_links_are_the_statements_with_iris(spark, mapping):
    rows = lambda **k: catalog.statements(spark, SF, mapping, **k)
    want = sorted(map(repr, rows().where(F.col("o")["kind"] == "iri").collect()))
    assert bool(want) == (mapping is not DOCUMENTS) and sorted(map(repr, rows(links=True).collect())) == want
