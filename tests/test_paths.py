"""Paths as long as they are."""

from quadrille.operators import graph


def test_a_path_of_70_steps(spark):
    edge = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(70)] + [("x", "y")], "a string, b string")
    assert [tuple(r) for r in graph.shortest_path(edge, "n00", "n70").orderBy("step").collect()] == [(i, f"n{i:02}") for i in range(71)]
    assert graph.shortest_path(edge, "x", "n00").count() == 0
    assert [tuple(r) for r in graph.shortest_path(edge, "x", "x").collect()] == [(0, "x")]
