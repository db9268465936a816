"""What a task holds does not grow with the input, and rows are dealt out no more often than needed."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import store
from quadrille.operators import codec, relational
from quadrille.options import Options
from quadrille.plans import catalog
from quadrille.plans.mapping import EVENTS, ORDERS

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dict_names", "dict_prefixes", "delta_codes", "decode_relational_graphs", "frames_per_graph"])
def test_tasks_follow_the_input(spark, monkeypatch, name):
    monkeypatch.setattr(store, "TASK_BYTES", 1024)
    tasks = store.input_bytes(spark.read.parquet(f"{SF}/{'orders' if 'd' == name[0] and 'graphs' not in name else 'events'}.parquet")) // 1024
    assert tasks > 8
    assert f"hashpartitioning(stream_id" in _plan(catalog.QUERIES[name](spark, SF))
    assert f", {tasks}), REPARTITION_BY_NUM" in _plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("copies", [1, 16])
def test_tasks_follow_the_rows_of_files_that_compress_well(spark, monkeypatch, tmp_path, copies):
    monkeypatch.setattr(store, "TASK_ROWS", 100, raising=False)
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events.parquet")
    many = events.select(((F.col("event_id") * copies).alias("event_id")), *(F.lit(v).alias(c) for c, v in events.drop("event_id").head().asDict().items()), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"))
    many.withColumn("event_id", F.col("event_id") + F.col("k")).drop("k").coalesce(1).write.parquet(path)
    assert store.input_bytes(spark.read.parquet(path)) < store.TASK_BYTES
    plan = _plan(catalog.QUERIES["decode_relational_graphs"](spark, str(tmp_path)))
    assert plan.count(f", {events.count() * copies // 100}), REPARTITION_BY_NUM") == 3


def test_few_tasks_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 400, raising=False)
    assert store.input_rows(spark.read.parquet(f"{SF}/events.parquet")) == 1000
    assert "REPARTITION_BY_COL" not in _plan(catalog.QUERIES["decode_relational_graphs"](spark, SF))


def test_rows_are_counted_in_parquet_files_alone(spark, tmp_path):
    spark.range(10).write.csv(str(tmp_path / "csv"))
    assert store.input_rows(spark.read.csv(str(tmp_path / "csv"))) is None
    assert store.input_rows(spark.range(10)) is None


def test_resolve_deals_rows_once(spark):
    frames = codec.encode(catalog.statements(spark, SF, EVENTS), Options.of("GRAPHS", "FLAT_QUADS", "small"))
    rows = codec.rows(frames)
    assert _plan(relational.resolve(rows)).count("Exchange") == _plan(rows).count("Exchange") + 1


def test_codec_moves_the_tables_rows_and_not_their_statements(spark):
    plan = _plan(catalog.QUERIES["roundtrip_quads"](spark, SF))
    assert plain_order(plan) == ["Generate", "Exchange"]


def plain_order(plan: str) -> list[str]:
    """The statements' making and the shuffle below it, from the top, under the encoder."""
    below = plan[plan.rindex("MapInArrow") :]
    return [w for _, w in sorted((below.index(w), w) for w in ("Generate", "Exchange"))]
