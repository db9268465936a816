"""The stages of the format in SQL: IRI split, dictionaries, delta codes, repeated terms, state resolution, framing.

All windows are by stream, so nothing here meets in one task that the format itself does not order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.functions.store import dealt
from quadrille.functions.terms import split_iri


def iri_accesses(statements: DataFrame) -> DataFrame:
    """(stream_id, row_idx, slot, iri, prefix, name): IRIs in the order in which an encoder meets them; terms that
    repeat the slot's last value are not met again."""
    w = Window.partitionBy("stream_id").orderBy("row_idx")
    slots = [F.when((F.col(c)["kind"] == "iri") & ~F.coalesce(F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(False)), F.col(c)["value"]).alias(c) for c in "spog"]
    wide = dealt(statements, "stream_id").select("stream_id", "row_idx", *slots)
    met = wide.select("stream_id", "row_idx", F.posexplode(F.array(*"spog")).alias("slot", "iri")).where("iri IS NOT NULL")
    prefix, name = split_iri(F.col("iri"))
    return met.select("stream_id", "row_idx", "slot", "iri", prefix.alias("prefix"), name.alias("name"))


def dictionary(accesses: DataFrame, column: str) -> DataFrame:
    """(stream_id, value, id) of a table that never overflows: ids follow first appearance. Values are pre-aggregated
    before the numbering window, which so holds one row per distinct value."""
    first = accesses.groupBy("stream_id", F.col(column).alias("value")).agg(F.min(F.struct("row_idx", "slot")).alias("first"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("first"))
    return first.select("stream_id", "value", number.alias("id"))


def delta_codes(accesses: DataFrame) -> DataFrame:
    """Accesses with prefix_code and name_code: 0 for the same prefix again, and for the name after the last. Ids follow
    first appearance; all windows are inside a stream, so accesses are dealt out once."""
    w = Window.partitionBy("stream_id").orderBy("row_idx", "slot")
    coded = accesses
    for part in ("prefix", "name"):
        own = Window.partitionBy("stream_id", part).orderBy("row_idx", "slot")
        coded = coded.withColumn("__first", (F.row_number().over(own) == 1).cast("int"))
        coded = coded.withColumn("__met", F.sum("__first").over(w)).withColumn(f"{part}_id", F.first("__met").over(own))
    return coded.select("stream_id", "row_idx", "slot", "iri", "prefix_id", "name_id", F.when(F.col("prefix_id").eqNullSafe(F.lag("prefix_id").over(w)), 0).otherwise(F.col("prefix_id")).alias("prefix_code"), F.when(F.col("name_id") == F.coalesce(F.lag("name_id").over(w), F.lit(0)) + 1, 0).otherwise(F.col("name_id")).alias("name_code"))


def repeated_terms(statements: DataFrame) -> DataFrame:
    """Statements with same_s .. same_g: whether a slot repeats the statement before in its stream."""
    w = Window.partitionBy("stream_id").orderBy("row_idx")
    first = F.row_number().over(w) == 1
    return dealt(statements, "stream_id").select("*", *(F.when(first, F.lit(False)).otherwise(F.col(c).eqNullSafe(F.lag(c).over(w))).alias(f"same_{c}") for c in "spog"))


def graph_runs(statements: DataFrame) -> DataFrame:
    """Statements with run: a number, from 0, that grows wherever the graph differs from the statement before."""
    w = Window.partitionBy("stream_id").orderBy("row_idx")
    marked = dealt(statements, "stream_id").withColumn("__new", F.when(F.lag(F.lit(1)).over(w).isNull() | F.col("g").eqNullSafe(F.lag("g").over(w)), 0).otherwise(1))
    return marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def bounded_frames(rows: DataFrame, frame_size: int) -> DataFrame:
    """(stream_id, row_idx, frame_idx) of statements that weigh `n_rows` rows each: a frame ends with the statement that
    fills it, and the options row weighs 1. As the sum starts again at every cut, each stream is walked in order, with
    one number kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, fill, frame = None, 1, 0
        for batch in batches:
            out = []
            for id_, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if id_ != stream:
                    stream, fill, frame = id_, 1, 0
                out.append(frame)
                fill += n
                if fill >= frame_size:
                    fill, frame = 0, frame + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["stream_id", "row_idx", "frame_idx"])

    shown = rows.select("stream_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("n_rows").cast("long").alias("n_rows"))
    return dealt(shown, "stream_id").sortWithinPartitions("stream_id", "row_idx").mapInArrow(run, "stream_id string, row_idx long, frame_idx long")


_TABLES = ("name", "prefix", "datatype")
_HELD = ("triple", "quad", "graph_start", "graph_end")


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values)


def resolve(rows: DataFrame) -> DataFrame:
    """Statements of coded rows (codec.rows), by windows alone: what the sequential decoder gives, for streams without
    quoted triples.

    One pass by stream resolves the coded ids: an id that is not written is the anchor before it plus the number of ids
    since. Dictionary probes are as-of joins, the last entry of an id before its reference: references, entries and the
    rows themselves go through one window by table and id. A last pass by stream puts the terms back and fills repeated
    ones. Every key begins with the stream, so rows are dealt out once, and joined with nothing.
    """
    w = Window.partitionBy("stream_id").orderBy("row_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    wide = dealt(rows, "stream_id").where("row_kind != 'options'")
    is_iri = [F.coalesce(F.col(c)["kind"] == "iri", F.lit(False)) for c in "spog"]
    prefix_id = [F.when(is_iri[k] & (F.col(c)["prefix_id"] != 0), F.col(c)["prefix_id"]) for k, c in enumerate("spog")]
    counts = [i.cast("int") for i in is_iri]
    wide = wide.select("*", F.coalesce(F.sum(sum(counts[1:], counts[0])).over(before), F.lit(0)).alias("met"), F.last(_first(prefix_id[::-1]), ignorenulls=True).over(before).alias("prefix"), *(F.sum(F.when(F.col("row_kind") == t, 1).otherwise(0)).over(until).alias(f"n_{t}") for t in _TABLES))
    place = [F.col("met") + sum(counts[1 : k + 1], counts[0]) for k in range(4)]
    anchor = [F.when(is_iri[k] & (F.col(c)["name_id"] != 0), F.col(c)["name_id"] - place[k]) for k, c in enumerate("spog")]
    written = {t: F.when((F.col("row_kind") == t) & (F.col("entry_id") != 0), F.col("entry_id") - F.col(f"n_{t}")) for t in _TABLES}
    wide = wide.select("*", F.last(_first(anchor[::-1]), ignorenulls=True).over(before).alias("anchor"), *(F.last(written[t], ignorenulls=True).over(until).alias(f"a_{t}") for t in _TABLES))

    def item(what: str, id_: Column, slot: int, value: Column | None = None, held: Column | None = None) -> Column:
        return F.struct(F.lit(what).alias("what"), id_.cast("long").alias("id"), F.lit(slot).alias("slot"), (F.lit(None).cast("string") if value is None else value).alias("value"), (F.lit(None).cast(kept_type) if held is None else held).alias("held"))

    kept = F.struct("frame_idx", "row_kind", *(F.struct(F.col(c)["kind"].alias("kind"), F.col(c)["value"].alias("value"), F.col(c)["lang"].alias("lang")).alias(c) for c in "spog"))
    term_type = "struct<kind:string,value:string,lang:string>"
    kept_type = "struct<frame_idx:bigint,row_kind:string," + ",".join(f"{c}:{term_type}" for c in "spog") + ">"
    items = [F.when(F.col("row_kind").isin(*_HELD), item("row", F.col("row_idx"), 4, held=kept.cast(kept_type)))]
    for t in _TABLES:
        items.append(F.when(F.col("row_kind") == t, item(t, F.col(f"n_{t}") + F.coalesce(f"a_{t}", F.lit(0)), -1, F.col("entry_value"))))
    for k, c in enumerate("spog"):
        items.append(F.when(is_iri[k], item("name", place[k] + _first([*anchor[: k + 1][::-1], F.col("anchor"), F.lit(0)]), k)))
        prefix = _first([*prefix_id[: k + 1][::-1], F.col("prefix"), F.lit(0)])
        items.append(F.when(is_iri[k] & (prefix != 0), item("prefix", prefix, k)))
        items.append(F.when(F.col(c)["datatype_id"].isNotNull(), item("datatype", F.col(c)["datatype_id"], k)))
    every = wide.select("stream_id", "row_idx", F.explode(F.array_compact(F.array(*items))).alias("x")).select("stream_id", "row_idx", "x.*")
    asof = Window.partitionBy("stream_id", "what", "id").orderBy("row_idx", "slot")
    probed = every.withColumn("value", F.last("value", ignorenulls=True).over(asof)).where("slot >= 0")
    values = [F.max(F.when((F.col("slot") == k) & (F.col("what") == t), F.col("value"))).alias(f"{t}_{c}") for k, c in enumerate("spog") for t in _TABLES]
    back = probed.groupBy("stream_id", "row_idx").agg(F.first("held", ignorenulls=True).alias("held"), *values).where("held IS NOT NULL").select("stream_id", "row_idx", "held.frame_idx", "held.row_kind", *(F.col(f"held.{c}").alias(c) for c in "spog"), *(f"{t}_{c}" for c in "spog" for t in _TABLES))
    none = F.lit(None).cast("string")

    def term(c: str) -> Column:
        kind = F.col(c)["kind"]
        value = F.when(kind == "iri", F.concat(F.coalesce(f"prefix_{c}", F.lit("")), f"name_{c}")).otherwise(F.col(c)["value"])
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), value.alias("value"), F.col(c)["lang"].alias("lang"), F.when(kind == "literal", F.col(f"datatype_{c}")).alias("datatype")))

    statement = F.col("row_kind").isin("triple", "quad")
    # an end marker is a graph of its own kind, so that the fill stops there
    end = F.struct(F.lit("none").alias("kind"), none.alias("value"), none.alias("lang"), none.alias("datatype"))
    shown = back.select("stream_id", "frame_idx", "row_idx", "row_kind", *(F.when(statement, term(c)).alias(c) for c in "spog"), F.when(F.col("row_kind") == "graph_start", term("s")).when(F.col("row_kind") == "graph_end", end).alias("mark"))
    filled = shown.select("stream_id", "frame_idx", "row_idx", "row_kind", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("s", "p", "o", "g", "mark")))
    graph = F.when(F.col("row_kind") == "quad", F.col("g")).otherwise(F.when(F.col("mark")["kind"] != "none", F.col("mark")))
    return filled.where("row_kind IN ('triple', 'quad')").select("stream_id", "frame_idx", "row_idx", "s", "p", "o", graph.alias("g"))
