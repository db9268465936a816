"""Grouped reads: one graph or dataset per frame, counts, set semantics, functions of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.codec import frame_metadata, streams_of
from quadrille.sources.kernel import Decoder


def per_frame(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_idx, n): statements of every frame, empty frames included, read from the frames without decoding."""
    return frame_metadata(frames).select("stream_id", "frame_idx", F.col("n_statements").cast("long").alias("n"))


def as_set(statements: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Distinct statements, in all or within the given columns; order and positions are lost. Frame by frame:
    within=("stream_id", "frame_idx")."""
    return statements.select(*within, "s", "p", "o", "g").distinct()


def per_graph(statements: DataFrame) -> DataFrame:
    """(g, n): statements by graph name, runs joined."""
    return statements.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def unpacked_graphs(statements: DataFrame) -> DataFrame:
    """Triples of a dataset, graph by graph: the graph's name becomes the group, and g goes."""
    return statements.withColumn("graph", F.col("g")).withColumn("g", F.lit(None).cast(statements.schema["g"].dataType))


def apply_per_frame(frames: DataFrame, function: Callable[[str, int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """function(stream_id, frame_idx, statements) of every frame, empty ones too, and the rows that it returns. Statements
    are tuples (s, p, o, g) of terms (kind, value, lang, datatype); a frame is in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, contents in streams_of(batches):
            decoder = Decoder()
            for number, content in enumerate(contents):
                rows = function(stream, number, [e[1:] for _, e in decoder.frame(content) if e[0] == "statement"])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    ordered = frames.repartition("stream_id").sortWithinPartitions("stream_id", "frame_idx").select("stream_id", "frame_idx", "content")
    return ordered.mapInArrow(run, schema)
