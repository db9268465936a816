"""N-Triples and N-Quads text, with quoted triples and `@prefix` lines, to statements and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadrille.functions.terms import n3, parse_terms
from quadrille.operators.codec import _Columns
from quadrille.schema import STATEMENT

_STATEMENT = to_arrow_schema(STATEMENT)


def _parsed(rows: Iterator[tuple[str, int, str]], quads: bool) -> Iterator[pa.RecordBatch]:
    out = _Columns(_STATEMENT)
    default = ("default", None, None, None) if quads else None
    for stream, row, line in rows:
        if line.lstrip().startswith("@prefix"):
            continue
        terms = parse_terms(line)
        if not terms:
            continue
        if len(terms) not in (3, 4):
            raise ValueError(f"a statement has three or four terms: {line!r}")
        out.add((stream, 0, row, *terms[:3], terms[3] if len(terms) == 4 else default))
        if out.full():
            yield out.take()
    if out.rows:
        yield out.take()


def parse_lines(lines: DataFrame, quads: bool = False) -> DataFrame:
    """Statements (STATEMENT, frame 0) of (stream_id, row_idx, value) lines; blank lines, comments and @prefix lines
    give none. quads: a statement of three terms is in the default graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parsed((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), quads)

    return lines.select("stream_id", "row_idx", "value").mapInArrow(run, STATEMENT)


def prefixes(lines: DataFrame) -> DataFrame:
    """(stream_id, row_idx, prefix, iri) of the @prefix lines."""
    pattern = r"^\s*@prefix\s+([^:\s]*):\s*<([^>]*)>"
    return lines.where(F.col("value").rlike(pattern)).select("stream_id", "row_idx", F.regexp_extract("value", pattern, 1).alias("prefix"), F.regexp_extract("value", pattern, 2).alias("iri"))


def read(spark: SparkSession, path: str, quads: bool | None = None) -> DataFrame:
    """Statements of text files; stream_id is the file's name. row_idx orders its lines, however Spark splits the file: it
    is the byte where the line's split begins plus the lines before it in that split, as no line is shorter than a byte."""
    found = spark.read.text(path).select(F.col("_metadata.file_name").alias("stream_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value")
    as_quads = path.endswith((".nq", ".nq.gz")) if quads is None else quads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, str]]:
            split, count = None, 0
            for b in batches:
                for name, *here, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if here != split:
                        split, count = here, 0
                    yield name, here[1] + count, line
                    count += 1

        yield from _parsed(rows(), as_quads)

    return found.mapInArrow(run, STATEMENT)


def lines(statements: DataFrame, escape: bool = True) -> DataFrame:
    """(stream_id, row_idx, value): a line for each statement."""
    graph = F.when(F.col("g").isNull() | (F.col("g")["kind"] == "default"), F.lit(None).cast("string")).otherwise(n3(F.col("g"), escape))
    return statements.select("stream_id", "row_idx", F.concat(F.concat_ws(" ", n3(F.col("s"), escape), n3(F.col("p"), escape), n3(F.col("o"), escape), graph), F.lit(" .")).alias("value"))


def write(statements: DataFrame, path: str) -> None:
    """Text files in the order of (stream_id, row_idx) within each."""
    lines(statements).repartitionByRange("stream_id", "row_idx").sortWithinPartitions("stream_id", "row_idx").select("value").write.text(path)
