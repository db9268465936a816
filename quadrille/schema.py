"""Spark types of the statement model."""

from pyspark.sql import types as T

#: kind: iri, bnode, literal, triple (value: its N-Triples text) or default (only as a graph name).
TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "lang", "datatype")])

#: g is null for triples. (stream_id, row_idx) orders statements.
STATEMENT = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("row_idx", T.LongType()),
    *(T.StructField(n, TERM) for n in "spog"),
])

#: What a scan yields: statements, and namespace declarations (event 'namespace') with prefix and iri.
EVENT = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("event", T.StringType()),
    *(T.StructField(n, TERM) for n in "spog"),
    T.StructField("prefix", T.StringType()),
    T.StructField("iri", T.StringType()),
])

FRAME = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("n_rows", T.IntegerType()),
    T.StructField("n_statements", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.BinaryType())),
    T.StructField("content", T.BinaryType()),
])

WTERM = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("prefix_id", T.IntegerType()),
    T.StructField("name_id", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("datatype_id", T.IntegerType()),
])

#: Rows as they are on the wire: ids keep their coded values, a null slot is a repeated term.
ROW = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("row_kind", T.StringType()),
    *(T.StructField(n, WTERM) for n in "spog"),
    T.StructField("entry_id", T.IntegerType()),
    T.StructField("entry_value", T.StringType()),
])

XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_STRING = XSD + "string"
