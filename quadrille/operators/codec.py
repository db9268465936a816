"""Encoding and decoding as DataFrame operators: statements to frames, frames to rows and statements.

Streams are independent, and each is sequential: rows are dealt by stream_id and sorted within partitions, so memory is
one frame and one stream's dictionaries. Choose many streams (`spread`) for parallelism; a hot stream is a choice of the
caller that `spread` undoes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quadrille.functions.store import dealt
from quadrille.options import ConformanceError, Options
from quadrille.schema import EVENT, FRAME, ROW, TERM
from quadrille.sources import columnar, wire
from quadrille.sources.kernel import Decoder, Encoder, Frame

#: Parts of a term.
_PARTS = TERM.names
_EVENT, _FRAME, _ROW = to_arrow_schema(EVENT), to_arrow_schema(FRAME), to_arrow_schema(ROW)
#: Events, and frames, that a record batch holds.
BATCH = 5000
#: Bytes of frames that are decoded at once.
CHUNK = 512 << 10
FRAMES = 64


def spread(statements: DataFrame, streams: int, by: Column) -> DataFrame:
    """Give each row one of `streams` stream ids by the hash of a column; order inside a stream stays row_idx."""
    return statements.withColumn("stream_id", F.concat_ws("-", "stream_id", F.lpad(F.pmod(F.xxhash64(by), F.lit(streams)).cast("string"), 5, "0")))


def _terms(batch: pa.RecordBatch, name: str) -> list[tuple | None]:
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        return [None] * batch.num_rows
    parts = [column.field(i).to_pylist() for i in range(4)]
    whole = zip(*parts, strict=True)
    return list(whole) if not column.null_count else [None if null else t for t, null in zip(whole, column.is_null().to_pylist(), strict=True)]


def encode(statements: DataFrame, options: Options, frame_size: int = 250, framing: str | None = None, group: str | None = None, namespaces: list[tuple[str, str]] | None = None, ordered: bool = False) -> DataFrame:
    """Frames (FRAME) of statements: one self-contained stream for each stream_id, in the order of row_idx.

    group: a column whose changes end a graph or dataset (framing 'graph' or 'dataset'). namespaces: declarations that
    every stream begins with. An empty input gives no stream. ordered: streams are whole in their partitions and in order.
    """
    names = ["stream_id", *([group] if group else []), "s", "p", "o", "g"]
    placed = statements if ordered else dealt(statements, "stream_id").sortWithinPartitions("stream_id", "row_idx")
    shown = placed.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stream, number = _Columns(_FRAME), None, 0
        for id_, frames in encoded(batches, options, frame_size, framing, group, namespaces):
            if id_ != stream:
                stream, number = id_, 0
            for frame in frames:
                out.add((stream, number, frame.n_rows, frame.n_statements, [], frame))
                number += 1
            if len(out.rows) >= FRAMES:
                yield out.take()
        if out.rows:
            yield out.take()

    return shown.mapInArrow(run, FRAME)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does not."""
    if pa.types.is_struct(column.type):
        changed = np.any([_changes(f) for f in (column.is_null(), *column.flatten())], axis=0)
        return changed
    changed = np.zeros(len(column), bool)
    if column.null_count < len(column):
        codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        changed[1:] = codes[1:] != codes[:-1]
    return changed


def encoded(batches: Iterator[pa.RecordBatch], options: Options, frame_size: int = 250, framing: str | None = None, group: str | None = None, namespaces: list[tuple[str, str]] | None = None) -> Iterator[tuple[str, list[Frame]]]:
    """(stream_id, frames that are full) of sorted statements, stream by stream; a run of one stream in a batch at once."""
    stream = member = encoder = None

    def close() -> list[Frame]:
        return [*(encoder.end_group() if encoder.framing in ("graph", "dataset") else ()), *encoder.finish()]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("stream_id"))
        bounds = [0, *np.flatnonzero(_changes(ids)).tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:]):
            id_, part = ids[begin].as_py(), batch.slice(begin, end - begin)
            members = part.column(part.schema.get_field_index(group)) if group else None
            ends = _changes(members) if group else None
            if encoder is None or id_ != stream:
                if encoder is not None:
                    yield stream, close()
                stream, encoder = id_, Encoder(options, frame_size, framing)
                for label, value in namespaces or ():
                    encoder.namespace(label, value)
            elif group:
                ends[0] = members[0].as_py() != member
            if group:
                member = members[-1].as_py()
            full = columnar.encode(encoder, [part.column(i) if i >= 0 else pa.nulls(len(part)) for i in map(part.schema.get_field_index, "spog")], ends)
            if full is None:
                full = []
                for at, terms in enumerate(zip(*(_terms(part, n) if n in part.schema.names else [None] * len(part) for n in "spog"), strict=True)):
                    if group and ends[at]:
                        full += encoder.end_group()
                    full += encoder.add(terms)
            yield stream, full
    if encoder is not None:
        yield stream, close()


class _Columns:
    """Rows collected and handed out as record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []
        self.add = self.rows.append

    def full(self) -> bool:
        return len(self.rows) >= BATCH

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([_structs(c, f.type) if pa.types.is_struct(f.type) else pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows.clear()
        return batch


def _structs(values: list[tuple | None], kind: pa.StructType) -> pa.Array:
    if not values:
        return pa.array([], kind)
    none = (None,) * kind.num_fields
    mask = None if None not in values else pa.array([v is None for v in values], pa.bool_())
    parts = zip(*values, strict=True) if mask is None else zip(*[none if v is None else v for v in values], strict=True)
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields, strict=True)], fields=fields, mask=mask)


def events_of(stream: str, frames: Iterator[bytes], as_quads: bool = False, check=None, only: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Events (EVENT) of one stream's frames in order. Frames without rows before the options are kept as numbers.
    only: statements alone, and those whose terms have these values, by (slot, part), as ('p', 'value')."""
    decoder, out, base, number = Decoder(), _Columns(_EVENT), 0, 0
    default = ("default", None, None, None)
    wanted = [("spog".index(slot) + 1, _PARTS.index(part), value) for (slot, part), value in (only or {}).items()]
    for held in _chunks(frames):
        whole = columnar.decode(decoder, held, number, base, as_quads, [(slot - 1, part, value) for slot, part, value in wanted])
        if whole is not None:
            if out.rows:
                yield out.take()
            columns, n_rows = whole
            if check is not None:
                check(decoder.options)
                check = None
            n = len(columns["row_idx"])
            columns |= {"stream_id": pa.repeat(pa.scalar(stream, pa.string()), n), "event": pa.repeat(pa.scalar("statement"), n), "prefix": pa.nulls(n, pa.string()), "iri": pa.nulls(n, pa.string())}
            batch = pa.RecordBatch.from_arrays([columns[c] for c in _EVENT.names], schema=_EVENT)
            for at in range(0, n, BATCH):
                yield batch.slice(at, BATCH)
            base, number = base + n_rows, number + len(held)
            continue
        for content in held:
            for i, event in decoder.frame(content):
                if event[0] == "statement":
                    if wanted and not all(event[k] is not None and event[k][part] == value for k, part, value in wanted):
                        continue
                    _, s, p, o, g = event
                    out.add((stream, number, base + i, "statement", s, p, o, default if g is None and as_quads else g, None, None))
                elif only is None:
                    out.add((stream, number, base + i, "namespace", None, None, None, None, event[1], event[2]))
                if out.full():
                    yield out.take()
            if check is not None and decoder.options is not None:
                check(decoder.options)
                check = None
            base, number = base + decoder.n_rows, number + 1
    if decoder.options is None:
        raise ConformanceError("the stream has no rows")
    if out.rows:
        yield out.take()


def _chunks(frames: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Frames by CHUNK bytes."""
    held, size = [], CHUNK
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_stream(frames: DataFrame) -> DataFrame:
    return dealt(frames, "stream_id").sortWithinPartitions("stream_id", "frame_idx").select("stream_id", "frame_idx", "content")


def streams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Each stream of a sorted partition with its frames, which must be read before the next; gaps are errors."""
    rows = ((s, i, c) for b in batches for s, i, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    ahead = next(rows, None)

    def frames(stream: str) -> Iterator[bytes]:
        nonlocal ahead
        expected = 0
        while ahead is not None and ahead[0] == stream:
            if ahead[1] != expected:
                raise ConformanceError(f"stream {stream} lacks frame {expected}")
            expected += 1
            content = ahead[2]
            ahead = next(rows, None)
            yield content

    while ahead is not None:
        stream = ahead[0]
        yield stream, frames(stream)


def decode_events(frames: DataFrame, as_quads: bool = False, only: dict | None = None) -> DataFrame:
    """Events of all streams. A lost frame is an error: later frames need its state. only: as in events_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, contents in streams_of(batches):
            yield from events_of(stream, contents, as_quads, only=only)

    return _by_stream(frames).mapInArrow(run, EVENT)


class Adapter:
    """What becomes of a stream's events: subclass it, name the columns in schema, and return a row or None from each
    method. One object goes through a task's streams in order, so it may keep state from `begin` on."""

    schema = ""

    def begin(self, stream: str) -> None:
        """A stream begins."""

    def statement(self, frame: int, s: tuple, p: tuple, o: tuple, g: tuple | None) -> tuple | None:
        """A statement of terms (kind, value, lang, datatype)."""

    def namespace(self, frame: int, prefix: str, iri: str) -> tuple | None:
        """A namespace declaration."""

    def end(self) -> tuple | None:
        """The stream is over."""


def decode_with(frames: DataFrame, adapter: Adapter) -> DataFrame:
    """The rows that an adapter makes of all streams."""
    kinds = StructType.fromDDL(adapter.schema)
    shape = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns(shape)
        for stream, contents in streams_of(batches):
            adapter.begin(stream)
            decoder = Decoder()
            for number, content in enumerate(contents):
                for _, event in decoder.frame(content):
                    row = adapter.statement(number, *event[1:]) if event[0] == "statement" else adapter.namespace(number, *event[1:])
                    if row is not None:
                        out.add(row)
                if out.full():
                    yield out.take()
            row = adapter.end()
            if row is not None:
                out.add(row)
        if out.rows:
            yield out.take()

    return _by_stream(frames).mapInArrow(run, kinds)


def decode(frames: DataFrame, as_quads: bool = False, predicate: str | None = None) -> DataFrame:
    """Statements of all streams, or those of a predicate, whose others never leave the decoder."""
    return statements_of(decode_events(frames, as_quads, None if predicate is None else {("p", "kind"): "iri", ("p", "value"): predicate}))


def statements_of(events: DataFrame) -> DataFrame:
    return events.where("event = 'statement'").select("stream_id", "frame_idx", "row_idx", "s", "p", "o", "g")


def namespaces_of(events: DataFrame) -> DataFrame:
    return events.where("event = 'namespace'").select("stream_id", "frame_idx", "row_idx", "prefix", "iri")


def last_namespaces(events: DataFrame) -> DataFrame:
    """Each stream's namespace map: the last declaration of a prefix wins."""
    return namespaces_of(events).groupBy("stream_id", "prefix").agg(F.max_by("iri", "row_idx").alias("iri"))


def rows(frames: DataFrame) -> DataFrame:
    """Rows (ROW) as coded, for relational.resolve: ids unresolved, repeated terms null. Quoted triples are errors."""

    def term(t: tuple | None) -> tuple | None:
        if t is None:
            return None
        if t[0] == "triple":
            raise NotImplementedError("quoted triples need the sequential decoder")
        if t[0] == "iri":
            return "iri", t[1], t[2], None, None, None
        if t[0] == "literal":
            return "literal", None, None, t[1], t[2], t[3]
        return t[0], None, None, t[1] if t[0] == "bnode" else None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns(_ROW)
        for stream, contents in streams_of(batches):
            at = 0
            for number, content in enumerate(contents):
                for row in wire.read_frame(content)[0]:
                    kind, slots, entry = row[0], [None] * 4, (None, None)
                    if kind in ("triple", "quad"):
                        slots = [term(t) for t in row[1:]] + [None] * (5 - len(row))
                    elif kind in ("name", "prefix", "datatype"):
                        entry = row[1:]
                    elif kind == "graph_start":
                        slots = [term(row[1]), None, None, None]
                    elif kind == "namespace":
                        slots, entry = [term(row[2]), None, None, None], (None, row[1])
                    out.add((stream, number, at, kind, *slots, *entry))
                    at += 1
                    if out.full():
                        yield out.take()
        if out.rows:
            yield out.take()

    return _by_stream(frames).mapInArrow(run, ROW)


def to_bytes(frames: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """(stream_id, content): each stream's frames, delimited, as one value, for message buses and small streams. A stream
    of more than most_bytes is an error that names it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "content"))), lambda x: x["content"])
    size = F.sum(F.octet_length("content"))
    text = F.concat(F.lit("stream "), F.col("stream_id"), F.lit(" has "), F.col("size").cast("string"), F.lit(f" bytes, more than the {most_bytes} of one value"))
    grouped = frames.groupBy("stream_id").agg(ordered.alias("frames"), size.alias("size"))
    grouped = grouped.select("stream_id", F.when(F.col("size") > most_bytes, F.raise_error(text).cast("array<binary>")).otherwise(F.col("frames")).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [b"".join(wire.varint(len(f)) + f for f in fs) for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary())], ["stream_id", "content"])

    return grouped.mapInArrow(run, "stream_id string, content binary")


def from_bytes(values: DataFrame, as_quads: bool = False) -> DataFrame:
    """Events of (stream_id, content) values that each hold a whole stream, delimited or one bare frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from events_of(stream, wire.split_frames(content), as_quads)

    return values.select("stream_id", "content").mapInArrow(run, EVENT)


def with_metadata(frames: DataFrame, metadata: Column) -> DataFrame:
    """Frames with a metadata map (string to binary) written into them."""
    shown = frames.withColumn("metadata", metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("metadata")
            content = []
            for body, pairs in zip(b.column(b.schema.get_field_index("content")).to_pylist(), b.column(at).to_pylist(), strict=True):
                kept = b"".join(wire.put(1, v) for n, v in wire.fields(body) if n == 1)
                content.append(kept + wire.write_frame([], dict(pairs or [])))
            yield b.set_column(b.schema.get_field_index("content"), "content", pa.array(content, pa.binary()))

    return shown.select(*FRAME.names).mapInArrow(run, FRAME)


def frame_metadata(frames: DataFrame) -> DataFrame:
    """FRAME rows with counts and metadata read from the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stream, number, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found, metadata = wire.read_frame(content)
                out.append({"stream_id": stream, "frame_idx": number, "n_rows": len(found), "n_statements": sum(r[0] in ("triple", "quad") for r in found), "metadata": list(metadata.items()), "content": content})
            yield pa.RecordBatch.from_pylist(out, _FRAME)

    return frames.select("stream_id", "frame_idx", "content").mapInArrow(run, FRAME)
