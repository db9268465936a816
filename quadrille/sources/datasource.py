"""The data source `rdfstream`: spark.read / df.write / readStream / writeStream of stream files.

A file is one stream, and one task, which holds a frame at a time. The registered source lists, reads and writes through
Arrow's file systems (local paths, hdfs, s3, gs and others by their scheme). Stores that Spark alone reaches are read
through its binaryFile source (`read_streams`, and `arriving` for new files), a file in memory at a time.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quadrille.functions.store import dealt
from quadrille.operators.codec import encoded, events_of
from quadrille.options import LOGICAL, ConformanceError, Options, check_strict
from quadrille.schema import EVENT, TERM
from quadrille.sources import wire
from quadrille.sources.kernel import read_options

FORMAT = "rdfstream"
#: Names of the stream files in a folder, unless the option `glob` names others.
GLOBS = ("*.rdfs", "*.rdfs.gz")
#: Media types of stream files, and of their compressed form.
MEDIA_TYPE = "application/x-rdf-stream"
#: Columns whose changes end a group, by logical type, where no option `group` says so.
GROUPED_BY = {LOGICAL["SUBJECT_GRAPHS"]: "s", LOGICAL["NAMED_GRAPHS"]: "g", LOGICAL["TIMESTAMPED_NAMED_GRAPHS"]: "g"}


def _store(path: str) -> tuple[stores.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path


def _globs(options: dict) -> tuple[str, ...]:
    given = options.get("glob") or options.get("pathGlobFilter")
    return tuple(given.split(",")) if given else GLOBS


def files(path: str, globs: tuple[str, ...] = GLOBS) -> list[str]:
    """The stream files of a path: a file, a pattern for the last part of a path, or a folder with all below it. Names that
    begin with a dot or underscore are unfinished."""
    store, at = _store(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in posixpath.basename(at) for c in "*?["):
        at, globs = posixpath.dirname(at), (posixpath.basename(at),)
    info = store.get_file_info(at)
    if info.type == stores.FileType.File:
        return [path]
    found = store.get_file_info(stores.FileSelector(at, recursive=True, allow_not_found=True)) if info.type == stores.FileType.Directory else []
    hidden = lambda p: any(part[:1] in "._" for part in p.removeprefix(at).split("/") if part)
    return sorted(scheme + f.path for f in found if f.type == stores.FileType.File and not hidden(f.path) and any(fnmatch.fnmatch(f.base_name, g) for g in globs))


def open_frames(path: str) -> Iterator[bytes]:
    store, at = _store(path)
    with store.open_input_stream(at, compression="gzip" if at.endswith(".gz") else None) as f:
        yield from wire.read_frames(f)


def first_options(path: str) -> Options:
    """Options of the first frame that has rows."""
    for frame in open_frames(path):
        if frame and wire.read_frame(frame)[0]:
            return read_options(frame)
    raise ConformanceError(f"{path} holds no row")


@dataclass
class StreamFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    statements: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files(options["path"], _globs(options))
        self.as_quads = str(options.get("asQuads", "false")).lower() == "true"
        self.strict = str(options.get("logicalTypeStrict", "false")).lower() == "true"
        self.mode = options.get("mode", "flat")
        self.only: dict[tuple[str, str], str] | None = None
        if options.get("predicate"):
            self.only = {("p", "kind"): "iri", ("p", "value"): options["predicate"]}

    def partitions(self) -> list[InputPartition]:
        return [StreamFile(p) for p in self.paths]

    def read(self, partition: StreamFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there is no file
            return
        check = (lambda o: check_strict(o.logical, self.mode)) if self.strict else None
        if check is not None:
            check(first_options(partition.path))
        yield from events_of(posixpath.basename(partition.path), open_frames(partition.path), self.as_quads, check, self.only)


class FilteringReader(Reader):
    """Spark asks for filters only where spark.sql.python.filterPushdown.enabled is on, and refuses a reader that offers
    to take them elsewhere; hence the option pushFilters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality with a part of s, p or o, and event = 'statement'; other filters stay Spark's."""
        for f in filters:
            column = f.attribute if isinstance(f, EqualTo) else ()
            if column == ("event",) and f.value == "statement":
                self.only = self.only or {}
            elif len(column) == 2 and column[0] in ("s", "p", "o") and column[1] in TERM.names and (self.only or {}).get(column, f.value) == f.value:
                self.only = {**(self.only or {}), column: f.value}
            else:
                yield f


class Writer(DataSourceArrowWriter, DataSourceStreamArrowWriter):
    """Writes each run of one stream_id in a partition as a file; callers sort by (stream_id, row_idx)."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.names = options["path"].rstrip("/"), overwrite, schema.names
        missing = {"stream_id", "s", "p", "o"} - set(schema.names)
        if missing:
            raise ValueError(f"statements lack {sorted(missing)}")
        self.delimited = str(options.get("delimited", "true")).lower() == "true"
        sizes = {k: int(options[k]) for k in ("names", "prefixes", "datatypes") if k in options}
        self.namespaces = list(json.loads(options.get("namespaces") or "{}").items())
        self.options = Options.of(options.get("physicalType", "QUADS" if "g" in schema.names else "TRIPLES"), options.get("logicalType", 0), options.get("preset", "default"), stream_name=options.get("streamName", ""), namespaces=bool(self.namespaces), **sizes)
        self.frame_size = int(options.get("frameSize", 250))
        self.framing = options.get("framing") if self.delimited else "manual"
        self.group = options.get("group") or GROUPED_BY.get(self.options.logical)
        if self.group and self.group not in schema.names:
            raise ValueError(f"statements lack the group {self.group}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        paths, count, stream, out = [], 0, None, None

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for batch in batches:
                count += batch.num_rows
                yield batch

        for id_, frames in encoded(counted(), self.options, self.frame_size, self.framing, self.group, self.namespaces):
            if out is None or id_ != stream:
                if out is not None:
                    out.close()
                stream = id_
                # hidden until commit
                paths.append(f"{folder}/.{stream}-{uuid.uuid4().hex[:12]}.rdfs")
                out = store.open_output_stream(paths[-1])
            out.write(b"".join(wire.varint(len(frame)) + frame if self.delimited else frame for frame in frames))
        if out is not None:
            out.close()
        return Written(paths, count)

    def commit(self, messages: list[Written], batchId: int = -1) -> None:
        store, _ = _store(self.path)
        if self.overwrite and batchId < 0:
            for old in files(self.path):
                store.delete_file(_store(old)[1])
        for message in messages:
            for path in message.paths if message else ():
                store.move(path, posixpath.join(posixpath.dirname(path), posixpath.basename(path)[1:]))

    def abort(self, messages: list[Written], batchId: int = -1) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for path in message.paths if message else ():
                if store.get_file_info(path).type == stores.FileType.File:
                    store.delete_file(path)


class Arrivals(DataSourceStreamReader):
    """New files as a stream. The offset names all files seen so far, so it does not matter how names sort or when a file
    comes; for very many files use `arriving`, where Spark keeps that list in its own compacted log."""

    def __init__(self, options: dict):
        self.reader = Reader(options)
        self.path, self.globs = options["path"], _globs(options)

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": files(self.path, self.globs)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = set(start["files"])
        return [StreamFile(p) for p in end["files"] if p not in before]

    def read(self, partition: StreamFile) -> Iterator[pa.RecordBatch]:
        yield from self.reader.read(partition)


class StatementSource(DataSource):
    """Reads events (schema EVENT) and writes statements.

    Read options: glob (names of files, by commas), asQuads, logicalTypeStrict, mode (flat or grouped), predicate (an IRI:
    only its statements), pushFilters (equality filters go into the decoder; needs spark.sql.python.filterPushdown.enabled).
    Write options: physicalType, logicalType, preset, names, prefixes, datatypes, frameSize, framing, delimited,
    streamName, group (a column whose changes end a graph or dataset), namespaces (JSON of prefixes and IRIs).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if str(self.options.get("pushFilters", "false")).lower() == "true" else Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Arrivals(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatementSource)


def write_statements(statements: DataFrame, path: str, namespaces: dict[str, str] | None = None, ordered: bool = False, **options: str) -> None:
    """Write each stream_id as a file of its own. ordered: as in codec.encode."""
    register(statements.sparkSession)
    if namespaces:
        options["namespaces"] = json.dumps(namespaces)
    names = ["stream_id", "s", "p", "o", *(["g"] if options.get("physicalType", "QUADS") != "TRIPLES" else []), *([options["group"]] if options.get("group") else [])]
    placed = statements if ordered else dealt(statements, "stream_id").sortWithinPartitions("stream_id", "row_idx")
    placed.select(*dict.fromkeys(names)).write.format(FORMAT).options(**options).mode("overwrite").save(path)


def _whole(found: DataFrame) -> DataFrame:
    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [gzip.decompress(c) if p.endswith(".gz") else c for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["stream_id", "content"])

    shown = found.select(F.element_at(F.split("path", "/"), -1).alias("stream_id"), "path", "content")
    return shown.mapInArrow(unzip, "stream_id string, content binary")


def read_streams(spark: SparkSession, path: str, as_quads: bool = False, glob: str | None = None) -> DataFrame:
    """Events of all files under a path of any store that Spark reads; a file is held in memory by its task."""
    from quadrille.operators.codec import from_bytes

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return from_bytes(_whole((reader.option("pathGlobFilter", glob) if glob else reader).load(path)), as_quads)


def arriving(spark: SparkSession, path: str, as_quads: bool = False, glob: str | None = None) -> DataFrame:
    """The same as a stream of the files that come; Spark's file source remembers the names it has read."""
    from quadrille.operators.codec import from_bytes

    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return from_bytes(_whole((reader.option("pathGlobFilter", glob) if glob else reader).load(path)), as_quads)
