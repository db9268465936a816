"""Grouped and named files, files that arrive, other stores, golden bytes, and functions of frames."""

import os

import pytest
from pyspark.sql import functions as F

from quadrille.operators import codec, grouping, relational
from quadrille.options import ConformanceError, Options
from quadrille.plans.mapping import EVENTS, NATION, flat
from quadrille.sources import datasource, ntriples, wire
from quadrille.sources.kernel import Decoder, Encoder

SF = "/root/testdata/sf0.001"
IRI = "iri"


def iri(x):
    return IRI, x, None, None


@pytest.fixture(scope="module")
def nation(spark):
    return NATION.statements(spark.read.parquet(f"{SF}/nation.parquet"), 3)


def plain(statements):
    return sorted(map(tuple, flat(statements).drop("row_idx").collect()), key=repr)


def write_file(path, n):
    encoder = Encoder(Options.of("TRIPLES", "FLAT_TRIPLES"))
    frames = [*encoder.add((iri(f"http://e/{n}"), iri("http://e/p"), ("literal", str(n), None, None), None)), *encoder.finish()]
    with open(path, "wb") as f:
        f.write(b"".join(wire.varint(len(x)) + x for x in frames))


@pytest.mark.parametrize("source", ["registered", "binary"])
def test_files_whose_names_sort_before_those_read(spark, tmp_path, source):
    """Two triggers: the second file's name comes first in order."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    os.makedirs(path)
    datasource.register(spark)

    def trigger():
        stream = spark.readStream.format(datasource.FORMAT).load(path) if source == "registered" else datasource.arriving(spark, path)
        run = codec.statements_of(stream).select(F.col("o")["value"].alias("o")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(r.o for r in spark.read.parquet(out).collect())

    write_file(f"{path}/m-1.rdfs", 1)
    assert trigger() == ["1"]
    write_file(f"{path}/a-2.rdfs", 2)
    write_file(f"{path}/.z-3.rdfs", 3)  # unfinished
    assert trigger() == ["1", "2"]
    os.rename(f"{path}/.z-3.rdfs", f"{path}/c-3.rdfs")
    assert trigger() == ["1", "2", "3"]


@pytest.mark.parametrize("physical, logical, group", [("GRAPHS", "NAMED_GRAPHS", None), ("QUADS", "DATASETS", "d"), ("TRIPLES", "GRAPHS", "d"), ("TRIPLES", "SUBJECT_GRAPHS", None)])
def test_a_frame_for_each_group(spark, tmp_path, physical, logical, group):
    rows = EVENTS.statements(spark.read.parquet(f"{SF}/events.parquet"), 2).where("row_idx < 2000").withColumn("d", F.floor(F.col("row_idx") / 40).cast("string"))
    datasource.write_statements(rows, f"{tmp_path}/out", {"ex": "http://e/"}, physicalType=physical, logicalType=logical, **({"group": group} if group else {}))
    events = spark.read.format(datasource.FORMAT).options(logicalTypeStrict="true", mode="grouped").load(f"{tmp_path}/out")
    found = codec.statements_of(events)
    kept = found if physical != "TRIPLES" else found.withColumn("g", F.lit(None).cast(rows.schema["g"].dataType))
    assert plain(kept) == plain(rows if physical != "TRIPLES" else rows.withColumn("g", F.lit(None).cast(rows.schema["g"].dataType)))
    assert {r.iri for r in codec.namespaces_of(events).collect()} == {"http://e/"}
    by = F.col(group) if group else F.col("g" if physical == "GRAPHS" else "s")["value"]
    want = relational.graph_runs(rows.withColumn("g", F.struct(*(by.alias(c) for c in ("kind", "value", "lang", "datatype"))))).groupBy("stream_id", "run").count()
    assert sorted(r["count"] for r in found.groupBy("stream_id", "frame_idx").count().collect()) == sorted(r["count"] for r in want.collect())


def test_other_names_and_stores(spark, nation, tmp_path):
    """Names by a pattern, a scheme that Arrow knows, and a path that only Spark opens."""
    path = f"{tmp_path}/out"
    datasource.write_statements(nation, f"file://{path}", physicalType="TRIPLES")
    os.makedirs(f"{path}/below")
    for k, n in enumerate(sorted(n for n in os.listdir(path) if n.endswith(".rdfs"))):
        os.rename(f"{path}/{n}", f"{path}/below/{k}.stream")
    assert spark.read.format(datasource.FORMAT).load(path).count() == 0
    for where, options in ((path, {"glob": "*.stream"}), (f"file://{path}", {"pathGlobFilter": "*.x,*.stream"}), (f"{path}/below/*.stream", {})):
        assert plain(codec.statements_of(spark.read.format(datasource.FORMAT).options(**options).load(where))) == plain(nation)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{path}")
    assert plain(codec.statements_of(datasource.read_streams(spark, "viewfs://store/in", glob="*.stream"))) == plain(nation)


def test_filters_go_into_the_decoder(spark, nation, tmp_path):
    datasource.write_statements(nation, f"{tmp_path}/out", physicalType="TRIPLES")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format(datasource.FORMAT).option("pushFilters", "true").load(f"{tmp_path}/out")
        kept = found.where((F.col("p")["value"] == "http://example.org/schema#n_name") & (F.col("event") == "statement"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 25 and "n_name" not in plan.split("Filter")[1].split("BatchScan")[0] if "Filter" in plan else kept.count() == 25
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert codec.decode(codec.encode(nation, Options.of("TRIPLES")), predicate="http://example.org/schema#n_name").count() == 25


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    with open(f"{tmp_path}/t.nt", "w") as f:
        f.writelines(f'<a> <b> "{i}" .\n' + "\n" * (i % 3) for i in range(3000))
    size = os.path.getsize(f"{tmp_path}/t.nt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 7))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = ntriples.read(spark, f"{tmp_path}/t.nt")
        assert found.rdd.getNumPartitions() > 3
        assert [int(r.v) for r in found.orderBy("row_idx").select(F.col("o")["value"].alias("v")).collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_value_that_would_be_too_large_is_named(spark, nation):
    frames = codec.encode(nation, Options.of("TRIPLES"))
    with pytest.raises(Exception, match="stream nation-[012] has"):
        codec.to_bytes(frames, most_bytes=50).collect()


def test_functions_see_empty_frames(spark):
    rows = [("a", 0, bytes(wire.write_frame([]))), ("a", 1, bytes(Encoder(Options.of("TRIPLES")).finish()[0]))]
    frames = spark.createDataFrame(rows, "stream_id string, frame_idx long, content binary")
    got = grouping.apply_per_frame(frames, lambda s, k, found: [(s, k, len(found))], "stream string, frame long, n int").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0), ("a", 1, 0)]


def field(n, body):
    return wire.varint(n << 3 | 2) + wire.varint(len(body)) + body


def number(n, value):
    return wire.varint(n << 3) + wire.varint(value)


def row(n, body):
    return field(1, field(n, body))


def entry(n, value, index=0):
    return row(n, (number(1, index) if index else b"") + field(2, value.encode()))


def test_bytes_by_hand():
    """Every kind of row, put together here: tables of one prefix and eight names, evicted entries, repeated terms, a graph
    with its markers, a language, a datatype, a quoted triple, blank nodes, metadata and fields that no one knows."""
    options = row(1, field(1, b"hand") + number(2, 3) + number(3, 1) + number(4, 1) + number(9, 8) + number(10, 1) + number(11, 1) + number(14, 14) + number(15, 2) + number(77, 5))
    one = b"".join([
        options,
        entry(10, "http://e/"), entry(9, "a"), entry(9, "b"), entry(11, "http://e/int"),
        row(6, field(1, b"ex") + field(2, number(1, 1) + number(2, 1))),
        row(4, field(1, number(2, 2))),
        row(2, field(1, number(2, 1)) + field(5, b"") + field(11, field(1, b"x") + field(2, b"en"))),
        row(2, field(11, field(1, b"7") + number(3, 1))),
        row(5, b""),
        field(15, field(1, b"note") + field(2, b"\x01\x02")),
        field(99, b"unknown"),
    ])
    two = b"".join([
        entry(9, "c", 1), entry(10, "urn:", 1),
        row(4, field(3, b"")),
        row(2, field(2, b"s") + field(5, number(2, 1)) + field(12, field(1, number(2, 2)) + field(6, b"q") + field(11, b""))),
        row(5, b""),
    ])
    decoder = Decoder()
    got = [e for _, e in decoder.frame(one)]
    assert decoder.metadata == {"note": b"\x01\x02"}
    none = (None, None)
    g = iri("http://e/b")
    a, b = iri("http://e/a"), iri("http://e/b")
    assert got == [("namespace", "ex", "http://e/a"), ("statement", a, b, ("literal", "x", "en", None), g), ("statement", a, b, ("literal", "7", None, "http://e/int"), g)]
    got = [e for _, e in decoder.frame(two)]
    assert got == [("statement", ("bnode", "s", *none), iri("urn:c"), ("triple", '<< <urn:b> _:q "" >>', *none), ("default", None, *none))]
    with pytest.raises(IndexError):
        list(Decoder().frame(options + entry(9, "z", 9)))
    with pytest.raises(ConformanceError):
        list(Decoder().frame(options + row(2, field(1, number(2, 1)))[:-1]))


def test_our_bytes_are_those_by_hand():
    encoder = Encoder(Options.of("QUADS", "FLAT_QUADS", names=8, prefixes=1, datatypes=1))
    p = iri("http://e/p")
    got = [*encoder.add((iri("http://e/a"), p, ("literal", "1", None, "http://e/int"), ("default", None, None, None))), *encoder.add((iri("http://e/a"), p, ("literal", "x", "en", None), ("default", None, None, None))), *encoder.finish()]
    want = b"".join([
        row(1, number(2, 2) + number(3, 1) + number(4, 1) + number(9, 8) + number(10, 1) + number(11, 1) + number(14, 2) + number(15, 1)),
        entry(10, "http://e/"), entry(9, "a"), entry(9, "p"), entry(11, "http://e/int"),
        row(3, field(1, number(1, 1)) + field(5, b"") + field(11, field(1, b"1") + number(3, 1)) + field(15, b"")),
        row(3, field(11, field(1, b"x") + field(2, b"en"))),
    ])
    assert got == [want] and got[0].n_rows == 7 and got[0].n_statements == 2
