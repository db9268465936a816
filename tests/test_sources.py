import gzip
import os

import pytest
from pyspark.sql import functions as F

from quadrille.operators import codec, graph, relational
from quadrille.options import Options
from quadrille.plans.mapping import EVENTS, NATION, flat
from quadrille.schema import STATEMENT
from quadrille.sources import datasource, ntriples

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nation(spark):
    return NATION.statements(spark.read.parquet(f"{SF}/nation.parquet"), 3)


def plain(statements):
    return sorted(map(tuple, flat(statements).drop("row_idx").collect()), key=repr)


def test_files_by_stream_gzip_and_strictness(spark, nation, tmp_path):
    path = f"{tmp_path}/out"
    datasource.write_statements(nation, path, physicalType="TRIPLES", logicalType="FLAT_TRIPLES", frameSize="5")
    names = sorted(os.listdir(path))
    assert len([n for n in names if n.endswith(".rdfs")]) == 3
    zipped = f"{path}/{names[0]}"
    with open(zipped, "rb") as f:
        body = f.read()
    os.remove(zipped)
    with gzip.open(zipped + ".gz", "wb") as f:
        f.write(body)
    for found in (spark.read.format(datasource.FORMAT).option("logicalTypeStrict", "true").load(path), datasource.read_streams(spark, path)):
        assert plain(codec.statements_of(found)) == plain(nation)
    with pytest.raises(Exception, match="GROUPED"):
        spark.read.format(datasource.FORMAT).options(logicalTypeStrict="true", mode="grouped").load(path).collect()


def test_single_frame_files(spark, nation, tmp_path):
    path = f"{tmp_path}/bare"
    datasource.write_statements(nation, path, physicalType="TRIPLES", delimited="false")
    assert plain(codec.statements_of(spark.read.format(datasource.FORMAT).load(path))) == plain(nation)


def test_streaming_both_ways(spark, nation, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/copy"
    datasource.write_statements(nation, path, physicalType="TRIPLES")
    arriving = spark.readStream.format(datasource.FORMAT).load(path)
    run = codec.statements_of(arriving).select("stream_id", "s", "p", "o").writeStream.format(datasource.FORMAT).options(path=out, checkpointLocation=f"{tmp_path}/progress", physicalType="TRIPLES").trigger(availableNow=True).start()
    run.awaitTermination()
    assert plain(codec.statements_of(spark.read.format(datasource.FORMAT).load(out))) == plain(nation)


def test_a_lost_frame_is_an_error(spark, nation):
    frames = codec.encode(nation, Options.of("TRIPLES"), 5)
    with pytest.raises(Exception, match="lacks frame"):
        codec.decode(frames.where("frame_idx != 1")).collect()


def test_windows_equal_the_decoder_under_eviction(spark):
    events = EVENTS.statements(spark.read.parquet(f"{SF}/events.parquet"), 2)
    for physical in ("QUADS", "GRAPHS"):
        frames = codec.encode(events, Options.of(physical, "FLAT_QUADS", "tiny"), 20)
        assert plain(relational.resolve(codec.rows(frames))) == plain(codec.decode(frames)) == plain(events)


def test_text_files(spark, tmp_path):
    lines = ["@prefix ex: <http://e/> .", "# note", '<a> <b> "x"@en .', "", '_:c <b> << <a> <b> "y\\n" >> .']
    with open(f"{tmp_path}/t.nt", "w") as f:
        f.write("\n".join(lines))
    found = ntriples.read(spark, f"{tmp_path}/t.nt").orderBy("row_idx")
    assert [r.value for r in ntriples.lines(found).orderBy("row_idx").collect()] == ['<a> <b> "x"@en .', '_:c <b> << <a> <b> "y\\n" >> .']
    ntriples.write(found, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
    given = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "stream_id string, row_idx long, value string")
    assert [tuple(r)[2:] for r in ntriples.prefixes(given).collect()] == [("ex", "http://e/")]
    assert ntriples.parse_lines(given, quads=True).first().g.kind == "default"


def test_empty_inputs(spark):
    none = spark.createDataFrame([], STATEMENT)
    frames = codec.encode(none, Options.of("QUADS"))
    assert frames.count() == 0 and codec.decode(frames).count() == 0 and relational.resolve(codec.rows(frames)).count() == 0


def test_spread_splits_a_hot_stream(spark, nation):
    parts = codec.spread(nation.withColumn("stream_id", F.lit("all")), 4, F.col("s"))
    frames = codec.encode(parts, Options.of("TRIPLES"))
    assert frames.select("stream_id").distinct().count() > 1 and plain(codec.decode(frames)) == plain(nation)


def test_paths_and_components(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d2"), ("d", "d2"), ("x", "y")], "a string, b string")
    assert [r.node for r in graph.shortest_path(edge, "a", "d").orderBy("step").collect()] == ["a", "d2", "d"]
    assert graph.shortest_path(edge, "a", "x").count() == 0
    assert {r.component for r in graph.components(edge).collect()} == {"a", "x"}
    with pytest.raises(ValueError):
        graph.join(edge.select("a"), edge.select("b"))
