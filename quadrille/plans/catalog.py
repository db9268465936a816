"""The registered queries of the statement engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import options as opt
from quadrille.functions.store import shared_path, stored
from quadrille.functions.terms import bnode, debug_text, default_graph, n3, quoted, split_iri
from quadrille.operators import codec, graph, grouping, relational
from quadrille.options import Options
from quadrille.plans.mapping import BASE, CUSTOMER, DOCUMENTS, EVENTS, NATION, ORDERS, REGION, SCHEMA, STREAM_KEYS, Mapping, flat
from quadrille.sources import datasource, ntriples, wire
from quadrille.streaming.decode import decode_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS = ["s", "p", "o_kind", "o_value", "o_lang", "o_datatype", "g_kind", "g_value"]
_SHOWN = ", ".join(COLUMNS)


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def statements(spark: SparkSession, sf_dir: str, mapping: Mapping, streams: int | None = None, ordered: bool = False, links: bool = False) -> DataFrame:
    return mapping.statements(spark.read.parquet(f"{sf_dir}/{mapping.table}.parquet"), streams, ordered, links)


def _sql(mapping: Mapping) -> str:
    return f"SELECT {_SHOWN} FROM ({mapping.sql()})"


# ------------------------------------------------------------------ mapping, round trips


for _m in (NATION, CUSTOMER, ORDERS, EVENTS, DOCUMENTS):

    def _map(spark, sf_dir, m=_m):
        return flat(statements(spark, sf_dir, m)).select(COLUMNS)

    query(_sql(_m), f"map_{_m.table}")(_map)


def round_trip(mapping: Mapping, options: Options, frame_size: int = 250, framing: str | None = None, group: str | None = None):
    def run(spark, sf_dir):
        frames = codec.encode(statements(spark, sf_dir, mapping, ordered=True), options, frame_size, framing, group, ordered=True)
        return flat(codec.decode(frames)).select(COLUMNS)

    return run


for _name, _m, _o, _size in (
    ("roundtrip_triples", ORDERS, Options.of("TRIPLES", "FLAT_TRIPLES"), 250),
    ("roundtrip_quads", EVENTS, Options.of("QUADS", "FLAT_QUADS"), 250),
    ("roundtrip_graphs", EVENTS, Options.of("GRAPHS", "FLAT_QUADS"), 250),
    ("roundtrip_small_lookup", CUSTOMER, Options.of("TRIPLES", "FLAT_TRIPLES", "small"), 200),
    ("roundtrip_tiny_lookup", CUSTOMER, Options.of("TRIPLES", "FLAT_TRIPLES", "tiny"), 4),
    ("roundtrip_no_prefix", CUSTOMER, Options.of("TRIPLES", "FLAT_TRIPLES", "no_prefix"), 10_000),
    ("roundtrip_frame1", NATION, Options.of("TRIPLES", "FLAT_TRIPLES"), 1),
    ("roundtrip_text", DOCUMENTS, Options.of("TRIPLES", "FLAT_TRIPLES"), 250),
):
    query(_sql(_m), _name)(round_trip(_m, _o, _size))


@query(_sql(ORDERS))
def decode_relational(spark, sf_dir):
    """The windows resolve what the encoder coded."""
    frames = codec.encode(statements(spark, sf_dir, ORDERS, ordered=True), Options.of("TRIPLES", "FLAT_TRIPLES", "small"), ordered=True)
    return flat(relational.resolve(codec.rows(frames))).select(COLUMNS)


@query(_sql(EVENTS))
def decode_relational_graphs(spark, sf_dir):
    frames = codec.encode(statements(spark, sf_dir, EVENTS, ordered=True), Options.of("GRAPHS", "FLAT_QUADS", "small"), ordered=True)
    return flat(relational.resolve(codec.rows(frames))).select(COLUMNS)


@query(f"SELECT {_SHOWN.replace('g_kind', chr(39) + 'default' + chr(39) + ' AS g_kind')} FROM ({NATION.sql()})")
def triples_as_quads(spark, sf_dir):
    """Triples read as quads are in the default graph."""
    frames = codec.encode(statements(spark, sf_dir, NATION), Options.of("TRIPLES", "FLAT_TRIPLES"))
    return flat(codec.decode(frames, as_quads=True)).select(COLUMNS)


@query(_sql(CUSTOMER))
def roundtrip_bytes(spark, sf_dir):
    """Whole streams as single values, as a message bus carries them."""
    frames = codec.encode(statements(spark, sf_dir, CUSTOMER), Options.of("TRIPLES", "FLAT_TRIPLES"))
    return flat(codec.statements_of(codec.from_bytes(codec.to_bytes(frames)))).select(COLUMNS)


@query(_sql(CUSTOMER))
def roundtrip_files(spark, sf_dir):
    """Written by the data source, read by Spark's file reader."""
    path = shared_path(spark, "files")
    datasource.write_statements(statements(spark, sf_dir, CUSTOMER), path, physicalType="TRIPLES", logicalType="FLAT_TRIPLES")
    return flat(codec.statements_of(datasource.read_streams(spark, path))).select(COLUMNS)


@query(_sql(EVENTS))
def roundtrip_source(spark, sf_dir):
    """Written and read by the data source."""
    path = shared_path(spark, "source")
    datasource.write_statements(statements(spark, sf_dir, EVENTS, ordered=True), path, ordered=True, physicalType="QUADS", logicalType="FLAT_QUADS")
    return flat(codec.statements_of(spark.read.format(datasource.FORMAT).option("logicalTypeStrict", "true").load(path))).select(COLUMNS)


@query(_sql(EVENTS))
def roundtrip_ntriples(spark, sf_dir):
    """Text out and in again."""
    lines = ntriples.lines(statements(spark, sf_dir, EVENTS))
    return flat(ntriples.parse_lines(lines, quads=True)).select(COLUMNS)


@query(f"SELECT '<< <' || s || '> <' || p || '> \"' || o_value || '\" >>' AS quoted, '{SCHEMA}statedIn' AS p, o_value AS o FROM ({NATION.sql()}) WHERE o_kind = 'literal'")
def roundtrip_quoted(spark, sf_dir):
    """Statements about statements."""
    rows = statements(spark, sf_dir, NATION).where(F.col("o")["kind"] == "literal")
    about = rows.withColumn("s", quoted(F.col("s"), F.col("p"), F.col("o"))).withColumn("p", F.col("p").withField("value", F.lit(SCHEMA + "statedIn")))
    back = codec.decode(codec.encode(about, Options.of("TRIPLES", "FLAT_TRIPLES")))
    return back.select(F.col("s")["value"].alias("quoted"), F.col("p")["value"].alias("p"), F.col("o")["value"].alias("o"))


# ------------------------------------------------------------------ terms and coding


_SPLIT = "CASE WHEN contains(v, '#') THEN regexp_extract(v, '[^#]*$') ELSE regexp_extract(v, '[^/]*$') END"


@query(f"SELECT v AS iri, left(v, length(v) - length({_SPLIT})) AS prefix, {_SPLIT} AS name FROM (SELECT url AS v FROM pages UNION ALL SELECT p FROM ({ORDERS.sql()}))")
def iri_split(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("iri"))
    rows = urls.union(statements(spark, sf_dir, ORDERS).select(F.col("p")["value"]))
    prefix, name = split_iri(F.col("iri"))
    return rows.select("iri", prefix.alias("prefix"), name.alias("name"))


_N3 = "CASE WHEN o_kind = 'iri' THEN '<' || o_value || '>' WHEN o_lang IS NOT NULL THEN '\"' || o_value || '\"@' || o_lang WHEN o_datatype IS NOT NULL THEN '\"' || o_value || '\"^^<' || o_datatype || '>' ELSE '\"' || o_value || '\"' END"


@query(f"SELECT '<' || s || '>' AS s, {_N3} AS o FROM ({DOCUMENTS.sql()} UNION ALL {CUSTOMER.sql()})")
def term_n3(spark, sf_dir):
    rows = statements(spark, sf_dir, DOCUMENTS).union(statements(spark, sf_dir, CUSTOMER))
    return rows.select(n3(F.col("s")).alias("s"), n3(F.col("o")).alias("o"))


_Q = "coalesce('''' || {0} || '''', 'None')"


@query(f"SELECT 'IRI(' || s || ')' AS s, CASE WHEN o_kind = 'iri' THEN 'IRI(' || o_value || ')' ELSE 'Literal(' || {_Q.format('o_value')} || ', langtag=' || {_Q.format('o_lang')} || ', datatype=' || {_Q.format('o_datatype')} || ')' END AS o FROM ({DOCUMENTS.sql()} UNION ALL {CUSTOMER.sql()})")
def term_debug(spark, sf_dir):
    rows = statements(spark, sf_dir, DOCUMENTS).union(statements(spark, sf_dir, CUSTOMER))
    return rows.select(debug_text(F.col("s")).alias("s"), debug_text(F.col("o")).alias("o"))


def _accesses_sql(m: Mapping) -> str:
    n = len(m.fields)
    return f"""b AS (SELECT *, '{m.table}-' || CAST(row_idx // {n} // {STREAM_KEYS} AS VARCHAR) AS stream_id FROM ({m.sql()})),
    l AS (SELECT *, lag(s) OVER w AS s1, lag(p) OVER w AS p1, lag(o_kind) OVER w AS k1, lag(o_value) OVER w AS o1 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx)),
    met AS (SELECT stream_id, row_idx, 0 AS slot, s AS v FROM l WHERE s IS DISTINCT FROM s1
            UNION ALL SELECT stream_id, row_idx, 1, p FROM l WHERE p IS DISTINCT FROM p1
            UNION ALL SELECT stream_id, row_idx, 2, o_value FROM l WHERE o_kind = 'iri' AND (o_value IS DISTINCT FROM o1 OR o_kind IS DISTINCT FROM k1)),
    acc AS (SELECT stream_id, row_idx, slot, v AS iri, left(v, length(v) - length({_SPLIT})) AS prefix, {_SPLIT} AS name FROM met)"""


def _dict_sql(column: str) -> str:
    return f"SELECT stream_id, {column} AS value, row_number() OVER (PARTITION BY stream_id ORDER BY min(row_idx * 4 + slot)) AS id FROM acc GROUP BY stream_id, {column}"


@query(f"WITH {_accesses_sql(ORDERS)} {_dict_sql('name')}")
def dict_names(spark, sf_dir):
    return relational.dictionary(relational.iri_accesses(statements(spark, sf_dir, ORDERS)), "name")


@query(f"WITH {_accesses_sql(ORDERS)} {_dict_sql('prefix')}")
def dict_prefixes(spark, sf_dir):
    return relational.dictionary(relational.iri_accesses(statements(spark, sf_dir, ORDERS)), "prefix")


@query(f"""WITH {_accesses_sql(ORDERS)}, n AS ({_dict_sql('name')}), p AS ({_dict_sql('prefix')}),
    c AS (SELECT acc.stream_id, row_idx, slot, iri, p.id AS prefix_id, n.id AS name_id FROM acc JOIN n ON n.stream_id = acc.stream_id AND n.value = acc.name JOIN p ON p.stream_id = acc.stream_id AND p.value = acc.prefix)
    SELECT stream_id, row_idx, slot, iri, prefix_id, name_id, CASE WHEN prefix_id IS NOT DISTINCT FROM lag(prefix_id) OVER w THEN 0 ELSE prefix_id END AS prefix_code,
    CASE WHEN name_id = coalesce(lag(name_id) OVER w, 0) + 1 THEN 0 ELSE name_id END AS name_code FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx, slot)""")
def delta_codes(spark, sf_dir):
    return relational.delta_codes(relational.iri_accesses(statements(spark, sf_dir, ORDERS)))


_STREAMED = f"SELECT *, 'events-' || CAST(row_idx // {len(EVENTS.fields)} // {STREAM_KEYS} AS VARCHAR) AS stream_id FROM ({EVENTS.sql()})"


@query(f"""SELECT stream_id, row_idx, coalesce(s = lag(s) OVER w, false) AS same_s, coalesce(p = lag(p) OVER w, false) AS same_p,
    coalesce(o_value = lag(o_value) OVER w AND o_datatype = lag(o_datatype) OVER w, false) AS same_o, coalesce(g_kind = lag(g_kind) OVER w AND g_value IS NOT DISTINCT FROM lag(g_value) OVER w, false) AS same_g
    FROM ({_STREAMED}) WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx)""")
def repeated_terms(spark, sf_dir):
    return relational.repeated_terms(statements(spark, sf_dir, EVENTS)).select("stream_id", "row_idx", "same_s", "same_p", "same_o", "same_g")


@query(f"""SELECT stream_id, row_idx, g_value AS g, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY row_idx) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN lag(1) OVER w IS NULL OR g_value IS NOT DISTINCT FROM lag(g_value) OVER w THEN 0 ELSE 1 END AS new FROM ({_STREAMED}) WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx))""")
def split_to_graphs(spark, sf_dir):
    return relational.graph_runs(statements(spark, sf_dir, EVENTS)).select("stream_id", "row_idx", F.col("g")["value"].alias("g"), "run")


@query(f"SELECT g_value AS graph, s, p, o_value AS o FROM ({EVENTS.sql()})")
def graphs_unpacked(spark, sf_dir):
    """A dataset as triples, graph by graph."""
    rows = grouping.unpacked_graphs(statements(spark, sf_dir, EVENTS))
    back = rows.where("g IS NULL")
    return back.select(F.col("graph")["value"].alias("graph"), F.col("s")["value"].alias("s"), F.col("p")["value"].alias("p"), F.col("o")["value"].alias("o"))


@query(f"""WITH {_accesses_sql(ORDERS)} SELECT 'triple' AS row_kind, (SELECT count(*) FROM b) AS n UNION ALL SELECT 'options', (SELECT count(DISTINCT stream_id) FROM b)
    UNION ALL SELECT 'name', (SELECT count(*) FROM (SELECT DISTINCT stream_id, name FROM acc)) UNION ALL SELECT 'prefix', (SELECT count(*) FROM (SELECT DISTINCT stream_id, prefix FROM acc))
    UNION ALL SELECT 'datatype', (SELECT count(*) FROM (SELECT DISTINCT stream_id, o_datatype FROM b WHERE o_datatype IS NOT NULL))""")
def row_kind_counts(spark, sf_dir):
    """Rows that the encoder writes. A stream of STREAM_KEYS orders meets fewer than 4096 names, so none is evicted and first
    appearances are what is written."""
    rows = statements(spark, sf_dir, ORDERS, ordered=True)
    frames = codec.encode(rows, Options.of("TRIPLES", "FLAT_TRIPLES", names=4096, prefixes=150), ordered=True)
    return codec.rows(frames).groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ framing and grouping


@query(f"""WITH RECURSIVE w AS (SELECT o_orderkey // {STREAM_KEYS} AS stream, o_orderkey AS row_idx, o_orderkey % 3 + 1 AS n_rows, row_number() OVER (PARTITION BY o_orderkey // {STREAM_KEYS} ORDER BY o_orderkey) AS k FROM orders),
    f AS (SELECT stream, row_idx, k, CASE WHEN 1 + n_rows >= 20 THEN 0 ELSE 1 + n_rows END AS fill, CAST(0 AS BIGINT) AS frame_idx, CASE WHEN 1 + n_rows >= 20 THEN 1 ELSE 0 END AS next FROM w WHERE k = 1
    UNION ALL SELECT w.stream, w.row_idx, w.k, CASE WHEN f.fill + w.n_rows >= 20 THEN 0 ELSE f.fill + w.n_rows END, CAST(f.next AS BIGINT), CASE WHEN f.fill + w.n_rows >= 20 THEN f.next + 1 ELSE f.next END FROM f JOIN w ON w.stream = f.stream AND w.k = f.k + 1)
    SELECT CAST(stream AS VARCHAR) AS stream_id, row_idx, frame_idx FROM f""")
def frames_bounded(spark, sf_dir):
    """Statements that weigh 1 to 3 rows, in frames of 20 rows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / STREAM_KEYS).cast("string").alias("stream_id"), F.col("o_orderkey").alias("row_idx"), (F.col("o_orderkey") % 3 + 1).alias("n_rows"))
    return relational.bounded_frames(rows, 20)


@query(f"WITH r AS (SELECT stream_id, row_idx, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY row_idx) AS BIGINT) AS frame_idx FROM (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR g_value IS NOT DISTINCT FROM lag(g_value) OVER w THEN 0 ELSE 1 END AS new FROM ({_STREAMED}) WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx))) SELECT stream_id, frame_idx, count(*) AS n FROM r GROUP BY ALL")
def frames_per_graph(spark, sf_dir):
    """A frame for each run of a graph."""
    rows = relational.graph_runs(statements(spark, sf_dir, EVENTS))
    frames = codec.encode(rows, Options.of("GRAPHS", "NAMED_GRAPHS"), framing="graph", group="run", ordered=True)
    return grouping.per_frame(frames)


_BY_STREAM = f"SELECT *, 'customer-' || CAST(row_idx // 4 // {STREAM_KEYS} AS VARCHAR) AS stream_id, row_idx // 4000 AS d FROM ({CUSTOMER.sql()})"


@query(f"SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS frame_idx, count(*) AS n FROM ({_BY_STREAM}) GROUP BY stream_id, d")
def frames_per_dataset(spark, sf_dir):
    """A frame for each thousand customers of a stream."""
    rows = statements(spark, sf_dir, CUSTOMER).withColumn("d", F.floor(F.col("row_idx") / 4000)).withColumn("g", F.struct(F.lit("default").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("value", "lang", "datatype"))))
    frames = codec.encode(rows, Options.of("QUADS", "DATASETS"), framing="dataset", group="d")
    return grouping.per_frame(frames)


@query(f"SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS frame_idx, CAST(dense_rank() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS VARCHAR) AS note, CAST(count(*) AS INT) AS n FROM ({_BY_STREAM}) GROUP BY stream_id, d")
def frame_metadata(spark, sf_dir):
    """Metadata written into frames, read back with each frame's size."""
    rows = statements(spark, sf_dir, CUSTOMER).withColumn("d", F.floor(F.col("row_idx") / 4000))
    frames = codec.encode(rows, Options.of("TRIPLES", "GRAPHS"), framing="graph", group="d")
    noted = codec.with_metadata(frames, F.create_map(F.lit("note"), F.col("frame_idx").cast("string").cast("binary")))
    return codec.frame_metadata(noted).select("stream_id", "frame_idx", F.col("metadata")["note"].cast("string").alias("note"), F.col("n_statements").alias("n"))


@query("SELECT prefix, iri FROM (VALUES ('ex', 'http://example.org/'), ('sch', 'http://example.org/schema#')) t(prefix, iri)")
def namespaces_last_bind(spark, sf_dir):
    """The last declaration of a prefix wins."""
    given = [("ex", "http://old.example.org/"), ("sch", SCHEMA), ("ex", BASE)]
    frames = codec.encode(statements(spark, sf_dir, REGION, 1), Options.of("TRIPLES", "FLAT_TRIPLES", namespaces=True), namespaces=given)
    return codec.last_namespaces(codec.decode_events(frames)).select("prefix", "iri")


@query(f"SELECT g_value AS g, count(*) AS n FROM ({EVENTS.sql()}) GROUP BY g_value")
def graphs_hash_grouped(spark, sf_dir):
    return grouping.per_graph(statements(spark, sf_dir, EVENTS)).select(F.col("g")["value"].alias("g"), "n")


@query(f"WITH r AS (SELECT stream_id, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY row_idx) AS BIGINT) AS frame_idx FROM (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR g_value IS NOT DISTINCT FROM lag(g_value) OVER w THEN 0 ELSE 1 END AS new FROM ({_STREAMED}) WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx))) SELECT stream_id, frame_idx, count(*) AS n FROM r GROUP BY ALL ORDER BY stream_id, frame_idx LIMIT 50")
def count_per_graph_first50(spark, sf_dir):
    """Statements in each of the first 50 graphs."""
    return frames_per_graph(spark, sf_dir).orderBy("stream_id", "frame_idx").limit(50)


@query(f"SELECT DISTINCT {_SHOWN} FROM (SELECT * FROM ({NATION.sql()}) UNION ALL SELECT * FROM ({NATION.sql()}))")
def dedup_set(spark, sf_dir):
    once = statements(spark, sf_dir, NATION)
    return flat(grouping.as_set(once.union(once)).withColumn("row_idx", F.lit(0))).select(COLUMNS)


_RUNS = f"SELECT *, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY row_idx) AS BIGINT) AS frame_idx FROM (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR g_value IS NOT DISTINCT FROM lag(g_value) OVER w THEN 0 ELSE 1 END AS new FROM ({_STREAMED}) WINDOW w AS (PARTITION BY stream_id ORDER BY row_idx))"


def _named(events: DataFrame) -> DataFrame:
    """Events of written files by the stream's own name."""
    return events.withColumn("stream_id", F.regexp_extract("stream_id", "^(.*)-[0-9a-f]{12}[.]", 1))


@query(f"SELECT stream_id, frame_idx, count(*) AS n, min(g_value) AS g FROM ({_RUNS}) GROUP BY stream_id, frame_idx")
def grouped_files(spark, sf_dir):
    """Files with a frame for each run of a graph, written and read by the data source."""
    path = shared_path(spark, "grouped")
    datasource.write_statements(statements(spark, sf_dir, EVENTS, ordered=True), path, ordered=True, physicalType="GRAPHS", logicalType="NAMED_GRAPHS")
    found = _named(spark.read.format(datasource.FORMAT).options(logicalTypeStrict="true", mode="grouped").load(path))
    return found.groupBy("stream_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("g")["value"]).alias("g"))


@query(f"SELECT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS frame_idx, count(DISTINCT s) AS subjects, count(DISTINCT p || o_value) AS pairs FROM ({_BY_STREAM}) GROUP BY stream_id, d")
def function_per_frame(spark, sf_dir):
    """A function of each frame's statements."""
    rows = statements(spark, sf_dir, CUSTOMER).withColumn("d", F.floor(F.col("row_idx") / 4000))
    frames = codec.encode(rows, Options.of("TRIPLES", "GRAPHS"), framing="graph", group="d")

    def counted(stream: str, frame: int, found: list[tuple]) -> list[tuple]:
        return [(stream, frame, len({s for s, *_ in found}), len({p[1] + o[1] for _, p, o, _ in found}))]

    return grouping.apply_per_frame(frames, counted, "stream_id string, frame_idx long, subjects long, pairs long")


@query(f"SELECT DISTINCT stream_id, dense_rank() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS frame_idx, p, o_value AS o FROM (SELECT stream_id, d, p, o_value FROM ({_BY_STREAM}) WHERE p <> '{SCHEMA}c_name')")
def sets_per_frame(spark, sf_dir):
    """Frames as sets: statements of one subject, repeated within and across frames."""
    rows = statements(spark, sf_dir, CUSTOMER).withColumn("d", F.floor(F.col("row_idx") / 4000)).where(F.col("p")["value"] != SCHEMA + "c_name")
    rows = rows.withColumn("s", F.col("s").withField("value", F.lit(BASE + "all")))
    frames = codec.encode(rows, Options.of("TRIPLES", "GRAPHS"), framing="graph", group="d")
    found = grouping.as_set(codec.decode(frames), ("stream_id", "frame_idx"))
    return found.select("stream_id", "frame_idx", F.col("p")["value"].alias("p"), F.col("o")["value"].alias("o"))


@query(f"SELECT stream_id, max(row_idx) - min(row_idx) + 1 AS n, count(*) FILTER (o_kind = 'literal') AS literals, CAST(sum(length(o_value)) AS BIGINT) AS letters FROM ({_BY_STREAM}) GROUP BY stream_id")
def adapter_per_stream(spark, sf_dir):
    """A user's adapter that keeps state through a stream and gives one row at its end."""

    class Sums(codec.Adapter):
        schema = "stream_id string, n long, literals long, letters long"

        def begin(self, stream):
            self.stream, self.n, self.literals, self.letters = stream, 0, 0, 0

        def statement(self, frame, s, p, o, g):
            self.n += 1
            self.literals += o[0] == "literal"
            self.letters += len(o[1])

        def end(self):
            return self.stream, self.n, self.literals, self.letters

    return codec.decode_with(codec.encode(statements(spark, sf_dir, CUSTOMER), Options.of("TRIPLES", "FLAT_TRIPLES")), Sums())


@query("SELECT prefix, iri, n FROM (VALUES ('ex', 'http://example.org/'), ('sch', 'http://example.org/schema#')) t(prefix, iri), (SELECT count(DISTINCT c_custkey // " + str(STREAM_KEYS) + ") AS n FROM customer)")
def namespaces_written(spark, sf_dir):
    """Namespace declarations of every file that the data source writes, and read back."""
    path = shared_path(spark, "namespaces")
    datasource.write_statements(statements(spark, sf_dir, CUSTOMER), path, {"ex": BASE, "sch": SCHEMA}, physicalType="TRIPLES", logicalType="FLAT_TRIPLES")
    found = codec.last_namespaces(spark.read.format(datasource.FORMAT).load(path))
    return found.groupBy("prefix", "iri").agg(F.count_distinct("stream_id").alias("n"))


@query(f"SELECT s, p, o_value AS o FROM ({CUSTOMER.sql()}) WHERE p = '{SCHEMA}c_acctbal'")
def pushed_predicate(spark, sf_dir):
    """A predicate's statements, chosen in the reader."""
    path = shared_path(spark, "pushed")
    datasource.write_statements(statements(spark, sf_dir, CUSTOMER), path, physicalType="TRIPLES", logicalType="FLAT_TRIPLES")
    found = spark.read.format(datasource.FORMAT).option("predicate", SCHEMA + "c_acctbal").load(path)
    return found.select(F.col("s")["value"].alias("s"), F.col("p")["value"].alias("p"), F.col("o")["value"].alias("o"))


@query(_sql(CUSTOMER))
def roundtrip_bare_files(spark, sf_dir):
    """Files of one bare frame each."""
    path = shared_path(spark, "bare")
    datasource.write_statements(statements(spark, sf_dir, CUSTOMER), path, physicalType="TRIPLES", delimited="false")
    return flat(codec.statements_of(spark.read.format(datasource.FORMAT).load(path))).select(COLUMNS)


@query(f"SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS s, 'bnode' AS s_kind, 'r' || CAST(n_regionkey AS VARCHAR) AS o, 'bnode' AS o_kind, 'g' || CAST(n_regionkey AS VARCHAR) AS g, 'bnode' AS g_kind FROM nation")
def roundtrip_bnodes(spark, sf_dir):
    """Blank nodes as subject, object and graph."""
    one = statements(spark, sf_dir, NATION).where(F.col("o")["kind"] == "iri")
    key = lambda c, label: bnode(F.concat(F.lit(label), F.regexp_extract(c, "[0-9]+$", 0)))
    about = one.select("stream_id", "frame_idx", "row_idx", key(F.col("s")["value"], "n").alias("s"), "p", key(F.col("o")["value"], "r").alias("o"), key(F.col("o")["value"], "g").alias("g"))
    back = codec.decode(codec.encode(about, Options.of("QUADS", "FLAT_QUADS")))
    return back.select(*(F.col(c)["value"].alias(c) for c in "sog"), *(F.col(c)["kind"].alias(f"{c}_kind") for c in "sog"))


@query(f"SELECT CASE WHEN row_idx % 2 = 0 THEN 'default' ELSE g_kind END AS g_kind, CASE WHEN row_idx % 2 = 0 THEN NULL ELSE g_value END AS g_value, s, p, o_value FROM ({EVENTS.sql()})")
def roundtrip_default_graph(spark, sf_dir):
    """Statements of the default graph between those of named ones, in a stream of graphs."""
    rows = statements(spark, sf_dir, EVENTS, ordered=True).withColumn("g", F.when(F.col("row_idx") % 2 == 0, default_graph()).otherwise(F.col("g")))
    back = codec.decode(codec.encode(rows, Options.of("GRAPHS", "FLAT_QUADS"), ordered=True))
    return flat(back).select("g_kind", "g_value", "s", "p", "o_value")


@query("SELECT 'events' AS source, 'QUADS' AS physical, 'FLAT_QUADS' AS logical, count(event_type) AS graphs FROM events UNION ALL SELECT 'nation', 'TRIPLES', 'FLAT_TRIPLES', 0")
def guess_by_data(spark, sf_dir):
    """Stream types chosen by what the statements hold."""
    out = None
    for m in (EVENTS, NATION):
        n = statements(spark, sf_dir, m).where(F.col("p")["value"] == SCHEMA + m.fields[0].column).agg(F.count("g").alias("graphs"))
        physical, logical = (F.when(F.col("graphs") > 0, opt.guess(True)[i]).otherwise(opt.guess(False)[i]) for i in (0, 1))
        n = n.select(F.lit(m.table).alias("source"), physical.alias("physical"), logical.alias("logical"), "graphs")
        out = n if out is None else out.union(n)
    return out


# ------------------------------------------------------------------ validation tables


def _constant(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


_PHYS = "(VALUES ('UNSPECIFIED'), ('TRIPLES'), ('QUADS'), ('GRAPHS')) p(physical)"
_LOG = "(VALUES ('UNSPECIFIED', 0), ('FLAT_TRIPLES', 1), ('FLAT_QUADS', 2), ('GRAPHS', 3), ('DATASETS', 4), ('SUBJECT_GRAPHS', 13), ('NAMED_GRAPHS', 14), ('TIMESTAMPED_NAMED_GRAPHS', 114)) l(logical, code)"


@query(f"SELECT physical, logical, physical = 'UNSPECIFIED' OR logical = 'UNSPECIFIED' OR (physical = 'TRIPLES') = (logical IN ('GRAPHS', 'SUBJECT_GRAPHS', 'FLAT_TRIPLES')) AS ok FROM {_PHYS}, {_LOG}")
def type_matrix(spark, sf_dir):
    return _constant(spark, [(p, q, opt.compatible(i, j)) for p, i in opt.PHYSICAL.items() for q, j in opt.LOGICAL.items()], "physical string, logical string, ok boolean")


@query(f"SELECT logical, mode, CASE WHEN mode = 'flat' THEN logical IN ('FLAT_TRIPLES', 'FLAT_QUADS') ELSE logical NOT IN ('FLAT_TRIPLES', 'FLAT_QUADS', 'UNSPECIFIED') END AS ok FROM {_LOG}, (VALUES ('flat'), ('grouped')) m(mode)")
def strict_matrix(spark, sf_dir):
    def ok(logical, mode):
        try:
            opt.check_strict(logical, mode)
        except opt.ConformanceError:
            return False
        return True

    return _constant(spark, [(q, m, ok(j, m)) for q, j in opt.LOGICAL.items() for m in ("flat", "grouped")], "logical string, mode string, ok boolean")


@query(f"SELECT logical, CASE code % 10 WHEN 1 THEN 'rows' WHEN 2 THEN 'rows' WHEN 3 THEN 'graph' WHEN 4 THEN 'dataset' END AS framing FROM {_LOG} WHERE code > 0")
def flow_for_type(spark, sf_dir):
    return _constant(spark, [(q, opt.framing_for(j)) for q, j in opt.LOGICAL.items() if j], "logical string, framing string")


@query("SELECT namespaces, CASE WHEN namespaces THEN 2 ELSE 1 END AS version FROM (VALUES (true), (false)) t(namespaces)")
def version_rule(spark, sf_dir):
    return _constant(spark, [(n, opt.version_for(n)) for n in (True, False)], "namespaces boolean, version int")


@query(f"SELECT logical, has_graphs, CASE WHEN has_graphs AND code % 10 <> 3 THEN 'QUADS' ELSE 'TRIPLES' END AS physical FROM {_LOG}, (VALUES (true), (false)) t(has_graphs)")
def guess_stream(spark, sf_dir):
    return _constant(spark, [(q, h, opt.guess_physical(j, h)) for q, j in opt.LOGICAL.items() for h in (True, False)], "logical string, has_graphs boolean, physical string")


@query("SELECT a, b, c, a <> 10 OR (b = 10 AND c <> 10) AS delimited FROM (VALUES (0), (10), (17)) x(a), (VALUES (0), (10), (17)) y(b), (VALUES (0), (10), (17)) z(c)")
def delimited_hint(spark, sf_dir):
    values = (0, 10, 17)
    return _constant(spark, [(a, b, c, wire.is_delimited(bytes((a, b, c)))) for a in values for b in values for c in values], "a int, b int, c int, delimited boolean")


# ------------------------------------------------------------------ patterns and graphs


@query(f"SELECT DISTINCT c_mktsegment AS o FROM customer")
def predicate_distinct(spark, sf_dir):
    """Distinct objects of a predicate, of decoded statements."""
    frames = codec.encode(statements(spark, sf_dir, CUSTOMER), Options.of("TRIPLES", "FLAT_TRIPLES"))
    found = codec.decode(frames, predicate=SCHEMA + "c_mktsegment")
    return found.select(F.col("o")["value"].alias("o")).distinct()


@query()
def approx_distinct(spark, sf_dir):
    """Approximate count of the customers that orders name."""
    found = graph.pattern(statements(spark, sf_dir, ORDERS), o="o", predicate_iri=SCHEMA + "o_custkey")
    return found.agg(F.approx_count_distinct(F.col("o")["value"]).alias("n"))


@query(f"SELECT count(DISTINCT o_custkey) AS n FROM orders")
def count_distinct_objects(spark, sf_dir):
    found = graph.pattern(statements(spark, sf_dir, ORDERS), o="o", predicate_iri=SCHEMA + "o_custkey")
    return found.agg(F.count_distinct(F.col("o")["value"]).alias("n"))


def _bgp(spark, sf_dir, how):
    orders, customers = statements(spark, sf_dir, ORDERS), statements(spark, sf_dir, CUSTOMER)
    who = graph.pattern(orders, s="order", o="customer", predicate_iri=SCHEMA + "o_custkey")
    where = graph.pattern(customers.where(F.col("o")["value"] != "BUILDING"), s="customer", o="segment", predicate_iri=SCHEMA + "c_mktsegment")
    out = graph.join(who, where, how)
    return out.select(*(F.col(c)["value"].alias(c if c != "order" else "o") for c in out.columns))


_OC = f"'{BASE}orders/' || CAST(o_orderkey AS VARCHAR) AS o, '{BASE}customer/' || CAST(o_custkey AS VARCHAR) AS customer"
query(f"SELECT {_OC}, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'", "bgp_join")(lambda spark, sf_dir: _bgp(spark, sf_dir, "inner"))
query(f"SELECT {_OC}, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'", "bgp_left")(lambda spark, sf_dir: _bgp(spark, sf_dir, "left"))
query(f"SELECT {_OC} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')", "bgp_semi")(lambda spark, sf_dir: _bgp(spark, sf_dir, "left_semi"))
query(f"SELECT {_OC} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')", "bgp_anti")(lambda spark, sf_dir: _bgp(spark, sf_dir, "left_anti"))


_PAIR = f"SELECT '{BASE}customer/' || CAST(o_custkey AS VARCHAR) AS x, o_orderstatus AS y FROM orders"


@query(f"SELECT x AS a, y AS b FROM ({_PAIR}) UNION ALL SELECT y, x FROM ({_PAIR})")
def pairing_join(spark, sf_dir):
    out = graph.pairing(statements(spark, sf_dir, ORDERS), SCHEMA + "o_custkey", SCHEMA + "o_orderstatus")
    return out.select(F.col("a")["value"].alias("a"), F.col("b")["value"].alias("b"))


@query(f"SELECT p, count(*) AS n FROM ({ORDERS.sql()}) WHERE p NOT IN ('{SCHEMA}o_custkey', '{SCHEMA}o_orderstatus') GROUP BY p")
def removal(spark, sf_dir):
    """Statements left once some predicates are removed."""
    kept = graph.without(statements(spark, sf_dir, ORDERS), [SCHEMA + "o_custkey", SCHEMA + "o_orderstatus"])
    return kept.groupBy(F.col("p")["value"].alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _links(spark, sf_dir, *mappings):
    out = None
    for m in mappings:
        rows = statements(spark, sf_dir, m, links=True)
        out = rows if out is None else out.union(rows)
    return graph.edges(out)


def _edges_sql(*mappings: Mapping) -> str:
    every = " UNION ALL ".join(f"SELECT s, o_value AS o FROM ({m.sql()}) WHERE o_kind = 'iri'" for m in mappings)
    return f"SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM ({every})"


@query(_edges_sql(ORDERS, CUSTOMER, NATION))
def edges_undirected(spark, sf_dir):
    return _links(spark, sf_dir, ORDERS, CUSTOMER, NATION)


@query(f"SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ({_edges_sql(ORDERS, CUSTOMER, NATION)}) UNION ALL SELECT b FROM ({_edges_sql(ORDERS, CUSTOMER, NATION)})) GROUP BY node ORDER BY degree DESC, node LIMIT 5")
def degree_topk(spark, sf_dir):
    return graph.degrees(_links(spark, sf_dir, ORDERS, CUSTOMER, NATION)).orderBy(F.desc("degree"), "node").limit(5)


_LINKED = (ORDERS, CUSTOMER, NATION)
#: Each order hangs on its customer, nation and region, so a region's tree is a component.
_TREES = f"""t AS (SELECT n_regionkey AS region, '{BASE}nation/' || CAST(n_nationkey AS VARCHAR) AS node FROM nation UNION SELECT n_regionkey, '{BASE}region/' || CAST(n_regionkey AS VARCHAR) FROM nation
    UNION SELECT n_regionkey, '{BASE}customer/' || CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION SELECT n_regionkey, '{BASE}orders/' || CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"WITH {_TREES} SELECT node, min(node) OVER (PARTITION BY region) AS component FROM t")
def connected_components(spark, sf_dir):
    return graph.components(_links(spark, sf_dir, *_LINKED))


_LEAST = "SELECT o_orderkey, c_custkey, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0 ORDER BY o_orderkey LIMIT 1"


@query(f"""WITH t AS ({_LEAST}) SELECT 0 AS step, '{BASE}region/0' AS node UNION ALL SELECT 1, '{BASE}nation/' || CAST(n_nationkey AS VARCHAR) FROM t
    UNION ALL SELECT 2, '{BASE}customer/' || CAST(c_custkey AS VARCHAR) FROM t UNION ALL SELECT 3, '{BASE}orders/' || CAST(o_orderkey AS VARCHAR) FROM t""")
def shortest_path(spark, sf_dir):
    """From region 0 to its order with the smallest key."""
    orders, customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    own = customer.join(nation.where("n_regionkey = 0"), F.col("n_nationkey") == F.col("c_nationkey"))
    least = orders.join(own, F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.min("o_orderkey")).first()[0]
    return graph.shortest_path(_links(spark, sf_dir, *_LINKED), f"{BASE}region/0", f"{BASE}orders/{least}")


_LARGE = _edges_sql(*_LINKED)


@query(f"""WITH e AS ({_LARGE}), n AS (SELECT node FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node ORDER BY count(*) DESC, node LIMIT 60)
    SELECT a, b FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)""")
def induced_subgraph(spark, sf_dir):
    """The subgraph of the 60 nodes with the most links."""
    e = stored(_links(spark, sf_dir, *_LINKED), "links")
    nodes = graph.degrees(e).orderBy(F.desc("degree"), "node").select("node").limit(60)
    return graph.induced(e, nodes)


# ------------------------------------------------------------------ sets of streams, Structured Streaming


@query(f"{_sql(NATION)} UNION ALL {_sql(REGION)}")
def union_streams(spark, sf_dir):
    return flat(statements(spark, sf_dir, NATION).unionByName(statements(spark, sf_dir, REGION))).select(COLUMNS)


_PART = f"SELECT {_SHOWN} FROM ({NATION.sql()}) WHERE row_idx < 20"


def _halves(spark, sf_dir):
    rows = flat(statements(spark, sf_dir, NATION))
    return rows.select(COLUMNS), rows.where("row_idx < 20").select(COLUMNS)


@query(f"{_sql(NATION)} INTERSECT {_PART}")
def intersect_streams(spark, sf_dir):
    whole, part = _halves(spark, sf_dir)
    return whole.intersect(part)


@query(f"{_sql(NATION)} EXCEPT {_PART}")
def except_streams(spark, sf_dir):
    whole, part = _halves(spark, sf_dir)
    return whole.subtract(part)


@query(_sql(CUSTOMER))
def stream_flat_decode(spark, sf_dir):
    """Frames that arrive as files over several triggers, decoded with state kept between them."""
    path = shared_path(spark, "arrivals")
    codec.encode(statements(spark, sf_dir, CUSTOMER), Options.of("TRIPLES", "FLAT_TRIPLES")).write.parquet(path)
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    checkpoint, sink = shared_path(spark, "progress"), shared_path(spark, "decoded")
    run = decode_stream(arriving).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink).select(COLUMNS)


@query("SELECT g_value AS g, start, count(*) AS n FROM (SELECT 'http://example.org/graph/' || event_type AS g_value, date_trunc('hour', ts) AS start FROM events) GROUP BY g_value, start")
def window_counts(spark, sf_dir):
    """Time windows over decoded statements: events by graph and hour."""
    rows = statements(spark, sf_dir, EVENTS).where(F.col("p")["value"] == SCHEMA + "ts")
    at = F.to_timestamp_ntz(F.col("o")["value"], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.groupBy(F.col("g")["value"].alias("g"), F.date_trunc("hour", at).cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT g_value AS g, start, count(*) AS n FROM (SELECT 'http://example.org/graph/' || event_type AS g_value, date_trunc('hour', ts) AS start FROM events)
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY g_value, start""")
def stream_windows(spark, sf_dir):
    """Windows over arriving statements, given out once the watermark, two hours behind, has passed their end."""
    arrived, sink = shared_path(spark, "statements"), shared_path(spark, "windows")
    rows = codec.decode(codec.encode(statements(spark, sf_dir, EVENTS, ordered=True), Options.of("QUADS", "FLAT_QUADS"), ordered=True), predicate=SCHEMA + "ts")
    rows.select(F.col("g")["value"].alias("g"), F.to_timestamp(F.col("o")["value"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")).write.parquet(arrived)
    stream = spark.readStream.schema("g string, at timestamp").parquet(arrived).withWatermark("at", "2 hours")
    counts = stream.groupBy("g", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    run = counts.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("g string, window struct<start: timestamp, end: timestamp>, n long").parquet(sink).select("g", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
