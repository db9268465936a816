"""Direct mapping of tables to statements.

Subject: BASE<table>/<key>; predicate: SCHEMA<column>; foreign keys become IRIs, other columns literals with a datatype.
row_idx is key * number of columns + position, so the order needs no sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.store import dealt
from quadrille.functions.terms import default_graph, iri, literal
from quadrille.schema import TERM, XSD

BASE = "http://example.org/"
SCHEMA = "http://example.org/schema#"
#: Keys that a stream covers, so that the number of streams, and of tasks that encode and decode, follows the data.
STREAM_KEYS = 2048


@dataclass(frozen=True)
class Field:
    column: str
    #: A table name for a foreign key, else integer, decimal, dateTime, lang:<column> or string.
    kind: str

    def term(self) -> Column:
        c = F.col(self.column)
        if self.kind == "integer":
            return literal(c, datatype=F.lit(XSD + "integer"))
        if self.kind == "decimal":
            return literal(c.cast("decimal(18,2)"), datatype=F.lit(XSD + "decimal"))
        if self.kind == "dateTime":
            return literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), datatype=F.lit(XSD + "dateTime"))
        if self.kind.startswith("lang:"):
            return literal(c, lang=F.col(self.kind[5:]))
        if self.kind == "string":
            return literal(c)
        return iri(F.concat(F.lit(f"{BASE}{self.kind}/"), c.cast("string")))

    @property
    def is_link(self) -> bool:
        return self.kind not in ("integer", "decimal", "dateTime", "string") and not self.kind.startswith("lang:")

    def sql(self) -> tuple[str, str, str, str]:
        """kind, value, lang and datatype in SQL."""
        c, null = self.column, "CAST(NULL AS VARCHAR)"
        if self.kind == "integer":
            return "'literal'", f"CAST({c} AS VARCHAR)", null, f"'{XSD}integer'"
        if self.kind == "decimal":
            return "'literal'", f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)", null, f"'{XSD}decimal'"
        if self.kind == "dateTime":
            return "'literal'", f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')", null, f"'{XSD}dateTime'"
        if self.kind.startswith("lang:"):
            return "'literal'", c, self.kind[5:], null
        if self.kind == "string":
            return "'literal'", c, null, null
        return "'iri'", f"'{BASE}{self.kind}/' || CAST({c} AS VARCHAR)", null, null


@dataclass(frozen=True)
class Mapping:
    table: str
    key: str
    fields: tuple[Field, ...]
    #: A column that names the graph; its nulls are the default graph.
    graph: str | None = None

    def statements(self, rows: DataFrame, streams: int | None = None, ordered: bool = False, links: bool = False) -> DataFrame:
        """Statements of a table's rows: a stream for every STREAM_KEYS keys, or `streams` by the key modulo their number.
        ordered: dealt out by stream and in order, as the codec wants them; the table's narrow rows are what is moved.
        links: those whose object is an IRI, so that no others are made."""
        subject = iri(F.concat(F.lit(f"{BASE}{self.table}/"), F.col(self.key).cast("string")))
        graph = F.lit(None).cast(TERM)
        if self.graph:
            graph = F.when(F.col(self.graph).isNull(), default_graph()).otherwise(iri(F.concat(F.lit(f"{BASE}graph/"), F.col(self.graph))))
        made = {i for i, f in enumerate(self.fields) if f.is_link or not links} or range(len(self.fields))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), iri(F.lit(SCHEMA + f.column)).alias("p"), f.term().alias("o")) for i, f in enumerate(self.fields) if i in made))).alias("x")
        stream = F.concat(F.lit(f"{self.table}-"), (F.floor(F.col(self.key) / STREAM_KEYS) if streams is None else F.pmod(F.col(self.key), F.lit(streams))).cast("string"))
        rows = rows.withColumn("__stream", stream)
        if ordered:
            rows = dealt(rows, "__stream").sortWithinPartitions("__stream", self.key)
        shown = rows.select(F.col("__stream").alias("stream_id"), F.col(self.key).cast("long").alias("__k"), subject.alias("s"), graph.alias("g"), each)
        shown = shown.where("x.o.value IS NOT NULL AND x.o.kind = 'iri'" if links else "x.o.value IS NOT NULL")
        return shown.select("stream_id", F.lit(0).cast("long").alias("frame_idx"), (F.col("__k") * len(self.fields) + F.col("x.at")).alias("row_idx"), "s", F.col("x.p").alias("p"), F.col("x.o").alias("o"), "g")

    def sql(self) -> str:
        """The same statements, as flat(): one SELECT a field."""
        parts = []
        g = f"CASE WHEN {self.graph} IS NULL THEN 'default' ELSE 'iri' END, CASE WHEN {self.graph} IS NULL THEN NULL ELSE '{BASE}graph/' || {self.graph} END" if self.graph else "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
        for i, f in enumerate(self.fields):
            kind, value, lang, datatype = f.sql()
            parts.append(f"SELECT CAST({self.key} AS BIGINT) * {len(self.fields)} + {i} AS row_idx, '{BASE}{self.table}/' || CAST({self.key} AS VARCHAR) AS s, '{SCHEMA}{f.column}' AS p, {kind} AS o_kind, {value} AS o_value, {lang} AS o_lang, {datatype} AS o_datatype, g.* FROM {self.table}, LATERAL (SELECT {g}) g(g_kind, g_value) WHERE {f.column} IS NOT NULL")
        return " UNION ALL ".join(parts)


def flat(statements: DataFrame) -> DataFrame:
    """Statements as plain columns."""
    o, g = F.col("o"), F.col("g")
    return statements.select("row_idx", F.col("s")["value"].alias("s"), F.col("p")["value"].alias("p"), o["kind"].alias("o_kind"), o["value"].alias("o_value"), o["lang"].alias("o_lang"), o["datatype"].alias("o_datatype"), g["kind"].alias("g_kind"), g["value"].alias("g_value"))


NATION = Mapping("nation", "n_nationkey", (Field("n_name", "string"), Field("n_regionkey", "region")))
REGION = Mapping("region", "r_regionkey", (Field("r_name", "string"),))
CUSTOMER = Mapping("customer", "c_custkey", (Field("c_name", "string"), Field("c_nationkey", "nation"), Field("c_acctbal", "decimal"), Field("c_mktsegment", "string")))
ORDERS = Mapping("orders", "o_orderkey", (Field("o_custkey", "customer"), Field("o_orderstatus", "string"), Field("o_totalprice", "decimal"), Field("o_orderdate", "dateTime"), Field("o_orderpriority", "string")))
EVENTS = Mapping("events", "event_id", (Field("ts", "dateTime"), Field("user_id", "integer"), Field("value", "decimal"), Field("props", "string")), graph="event_type")
DOCUMENTS = Mapping("documents", "doc_id", (Field("text", "lang:lang"), Field("source", "string"), Field("n_chars", "integer")))
SUPPLIER = Mapping("supplier", "s_suppkey", (Field("s_name", "string"), Field("s_nationkey", "nation")))
