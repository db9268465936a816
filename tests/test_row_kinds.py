"""Rows that the encoder writes where its tables overflow, against a least-recently-used table by hand."""

import datetime
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from quadrille.operators import codec
from quadrille.options import Options
from quadrille.plans.mapping import BASE, ORDERS, SCHEMA

N, CYCLE, STREAMS, SIZES = 40_000, 2500, 8, {"name": 4096, "prefix": 150, "datatype": 32}


def brute(orders):
    """Rows by kind. orders: (key, customer) by key; tables are dicts whose oldest key comes first."""
    n = Counter()
    tables = [{k: {} for k in SIZES} for _ in range(STREAMS)]

    def use(table, kind, value):
        if value not in table[kind]:
            n[kind] += 1
            if len(table[kind]) == SIZES[kind]:
                del table[kind][next(iter(table[kind]))]
        table[kind].pop(value, None)
        table[kind][value] = True

    def iri(table, value):
        cut = max(value.rfind("#"), value.rfind("/")) + 1
        use(table, "prefix", value[:cut])
        use(table, "name", value[cut:])

    for key, customer in orders:
        table = tables[key % STREAMS]
        iri(table, f"{BASE}orders/{key}")
        for f in ORDERS.fields:
            iri(table, SCHEMA + f.column)
            if f.kind == "customer":
                iri(table, f"{BASE}customer/{customer}")
            elif f.kind in ("decimal", "dateTime"):
                use(table, "datatype", f.kind)
            n["triple"] += 1
    n["options"] = STREAMS
    return dict(n)


def test_evicted_names_are_counted_again(spark, tmp_path):
    orders = [(i, 1_000_000 + i // STREAMS % CYCLE) for i in range(N)]
    at = datetime.datetime(2020, 1, 1)
    columns = {"o_orderkey": [k for k, _ in orders], "o_custkey": [c for _, c in orders], "o_orderstatus": ["O"] * N, "o_totalprice": [1.0] * N, "o_orderdate": [at] * N, "o_orderpriority": ["1"] * N}
    pq.write_table(pa.table(columns), tmp_path / "orders.parquet")
    want = brute(orders)
    assert want["name"] > STREAMS * len(ORDERS.fields) + N + STREAMS * CYCLE  # more rows than names
    rows = ORDERS.statements(spark.read.parquet(str(tmp_path / "orders.parquet")), STREAMS)
    frames = codec.encode(rows, Options.of("TRIPLES", "FLAT_TRIPLES", names=SIZES["name"], prefixes=SIZES["prefix"]))
    got = {r.row_kind: r["count"] for r in codec.rows(frames).groupBy("row_kind").count().collect()}
    assert got == want
