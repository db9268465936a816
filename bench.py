"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("map_orders", "roundtrip_triples", "roundtrip_quads", "roundtrip_graphs", "roundtrip_small_lookup", "roundtrip_ntriples", "decode_relational", "dict_names", "delta_codes", "split_to_graphs", "frames_per_graph", "predicate_distinct", "bgp_join", "bgp_anti", "pairing_join", "degree_topk", "connected_components")


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quadrille.operators import codec
    from quadrille.options import Options
    from quadrille.plans import catalog
    from quadrille.plans.mapping import ORDERS
    from quadrille.sources import ntriples

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["map_nation"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["roundtrip_frame1"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    rows = catalog.statements(spark, sf_dir, ORDERS)
    text = ntriples.lines(rows).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    began = time.time()
    count, size = codec.encode(rows, Options.of("TRIPLES", "FLAT_TRIPLES")).agg(F.sum("n_statements"), F.sum(F.octet_length("content"))).first()
    took = time.time() - began
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir, "encode_statements_per_s": round(count / took), "encoded_bytes_per_ntriples_byte": round(size / text, 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
