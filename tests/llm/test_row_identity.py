"""Rows without an id and ids with several texts: every such row is a document of its own."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import repeats
from tests.llm.test_operators import brute_repeats, prose


def by_order(spark, rows):
    """What brute_repeats expects of rows (id, text) once documents are numbered: by id, nulls last, then by hash of the text."""
    hashes = [r.h for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "n long, text string").select("n", F.xxhash64("text").alias("h")).orderBy("n").collect()]
    key = [(0, d, h, 0) if d is not None else (1, h, i, 0) for i, ((d, _), h) in enumerate(zip(rows, hashes, strict=True))]
    number = {k: i for i, k in enumerate(sorted(set(key)))}
    back = {number[k]: d for k, (d, _) in zip(key, rows, strict=True)}
    return sorted(((back[i], *rest) for i, *rest in brute_repeats([(number[k], t) for k, (_, t) in zip(key, rows, strict=True)])), key=repr)


def test_texts_without_an_id_and_texts_of_one_id(spark):
    rng = random.Random(12)
    line, other = prose(rng, 14), prose(rng, 16)
    rows = [(i, prose(rng, 10) + "\n" + line) for i in range(3)]
    rows += [(None, prose(rng, 5) + "\n" + line), (None, prose(rng, 40)), (None, prose(rng, 20) + other), (None, other + prose(rng, 9)), (None, "short")]
    rows += [(None, rows[4][1])] * 2  # copies
    rows += [(7, prose(rng, 30)), (7, prose(rng, 12) + "\n" + line), (7, line + other), rows[0], (7, line + other)]
    rows += [((1 << 63) - 1, prose(rng, 8) + other), (-(1 << 63), other), (-1, other + line)]
    got = sorted(map(tuple, repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == by_order(spark, rows)
    assert all(0 <= r[2] <= r[1] for r in got)


def test_pipeline_stages_see_documents_without_an_id(spark):
    rng = random.Random(13)
    one, two, short = prose(rng, 60), prose(rng, 60), "six words are in this text"
    near = " ".join(one.split() + ["more"])
    rows = [(None, one), (None, one), (None, near), (None, two), (5, two), (None, short), (None, short), (9, prose(rng, 60)), (9, prose(rng, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(kept) == 5 and {t for i, t in kept if i is None} in ({one, short}, {near, short})
    assert (5, two) in kept and sum(i == 9 for i, _ in kept) == 2
    cut = [(r.doc_id, r.text) for r in corpus_pipeline.without_repeats(spark, docs, "").collect()]
    assert sum(t in (one, near) for _, t in cut) == 1 and (5, two) in cut and not any(i is None and t == two for i, t in cut)
