"""The pipeline on the smallest tables: every stage's decisions against brute force on its own input."""

import corpus_pipeline
import __spark_entry__
import pytest

from quadrille.llm import common, minhash

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into and comes out of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = common.table(spark, SF, "documents")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        after = spark.read.parquet(f"file://{folder}/{name}")
        if name != "packing":
            assert after.columns == columns
        out.append((name, docs, after))
        docs = after
    return out


def test_filters_keep_clean_documents(steps):
    name, before, after = steps[0]
    assert name == "language" and after.count() >= 0.97 * before.count()
    labels = {r.doc_id: r.quality for r in before.sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1][2].select("doc_id").collect()}
    known = [(i, q) for i, q in labels.items()]
    assert sum((i in kept) == bool(q) for i, q in known) >= 0.95 * len(known)


def test_one_of_each_group_stays(steps):
    from tests.llm.test_operators import brute_components

    _, before, after = steps[2]
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.SHINGLE_WORDS).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_repeats_go(steps):
    import hashlib

    from tests.llm.test_operators import brute_repeats

    _, before, after = steps[3]
    want = {r[0]: r for r in brute_repeats([(r.doc_id, r.text) for r in before.collect()])}
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == {i for i, r in want.items() if r[1] == 0 or r[2] < r[1]}
    whole = [i for i in got if want[i][2] == 0]
    assert all(hashlib.sha256(got[i].text.encode()).hexdigest() == want[i][4] for i in whole)
    assert all(got[i].n_chars == len(got[i].text) for i in got if want[i][2])


def test_run_returns_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    want = steps[4][2]
    pick = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(got.select(*pick).collect()) == sorted(want.select(*pick).collect())


def test_odd_tables(spark, tmp_path):
    """Nulls, clashing extra columns, and an empty table pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, predicted int, kept boolean"
    rows = [(1, None, None, None, None, 1.0, "a", 1, True), (None, "some words here", "en", None, 3, None, None, None, None), (2, "plain words of text " * 20, "en", "s", None, 0.0, "b", 0, False), (2, "plain words of text " * 20, "en", "s", None, 0.0, "b", 0, False), (3, "", "en", "s", 0, 0.0, "b", 0, False)]
    for k, given in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in found} == ({None, 2} if given else set())
    assert minhash.near_duplicates(spark.createDataFrame(rows, schema)).count() == len(rows)
