"""The registered quality model learns from metadata: equal texts whose n_chars alone tells the label."""

import zlib

import corpus_pipeline
from quadrille.llm import quality


def test_n_chars_is_learned_and_scored(spark, tmp_path):
    rows = [(i, "the same words in every text", "en", "s", 40_000 if i % 2 else 3) for i in range(240)]
    docs = spark.createDataFrame([*rows, (1000, "the same words in every text", "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality.op2_quality_fm(spark, str(tmp_path)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out and got[i].predicted == i % 2 for i in held)
    assert 0 <= got[1000].score <= 1
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {1000} == {i for i in range(240) if i % 2}
