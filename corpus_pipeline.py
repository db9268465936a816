"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents:

1. language: documents in no known language go (no letters, or a best share under LEAST_LANGUAGE);
2. quality: documents that the classifier, learned from the labels that the remaining documents have, rejects go;
3. near_duplicates: of each group of near duplicates (5-word shingles, 0.8) the smallest doc_id stays; every document without
   a doc_id is one of its own, after all others;
4. repeats: byte strings of 50 and more that an earlier document holds are cut out, n_chars follows, and documents with
   nothing left go;
5. packing: one row per piece of a document in a sequence of 2048 tokens.

ORACLE_SQL is None: SQL cannot express tokenisation, the trained models or the signatures. The stages are tested against
brute-force versions.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, langid, minhash, packing, quality, repeats

LEAST_LANGUAGE = 0.4
SHINGLE_WORDS = 5

#: Scratch tables of the stage that was called last; its output is written by the time the next is called.
_last: list[str] = []


def _stage(work):
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _last)
        before = set(common.scratch_tables())
        out = work(spark, docs, sf_dir)
        _last[:] = [p for p in common.scratch_tables() if p not in before]
        return out

    return run_stage


def _wrapped(docs: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """The text, columns meta, and the whole row as one column, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), F.col("text"), *(docs[c] for c in meta))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(_wrapped(docs), langid.fit(docs), keep=["__row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("__row.*")


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), meta_cols=quality.META)
    return quality.score(_wrapped(docs, quality.META), model, ["__row"], meta_cols=quality.META).where("predicted = 1").select("__row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, unnamed = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    every = named.withColumn("__id", F.col("doc_id").cast("long"))
    # written, since their numbers must be the same whenever they are read
    numbered = common.materialize(unnamed.withColumn("__id", F.monotonically_increasing_id()), "unnamed")
    last = numbered.agg(F.max("__id")).first()[0]
    if last is not None:
        after = every.agg(F.max("__id")).first()[0]
        after = 0 if after is None else after + 1
        if after + last >= 1 << 63:
            raise ValueError(f"no numbers are left after doc_id {after - 1} for documents without one")
        every = every.union(numbered.withColumn("__id", F.col("__id") + F.lit(after).cast("long")))
    kept = minhash.near_duplicates(every, "__id", words=SHINGLE_WORDS).where("kept").select(F.col("__id").alias("__kept")).distinct()
    return every.join(kept, F.col("__id") == F.col("__kept"), "left_semi").select(docs.columns)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = docs.withColumn("__had", F.octet_length("text"))
    cut = repeats.remove(before)
    shown = cut.where(F.col("__had").isNull() | (F.col("__had") == 0) | (F.octet_length("text") > 0))
    changed = F.octet_length("text") != F.col("__had")
    return shown.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeats", without_repeats),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is written in the shared folder and deleted after use."""
    docs = common.table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if (name, stage) == STAGES[-1]:
            if written:  # packing reads the tables it made, no longer its input
                common.release(spark, [written])
            return out
        path = f"{common.shared_dir(spark)}/quadrille-stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        if written:
            common.release(spark, [written])
        docs, written = spark.read.parquet(path), path
    return docs
