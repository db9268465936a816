"""Language identification with a string kernel.

Kernel: the number of byte n-grams (n = 1 to 3, blended) that two lower-cased texts both hold, normalised by the
geometric mean of their own counts. N-grams are numbered by their bytes, so none is taken for another. Nystrom landmarks
span a feature space in which one-versus-rest kernel ridge regression is solved. A text's kernel values with the landmarks
need only the n-grams that some landmark holds: a batch's presence matrix times the landmarks' n-grams times the
solution, of which the last two are multiplied once, as the model's weights.

Limits that are parameters: PER_LANG rows a language are learned from, of which LANDMARKS a language are landmarks. Rows
are those with the smallest hashes of their id, then of their text, so an id that repeats brings no more of them.

Defined results: null text or text without a letter gives `und` with score 0; an empty or unlabelled table trains no
model and every row is `und`; rows without an id are not learned from; rows repeat as they are given; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, in_worker, ship_package, slices, smallest_hashes

#: N-grams are 256 single bytes, then pairs, then triples.
PAIRS, TRIPLES, GRAMS = 256, 256 + (1 << 16), 256 + (1 << 16) + (1 << 24)
#: Texts whose presence matrix is multiplied at once, and training rows likewise.
BATCH = 128
PER_LANG = 300
LANDMARKS = 48
RIDGE = 1e-3
SHARPNESS = 6.0
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    found = _WORDLIKE.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of the whole text, by number."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int32)
    two = data[:-1] << 8 | data[1:]
    three = np.unique(two[:-1] << 8 | data[2:])
    return np.concatenate([np.flatnonzero(np.bincount(data, minlength=256)), PAIRS + np.flatnonzero(np.bincount(two, minlength=1)), TRIPLES + three]).astype(np.int32)


@dataclass
class KernelModel:
    langs: list[str]
    vocabulary: np.ndarray  # sorted n-grams that a landmark holds
    weights: np.ndarray  # (vocabulary, classes): landmarks' n-grams times the ridge solution

    @staticmethod
    def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
        """(sets, vocabulary): 1 / sqrt(size) where the set holds the n-gram."""
        out = np.zeros((len(sets), len(vocabulary)))
        if len(vocabulary):
            every = np.concatenate(sets)
            place = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            held = vocabulary[place] == every
            out[row[held], place[held]] = 1
        return out / np.sqrt(np.maximum([len(s) for s in sets], 1))[:, None]

    @staticmethod
    def fit(sets: list[np.ndarray], langs: list[str]) -> KernelModel | None:
        classes = sorted(set(langs))
        if not classes:
            return None
        seen: dict[str, int] = {}
        marks = []
        for i, lang in enumerate(langs):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= LANDMARKS:
                marks.append(i)
        vocabulary = np.unique(np.concatenate([sets[i] for i in marks]))
        landmarks = KernelModel.presence([sets[i] for i in marks], vocabulary)
        kernel = np.concatenate([KernelModel.presence(sets[i : i + BATCH], vocabulary) @ landmarks.T for i in range(0, len(sets), BATCH)])
        values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
        good = values > 1e-8 * max(values.max(), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ root
        targets = np.where(np.array(langs)[:, None] == np.array(classes)[None], 1.0, -1.0)
        # rows weigh so that every class counts the same
        share = np.array([1 / langs.count(c) for c in classes])
        weight = share[[classes.index(c) for c in langs]][:, None]
        gram = features.T @ (weight * features) + RIDGE * np.eye(features.shape[1])
        solution = root @ np.linalg.solve(gram, features.T @ (weight * targets))
        return KernelModel(classes, vocabulary, landmarks.T @ solution)

    def score(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Class index and softmax share for each set of n-grams. Sums are rounded, so that a text's place in its batch
        cannot matter."""
        found = [self.presence(sets[i : i + BATCH], self.vocabulary) @ self.weights for i in range(0, len(sets), BATCH)]
        sums = np.round(np.concatenate(found), 9)
        exps = np.exp(SHARPNESS * (sums - sums.max(axis=1, keepdims=True)))
        shares = exps / exps.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return best, shares[np.arange(len(sets)), best]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train=None) -> KernelModel | None:
    """Fit on at most PER_LANG rows a language, those with the smallest hashes of their id; train is a filter column."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        rows = rows.where(train)
    named = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("rank_hash"), F.col(text_col).cast("string").alias("text"))
    picked = smallest_hashes(named.select("id", "lang", "rank_hash").distinct(), "lang", PER_LANG, ["rank_hash", "id"]).select("id", "lang")
    sample = named.join(F.broadcast(picked), ["id", "lang"])  # at most PER_LANG ids a language
    sample = smallest_hashes(sample.withColumn("text_hash", F.xxhash64("text")), "lang", PER_LANG, ["rank_hash", "id", "text_hash"])

    @in_worker
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t or "").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["rank_hash", "lang", "grams"])

    found = sample.select("text", "rank_hash", "lang").mapInArrow(sets, "rank_hash long, lang string, grams binary").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    return KernelModel.fit([np.frombuffer(r[2], np.int32) for r in found], [r[1] for r in found])


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (default: the id), lang_pred and score."""
    ship_package(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    shown = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column(len(keep)).to_pylist()
                known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    best, share = model.score([grams(texts[i]) for i in known])
                    for i, b, s in zip(known, best, share, strict=True):
                        langs[i], scores[i] = model.langs[b], float(s)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    out = T.StructType([*shown.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return shown.mapInArrow(run, out)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Train where crc32(doc_id) mod 5 is not 0, predict every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, train=crc_bucket("doc_id", 5) != 0)
    held = docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)))
    return predict(held, model, keep=["doc_id", "held_out"])
