"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions in time
linear in the number of features a document has (the sum-of-squares identity).

Features: distinct lower-cased words hashed into 2**WORD_BITS columns, each with value 1/sqrt(count); STATS structure
statistics of the whole text, each put in one of BINS one-hot columns; optional numeric metadata columns in log bins.

Limit that is a parameter: at most TRAIN_ROWS labelled rows (smallest hashes of id, then of text, half of them for each
label where there are enough) are learned from. Empty and null texts are scored like any other (no words, all statistics
0). Without labelled rows every score is 0.5. Equal rows of the labels count once; an id with both labels is learned with
both; rows without an id are scored and not learned from; rows repeat as they are given; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, crc_bucket, in_worker, ship_package, slices, smallest_hashes, table

WORD_BITS = 16
BINS = 12
RANK = 8
TRAIN_ROWS = 2000
EPOCHS = 12
META_BINS = 24
#: Metadata that documents have, for op2 and the pipeline.
META = ("n_chars",)

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b" ", b"\n\r\t\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"|", b"#$%&*@", b"<>{}[]()/\\=+", b"'\"-_`~^")):
    _CLASS[list(_chars)] = _k + 1
_CLASS[128:] = 13
STATS = ("spaces", "breaks", "lower", "upper", "digits", "stops", "commas", "marks", "bars", "signs", "code", "quotes", "high", "word length", "distinct words", "repeated lines", "line length", "size")
STAT_COLUMNS = len(STATS) * BINS


def _bin(x: float, top: float) -> int:
    return min(int(BINS * min(max(x, 0.0), top) / top), BINS - 1)


def statistics(text: str, n_words: int, n_distinct: int) -> list[int]:
    """The bin of each of STATS."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(len(data), 1)
    share = np.bincount(_CLASS[data], minlength=14)[1:] / n
    tops = (0.5, 0.1, 1, 1, 0.2, 0.06, 0.1, 0.1, 0.1, 0.4, 0.1, 0.1, 0.5)
    bins = [_bin(s, t) for s, t in zip(share, tops, strict=True)]
    lines = [x for x in text.split("\n") if x]
    bins.append(_bin((n - share[0] * n) / max(n_words, 1), 16))
    bins.append(_bin(n_distinct / max(n_words, 1), 1.0001))
    bins.append(_bin(1 - len(set(lines)) / max(len(lines), 1), 1.0001))
    bins.append(_bin(np.log1p(n / max(len(lines), 1)), 9))
    bins.append(_bin(np.log1p(n), 14))
    return bins


#: Word to hashed column.
_columns = Memo(lambda word: zlib.crc32(word.encode("utf-8", "replace")) >> (32 - WORD_BITS))


def features(text: str, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one document."""
    words = text.lower().split()
    distinct = set(words)
    columns = np.unique(np.fromiter(map(_columns.__getitem__, distinct), np.int32, len(distinct)))
    base = 1 << WORD_BITS
    stats = [base + BINS * i + b for i, b in enumerate(statistics(text, len(words), len(distinct)))]
    base += STAT_COLUMNS
    stats += [base + META_BINS * i + (0 if v is None or v != v else min(1 + int(np.log2(1 + max(float(v), 0))), META_BINS - 1)) for i, v in enumerate(meta)]
    values = np.full(len(columns) + len(stats), 1 / np.sqrt(len(STATS)), np.float32)
    values[: len(columns)] = 1 / np.sqrt(max(len(columns), 1))
    return np.concatenate([columns, np.array(stats, np.int32)]), values


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # (columns, RANK)

    def raw(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of documents that begin at starts, and their factor sums. Each has a feature."""
        vx = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[columns] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(c) for c, _ in rows])
        raw, _ = self.raw(np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_meta: int = 0, seed: int = 7) -> FactorisationMachine:
        """Mini-batch AdaGrad on the logistic loss, both labels weighing the same."""
        rng = np.random.default_rng(seed)
        width = (1 << WORD_BITS) + STAT_COLUMNS + META_BINS * n_meta
        fm = FactorisationMachine(0.0, np.zeros(width, np.float32), rng.normal(0, 0.05, (width, RANK)).astype(np.float32))
        y = np.array(labels, np.float32)
        if len(y) == 0:
            fm.factors[:] = 0
            return fm
        ones = float(y.mean())
        weight = np.where(y > 0, 0.5 / max(ones, 1e-6), 0.5 / max(1 - ones, 1e-6)) if 0 < ones < 1 else np.ones_like(y)
        seen_w, seen_v, seen_b = np.full(width, 1e-6, np.float32), np.full((width, RANK), 1e-6, np.float32), 1e-6
        for epoch in range(EPOCHS):
            rate = 0.15 / (1 + 0.3 * epoch)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                sizes = np.array([len(rows[i][0]) for i in batch])
                columns, values = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
                raw, sums = fm.raw(columns, values, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                each = np.repeat(slope, sizes)
                used, where = np.unique(columns, return_inverse=True)
                grad_w = np.bincount(where, each * values, len(used)) + 1e-4 * fm.linear[used]
                inner = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - fm.factors[columns] * values[:, None])
                grad_v = np.zeros((len(used), RANK), np.float32)
                np.add.at(grad_v, where, inner.astype(np.float32))
                grad_v += 1e-4 * fm.factors[used]
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                seen_b += float(slope.sum()) ** 2
                fm.linear[used] -= rate * grad_w / np.sqrt(seen_w[used])
                fm.factors[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
                fm.bias -= rate * float(slope.sum()) / seen_b**0.5
        return fm


def _encode(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
    pairs = [(c.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for c, v in rows]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = (), train=None) -> FactorisationMachine:
    """Learn from a bounded sample of rows that have a label; train is a filter on id_col."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label"))
    if train is not None:
        known = known.where(train)
    known = smallest_hashes(known.distinct().withColumn("h", F.xxhash64(F.col(id_col).cast("string"))), "label", TRAIN_ROWS // 2, ["h", id_col])
    shown = docs.select(id_col, F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("double").alias(f"m_{i}") for i, c in enumerate(meta_cols)))
    # at most TRAIN_ROWS ids; an id that repeats brings no more rows
    sample = shown.join(F.broadcast(known.select(id_col, "label", "h")), id_col).withColumn("text_hash", F.xxhash64("text"))
    sample = smallest_hashes(sample, "label", TRAIN_ROWS // 2, ["h", id_col, "text_hash"])

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = [batch.column(3 + i).to_pylist() for i in range(len(meta_cols))]
            columns, values = _encode(features(t or "", tuple(m[i] for m in meta)) for i, t in enumerate(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], ["h", "label", "c", "v"])

    found = sample.select("text", "h", "label", *(f"m_{i}" for i in range(len(meta_cols)))).mapInArrow(run, "h long, label int, c binary, v binary").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    return FactorisationMachine.fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in found], [int(r[1] > 0) for r in found], len(meta_cols))


def score(docs: DataFrame, model: FactorisationMachine, keep: list[str], text_col: str = "text", meta_cols: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` of docs, score and predicted."""
    ship_package(docs.sparkSession)
    shown = docs.select(*keep, F.col(text_col).cast("string").alias("__text"), *(F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(meta_cols)))
    k = len(keep)

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 4 << 20):
                meta = [batch.column(k + 1 + i).to_pylist() for i in range(len(meta_cols))]
                scores = model.score([features(t or "", tuple(m[i] for m in meta)) for i, t in enumerate(batch.column(k).to_pylist())])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    out = T.StructType([*shown.schema.fields[:k], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return shown.mapInArrow(run, out)


def op2_quality_fm(spark, sf_dir: str) -> DataFrame:
    """Learn from labels whose crc32(doc_id) mod 3 is not 1, score every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), meta_cols=META, train=crc_bucket("doc_id", 3) != 1)
    held = docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)))
    return score(held, model, ["doc_id", "held_out"], meta_cols=META)
