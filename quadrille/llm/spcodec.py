"""SentencePiece encoding with byte spans of the source, and decoding.

The normaliser takes the longest prefix in the compiled character map and records the source byte of every byte that it
writes.
Texts split before each run of space symbols that follows another character, as no piece holds a space symbol after
another character and, without a character map, no prefix reaches across (checked when a model is loaded; texts of other
models are taken whole). Each part is normalised with its alignment, segmented, and its pieces' ends are projected to
source bytes, once; short parts are kept in a bounded memo. Decoding goes from ids alone.

Defined results: null and empty texts have no ids and decode to nothing; characters without a piece become byte pieces,
whose spans are single bytes; rows repeat as they are given; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, kept, ship_package, slices, table, tokenizer_path
from .spmodel import BYTE, CONTROL, SPACE, UNKNOWN, Model

MODEL = "piece_bpe_32k.model"
#: Parts that are kept, and their longest.
_MOST_MEMO = 200_000
_LONGEST = 48
_PARTS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")
_NORMAL_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = Model.load(path)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=m.bare)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in m.pieces)
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
        #: Bytes of the normalised text that a piece covers; unknown pieces cover a character and are measured when met.
        self.width = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(m.pieces, m.types, strict=True)], np.int64)
        self.decimal = [str(i) for i in range(len(m.pieces))]
        #: Whether the character map's prefixes and the pieces both end at a space, so that parts of a text can go alone.
        self.by_parts = self.splits and m.byte_fallback and m.dummy_prefix and m.escape_spaces and not m.trim_spaces and m.charsmap is None
        #: Part of the source to (ids as decimal text, ids, source bytes of each id).
        self.memo: dict[str, tuple[str, bytes, bytes]] = {}

    def _learn(self, parts: set[str]) -> dict[str, tuple[str, bytes, bytes]]:
        """Normalise, segment and align parts of the source, each of which begins with spaces or space symbols."""
        new = list(parts)
        if not new:
            return {}
        normal, source = self.model.normalize_parts(new)
        every = self.segmenter.encode([n.decode("utf-8", "replace") for n in normal], out_type=int, num_threads=1)
        count = np.cumsum([0, *map(len, every)])
        ids = np.fromiter((i for e in every for i in e), np.uint32, int(count[-1]))
        # pieces follow each other without a gap, in the parts put together as in each
        size = np.diff(source[np.concatenate([[0], np.cumsum(self.width[ids])])]).astype(np.uint32)
        ids_bytes, size_bytes, decimal = ids.tobytes(), size.tobytes(), self.decimal
        return {p: (",".join([decimal[i] for i in e]), ids_bytes[4 * a : 4 * b], size_bytes[4 * a : 4 * b]) for p, e, a, b in zip(new, every, count.tolist(), count[1:].tolist(), strict=False)}

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """For each text: ids as decimal text, ids, and the source byte at which each id begins (and the end)."""
        if not self.by_parts:
            yield from map(self.encode, texts)
            return
        memo = self.memo
        cut = [_PARTS.findall(" " + t) if t else [] for t in texts]  # that space is the dummy prefix
        learned = self._learn({p for parts in cut for p in parts} - memo.keys())
        short = {p: v for p, v in learned.items() if len(p) <= _LONGEST}
        if len(memo) + len(short) > _MOST_MEMO:
            learned |= {p: memo[p] for parts in cut for p in parts if p in memo}
            memo.clear()
        memo.update(short)
        for parts in cut:
            if not parts:
                yield "", np.zeros(0, np.uint32), np.zeros(1, np.int64)
                continue
            found = [memo.get(p) or learned[p] for p in parts]
            sizes = np.frombuffer(b"".join([x[2] for x in found]), np.uint32).astype(np.int64)
            sizes[0] -= 1  # the dummy prefix has no byte in the source
            yield ",".join([x[0] for x in found]), np.frombuffer(b"".join([x[1] for x in found]), np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The general way: normalise with alignment, segment, project piece ends to source bytes."""
        norm, source = self.model.normalize(text)
        if not norm:
            return "", np.zeros(0, np.uint32), np.zeros(1, np.int64)
        shown = norm.decode("utf-8", "replace")
        parts = _NORMAL_PARTS.findall(shown) if self.splits else [shown]
        ids = np.array([i for p in self.segmenter.encode(parts, out_type=int, num_threads=1) for i in p], np.uint32)
        width = self.width[ids]
        if not self.model.byte_fallback:
            at = 0
            for k, i in enumerate(ids):  # an unknown piece covers the run of characters up to the next known piece
                if self.model.types[i] == UNKNOWN:
                    rest = norm[at:].decode("utf-8", "replace")
                    stop = next((j for j in range(1, len(rest) + 1) if k + 1 < len(ids) and self.model.types[ids[k + 1]] != UNKNOWN and rest[j:].startswith(self.model.pieces[ids[k + 1]])), len(rest))
                    width[k] = len(rest[:stop].encode())
                at += width[k]
        ends = np.minimum(np.cumsum(width), len(norm))
        return ",".join(map(str, ids.tolist())), ids, np.concatenate([[0], np.asarray(source, np.int64)[ends]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy prefix of the first piece goes, bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids.tolist()])
        if self.model.dummy_prefix and len(ids) and data.startswith(b" ") and self.model.types[ids[0]] not in (BYTE, UNKNOWN):
            data = data[1:]
        return data.decode("utf-8", "replace")


_codecs: dict[str, Codec] = kept({})


def codec(name: str) -> Codec:
    """One codec a worker process."""
    if name not in _codecs:
        _codecs[name] = Codec(tokenizer_path(name))
    return _codecs[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id_col, ids, and begins: the source byte where each piece begins, and the text's size in bytes at the end."""
    ship_package(docs.sparkSession)
    shown = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                rows = list(c.encode_batch([t or "" for t in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], [id_col, "ids", "begins"])

    kind = shown.schema[id_col].dataType.simpleString()
    return shown.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, begins array<bigint>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Encode and decode every text in one pass and keep sums: what op8 returns."""
    ship_package(docs.sparkSession)
    shown = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n, ids_sum, text_sum, spans_sum = [], [], [], []
                for shown_ids, ids, begins in c.encode_batch(texts):
                    n.append(len(ids))
                    ids_sum.append(hashlib.sha256(shown_ids.encode()).hexdigest())
                    text_sum.append(hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
                    spans_sum.append(hashlib.sha256(begins.astype("<i8").tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string()), pa.array(spans_sum, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = shown.schema[id_col].dataType.simpleString()
    return shown.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded. spans_sha256 is over the source bytes where pieces begin and the text's size, as
    little-endian 64-bit numbers."""
    return digest(table(spark, sf_dir, "documents"))
