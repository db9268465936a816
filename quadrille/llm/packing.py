"""Best-fit packing of token sequences with exact complements.

Texts are tokenised, closed by END and cut into pieces of at most `capacity` tokens. Planning needs only how many pieces
there are of each length, at most `capacity` numbers whatever the data. For each length, longest first, the gap to a full
sequence is looked up among the single lengths, then the sums of two, then the sums of three lengths in stock, and every
combination that fills it exactly is consumed as often as the stock allows. What is left is packed best-fit, longest first,
again by length. The plan is a list of runs (length, first and end rank, sequences, offsets); pieces get a rank within
their length from counts of (length, bucket), and are dealt to the runs in parallel.

Defined results: null and empty texts are one piece of length 1 (END alone); repeated rows are packed once each, rows
without an id like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_worker, kept, materialize, ship_package, slices, table, tokenizer_path

MODEL = "byte_bpe_50k"
CAPACITY = 2048
END = 0
#: Pieces of a length are ranked in buckets: so many, and more where a bucket would get more than its share of pieces.
BUCKETS = 64
BUCKET_PIECES = 1 << 16


class ByteBpe:
    """Ids as the tokenizers library gives them for the .json file. The .tiktoken file holds the same vocabulary, and
    tiktoken encodes whole texts with it in half the time; texts with a special token's name go to the library itself."""

    def __init__(self, name: str = MODEL):
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name, self.library = name, None

    def _whole(self, text: str) -> bytes:
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(tokenizer_path(f"{self.name}.json"))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text:
            return self._whole(text)
        return self.words.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_tokenizers: dict[str, ByteBpe] = kept({})


def tokenizer(name: str) -> ByteBpe:
    if name not in _tokenizers:
        _tokenizers[name] = ByteBpe(name)
    return _tokenizers[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, and its ids if asked for."""
    ship_package(docs.sparkSession)
    shown = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kind = shown.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(model)
        closing = END.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "__text", 4 << 20):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    data = t.encode(text or "") + closing
                    for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                        part = data[4 * s : 4 * (s + n)]
                        rows.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names)

    return shown.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Stock:
    """Counts by length, with the lengths in stock as bits of a number, to look up sums of two at once."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = [0] * (capacity + 1)
        self.bits = self.mirror = 0  # bit i, and bit capacity - i: length i is in stock
        for length, n in counts.items():
            if n:
                self.count[length] = n
                self.bits |= 1 << length
                self.mirror |= 1 << capacity - length

    def take(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """Consume the combination as often as the stock (and most) allows."""
        times = min(self.count[x] // lengths.count(x) for x in set(lengths))
        times = times if most is None else min(times, most)
        for x in lengths if times else ():
            self.count[x] -= times
            if not self.count[x]:
                self.bits &= ~(1 << x)
                self.mirror &= ~(1 << self.capacity - x)
        return times

    def pairs(self, total: int, largest: int) -> Iterator[tuple[int, int]]:
        """(a, b) in stock with a >= b and a + b = total, a at most largest, the largest a first."""
        both = self.bits & (self.mirror >> self.capacity - total) & ((1 << min(total, largest + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return
            yield a, total - a
            both &= ~(1 << a)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many of these)."""
    stock, out = Stock(counts, capacity), []

    def use(lengths: tuple[int, ...]) -> None:
        if times := stock.take(lengths):
            out.append((lengths, times))

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if not stock.count[length]:
            continue
        if gap == 0:
            use((length,))
            continue
        if stock.count[gap]:
            use((length, gap))
        if stock.count[length] and gap >= 2:
            for a, b in stock.pairs(gap, gap - 1):
                use((length, a, b))
                if not stock.count[length]:
                    break
        a = min(gap - 2, capacity)
        while a > 0 and 3 * a >= gap and stock.count[length]:  # a is the largest of three
            if stock.count[a]:
                for b, c in stock.pairs(gap - a, a):
                    use((length, a, b, c))
                    if not (stock.count[length] and stock.count[a]):
                        break
            a -= 1
    # best fit: open sequences by gap, as bits and as lists of (lengths, how many)
    gaps, open_ = 0, {}

    def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
        nonlocal gaps
        open_.setdefault(gap, []).append((lengths, n))
        gaps |= 1 << gap

    for length in range(capacity, 0, -1):
        left = stock.count[length]
        while left:
            fitting = gaps >> length
            if not fitting:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            gap = length + (fitting & -fitting).bit_length() - 1
            lengths, n = open_[gap].pop()
            used = min(n, left)
            left -= used
            if n > used:
                open_[gap].append((lengths, n - used))
            if not open_[gap]:
                gaps &= ~(1 << gap)
            put(gap - length, (*lengths, length), used)
    for groups in open_.values():
        out += groups
    return out


def runs(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in each, first offset), by length and rank: the pieces of a
    length, by rank, fill the runs in order. A length that stands several times in a sequence is one run."""
    ranks: dict[int, int] = {}
    out, number = [], 0
    for lengths, n in sequences:
        offset = 0
        i = 0
        while i < len(lengths):
            each = 1
            while i + each < len(lengths) and lengths[i + each] == lengths[i]:
                each += 1
            first = ranks.get(lengths[i], 0)
            out.append((lengths[i], first, number, each, offset))
            ranks[lengths[i]] = first + n * each
            offset += each * lengths[i]
            i += each
        number += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length from 1 to capacity; order makes ranks certain.

    The pieces should be materialised: they are read for counts and for ranks.
    """
    ship_package(cut_pieces.sparkSession)
    buckets = max(BUCKETS, -(-cut_pieces.count() // BUCKET_PIECES))
    rows = cut_pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "lengths")
    stock = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table_ = runs(plan(stock, capacity))
    wide = 1 << 44
    keys = table_[:, 0] * wide + table_[:, 1]
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1).join(before, ["length", "__bucket"])
    names = cut_pieces.columns
    shown = ranked.select(*names, (F.col("__before") + F.col("__rank")).cast("long").alias("__rank"))
    at = names.index("length")

    @in_worker
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            run = table_[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            inside = rank - run[:, 1]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 2] + inside // run[:, 3]), pa.array(run[:, 4] + inside % run[:, 3] * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return shown.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, capacity=capacity), "pieces"), ["doc_id", "piece", "start", "length", "ids_crc32"], capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
