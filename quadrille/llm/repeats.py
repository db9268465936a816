"""Removal of byte strings that an earlier document holds, by longest-previous-factor arrays.

Every string of LENGTH bytes belongs to one anchor, the smallest hashed GRAM-byte string in it (leftmost of equals), so
equal strings have equal anchors. Suffixes are dealt out by the anchor of their first LENGTH bytes: each part then holds
all suffixes that can match each other that far, and a suffix array of the part answers for them.

1. Anchors of all documents are dealt out by fingerprint; an anchor that only one document holds cannot matter. Each
   document learns which of its anchors others hold too.
2. Those anchors' stretches (the bytes of all strings that belong to the anchor) are dealt out by fingerprint. Equal
   stretches in a batch travel once, for the smallest document; their bytes are compared, and larger documents' are
   decided by that. In each part the suffixes, up to their stretch's end, are sorted; the nearest suffixes of a smaller
   document before and after each one in that order (previous and next smaller values) give its longest previous factor,
   by range minima over the common prefixes of neighbours.
3. A factor of LENGTH bytes or more marks as many bytes as it has; marks are joined by document and removed.

A document is an id and a text: repeated rows of both are one document and never remove each other's bytes, and other texts
of the id are other documents. Ids order documents, then xxhash64 of the text. Every row without an id is a document; they
come last, in the order of that hash, copies as they are read. Null and empty texts have no bytes and no spans; extra
columns are ignored.

Tables name documents by KEY, whose bytes sort in that order; inside a task a document is its key's rank among the task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even_keys, free_shuffles, in_worker, materialize, ship_package, shuffle_parts, slices, strings, table, unzipped, zipped

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of the longest stretch: an anchor is the smallest of WINDOW places of at most WINDOW strings.
WIDTH = LENGTH + WINDOW - 1
#: Bytes of text that a part stands for at most, where shuffle partitions would be larger.
PART_BYTES = 48 << 20
#: Of a document: 0, id and hash of the text, or 1, hash and number of a row without id; then 1, so that no key ends in 0.
KEY = np.dtype("S18")
_BASE = 0x9E3779B97F4A7C15
#: Suffixes that are sorted at a time.
PORTION = 1 << 16
#: Strings whose anchors are found at a time, and bytes of text that are handled together.
PIECE = 1 << 19
BATCH_BYTES = 2 << 20
#: Bytes of stretches that a task gathers before it sends them.
HELD_BYTES = 16 << 20


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Anchors:
    """The anchors of a batch, in order: fingerprint, document, first and last string (by its start) of each, and the
    hashes of those two strings. A long run of strings can be several rows of one anchor."""

    prints: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    one: np.ndarray
    two: np.ndarray


def _piece(data: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the strings that begin at start; data holds their bytes."""

    def joined(a: np.ndarray, b: np.ndarray, at: int, size: int, total: int) -> np.ndarray:
        m = len(data) - total + 1
        return a[:m] * _power(size) + b[at : at + m]

    # polynomial hashes of 1, 2, 4 ... bytes at every place, then of GRAM and LENGTH bytes
    h = {1: data.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8, 16):
        h[2 * k] = h[k][: len(h[k]) - k] * _power(k) + h[k][k:]
    gram = _mix(joined(h[16], h[8], 16, 8, GRAM))
    whole = _mix(joined(joined(h[32], h[16], 32, 16, 48), h[2], 48, 2, LENGTH))
    del h
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        key = np.minimum(key[: len(key) - k], key[k:])
    key = np.minimum(key[: len(key) - (WINDOW - 16)], key[WINDOW - 16 :])
    own = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    end = np.concatenate([new[1:], [len(own)]]) - 1
    return _mix(gram[own[new]] + np.uint64(1)), doc[new], start[new], start[end], whole[start[new]], whole[start[end]]


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """Anchors of every string of LENGTH bytes that lies in one document, PIECE strings at a time."""
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    total = np.cumsum(counts)
    found = []
    for at in range(0, int(total[-1]) if len(total) else 0, PIECE):
        number = np.arange(at, min(at + PIECE, int(total[-1])))
        doc = np.searchsorted(total, number, side="right")
        start = offsets[doc] + number - (total[doc] - counts[doc])
        base, end = int(start[0]), int(start[-1]) + LENGTH
        prints, owner, first, last, one, two = _piece(data[base:end], doc, start - base)
        found.append((prints, owner, first + base, last + base, one, two))
    if not found:
        none, no_prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Anchors(no_prints, none, none, none, no_prints, no_prints)
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _bucket_blobs(prints: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each key: the rows dealt to it, in order."""
    part = (prints % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(len(keys) + 1))
    for p in range(len(keys)):
        if edges[p] < edges[p + 1]:
            yield int(keys[p]), order[edges[p] : edges[p + 1]]


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(strings(column)[0].tobytes(), KEY)


def _ranked(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them."""
    return np.unique(np.concatenate(names), return_inverse=True)


def _key_hash(names: np.ndarray) -> np.ndarray:
    pairs = np.ascontiguousarray(names.view(np.uint8).reshape(-1, KEY.itemsize)[:, 1:17]).view(">u8").astype(np.uint64)
    return _mix(pairs[:, 0] + pairs[:, 1] * np.uint64(_BASE))


def _by_document(ids: np.ndarray, prints: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, prints = ids[order], prints[order]
    first = _groups(ids)
    return ids[first].tolist(), [p.tobytes() for p in np.split(prints, first[1:])] if len(ids) else []


def _packed(ids: list[bytes], values: list[bytes], keys: np.ndarray) -> pa.RecordBatch:
    """Values by key, dealt out by key: one row (bucket, body) for each bucket that has some."""
    own_ids, size = np.array(ids, KEY), np.array([len(v) for v in values], np.int64)
    out = []
    for key, own in _bucket_blobs(_key_hash(own_ids), keys):
        out.append((key, len(own).to_bytes(8, "little") + own_ids[own].tobytes() + size[own].tobytes() + b"".join([values[i] for i in own])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "body"])


def _by_id(packed: DataFrame, parts: int, column: str) -> DataFrame:
    """(id, column): one row for each id of _packed rows, its values joined."""

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for body in batch.column(1).to_pylist():
                n = int.from_bytes(body[:8], "little")
                ids, size = np.frombuffer(body, KEY, n, 8).tolist(), np.frombuffer(body, np.int64, n, 8 + KEY.itemsize * n).tolist()
                at = 8 + (KEY.itemsize + 8) * n
                for i, z in zip(ids, size, strict=True):
                    found.setdefault(i, []).append(body[at : at + z])
                    at += z
        ids = list(found)
        for i in range(0, len(ids), 10_000):
            some = ids[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([b"".join(found[x]) for x in some], pa.binary())], ["id", column])

    return packed.repartition(parts, "bucket").mapInArrow(run, f"id binary, {column} binary")


def shared_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """(id, prints): anchors, 8 bytes each, that at least two documents hold. rows: (id, text)."""
    keys = even_keys(rows.sparkSession, parts)
    schema = "bucket int, id binary, told boolean, ids binary, prints binary"
    names = ["bucket", "id", "told", "ids", "prints"]

    @in_worker
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                called, ids = _ranked([_keys(batch.column(0))])
                data, offsets = strings(batch.column(1))
                a = anchors(data, offsets)
                if not len(a.prints):
                    continue
                # once a document, sorted by print
                order = np.lexsort((ids[a.doc], a.prints))
                prints, owner = a.prints[order], ids[a.doc][order]
                once = np.flatnonzero(np.concatenate([[True], (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])]))
                prints, owner = prints[once], owner[once]
                first = _groups(prints)
                count = np.diff(np.concatenate([first, [len(prints)]]))
                # documents of this batch that share an anchor know it now; the part only hears that it is shared
                several = np.repeat(count > 1, count)
                told_ids, told_prints = _by_document(owner[several], prints[several])
                out: list[tuple] = [(int(keys[i % parts]), i_, True, b"", p) for i, (i_, p) in enumerate(zip(called[told_ids].tolist(), told_prints, strict=True))]
                sent, sender = prints[first], np.where(count > 1, -1, owner[first])
                known = count > 1
                for key, own in _bucket_blobs(sent, keys):
                    # by document: ids and their counts, then the prints
                    own = own[np.lexsort((sender[own], ~known[own]))]
                    flag, who = known[own], sender[own]
                    singles = who[~flag]
                    at = _groups(singles)
                    size = np.diff(np.concatenate([at, [len(singles)]]))
                    head = np.array([int(flag.sum()), len(at)], np.int64).tobytes() + called[singles[at]].tobytes() + size.astype(np.uint32).tobytes()
                    out.append((key, None, False, head, sent[own].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names)

    @in_worker
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, owners, called = [], [], []
        n_called = 0
        told_ids: list[bytes] = []
        told_prints: list[bytes] = []
        for batch in batches:
            for id_, told, head, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                if told:
                    told_ids.append(id_)
                    told_prints.append(body)
                    continue
                n_known, n_docs = np.frombuffer(head, np.int64, 2)
                called.append(np.frombuffer(head, KEY, n_docs, 16))
                size = np.frombuffer(head, np.uint32, n_docs, 16 + KEY.itemsize * int(n_docs))
                prints.append(np.frombuffer(body, np.uint64))
                owners.append(np.concatenate([np.full(int(n_known), -1, np.int64), np.repeat(np.arange(n_called, n_called + n_docs), size)]))
                n_called += int(n_docs)
        if told_ids:
            yield _packed(told_ids, told_prints, keys)
        if not prints:
            return
        names, rank = _ranked(called)
        p, o = np.concatenate(prints), np.append(rank, -1)[np.concatenate(owners)]  # -1 stays
        order = np.argsort(p, kind="stable")
        p, o = p[order], o[order]
        first = _groups(p)
        size = np.diff(np.concatenate([first, [len(p)]]))
        # -1 speaks for several documents of a batch
        shared = (np.minimum.reduceat(o, first) == -1) | (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first))
        answer = np.repeat(shared, size) & (o != -1)
        ids, blobs = _by_document(o[answer], p[answer])
        if ids:
            yield _packed(names[ids].tolist(), blobs, keys)

    return _by_id(rows.mapInArrow(deal, schema).repartition(parts, "bucket").mapInArrow(meet, "bucket int, body binary"), parts, "prints")


def smaller_neighbours(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1."""
    n = len(values)
    out = np.arange(-1, n - 1)
    open_ = np.flatnonzero((out >= 0) & (values[np.maximum(out, 0)] >= values))
    while len(open_):
        # a place that is still open jumps to what its candidate points to
        out[open_] = out[out[open_]]
        open_ = open_[(out[open_] >= 0) & (values[np.maximum(out[open_], 0)] >= values[open_])]
    return out


def longest_previous(suffixes: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: how far it goes on like one of a smaller document.

    suffixes: (n, width) bytes, 0 beyond their sizes; docs: the document of each. The common prefix with any other suffix
    is the minimum over the common prefixes of neighbours between the two in sorted order, so the nearest smaller
    documents on either side of that order are best.
    """
    n, width = suffixes.shape
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}")[:, 0], kind="stable")
    s, d, z = suffixes[order], docs[order], sizes[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width).astype(np.uint8)  # of neighbours i and i + 1
    levels = [common]
    while 2 << (len(levels) - 1) <= len(common):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of common[a:b], a < b, and of the two suffixes' sizes."""
        level = np.frexp(b - a)[1] - 1
        out = np.minimum(z[a], z[b])
        for k in range(len(levels)):
            own = np.flatnonzero(level == k)
            if len(own):
                out[own] = np.minimum(out[own], np.minimum(levels[k][a[own]], levels[k][b[own] - (1 << k)]))
        return out

    lpf = np.zeros(n, np.int64)
    places = np.arange(n)
    before = smaller_neighbours(d)
    has = np.flatnonzero(before >= 0)
    lpf[has] = least(before[has], places[has])
    after = n - 1 - smaller_neighbours(d[::-1])[::-1]
    has = np.flatnonzero(after < n)
    lpf[has] = np.maximum(lpf[has], least(places[has], after[has]))
    out = np.empty(n, np.int64)
    out[order] = lpf
    return out


def _runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[bytes]]:
    """By document: the runs [begin, end) that its marked stretches make together, as 64-bit pairs."""
    if not len(ids):
        return [], []
    order = np.lexsort((starts, ids))
    i, s, e = ids[order], starts[order], (starts + sizes)[order]
    first = _groups(i)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))
    reach = np.maximum.accumulate(e + (number << 40)) - (number << 40)  # documents end far before 2**40
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] > reach[:-1])]))
    pairs = np.column_stack([s[new], reach[np.append(new[1:], len(s)) - 1]])
    owner = i[new]
    cut = _groups(owner)
    return owner[cut].tolist(), [x.tobytes() for x in np.split(pairs, cut[1:])]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _same(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from one and from two are equal, size of them, each at least 1."""
    out = np.zeros(len(one), bool)
    for at in range(0, len(one), 20_000):
        n = size[at : at + 20_000]
        equal = data[_spread(one[at : at + 20_000], n)] == data[_spread(two[at : at + 20_000], n)]
        out[at : at + 20_000] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def repeated_runs(rows: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """(id, runs): byte ranges that a smaller document holds, 64-bit pairs in no order. shared: of shared_anchors."""
    keys = even_keys(rows.sparkSession, parts)
    asked = zipped(rows, "text").join(shared, "id").select("id", "__zip", "prints")
    names = ["bucket", "id", "runs", "body"]

    def wanted(batch: pa.RecordBatch, at: int, stop: int, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Keys of some rows; of their shared anchors: print, row, first string in the document, size, hashes, bytes."""
        ids = _keys(batch.column(0).slice(at, stop - at))
        offsets = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        a = anchors(data, offsets)
        lists = batch.column(2).slice(at, stop - at).to_pylist()
        told = np.frombuffer(b"".join(lists), np.uint64)
        of = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]).astype(np.uint64)
        salt = np.uint64(0xA24BAED4963EE407)
        kept = np.flatnonzero(np.isin(_mix(a.prints + a.doc.astype(np.uint64) * salt), _mix(told + of * salt)))
        doc, first, last = a.doc[kept], a.first[kept], a.last[kept]
        size = last - first + LENGTH
        return ids, a.prints[kept], doc, first - offsets[doc], size, a.one[kept], a.two[kept], data[_spread(first, size)]

    def send(found: list[tuple]) -> pa.RecordBatch:
        """Decide what a smaller document of the task decides, and deal out the rest."""
        import zstandard

        given, prints, row, start, size, one, two, data = zip(*found, strict=True)
        before = np.cumsum([0, *map(len, given)])
        called, rank = _ranked(list(given))
        owner = rank[np.concatenate([r + b for r, b in zip(row, before, strict=False)])]
        prints, start, size, one, two, data = map(np.concatenate, (prints, start, size, one, two, data))
        begin = np.cumsum(size) - size
        # equal stretches: by the hashes of their first and last strings, then by their bytes; the smallest document's
        # stands for all
        order = np.lexsort((owner, size, two, one))
        differ = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (size[order][1:] != size[order][:-1])
        new = np.concatenate([[True], differ])
        stands = np.empty(len(order), np.int64)
        stands[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        decided = owner > owner[stands]
        marks = np.flatnonzero(decided)
        decided[marks] = _same(data, begin[marks], begin[stands[marks]], size[marks])
        marks = np.flatnonzero(decided)
        got, runs = _runs(owner[marks], start[marks], size[marks])
        out: list[tuple] = [(int(keys[i % parts]), i_, r, None) for i, (i_, r) in enumerate(zip(called[got].tolist(), runs, strict=True))]
        sent = np.flatnonzero(~decided)
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for key, own in _bucket_blobs(prints[sent], keys):
            own = sent[own]
            n = size[own]
            whose, of = np.unique(owner[own], return_inverse=True)
            head = np.array([len(own), len(whose)], np.int64).tobytes() + prints[own].tobytes() + of.astype(np.int64).tobytes() + start[own].tobytes() + n.tobytes() + called[whose].tobytes()
            out.append((key, None, None, squeeze(head + data[_spread(begin[own], n)].tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    @in_worker
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            packed = batch.column(1)
            at = 0
            while at < batch.num_rows:
                stop, texts, total = at, [], 0
                while stop < batch.num_rows and (not texts or total < BATCH_BYTES):
                    texts += unzipped(packed.slice(stop, 1))
                    total += len(texts[-1])
                    stop += 1
                new = wanted(batch, at, stop, texts)
                at = stop
                if len(new[1]):
                    found.append(new)
                    held += len(new[-1])
                if held >= HELD_BYTES:
                    yield send(found)
                    found, held = [], 0
        if found:
            yield send(found)

    @in_worker
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        gathered, called = [], []
        n_called = 0
        told_ids: list[bytes] = []
        told_runs: list[bytes] = []
        for batch in batches:
            ids, runs, bodies = (batch.column(i) for i in (1, 2, 3))
            for i, r in zip(ids.to_pylist(), runs.to_pylist(), strict=True):
                if r is not None:
                    told_ids.append(i)
                    told_runs.append(r)
            for body in bodies.to_pylist():
                if body is not None:
                    body = expand(body)
                    n, m = np.frombuffer(body, np.int64, 2).tolist()
                    prints, of, start, size = (np.frombuffer(body, k, n, 16 + 8 * n * i) for i, k in enumerate((np.uint64, np.int64, np.int64, np.int64)))
                    called.append(np.frombuffer(body, KEY, m, 16 + 32 * n))
                    gathered.append((prints, of + n_called, start, size, np.frombuffer(body, np.uint8, -1, 16 + 32 * n + KEY.itemsize * m)))
                    n_called += m
        if told_ids:
            yield _packed(told_ids, told_runs, keys)
        if not gathered:
            return
        prints, owner, start, size, data = (np.concatenate(x) for x in zip(*gathered, strict=True))
        gathered.clear()
        names, rank = _ranked(called)
        owner = rank[owner]
        begin = np.cumsum(size) - size
        suffixes_at = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(WIDTH, np.uint8)]), WIDTH)
        order = np.argsort(prints, kind="stable")
        n_suffixes = size[order] - LENGTH + 1
        total = np.cumsum(n_suffixes)
        edges = np.append(_groups(prints[order]), len(order))
        ends = total[edges[1:] - 1]
        marked = []
        at = 0
        while at < len(edges) - 1:  # whole anchors, up to about PORTION suffixes
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
            own = order[edges[at] : edges[stop]]
            n = size[own] - LENGTH + 1
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(own, n)
            left = size[of] - inside
            text = suffixes_at[begin[of] + inside]
            text[np.arange(WIDTH) >= left[:, None]] = 0
            factor = longest_previous(text, owner[of], left)
            hit = factor >= LENGTH
            marked.append((owner[of[hit]], (start[of] + inside)[hit], factor[hit]))
            at = stop
        ids, blobs = _runs(*(np.concatenate(x) for x in zip(*marked, strict=True)))
        if ids:
            yield _packed(names[ids].tolist(), blobs, keys)

    return _by_id(asked.mapInArrow(deal, "bucket int, id binary, runs binary, body binary").repartition(parts, "bucket").mapInArrow(meet, "bucket int, body binary"), parts, "runs")


def merged(runs: bytes | None, n: int) -> np.ndarray:
    """Disjoint byte ranges, in order, of all the ranges; ranges that touch are one."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.column_stack([pairs[first, 0], np.minimum(reach[np.concatenate([first[1:], [len(pairs)]]) - 1], n)])


def _kept(data: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _key(first: str, *numbers: Column) -> Column:
    """KEY of signed 64-bit numbers; its bytes sort as they do."""
    places = (F.lpad(F.hex(n.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for n in numbers)
    return F.unhex(F.concat(F.lit(first), *places, F.lit("01")))


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """keep, __zip (the text, zipped; null for null) and __runs (null without any) of every row of docs."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    every = docs.select(*keep, F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("__id"))
    same = F.xxhash64("__text")
    # rows without an id are written, since their numbers must be the same whenever they are read
    unnamed = materialize(every.where("__id IS NULL").withColumn("__id", F.monotonically_increasing_id()), "unnamed")
    named = every.where("__id IS NOT NULL").withColumn("__key", _key("00", F.col("__id"), same))
    every = named.union(unnamed.withColumn("__key", _key("01", same, F.col("__id")))).drop("__id")
    rows = every.select(F.col("__key").alias("id"), F.col("__text").alias("text")).where(F.octet_length("text") >= LENGTH)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-size // PART_BYTES))
    shared = materialize(shared_anchors(rows, parts), "anchors")
    free_shuffles(spark)
    runs = materialize(repeated_runs(rows, shared, parts), "runs")
    free_shuffles(spark)
    found = runs.select(F.col("id").alias("__key"), F.col("runs").alias("__runs"))
    shown = zipped(every.select(*keep, "__text", "__key"), "__text")
    return shown.join(found, "__key", "left").select(*keep, "__zip", "__runs")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    marked = _marked(docs, id_col, text_col, [id_col])
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, sums = [], [], [], []
            for i, runs_ in enumerate(batch.column(2).to_pylist()):
                data = unzipped(batch.column(1).slice(i, 1))[0] or b""
                found = merged(runs_, len(data))
                size.append(len(data))
                removed.append(int((found[:, 1] - found[:, 0]).sum()))
                spans.append(len(found))
                sums.append(hashlib.sha256(_kept(data, found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sums, pa.string())], names)

    kind = marked.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from text_col; characters that a cut leaves incomplete go with them. Null texts stay null."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    marked = _marked(docs, id_col, text_col, others)

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__zip", 1 << 20):
                texts = []
                for data, runs_ in zip(unzipped(batch.column(len(others))), batch.column(len(others) + 1).to_pylist(), strict=True):
                    texts.append(None if data is None else _kept(data, merged(runs_, len(data))).decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], [*others, text_col])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {text_col: "string"}
    return marked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*others, text_col])).select(names)


def op6_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
