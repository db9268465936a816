"""Encoder and decoder over whole batches of a stream: the kernel's state and bytes, by columns.

Both take the state of a kernel object, work on a run of statements or frames at once, and put the state back. What they
do not cover (quoted triples, namespaces, very long texts, anything malformed) they leave untouched: they return None,
and the kernel goes through that run itself, with its own errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadrille.options import PHYSICAL
from quadrille.schema import TERM, XSD_STRING
from quadrille.sources import wire
from quadrille.sources.kernel import _ROW_TAGS, _SLOT_TAGS, Decoder, Dictionary, Encoder, Frame

#: Runs of fewer statements, or chunks of fewer bytes, are the kernel's.
FEW = 64
_MOST = 1 << 14
_NUMBERS = [wire.varint(n) for n in range(_MOST)]
_B = pa.binary()
_SIZES = pa.array(_NUMBERS, _B)
_PREFIX_IDS = pa.array([b"", *(b"\x08" + n for n in _NUMBERS[1:4097])], _B)
_NAME_IDS = pa.array([b"", *(b"\x10" + n for n in _NUMBERS[1:4097])], _B)
_DATATYPE_IDS = pa.array([b"", *(b"\x18" + n for n in _NUMBERS[1:4097])], _B)
_ENTRY_IDS = pa.array([b"", *(b"\x08" + n for n in _NUMBERS[1:4097])], _B)
_NONE = pa.array([b""], _B)
_KINDS = ("iri", "literal", "bnode", "default")
_EMPTY = pa.scalar(b"", _B)


def _join(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, _EMPTY)


def _long(a: pa.Array) -> np.ndarray:
    return pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _field(mark: bytes, texts: pa.Array, sizes: np.ndarray) -> pa.Array:
    """A text field, or nothing for an empty text."""
    marks = pa.array([b"", *(mark + n for n in _NUMBERS[1 : int(sizes.max(initial=0)) + 1])], _B)
    return _join(marks.take(pa.array(sizes)), texts)


def _assign(table: Dictionary, values: list[str], codes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the accesses, accesses that write an entry, their coded ids). values: distinct, by first appearance."""
    known = [table.ids.get(v) for v in values]
    if len(table.ids) + known.count(None) <= table.size:
        at = np.arange(len(codes))
        first, last = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        first[codes[::-1]], last[codes] = at[::-1], at
        new, coded, size = [], [], len(table.ids)
        for k, id_ in enumerate(known):
            if id_ is None:
                size += 1
                known[k] = size
                new.append(k)
                coded.append(0 if size == table.last_new + 1 else size)
                table.last_new = size
        for k in np.argsort(last).tolist():
            table.ids[values[k]] = known[k]
            table.ids.move_to_end(values[k])
        return np.array(known, np.int64)[codes], first[new], np.array(coded, np.int64)
    ids, new, coded, used, unit = [], [], [], set(), None
    for j, (k, u) in enumerate(zip(codes.tolist(), units.tolist(), strict=True)):
        if u != unit:
            used.clear()
            unit = u
        id_, entry = table.find(values[k], used)
        ids.append(id_)
        if entry is not None:
            new.append(j)
            coded.append(entry)
    return np.array(ids, np.int64), np.array(new, np.int64), np.array(coded, np.int64)


def _rows(kind: str, bodies: pa.Array) -> pa.Array:
    """Whole rows of these bodies, as they stand in a frame."""
    sizes = _long(bodies)
    number = _SIZES.take(pa.array(sizes))
    return _join(pa.scalar(b"\x0a", _B), _SIZES.take(pa.array(1 + _long(number) + sizes)), pa.scalar(_ROW_TAGS[kind], _B), number, bodies)


def encode(e: Encoder, terms: list[pa.StructArray], ends: np.ndarray | None) -> list[Frame] | None:
    """Frames that these statements (s, p, o, g) of e's stream fill. ends: where a group ends before a statement."""
    n, physical = len(terms[0]), e.options.physical
    graphs, arity = physical == PHYSICAL["GRAPHS"], 3 if physical == PHYSICAL["TRIPLES"] else 4
    if n < FEW or physical not in (1, 2, 3) or not (e.options.generalized and e.prefixes.size and e.datatypes.size):
        return None
    parts, kinds, same = [], [], []
    for c, t in enumerate(terms[:arity]):
        if not pa.types.is_struct(t.type) or t.null_count:
            return None
        p = [t.field(i) for i in range(4)]
        kind = pc.index_in(p[0], pa.array(_KINDS)).fill_null(9).to_numpy(zero_copy_only=False)
        if not ((kind == 0) | (kind == (3 if c == 3 else 1)) | ((kind == 2) & (c != 3))).all() or (p[1].null_count and pc.any(pc.is_null(p[1]).filter(pa.array(kind != 3))).as_py()):
            return None
        equal = np.zeros(n, bool)
        equal[1:] = True
        for part in p:
            if part.null_count < n:
                code = _codes(part)
                equal[1:] &= code[1:] == code[:-1]
        parts.append(p)
        kinds.append(kind)
        same.append(equal)
    head = [tuple(x[0].as_py() for x in p) for p in parts]
    end = [tuple(x[n - 1].as_py() for x in p) for p in parts]
    ends = np.zeros(n, bool) if ends is None else ends
    for c in range(3 if graphs else arity):
        same[c][0] = head[c] == e.slots[c]
    if graphs:
        same[3][0] = head[3] == e.graph
        same[3] &= ~ends
    order = (3, 0, 1, 2) if graphs else tuple(range(arity))
    values, langs, types = (pa.concat_arrays([p[k] for p in parts]) for k in (1, 2, 3))
    kind = np.stack([kinds[c] for c in order], 1)
    met = np.stack([~same[c] for c in order], 1)
    row, place = np.divmod(np.arange(n * arity), arity)
    slot = np.array(order)[place]
    index = slot * n + row
    unit = 2 * row + (1 if not graphs else (place > 0).astype(np.int64))
    kind, met = kind.reshape(-1), met.reshape(-1)
    tag = np.where(slot == 3, 4, slot) if graphs else slot
    rows, keys, cells = [], [], np.zeros(n * arity, np.int64)
    fields, n_fields = [_NONE], 1

    # the texts of literals come first, as too long ones leave everything to the kernel
    at = np.flatnonzero(met & (kind == 1))
    texts, lang, datatype = values.take(pa.array(index[at])).cast(_B), langs.take(pa.array(index[at])).cast(_B), types.take(pa.array(index[at]))
    sizes = _long(texts)
    lang_sizes = np.where(pc.is_valid(lang).to_numpy(zero_copy_only=False), _long(lang.fill_null(b"")), 0)
    iris = np.flatnonzero(met & (kind == 0))
    found = values.take(pa.array(index[iris])).dictionary_encode()
    uniques = found.dictionary.to_pylist()
    if sizes.max(initial=0) + lang_sizes.max(initial=0) > _MOST - 64 or max(map(len, uniques), default=0) > (_MOST >> 2) - 64:
        return None
    if lang.null_count < len(lang) and (lang_sizes[pc.is_valid(lang).to_numpy(zero_copy_only=False)] == 0).any():
        return None

    def entries(table: Dictionary, texts_: list[str], codes: np.ndarray, where: np.ndarray, sub: int) -> np.ndarray:
        ids, new, coded = _assign(table, texts_, codes, unit[where])
        if len(new):
            chosen = pa.array([texts_[k] for k in codes[new].tolist()], pa.string()).cast(_B)
            rows.append(_rows(table.what, _join(_ENTRY_IDS.take(pa.array(coded)), _field(b"\x12", chosen, _long(chosen)))))
            keys.append(unit[where[new]] * 16 + 1 + place[where[new]] * 3 + sub)
        return ids

    if len(iris):
        prefix_of, name_of, prefixes, names = [], [], {}, {}
        for value in uniques:
            cut = value.rfind("#") + 1 or value.rfind("/") + 1
            prefix_of.append(prefixes.setdefault(value[:cut], len(prefixes)))
            name_of.append(names.setdefault(value[cut:], len(names)))
        codes = found.indices.to_numpy(zero_copy_only=False)
        prefix = entries(e.prefixes, list(prefixes), np.array(prefix_of)[codes], iris, 0)
        name = entries(e.names, list(names), np.array(name_of)[codes], iris, 1)
        shown_prefix = np.where(prefix == np.concatenate([[e.last_prefix], prefix[:-1]]), 0, prefix)
        shown_name = np.where(name == np.concatenate([[e.last_name], name[:-1]]) + 1, 0, name)
        e.last_prefix, e.last_name = int(prefix[-1]), int(name[-1])
        body = _join(_PREFIX_IDS.take(pa.array(shown_prefix)), _NAME_IDS.take(pa.array(shown_name)))
        fields.append(_join(_tags("iri").take(pa.array(tag[iris])), _SIZES.take(pa.array(_long(body))), body))
        cells[iris] = n_fields + np.arange(len(iris))
        n_fields += len(iris)
    if len(at):
        typed = np.flatnonzero(pc.and_(pc.and_(pc.is_null(lang), pc.is_valid(datatype)), pc.and_(pc.not_equal(datatype, XSD_STRING), pc.not_equal(datatype, ""))).fill_null(False).to_numpy(zero_copy_only=False))
        type_id = np.zeros(len(at), np.int64)
        if len(typed):
            known = datatype.take(pa.array(typed)).dictionary_encode()
            type_id[typed] = entries(e.datatypes, known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False), at[typed], 0)
        body = _join(_field(b"\x0a", texts, sizes), _field(b"\x12", lang.fill_null(b""), lang_sizes), _DATATYPE_IDS.take(pa.array(type_id)))
        fields.append(_join(_tags("literal").take(pa.array(tag[at])), _SIZES.take(pa.array(_long(body))), body))
        cells[at] = n_fields + np.arange(len(at))
        n_fields += len(at)
    for k, what in ((2, "bnode"), (3, "default")):
        at = np.flatnonzero(met & (kind == k))
        if len(at):
            body = values.take(pa.array(index[at])).cast(_B).fill_null(b"")
            fields.append(_join(_tags(what).take(pa.array(tag[at])), _SIZES.take(pa.array(_long(body))), body))
            cells[at] = n_fields + np.arange(len(at))
            n_fields += len(at)
    every = pa.concat_arrays(fields)
    cells = cells.reshape(n, arity)
    body = _join(*(every.take(pa.array(cells[:, k])) for k in range(1 if graphs else 0, arity)))
    rows.append(_rows("quad" if physical == PHYSICAL["QUADS"] else "triple", body))
    keys.append((2 * np.arange(n) + 1) * 16 + 15)
    if graphs:
        begun = np.flatnonzero(~same[3])
        rows.append(_rows("graph_start", every.take(pa.array(cells[begun, 0]))))
        keys.append(2 * begun * 16 + 15)
        closed = begun if e.graph is not None else begun[begun > 0]
        rows.append(_rows("graph_end", _NONE.take(pa.array(np.zeros(len(closed), np.int64)))))
        keys.append(2 * closed * 16)
        e.graph = end[3]
    key = np.concatenate(keys)
    sort = np.argsort(key)
    key = key[sort]
    whole = pa.concat_arrays(rows).take(pa.array(sort))
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, whole.offset * 4)
    content = memoryview(whole.buffers()[2]) if whole.buffers()[2] is not None else memoryview(b"")
    statement = key % 32 == 31
    counted = np.concatenate([[0], np.cumsum(statement)])
    if e.framing in ("graph", "dataset"):
        cuts = np.searchsorted(key, 2 * np.flatnonzero(ends) * 16, "right").tolist()
    elif e.most_rows == float("inf"):
        cuts = []
    else:
        may = np.flatnonzero(statement | (key % 32 == 0)) + 1
        cuts, begin = [], -e.n_rows
        while (j := int(np.searchsorted(may, begin + e.most_rows))) < len(may):
            begin = int(may[j])
            cuts.append(begin)
    out, begin = [], 0
    for cut in cuts:
        e.body += content[offsets[begin] : offsets[cut]]
        e.n_rows += cut - begin
        e.statements += int(counted[cut] - counted[begin])
        out.append(e._cut())
        begin = cut
    e.body += content[offsets[begin] : offsets[-1]]
    e.n_rows += len(whole) - begin
    e.statements += int(counted[-1] - counted[begin])
    for c in range(3 if graphs else arity):
        e.slots[c] = end[c]
    return out


_TAGS: dict[str, pa.Array] = {}


def _tags(kind: str) -> pa.Array:
    if kind not in _TAGS:
        _TAGS[kind] = pa.array([t.get(kind, b"") for t in _SLOT_TAGS], _B)
    return _TAGS[kind]


# ------------------------------------------------------------------ decoding

_TERM_TYPE = pa.struct([pa.field(n, pa.string()) for n in TERM.names])
_NAMES_OF_KINDS = pa.array([*_KINDS, None], pa.string())
_TABLES = ("name", "prefix", "datatype")
#: Our number of a kind by the format's, in s, p and o, and of a graph.
_SLOT_KINDS, _GRAPH_KINDS = np.array([0, 2, 1, 9]), np.array([0, 2, 3, 9])


class _Other(Exception):
    """Something that the kernel must see."""


def _need(ok) -> None:
    if not ok:
        raise _Other


class _Bytes:
    """Frames of a stream, joined, with a cursor for each of many places at once."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = np.frombuffer(data + b"\0\0\0\0", np.uint8)

    def numbers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Varints of up to three bytes, and the places after them."""
        b = self.at[at].astype(np.int64)
        value, after = b & 127, at + 1
        more = np.flatnonzero(b > 127)
        for shift in (7, 14):
            if not len(more):
                break
            b = self.at[after[more]].astype(np.int64)
            value[more] |= (b & 127) << shift
            after[more] += 1
            more = more[b > 127]
        else:
            _need(not len(more))
        return value, after

    def field(self, mark: int, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(has the field, its number, place after it): for texts the number is the length, and the place the text's."""
        has = (at < end) & (self.at[np.minimum(at, len(self.data))] == mark)
        value, after, on = np.zeros(len(at), np.int64), at.copy(), np.flatnonzero(has)
        if len(on):
            value[on], after[on] = self.numbers(at[on] + 1)
            _need((after[on] <= end[on]).all())
        return has, value, after

    def texts(self, begin: np.ndarray, size: np.ndarray) -> pa.Array:
        """Texts that stand at rising places."""
        if not len(begin):
            return pa.array([], pa.string())
        offsets = np.empty(2 * len(begin) + 1, np.int32)
        offsets[0], offsets[1::2], offsets[2::2] = 0, begin, begin + size
        _need((np.diff(offsets) >= 0).all())
        cut = pa.Array.from_buffers(_B, 2 * len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        return cut.take(pa.array(np.arange(1, 2 * len(begin), 2))).cast(pa.string())


def _filled(values: np.ndarray, known: np.ndarray, before: int) -> np.ndarray:
    """The last known value up to each place."""
    last = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(last >= 0, values[np.maximum(last, 0)], before)


def _counted(given: np.ndarray, before: int) -> np.ndarray:
    """Ids where 0 means one more than the last."""
    place = np.arange(len(given))
    last = np.maximum.accumulate(np.where(given != 0, place, -1))
    return np.where(last >= 0, given[np.maximum(last, 0)] + place - last, before + 1 + place)


def decode(d: Decoder, frames: list[bytes], first: int, base: int, as_quads: bool, only: list[tuple[int, int, str]] | None) -> tuple[dict, int] | None:
    """(columns of the frames' statements by name, number of rows), the decoder moved past them; None: not for here.
    first: number of the first frame; base: rows of the stream before it; only: (slot, part, value) to choose by."""
    data = b"".join(frames)
    fresh = d.options is None
    if len(data) < FEW or len(data) > 1 << 28:
        return None
    try:
        if fresh:
            _need(frames[0][:1] == b"\x0a")
            _, _, begin, end = wire._head(data, 0, len(frames[0]))
            row = wire.read_row(data, begin, end)
            _need(row[0] == "options")
            d._start(row[1])
        return _decode(d, int(fresh), data, frames, first, base, as_quads, only)
    except (_Other, pa.ArrowInvalid, IndexError, ValueError, TypeError):
        if fresh:
            d.options = None
        return None


def _decode(d: Decoder, skip: int, data: bytes, frames: list[bytes], first: int, base: int, as_quads: bool, only: list[tuple[int, int, str]] | None) -> tuple[dict, int]:
    b = _Bytes(data)
    starts, stops, per_frame, at, stop = [], [], [], 0, 0
    for frame in frames:
        stop, before = stop + len(frame), len(starts)
        while at < stop:
            _need(data[at] == 10 and at + 4 <= len(data))
            size, at = data[at + 1], at + 2
            if size > 127:
                size, at = size & 127 | data[at] << 7, at + 1
                if size > 1 << 14:
                    size, at = size & 16383 | data[at] << 14, at + 1
                    _need(size < 1 << 21)
            starts.append(at)
            at += size
            stops.append(at)
        _need(at == stop)
        per_frame.append(len(starts) - before)
    start, end = np.array(starts, np.int64), np.array(stops, np.int64)
    n = len(start)
    _need(n and (end - start >= 2).all())
    mark = b.at[start]
    kind = mark >> 3
    _need(((mark & 135) == 2).all() and np.isin(kind[skip:], (2, 3, 4, 5, 9, 10, 11)).all())
    size, body = b.numbers(start + 1)
    _need((body + size == end).all())
    _need((size[kind == 5] == 0).all())

    # fields of statements, and of the beginnings of graphs (slot 4)
    t_row, t_slot, t_kind, t_at, t_end = [], [], [], [], []
    held = np.flatnonzero((kind >= 2) & (kind <= 4))
    cursor, before = body[held], np.full(len(held), -1)
    _need((size[kind == 4] > 0).all())
    while True:
        on = np.flatnonzero(cursor < end[held])
        if not len(on):
            break
        row = held[on]
        m = b.at[cursor[on]].astype(np.int64)
        _need(((m & 135) == 2).all() and (m > 7).all())
        number = (m >> 3) - 1
        graph = kind[row] == 4
        slot = np.where(graph, 4, number >> 2)
        _need((slot > before[on]).all() and (number[graph] < 4).all() and (slot[~graph] < np.where(kind[row[~graph]] == 2, 3, 4)).all())
        before[on] = slot
        length, begin = b.numbers(cursor[on] + 1)
        cursor[on] = begin + length
        _need((cursor[on] <= end[row]).all())
        for to, x in ((t_row, row), (t_slot, slot), (t_kind, np.where(slot >= 3, _GRAPH_KINDS[number & 3], _SLOT_KINDS[number & 3])), (t_at, begin), (t_end, begin + length)):
            to.append(x)
    t_row, t_slot, t_kind, t_at, t_end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (t_row, t_slot, t_kind, t_at, t_end))
    sort = np.argsort(t_row * 8 + t_slot)
    t_row, t_slot, t_kind, t_at, t_end = t_row[sort], t_slot[sort], t_kind[sort], t_at[sort], t_end[sort]
    _need((t_kind < 9).all())

    # entries of the three tables
    sizes = {"name": d.options.names, "prefix": d.options.prefixes, "datatype": d.options.datatypes}
    entries, value_of = {}, {}
    for number, what in zip((9, 10, 11), _TABLES):
        row = np.flatnonzero(kind == number)
        _, given, after = b.field(8, body[row], end[row])
        _, length, after = b.field(18, after, end[row])
        _need((after + length == end[row]).all())
        ids = _counted(given, d.newest[what])
        _need(((ids > 0) & (ids <= sizes[what])).all())
        texts = b.texts(after, length)
        entries[what] = row, ids, texts
        value_of[what] = pa.concat_arrays([pa.array(d.tables[what], pa.string()), texts])

    def looked_up(what: str, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places in value_of[what]: the last entry of an id before its row."""
        row, entry_ids, _ = entries[what]
        _need(((ids > 0) & (ids <= sizes[what])).all())
        key = entry_ids * (n + 1) + row
        by_key = np.argsort(key)
        j = np.searchsorted(key[by_key], ids * (n + 1) + rows) - 1
        hit = j >= 0
        hit[hit] = entry_ids[by_key[j[hit]]] == ids[hit]
        place = ids.copy()
        place[hit] = sizes[what] + 1 + by_key[j[hit]]
        _need(not value_of[what].take(pa.array(place)).null_count)
        return place

    # terms: first the five that stood before, then those of the frames, by kind
    carried = [*d.slots, d.graph]
    values = [pa.array([t and t[1] for t in carried], pa.string())]
    langs = [pa.array([t and t[2] for t in carried], pa.string())]
    types = [pa.array([t and t[3] for t in carried], pa.string())]
    kinds = [np.array([4 if t is None else _KINDS.index(t[0]) if t[0] in _KINDS else 9 for t in carried])]
    _need((kinds[0] < 9).all())
    place_of, n_terms, last_prefix, last_name = np.zeros(len(t_row), np.int64), 5, d.last_prefix, d.last_name

    def keep(on: np.ndarray, which: int, texts: pa.Array, lang: pa.Array | None = None, datatype: pa.Array | None = None) -> None:
        nonlocal n_terms
        nothing = pa.nulls(len(on), pa.string())
        values.append(texts)
        langs.append(nothing if lang is None else lang)
        types.append(nothing if datatype is None else datatype)
        kinds.append(np.full(len(on), which))
        place_of[on] = n_terms + np.arange(len(on))
        n_terms += len(on)

    on = np.flatnonzero(t_kind == 0)
    if len(on):
        _, prefix, after = b.field(8, t_at[on], t_end[on])
        _, name, after = b.field(16, after, t_end[on])
        _need((after == t_end[on]).all())
        name = _counted(name, last_name)
        prefix = _filled(prefix, prefix != 0, last_prefix)
        last_prefix, last_name = int(prefix[-1]), int(name[-1])
        text = value_of["name"].take(pa.array(looked_up("name", name, t_row[on])))
        if prefix.any():
            _need((prefix > 0).all())
            text = pc.binary_join_element_wise(value_of["prefix"].take(pa.array(looked_up("prefix", prefix, t_row[on]))), text, "")
        keep(on, 0, text)
    on = np.flatnonzero(t_kind == 1)
    if len(on):
        _, length, begin = b.field(10, t_at[on], t_end[on])
        has_lang, lang_length, lang_begin = b.field(18, begin + length, t_end[on])
        has_type, datatype, after = b.field(24, lang_begin + lang_length, t_end[on])
        _need((after == t_end[on]).all() and not (has_lang & has_type).any())
        lang, typed = pa.nulls(len(on), pa.string()), pa.nulls(len(on), pa.string())
        if has_lang.any():
            lang = pc.if_else(pa.array(has_lang), b.texts(lang_begin, lang_length), None)
        if has_type.any() and sizes["datatype"]:
            where = np.flatnonzero(has_type)
            spots = np.zeros(len(on), np.int64)
            spots[where] = looked_up("datatype", datatype[where], t_row[on[where]])
            typed = value_of["datatype"].take(pa.array(spots, mask=~has_type))
        keep(on, 1, b.texts(begin, length), lang, typed)
    on = np.flatnonzero(t_kind == 2)
    if len(on):
        keep(on, 2, b.texts(t_at[on], t_end[on] - t_at[on]))
    on = np.flatnonzero(t_kind == 3)
    if len(on):
        keep(on, 3, pa.nulls(len(on), pa.string()))
    term_kind, value, lang, datatype = np.concatenate(kinds), pa.concat_arrays(values), pa.concat_arrays(langs), pa.concat_arrays(types)

    # each slot's term, or the one before it
    said = np.flatnonzero((kind == 2) | (kind == 3))
    at_row = np.full((n, 5), -1)
    at_row[t_row, t_slot] = place_of
    slots = [_filled(at_row[:, c], at_row[:, c] >= 0, c)[said] for c in range(3)]
    quad = kind == 3
    _need(all((term_kind[s] != 4).all() for s in slots))
    own = _filled(at_row[:, 3], at_row[:, 3] >= 0, 3)
    is_quad = quad[said]
    graph = np.full(len(said), -1)
    graph[is_quad] = own[said][is_quad]
    _need((term_kind[graph[is_quad]] != 4).all())
    open_ = np.where(kind == 5, -1, at_row[:, 4])
    now = _filled(open_, (kind == 4) | (kind == 5), 4 if d.graph is not None else -1)
    if d.options.physical == PHYSICAL["GRAPHS"]:
        graph[~is_quad] = now[said][~is_quad]
        _need((graph >= 0).all())

    newest = {what: int(entries[what][1][-1]) if len(entries[what][1]) else d.newest[what] for what in _TABLES}

    def term(k: int) -> tuple | None:
        return None if k < 0 or term_kind[k] == 4 else (_KINDS[term_kind[k]], value[k].as_py(), lang[k].as_py(), datatype[k].as_py())

    ends = [term(int(_filled(at_row[:, c], at_row[:, c] >= 0, c)[-1])) for c in range(4)]
    last_graph = term(int(now[-1])) if n else d.graph
    for what in _TABLES:
        for id_, text in zip(entries[what][1].tolist(), entries[what][2].to_pylist(), strict=True):
            d.tables[what][id_] = text
    d.newest, d.slots, d.graph, d.last_prefix, d.last_name = newest, ends, last_graph, last_prefix, last_name

    chosen = np.ones(len(said), bool)
    for slot, part, wanted in only or ():
        spots = graph if slot == 3 else slots[slot]
        source = _NAMES_OF_KINDS.take(pa.array(term_kind)) if part == 0 else (value, lang, datatype)[part - 1]
        hit = pc.equal(source, wanted).fill_null(False).to_numpy(zero_copy_only=False)
        chosen &= hit[spots] & (spots >= 0)
    pick = np.flatnonzero(chosen)

    def column(spots: np.ndarray) -> pa.Array:
        none = spots < 0
        if none.all():
            parts = [pa.nulls(len(spots), pa.string())] * 4
            if as_quads:
                parts[0] = pa.array(["default"] * len(spots), pa.string())
            return pa.StructArray.from_arrays(parts, fields=list(_TERM_TYPE), mask=None if as_quads else pa.array(none))
        at = pa.array(spots, mask=none)
        parts = [_NAMES_OF_KINDS.take(pa.array(term_kind[spots], mask=none)), value.take(at), lang.take(at), datatype.take(at)]
        if as_quads:
            parts[0] = parts[0].fill_null("default")
        return pa.StructArray.from_arrays(parts, fields=list(_TERM_TYPE), mask=pa.array(none) if none.any() and not as_quads else None)

    frame = np.repeat(np.arange(first, first + len(frames)), per_frame)
    rows = said[pick]
    found = {"frame_idx": pa.array(frame[rows]), "row_idx": pa.array(base + rows)} | {c: column(s[pick]) for c, s in zip("spog", (*slots, graph))}
    return found, n
