"""The wire format: protobuf messages of a frame, read and written by hand.

Terms on the wire are tuples: ('iri', prefix id, name id), ('bnode', label), ('literal', lex, lang, datatype id),
('triple', (s, p, o)), ('default',). None in a slot is a repeated term. Rows are tuples that begin with their kind:
('options', Options), ('triple', s, p, o), ('quad', s, p, o, g), ('graph_start', g), ('graph_end',), ('namespace', name,
iri), ('name' | 'prefix' | 'datatype', id, value).
"""

from __future__ import annotations

from collections.abc import Iterator

from quadrille.options import ConformanceError, Options

ROW_FIELDS = {1: "options", 2: "triple", 3: "quad", 4: "graph_start", 5: "graph_end", 6: "namespace", 9: "name", 10: "prefix", 11: "datatype"}
ROW_NUMBERS = {v: k for k, v in ROW_FIELDS.items()}
TERM_KINDS = ("iri", "bnode", "literal", "triple")
GRAPH_KINDS = ("iri", "bnode", "default", "literal")


def varint(n: int) -> bytes:
    if n < 128:
        return bytes((n,))
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ConformanceError("the data end inside a number")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at, end = 0, len(data)
    while at < end:
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 2:
            size, at = read_varint(data, at)
            if at + size > end:
                raise ConformanceError("the data end inside a field")
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 0:
            value, at = read_varint(data, at)
            yield key >> 3, value
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ConformanceError("not a frame")


def put(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def put_number(number: int, value: int) -> bytes:
    """Numbers of 0 are not written."""
    return varint(number << 3) + varint(value) if value else b""


# ------------------------------------------------------------------ terms


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int, int]:
    """Field number, wire type, and where the field's value begins and ends (of numbers: value, place after it)."""
    key = data[at]
    at += 1
    if key > 127:
        key, at = read_varint(data, at - 1)
    kind = key & 7
    if kind == 2:
        if at >= end:
            raise ConformanceError("the data end inside a number")
        size = data[at]
        at += 1
        if size > 127:
            size, at = read_varint(data, at - 1)
        if at + size > end:
            raise ConformanceError("the data end inside a field")
        return key >> 3, 2, at, at + size
    if kind == 0:
        value, at = read_varint(data, at)
        return key >> 3, 0, value, at
    if kind in (1, 5):
        return 0, kind, at, at + (8 if kind == 1 else 4)
    raise ConformanceError("not a frame")


def _read_iri(data: bytes, at: int, end: int) -> tuple:
    prefix = name = 0
    while at < end:
        n, _, value, at = _head(data, at, end)
        if n == 1:
            prefix = value
        elif n == 2:
            name = value
    return "iri", prefix, name


def _read_literal(data: bytes, at: int, end: int) -> tuple:
    lex, lang, datatype = "", None, None
    while at < end:
        n, _, value, at = _head(data, at, end)
        if n == 1:
            lex = data[value:at].decode()
        elif n == 2:
            lang, datatype = data[value:at].decode(), None
        elif n == 3:
            lang, datatype = None, value
    return "literal", lex, lang, datatype


def _read_term(kind: str, data: bytes, at: int, end: int) -> tuple:
    if kind == "iri":
        return _read_iri(data, at, end)
    if kind == "literal":
        return _read_literal(data, at, end)
    if kind == "bnode":
        return "bnode", data[at:end].decode()
    if kind == "default":
        return ("default",)
    return "triple", tuple(_read_slots(data, at, end, 3))


def _read_slots(data: bytes, at: int, end: int, arity: int) -> list[tuple | None]:
    """Slots s, p, o have four field numbers each, in the order of TERM_KINDS; then the graph's, of GRAPH_KINDS."""
    slots: list[tuple | None] = [None] * arity
    while at < end:
        n, kind, begin, at = _head(data, at, end)
        slot = (n - 1) >> 2
        if kind == 2 and 0 <= slot < arity:
            slots[slot] = _read_term((TERM_KINDS if slot < 3 else GRAPH_KINDS)[(n - 1) & 3], data, begin, at)
    return slots


def _term_body(term: tuple) -> bytes:
    kind = term[0]
    if kind == "iri":
        return put_number(1, term[1]) + put_number(2, term[2])
    if kind == "bnode":
        return term[1].encode()
    if kind == "literal":
        body = put(1, term[1].encode()) if term[1] else b""
        if term[2] is not None:
            return body + put(2, term[2].encode())
        return body if term[3] is None else body + varint(3 << 3) + varint(term[3])
    if kind == "triple":
        return _slots_body(term[1])
    return b""


def _slots_body(slots: tuple) -> bytes:
    out = b""
    for slot, term in enumerate(slots):
        if term is not None:
            kinds = TERM_KINDS if slot < 3 else GRAPH_KINDS
            if term[0] not in kinds:
                raise NotImplementedError(f"unsupported term type {term[0]} in slot {'spog'[slot]}")
            out += put(4 * slot + kinds.index(term[0]) + 1, _term_body(term))
    return out


# ------------------------------------------------------------------ rows and frames


def _read_options(data: bytes) -> Options:
    keys = {1: "stream_name", 2: "physical", 3: "generalized", 4: "star", 9: "names", 10: "prefixes", 11: "datatypes", 14: "logical", 15: "version"}
    found: dict = {"names": 0, "prefixes": 0, "datatypes": 0, "version": 0}
    for n, v in fields(data):
        if n in keys:
            found[keys[n]] = v.decode() if n == 1 else bool(v) if n in (3, 4) else v
    return Options(**found)


def options_body(o: Options) -> bytes:
    name = put(1, o.stream_name.encode()) if o.stream_name else b""
    return name + b"".join(put_number(n, int(v)) for n, v in ((2, o.physical), (3, o.generalized), (4, o.star), (9, o.names), (10, o.prefixes), (11, o.datatypes), (14, o.logical), (15, o.version)))


def read_row(data: bytes, at: int = 0, end: int | None = None) -> tuple:
    """The row in data[at:end]; of several the last, as the format has it."""
    end = len(data) if end is None else end
    row = None
    while at < end:
        n, wire_kind, begin, at = _head(data, at, end)
        kind = ROW_FIELDS.get(n) if wire_kind == 2 else None
        if kind == "triple":
            row = (kind, *_read_slots(data, begin, at, 3))
        elif kind == "quad":
            row = (kind, *_read_slots(data, begin, at, 4))
        elif kind in ("name", "prefix", "datatype"):
            index, value = 0, ""
            while begin < at:
                m, _, v, begin = _head(data, begin, at)
                if m == 1:
                    index = v
                elif m == 2:
                    value = data[v:begin].decode()
            row = (kind, index, value)
        elif kind == "options":
            row = (kind, _read_options(data[begin:at]))
        elif kind == "graph_start":
            term = None
            while begin < at:
                m, _, v, begin = _head(data, begin, at)
                if term is None and 1 <= m <= 4:
                    term = _read_term(GRAPH_KINDS[m - 1], data, v, begin)
            row = (kind, term)
        elif kind == "graph_end":
            row = (kind,)
        elif kind == "namespace":
            label, iri = "", ("iri", 0, 0)
            while begin < at:
                m, _, v, begin = _head(data, begin, at)
                if m == 1:
                    label = data[v:begin].decode()
                elif m == 2:
                    iri = _read_iri(data, v, begin)
            row = (kind, label, iri)
    if row is None:
        raise TypeError("unknown row")
    return row


def write_row(row: tuple) -> bytes:
    kind = row[0]
    if kind in ("triple", "quad"):
        body = _slots_body(row[1:])
    elif kind in ("name", "prefix", "datatype"):
        body = put_number(1, row[1]) + (put(2, row[2].encode()) if row[2] else b"")
    elif kind == "options":
        body = options_body(row[1])
    elif kind == "graph_start":
        if row[1][0] not in GRAPH_KINDS:
            raise NotImplementedError(f"unsupported term type {row[1][0]} for a graph")
        body = put(GRAPH_KINDS.index(row[1][0]) + 1, _term_body(row[1]))
    elif kind == "graph_end":
        body = b""
    else:
        body = (put(1, row[1].encode()) if row[1] else b"") + put(2, _term_body(row[2]))
    return put(ROW_NUMBERS[kind], body)


def read_frame(data: bytes) -> tuple[list[tuple], dict[str, bytes]]:
    rows, metadata, at, end = [], {}, 0, len(data)
    while at < end:
        n, kind, begin, at = _head(data, at, end)
        if n == 1 and kind == 2:
            rows.append(read_row(data, begin, at))
        elif n == 15 and kind == 2:
            key, value = "", b""
            for m, v in fields(data[begin:at]):
                if m == 1:
                    key = v.decode()
                else:
                    value = v
            metadata[key] = value
    return rows, metadata


def write_frame(rows: list[bytes], metadata: dict[str, bytes] | None = None) -> bytes:
    """rows: of write_row."""
    out = b"".join(put(1, r) for r in rows)
    for key in sorted(metadata or {}):
        out += put(15, put(1, key.encode()) + put(2, metadata[key]))
    return out


def is_delimited(head: bytes) -> bool:
    """Whether a file's first three bytes begin a length-prefixed stream rather than a bare frame."""
    return len(head) >= 3 and (head[0] != 0x0A or (head[1] == 0x0A and head[2] != 0x0A))


def split_frames(data: bytes) -> Iterator[bytes]:
    """The frames of a file's bytes, in either form."""
    if not is_delimited(data[:3]):
        if not data:
            raise ConformanceError("the stream holds no frame")
        yield data
        return
    at = 0
    while at < len(data):
        size, at = read_varint(data, at)
        if at + size > len(data):
            raise ConformanceError("the data end inside a frame")
        yield data[at : at + size]
        at += size


def read_frames(stream) -> Iterator[bytes]:
    """The frames of a binary file object, one in memory at a time; it need not be seekable."""
    head = b""
    while len(head) < 3 and (more := stream.read(3 - len(head))):
        head += more
    if not is_delimited(head):
        while more := stream.read(1 << 20):
            head += more
        if not head:
            raise ConformanceError("the stream holds no frame")
        yield head
        return
    buffer = head
    while True:
        while not buffer or (buffer[-1] >= 128 and all(b >= 128 for b in buffer)):
            more = stream.read(1)
            if not more:
                if buffer:
                    raise ConformanceError("the data end inside a number")
                return
            buffer += more
        size, at = read_varint(buffer, 0)
        frame = buffer[at : at + size]
        buffer = buffer[at + size :]
        missing = size - len(frame)
        while missing:
            more = stream.read(missing)
            if not more:
                raise ConformanceError("the data end inside a frame")
            frame += more
            missing -= len(more)
        yield frame
