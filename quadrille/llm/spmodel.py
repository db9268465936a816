"""Reading a SentencePiece model file: its pieces, and the normaliser with source alignment.

The file is one protobuf message (public schema): repeated pieces (1) of text (1), score (2), type (3); trainer options
(2) with byte fallback (35); normaliser options (3) with the compiled character map (2), add_dummy_prefix (3),
remove_extra_whitespaces (4) and escape_whitespaces (5).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


def _put(number: int, kind: int, value: object) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 and the replacement texts it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest prefix of data[at:] that the trie holds, and that prefix's length."""
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[0])
        return self.texts[found[0] : end], found[1]


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    byte_fallback: bool = False
    charsmap: CharacterMap | None = None
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    #: The same model without any normalisation, for segmenting text that is normalised already.
    bare: bytes = b""

    @property
    def identity(self) -> bool:
        """Normalisation changes nothing but a dummy prefix and the space symbol."""
        return self.charsmap is None and not self.trim_spaces and self.dummy_prefix and self.escape_spaces

    @staticmethod
    def load(path: str) -> Model:
        with open(path, "rb") as f:
            return Model.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Model:
        model, bare = Model(), []
        for number, kind, value in fields(data):
            if number == 1:
                text, score, type_ = "", 0.0, NORMAL
                for n, _, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        type_ = v
                model.pieces.append(text)
                model.scores.append(score)
                model.types.append(type_)
            elif number == 2:
                model.byte_fallback = any(n == 35 and v for n, _, v in fields(value))
            elif number == 3:
                for n, _, v in fields(value):
                    if n == 2 and v:
                        model.charsmap = CharacterMap(v)
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.trim_spaces = bool(v)
                    elif n == 5:
                        model.escape_spaces = bool(v)
                value = _put(1, 2, b"identity") + _put(3, 0, 0) + _put(4, 0, 0) + _put(5, 0, 0)
            bare.append(_put(number, kind, value))
        model.bare = b"".join(bare)
        return model

    def normalize_parts(self, parts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """normalize() of parts of texts that are not their beginnings, and the alignment of all of them put together:
        for each normalised byte (and the end) the byte of the joined parts it came from."""
        if self.charsmap is None and not self.trim_spaces and self.escape_spaces:
            # no prefix is in the map, so every character stands for itself, and spaces become the space symbol
            data = [p.encode("utf-8", "replace") for p in parts]
            joined = np.frombuffer(b"".join(data), np.uint8)
            space = SPACE.encode()
            source = np.repeat(np.arange(len(joined)), np.where(joined == 32, len(space), 1))
            return [d.replace(b" ", space) for d in data], np.append(source, len(joined))
        found = [self.normalize(p, first=False) for p in parts]
        base = np.cumsum([0, *(len(p.encode("utf-8", "replace")) for p in parts)])
        source = [np.asarray(s[:-1], np.int64) + b for (_, s), b in zip(found, base, strict=False)]
        return [n for n, _ in found], np.append(np.concatenate(source), base[-1])

    def normalize(self, text: str, first: bool = True) -> tuple[bytes, list[int]]:
        """Normalised UTF-8, and for each of its bytes (and its end) the byte of the source it came from. first: the text
        is whole or its beginning, and gets the dummy prefix."""
        data = text.encode("utf-8", "replace")
        at, end = 0, len(data)
        out, source = bytearray(), []

        def step(i: int) -> tuple[bytes, int, int]:
            """What the next characters become, their size, and how far the source moves on with each byte written."""
            if self.charsmap is not None and (hit := self.charsmap.longest(data, i)):
                return *hit, 0
            b = data[i]
            n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return data[i : i + n], n, 1

        if self.trim_spaces:
            while at < end:
                shown, n, _ = step(at)
                if shown != b" ":
                    break
                at += n
        if at == end:
            return b"", [0]
        space = SPACE.encode() if self.escape_spaces else b" "
        if self.dummy_prefix and first:
            out += space
            source += [at] * len(space)
        after_space = self.trim_spaces
        while at < end:
            shown, n, moves = step(at)
            if after_space:
                shown = shown.lstrip(b" ")
            if shown:
                for j, b in enumerate(shown):
                    new = space if b == 32 else bytes([b])
                    out += new
                    source += [at + j * moves] * len(new)
                after_space = shown.endswith(b" ") and self.trim_spaces
            at += n
        if self.trim_spaces:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), [*source, at]
