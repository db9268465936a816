import io

import pytest

from quadrille.options import ConformanceError, Options
from quadrille.sources import wire
from quadrille.sources.kernel import Decoder, Encoder, read_options

VECTOR = bytes.fromhex("110a0f0a0d10014880015 00f580f70017801".replace(" ", ""))


def test_options_vector():
    (frame,) = wire.split_frames(VECTOR)
    found = read_options(frame)
    assert (found.physical, found.logical, found.names, found.prefixes, found.datatypes, found.version) == (1, 1, 128, 15, 15, 1)
    again = wire.write_frame([wire.write_row(("options", found))])
    assert wire.varint(len(again)) + again == VECTOR


@pytest.mark.parametrize(("head", "want"), [(b"\x0a\x0a\x0a", False), (b"\x0a\x0a\x00", True), (b"\x0a\x00\x0a", False), (b"\x00\x0a\x0a", True), (b"\x00\x00\x00", True), (b"\x0a\x0a", False), (b"", False)])
def test_delimited(head, want):
    assert wire.is_delimited(head) is want


def test_numbers():
    for n in (0, 1, 127, 128, 300, 2**32 - 1):
        assert wire.read_varint(wire.varint(n), 0) == (n, len(wire.varint(n)))
    with pytest.raises(ConformanceError):
        wire.read_varint(b"\x80", 0)


class Unseekable(io.RawIOBase):
    def __init__(self, data):
        self.inner = io.BytesIO(data)

    def readable(self):
        return True

    def seekable(self):
        return False

    def read(self, n=-1):
        return self.inner.read(n if n < 0 else min(n, 2))


def stream(frames):
    return b"".join(wire.varint(len(f)) + f for f in frames)


def test_frames_from_files_of_both_kinds():
    encoder = Encoder(Options.of("TRIPLES", "FLAT_TRIPLES"), 2)
    frames = [f for i in range(40) for f in encoder.add((("iri", f"http://e/{i}", None, None), ("iri", "http://e/p", None, None), ("literal", "x" * i, None, None), None))]
    frames += encoder.finish()
    for given in (frames, [b"", *frames]):
        assert list(wire.read_frames(Unseekable(stream(given)))) == given == list(wire.split_frames(stream(given)))
    assert list(wire.split_frames(frames[0])) == [frames[0]] == list(wire.read_frames(io.BytesIO(frames[0])))
    with pytest.raises(ConformanceError):
        list(wire.split_frames(stream(frames)[:-1]))
    with pytest.raises(ConformanceError):
        list(wire.split_frames(b""))


def test_metadata():
    body = wire.write_frame([wire.write_row(("name", 0, "n"))], {"b": b"\x01", "a": b""})
    assert wire.read_frame(body) == ([("name", 0, "n")], {"a": b"", "b": b"\x01"})


def test_unknown_rows():
    with pytest.raises(TypeError):
        wire.read_row(b"")
    with pytest.raises(ConformanceError):
        next(iter(wire.fields(b"\x0b")))
    with pytest.raises(ConformanceError):
        Decoder().row(("name", 0, "x"))
