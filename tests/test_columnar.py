"""Whole batches give the kernel's bytes, events and state."""

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from quadrille.operators import codec
from quadrille.options import Options
from quadrille.schema import STATEMENT, XSD, XSD_STRING
from quadrille.sources import columnar
from quadrille.sources.kernel import Encoder

_SHAPE = to_arrow_schema(STATEMENT)
ROUTES = [("TRIPLES", None, None), ("QUADS", None, None), ("GRAPHS", None, None), ("GRAPHS", "graph", "frame_idx"), ("QUADS", "dataset", "frame_idx"), ("TRIPLES", "graph", "frame_idx"), ("GRAPHS", None, "frame_idx"), ("GRAPHS", "graph", "g")]


def made(n: int, seed: int, graph: bool) -> list[tuple]:
    r, out = random.Random(seed), []
    for i in range(n):
        s = r.choice([("iri", f"http://e.org/{r.randrange(3)}/x{i // 5}", None, None), ("bnode", f"b{i // 3}", None, None), ("iri", "plain", None, None)])
        p = ("iri", f"http://e.org/p#{'é' * r.randrange(2)}{r.randrange(6)}", None, None)
        o = r.choice([("iri", f"http://e.org/o/x{r.randrange(60)}", None, None), ("literal", "t" * r.choice([0, 1, 5, 127, 128, 300]), None, None), ("literal", "ü", "de", None), ("literal", str(r.randrange(4)), None, XSD + r.choice(["integer", "decimal"])), ("literal", "x", None, XSD_STRING), ("bnode", "", None, None)])
        g = r.choice([("default", None, None, None), ("iri", f"http://e.org/g/{i // 4 % 3}", None, None)]) if graph else None
        out.append((f"s{seed}-{i // 700}", i // 90, i, s, p, o, g))
    return out


def plain(rows, options, size, framing, group):
    out, encoder, stream, member = [], None, None, None
    at = _SHAPE.names.index(group) if group else 0

    def close():
        return [*(encoder.end_group() if encoder.framing in ("graph", "dataset") else ()), *encoder.finish()]

    for row in rows:
        if row[0] != stream:
            out += [(stream, f) for f in close()] if encoder else []
            stream, encoder = row[0], Encoder(options, size, framing)
        elif group and row[at] != member:
            out += [(stream, f) for f in encoder.end_group()]
        member = row[at]
        out += [(stream, f) for f in encoder.add(row[3:])]
    return out + [(stream, f) for f in close()]


def batches(rows, size):
    for i in range(0, len(rows), size):
        columns = list(zip(*rows[i : i + size], strict=True))
        yield pa.RecordBatch.from_arrays([codec._structs(c, f.type) if pa.types.is_struct(f.type) else pa.array(c, f.type) for c, f in zip(columns, _SHAPE, strict=True)], schema=_SHAPE)


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("preset", ["default", "small", "tiny"])
def test_encoded_bytes_are_the_kernels(monkeypatch, route, preset):
    physical, framing, group = route
    rows, options = made(2500, len(preset), physical != "TRIPLES"), Options.of(physical, 0, preset)
    used = []
    whole = columnar.encode
    monkeypatch.setattr(columnar, "encode", lambda *a: used.append(whole(*a)) or used[-1])
    got = [(s, f) for s, fs in codec.encoded(batches(rows, 333), options, 25, framing, group) for f in fs]
    want = plain(rows, options, 25, framing, group)
    assert [(s, bytes(f), f.n_rows, f.n_statements) for s, f in got] == [(s, bytes(f), f.n_rows, f.n_statements) for s, f in want]
    assert sum(u is not None for u in used) > 5


def events(frames, **options):
    return [tuple(r.values()) for b in codec.events_of("s", iter(frames), **options) for r in b.to_pylist()]


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("preset", ["default", "small", "tiny"])
@pytest.mark.parametrize("options", [{}, {"as_quads": True}, {"only": {("p", "kind"): "iri", ("p", "value"): "http://e.org/p#2"}}])
def test_decoded_events_are_the_kernels(monkeypatch, route, preset, options):
    physical, framing, group = route
    rows = [("s", *r[1:]) for r in made(2500, 7, physical != "TRIPLES")]
    frames = [bytes(f) for _, f in plain(rows, Options.of(physical, 0, preset), 25, framing, group)]
    monkeypatch.setattr(codec, "CHUNK", 5000)
    used = []
    whole = columnar.decode
    monkeypatch.setattr(columnar, "decode", lambda *a: used.append(whole(*a)) or used[-1])
    got = events(frames, **options)
    assert sum(u is not None for u in used) > 5
    monkeypatch.setattr(columnar, "decode", lambda *a: None)
    assert got == events(frames, **options) and got


def test_damaged_frames_fail_as_in_the_kernel(monkeypatch):
    rows = [("s", *r[1:]) for r in made(300, 3, True)]
    frames = [bytes(f) for _, f in plain(rows, Options.of("GRAPHS", 0, "small"), 25, None, None)]
    r = random.Random(1)
    for _ in range(300):
        bad = list(frames)
        k = r.randrange(1, len(bad))
        at = r.randrange(len(bad[k]))
        bad[k] = bad[k][:at] + bytes([r.randrange(256)]) + bad[k][at + 1 :]
        seen = []
        for decode in (columnar.decode, lambda *a: None):
            with monkeypatch.context() as m:
                m.setattr(columnar, "decode", decode)
                try:
                    seen.append(events(bad))
                except Exception as error:
                    seen.append((type(error), str(error)))
        assert seen[0] == seen[1]
