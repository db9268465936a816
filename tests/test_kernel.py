import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions.terms import parse_quoted, parse_terms, text_of
from quadrille.options import PRESETS, ConformanceError, Options, check_strict, code, compatible, framing_for, PHYSICAL
from quadrille.schema import XSD
from quadrille.sources import wire
from quadrille.sources.kernel import Decoder, Dictionary, Encoder


def iri(x):
    return "iri", x, None, None


def lit(x, lang=None, datatype=None):
    return "literal", x, lang, datatype


DEFAULT = ("default", None, None, None)


def round_trip(statements, options, frame_size=250, framing=None):
    encoder = Encoder(options, frame_size, framing)
    frames = [f for s in statements for f in encoder.add(s)]
    frames += encoder.finish()
    decoder = Decoder()
    return [e[1:] for f in frames for _, e in decoder.frame(f)], frames


def test_dictionary_reuses_the_oldest():
    d = Dictionary(3, "name")
    assert [d.find(v, set()) for v in "abc"] == [(1, 0), (2, 0), (3, 0)]
    assert d.find("a", set()) == (1, None)
    assert d.find("d", set()) == (2, 2) and d.find("e", set()) == (3, 0) and d.find("b", set()) == (1, 1)
    with pytest.raises(ConformanceError):
        Dictionary(0, "prefix").find("x", set())


@given(st.integers(1, 12), st.lists(st.integers(0, 30), max_size=200))
@settings(max_examples=50, deadline=None)
def test_dictionary_keeps_its_size(size, values):
    d, mirror = Dictionary(size, "name"), {}
    last = 0
    for v in values:
        index, coded = d.find(str(v), set())
        if coded is not None:
            last = coded or last + 1
            mirror[last] = str(v)
        assert mirror[index] == str(v) and 1 <= index <= size and len(d.ids) <= size


def terms(rng, star=True):
    kind = rng.randrange(6 if star else 5)
    if kind < 2:
        return iri(rng.choice(["http://a/", "http://b#", "http://c/d/", "", "urn:"]) + str(rng.randrange(12)))
    if kind == 2:
        return "bnode", f"b{rng.randrange(5)}", None, None
    if kind == 3:
        return lit(rng.choice(["", "é\n\"\\", "1"]), rng.choice([None, "en"]))
    if kind == 4:
        return lit(str(rng.randrange(3)), None, XSD + rng.choice(["int", "date", "float"]))
    inner = [terms(rng, False) for _ in range(3)]
    return "triple", "<< " + " ".join(map(text_of, inner)) + " >>", None, None


@pytest.mark.parametrize("physical", ["TRIPLES", "QUADS", "GRAPHS"])
@pytest.mark.parametrize("preset", ["default", "small", "no_prefix", "tiny"])
@pytest.mark.parametrize("frame_size", [1, 4, 200, 10_000])
def test_round_trips(physical, preset, frame_size):
    rng = random.Random(f"{physical}{preset}{frame_size}")
    star = preset != "tiny"
    graphs = [None] if physical == "TRIPLES" else [DEFAULT, iri("http://g/1"), ("bnode", "g", None, None), lit("g")]
    given = []
    for _ in range(300):
        s, p, o = (terms(rng, star) for _ in range(3))
        if given and rng.random() < 0.5:
            s = given[-1][0]
        given.append((s, p, o, rng.choice(graphs) if rng.random() < 0.3 or not given else given[-1][3]))
    got, frames = round_trip(given, Options.of(physical, "FLAT_TRIPLES" if physical == "TRIPLES" else "FLAT_QUADS", preset), frame_size)
    assert got == given
    for f in frames[:-1]:
        assert len(wire.read_frame(f)[0]) >= min(frame_size, 10_000)


def test_small_tables_are_refused_only_where_they_lose():
    options = Options.of("TRIPLES", names=8, prefixes=1)
    ok = [(iri("http://a/x"), iri("http://a/y"), iri("http://a/z"), None), (iri("http://b/x"), iri("http://b/y"), iri("http://b/z"), None)]
    assert round_trip(ok, options)[0] == ok
    with pytest.raises(ConformanceError, match="too small"):
        round_trip([(iri("http://a/x"), iri("http://b/y"), lit("z"), None)], options)


def test_string_datatype_and_language():
    given = [(iri("s"), iri("p"), lit("x", None, XSD + "string"), None), (iri("s"), iri("p"), lit("y", "en", XSD + "int"), None)]
    assert [r[2] for r in round_trip(given, Options.of("TRIPLES"))[0]] == [lit("x"), lit("y", "en")]
    with pytest.raises(ConformanceError):
        round_trip([(iri("s"), iri("p"), lit("1", None, XSD + "int"), None)], Options.of("TRIPLES", datatypes=0))


def test_framing_by_group():
    encoder = Encoder(Options.of("GRAPHS", "NAMED_GRAPHS"))
    frames = list(encoder.add((iri("s"), iri("p"), iri("o"), iri("g"))))
    frames += encoder.end_group()
    frames += encoder.end_group()  # an empty graph has a frame too
    assert len(frames) == 2 and wire.read_frame(frames[1])[0] == []
    assert [r[0] for r in wire.read_frame(frames[0])[0]][-3:] == ["graph_start", "triple", "graph_end"] or "graph_end" in [r[0] for r in wire.read_frame(frames[0])[0]]


def test_an_empty_stream_has_its_options():
    (frame,) = Encoder(Options.of("QUADS")).finish()
    assert [r[0] for r in wire.read_frame(frame)[0]] == ["options"]


def rows_fail(*rows, physical="TRIPLES", error=ConformanceError, **sizes):
    decoder = Decoder()
    with pytest.raises(error):
        for r in (("options", Options.of(physical, **sizes)), *rows):
            decoder.row(r)


def test_errors_of_decoding():
    b, p = ("bnode", "x"), ("iri", 0, 0)
    rows_fail(("triple", b, None, b), error=ValueError)
    rows_fail(("triple", b, p, b), error=IndexError)
    rows_fail(("name", 5000, "x"), error=IndexError)
    rows_fail(("options", Options.of("QUADS")))
    rows_fail(("triple", b, b, ("literal", "x", None, 0)))
    rows_fail(("triple", b, b, b), physical="GRAPHS")
    rows_fail(("graph_start", None), physical="GRAPHS")
    rows_fail(("triple", ("triple", (b, None, b)), b, b), error=ValueError)


def test_prefix_zero_is_none_at_first():
    decoder = Decoder()
    decoder.row(("options", Options.of("TRIPLES")))
    decoder.row(("name", 0, "whole"))
    assert decoder.row(("triple", ("iri", 0, 0), ("bnode", "b"), ("literal", "x", None, None)))[1] == iri("whole")


def test_options():
    with pytest.raises(ConformanceError):
        Options.of("TRIPLES", names=7)
    with pytest.raises(ConformanceError):
        Options.of("TRIPLES", names=5000)
    with pytest.raises(ConformanceError):
        Options.of("TRIPLES", "FLAT_QUADS")
    with pytest.raises(ConformanceError):
        Options.of("TRIPLES", version=3)
    with pytest.raises(NotImplementedError):
        code(PHYSICAL, "NONSENSE")
    with pytest.raises(NotImplementedError):
        framing_for(0)
    assert compatible(0, 2) and compatible(3, 114) and not compatible(1, 14)
    assert Options.of("QUADS", namespaces=True).version == 2 and PRESETS["small"] == (128, 32, 32)
    check_strict(1, "flat")
    for logical, mode in ((3, "flat"), (0, "grouped"), (2, "grouped")):
        with pytest.raises(ConformanceError):
            check_strict(logical, mode)


def test_namespaces_need_version_2():
    with pytest.raises(ConformanceError):
        Encoder(Options.of("TRIPLES")).namespace("ex", "http://e/")


def test_statement_kinds_are_enforced_on_write():
    strict = Options.of("QUADS", generalized=False, star=False)
    for s, p, g in ((lit("x"), iri("p"), DEFAULT), (iri("s"), ("bnode", "b", None, None), DEFAULT), (iri("s"), iri("p"), lit("g"))):
        with pytest.raises(ConformanceError):
            round_trip([(s, p, lit("o"), g)], strict)
    with pytest.raises(ConformanceError):
        round_trip([(("triple", '<< <a> <b> "c" >>', None, None), iri("p"), lit("o"), DEFAULT)], strict)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('<a> <b> "c" .', [iri("a"), iri("b"), lit("c")]),
        ('_:x <b> "c"@en-GB <g>.', [("bnode", "x", None, None), iri("b"), lit("c", "en-GB"), iri("g")]),
        (r'<a> <b> "é\n\"\\" . # note', [iri("a"), iri("b"), lit('é\n"\\')]),
        ('<a>\t<b>\t"1"^^<http://t>.', [iri("a"), iri("b"), lit("1", None, "http://t")]),
        ('<< <a> <b> _:c >> <p> "x" .', [("triple", "<< <a> <b> _:c >>", None, None), iri("p"), lit("x")]),
        ("  # only a note", []),
        ("", []),
        ("<a> <b> _:c.", [iri("a"), iri("b"), ("bnode", "c", None, None)]),
    ],
)
def test_lines(line, want):
    assert parse_terms(line) == want


def test_quoted_text_reads_back():
    inner = (iri("a"), iri("b"), lit('x "y" \\ \n', "en"))
    nested = ("triple", "<< " + " ".join(map(text_of, inner)) + " >>", None, None)
    outer = (nested, iri("p"), nested)
    assert parse_quoted("<< " + " ".join(map(text_of, outer)) + " >>") == outer and parse_quoted(nested[1]) == inner
    for bad in ("<a> <b>", "<< <a> <b> >> <c> <d> .", "nonsense ."):
        with pytest.raises(ValueError):
            parse_terms(bad)
