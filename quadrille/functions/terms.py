"""Terms: columns that build and show them, and the Python side of their N-Triples text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.schema import XSD_STRING


def _term(kind: str, value: Column, lang: Column | None = None, datatype: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (none if lang is None else lang).alias("lang"), (none if datatype is None else datatype).alias("datatype"))


def iri(value: Column) -> Column:
    return _term("iri", value)


def bnode(value: Column) -> Column:
    return _term("bnode", value)


def literal(value: Column, lang: Column | None = None, datatype: Column | None = None) -> Column:
    """xsd:string is the same as no datatype, and a language tag rules out a datatype."""
    kept = None if datatype is None else F.when(datatype != XSD_STRING, datatype)
    if lang is not None and kept is not None:
        kept = F.when(lang.isNull(), kept)
    return _term("literal", value, lang, kept)


def default_graph() -> Column:
    return _term("default", F.lit(None).cast("string"))


def quoted(s: Column, p: Column, o: Column) -> Column:
    return _term("triple", F.concat_ws(" ", F.lit("<<"), n3(s, True), n3(p, True), n3(o, True), F.lit(">>")))


def n3(term: Column, escape: bool = False) -> Column:
    """Text of a term; a language tag wins over a datatype. Without escape, literals stand as they are."""
    lex = term["value"]
    if escape:
        for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            lex = F.replace(lex, F.lit(plain), F.lit(coded))
    text = F.concat(F.lit('"'), lex, F.lit('"'))
    shown = F.when(term["lang"].isNotNull(), F.concat(text, F.lit("@"), term["lang"])).when(term["datatype"].isNotNull(), F.concat(text, F.lit("^^<"), term["datatype"], F.lit(">"))).otherwise(text)
    kind = term["kind"]
    return F.when(kind == "iri", F.concat(F.lit("<"), term["value"], F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), term["value"])).when(kind == "literal", shown).when(kind == "triple", term["value"]).when(kind == "default", F.lit(""))


def debug_text(term: Column) -> Column:
    """Text for logs that names the kind and all parts; absent parts show as None."""

    def shown(part: str) -> Column:
        return F.coalesce(F.concat(F.lit("'"), term[part], F.lit("'")), F.lit("None"))

    kind, value = term["kind"], term["value"]
    literal_text = F.concat(F.lit("Literal("), shown("value"), F.lit(", langtag="), shown("lang"), F.lit(", datatype="), shown("datatype"), F.lit(")"))
    named = F.when(kind == "iri", F.concat(F.lit("IRI("), value, F.lit(")"))).when(kind == "bnode", F.concat(F.lit("BlankNode(identifier="), value, F.lit(")")))
    return named.when(kind == "literal", literal_text).when(kind == "triple", F.concat(F.lit("Triple("), value, F.lit(")"))).when(kind == "default", F.lit("DefaultGraph()"))


def equal(a: Column, b: Column) -> Column:
    """Same kind, value, language and datatype."""
    return a.eqNullSafe(b)


def split_iri(value: Column) -> tuple[Column, Column]:
    """(prefix, name): the name follows the last #, else the last /, else is all."""
    name = F.when(F.instr(value, "#") > 0, F.substring_index(value, "#", -1)).otherwise(F.substring_index(value, "/", -1))
    return F.left(value, F.length(value) - F.length(name)), name


# ------------------------------------------------------------------ Python side

_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_TOKEN = re.compile(r"""\s*(?:(<<)|(>>)|<([^>]*)>|_:([^\s<>"]+?)(?=\.?(?:\s|$|>>))|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?|(\.)|(\#.*))""", re.S)

#: A statement of IRIs and at most one literal, spaced as `lines` writes it.
_PLAIN = re.compile(r'''<([^<>"\\]*)> <([^<>"\\]*)> (?:<([^<>"\\]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>"\\]*)>)?) (?:<([^<>"\\]*)> )?\.''', re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text) if "\\" in text else text


def text_of(term: tuple) -> str:
    """N-Triples text of (kind, value, lang, datatype), escaped."""
    kind, value, lang, datatype = term
    if kind == "iri":
        return f"<{value}>"
    if kind == "bnode":
        return f"_:{value}"
    if kind == "literal":
        text = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
        return text + (f"@{lang}" if lang is not None else f"^^<{datatype}>" if datatype is not None else "")
    return value if kind == "triple" else ""


def parse_terms(line: str) -> list[tuple]:
    """Terms of a line up to its dot; a quoted triple is one term, with canonical text."""
    if plain := _PLAIN.fullmatch(line):
        s, p, o, lex, lang, datatype, g = plain.groups()
        last = ("literal", unescape(lex), lang, datatype if datatype != XSD_STRING else None) if o is None else ("iri", o, None, None)
        terms = [("iri", s, None, None), ("iri", p, None, None), last]
        return terms if g is None else [*terms, ("iri", g, None, None)]
    return _parsed_terms(line)


def _parsed_terms(line: str) -> list[tuple]:
    """parse_terms of any line."""
    at, stack, done = 0, [[]], False
    while at < len(line) and line[at:].strip():
        m = _TOKEN.match(line, at)
        if m is None:
            raise ValueError(f"cannot read {line[at : at + 40]!r}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            inner = stack.pop()
            if len(inner) != 3 or not stack:
                raise ValueError("a quoted triple needs three terms")
            stack[-1].append(("triple", "<< " + " ".join(map(text_of, inner)) + " >>", None, None))
        elif m[3] is not None:
            stack[-1].append(("iri", unescape(m[3]), None, None))
        elif m[4] is not None:
            stack[-1].append(("bnode", m[4], None, None))
        elif m[5] is not None:
            datatype = m[7] if m[7] != XSD_STRING else None
            stack[-1].append(("literal", unescape(m[5]), m[6], datatype and unescape(datatype)))
        elif m[8]:
            done = True
        if done or m[9]:
            break
    if len(stack) != 1 or (stack[0] and not done):
        raise ValueError(f"unfinished statement {line!r}")
    return stack[0]


def parse_quoted(text: str) -> tuple[tuple, tuple, tuple]:
    """The three terms of a quoted triple's text."""
    s, p, o = parse_terms(text.strip()[2:-2] + " .")
    return s, p, o
