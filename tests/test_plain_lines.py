"""Plainly written lines are read at once, to the terms that the tokens give."""

import random

from quadrille.functions import terms
from quadrille.schema import XSD_STRING


def test_plain_lines_need_no_tokens():
    r, plain = random.Random(5), 0
    parts = ["<a>", "<>", "<b:c#d>", "<e\\u00e9>", "_:n", '"x"', '""', '"a \\"b\\" \\n"', '"> <"@en', '"1"^^<t>', f'"s"^^<{XSD_STRING}>', '"e"^^<>', "<< <a> <b> <c> >>", "# no", ".", ""]
    for _ in range(20000):
        line = r.choice([" ", " ", "  "]).join(r.choice(parts) for _ in range(r.choice([3, 3, 4, 5]))) + r.choice([" .", " .", ".", " . # end", ""])
        seen = []
        for read in (terms.parse_terms, terms._parsed_terms):
            try:
                seen.append(read(line))
            except ValueError as error:
                seen.append(str(error))
        assert seen[0] == seen[1], line
        plain += terms._PLAIN.fullmatch(line) is not None
    assert plain > 50
