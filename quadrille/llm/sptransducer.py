"""Token counts of a BPE SentencePiece model by a compiled finite-state transducer.

A text splits before each run of space symbols that follows another character: no piece reaches across, so there the
transducer is in its start state whatever came before. Between such places the state after a prefix is what the rest of
the text can still change: the longest suffix of the prefix that begins some piece, and for each place in that suffix
the last piece of the segmentation up to there and the tokens since. A piece follows another exactly if segmenting the
two alone gives the two back, so the last piece after one more character is the only one of the character's suffixes
that may follow the last piece before it. Every transition carries the change in the number of tokens (negative when
tokens merge).
States and transitions are made when first met and kept; the table is emptied when it reaches MOST_STATES.

Every text is cut into chunks of CHUNK characters, wherever that falls. A chunk's state map takes the state that the
transducer comes in to the state that it leaves in and the tokens between. A map is exact for every state and knows some
already: a start state inside a chunk forgets what came before, so all states share the map from there on, and for the
part before it the map begins with the state that the last characters of the chunk before lead to, and learns others when
it is asked. Maps compose associatively, and an inclusive prefix scan of them gives the count at every chunk's end.

Defined results: null and empty texts have no tokens; characters without a piece count as their UTF-8 bytes; rows
repeat as they are given; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_worker, kept, ship_package, slices, table, tokenizer_path
from .spmodel import NORMAL, SPACE, UNUSED, USER_DEFINED, Model

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 12
MOST_STATES = 200_000
#: Characters before a chunk whose end state its map begins with.
RUN_IN = 32
_RESET = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


#: The key of the start state: nothing live, no piece yet, no token since.
START = ("", (("", 0),))


class Transducer:
    def __init__(self, model: Model):
        if not model.identity:
            raise ValueError("the transducer reads normalised text; this model's normaliser changes characters")
        kept = (NORMAL, USER_DEFINED, UNUSED)
        self.scores = {p: s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t in kept}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece reaches across a space symbol")
        self.byte_fallback = model.byte_fallback
        self.prefixes = {p[:i] for p in self.scores for i in range(len(p))}
        self.longest = max(map(len, self.scores), default=1)
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Words that each follow one space symbol, from the start state: one move with its tokens.
        self.memo = Memo(lambda word: self.run(SPACE + word)[1])
        self._reset()

    def _reset(self) -> None:
        self.keys = [START]
        self.numbers = {START: 0}
        #: For each state: character to (next state, change of the count).
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _add(self, key: tuple) -> int:
        number = self.numbers[key] = len(self.keys)
        self.keys.append(key)
        self.moves.append({})
        return number

    def segment(self, text: str) -> list[str]:
        """Plain BPE: the best-scored, then leftmost, neighbouring pair merges until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: str, piece: str) -> bool:
        if not before:
            if piece not in self.whole:
                self.whole[piece] = self.segment(piece) == [piece]
            return self.whole[piece]
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= 4 * MOST_STATES:
                self.pairs.clear()
            known = self.pairs[before, piece] = self.segment(before + piece) == [before, piece]
        return known

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The move on one character. A state's key: the live suffix, and for each place in it from its start to its
        end (last piece up to there, tokens from there to the end)."""
        live, places = self.keys[state]
        text = live + char
        for size in range(min(len(text), self.longest), 0, -1):
            piece = text[-size:]
            if piece not in self.scores and size > 1:
                continue
            before, since = places[len(live) + 1 - size]
            if self.follows(before, piece):
                weight = 1 if piece in self.scores or not self.byte_fallback else len(piece.encode("utf-8", "replace"))
                break
        else:
            raise AssertionError(f"no segmentation ends in {char!r}")
        delta = weight - since
        cut = next(i for i in range(len(text) + 1) if text[i:] in self.prefixes or i == len(text))
        # places before the new end now have delta more tokens after them
        kept = tuple((b, n + delta) for b, n in places[cut:]) + ((piece, 0),)
        key = (text[cut:], kept[-(len(text) - cut + 1) :])
        number = self.numbers.get(key)
        if number is None:
            number = self._add(key)
        move = self.moves[state][char] = (number, delta)
        return move

    def run(self, text: str, key: tuple = START) -> tuple[tuple, int]:
        """The state after some characters from the state of a key, and the tokens between."""
        if len(self.keys) > MOST_STATES:
            self._reset()
        state = self.numbers.get(key)
        if state is None:
            state = self._add(key)
        count = 0
        moves = self.moves
        for char in text:
            move = moves[state].get(char) or self._compile(state, char)
            state = move[0]
            count += move[1]
        return self.keys[state], count

    def plain(self, text: str) -> int:
        """Tokens of text from the start state to a start state; whole words are single moves."""
        memo = self.memo
        parts = text.split(SPACE)
        if parts[0] == "" and "" not in parts[1:]:
            return sum([memo[p] for p in parts[1:]])
        return sum([self.run(p)[1] for p in _RESET.split(text)])

    def scan(self, maps: list[StateMap | Composed]) -> list[StateMap | Composed]:
        """Inclusive prefix scan by doubling."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else Composed(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of the text up to the end of each chunk."""
        if not text:
            return []
        shown = SPACE + text.replace(" ", SPACE)
        maps = [StateMap(self, shown, at, min(at + CHUNK, len(shown))) for at in range(0, len(shown), CHUNK)]
        return [m.after(START)[1] for m in self.scan(maps)]

    def count(self, text: str) -> int:
        return self.prefix_counts(text)[-1] if text else 0


class StateMap:
    """State in to (state out, tokens between) over text[begin:end]."""

    def __init__(self, transducer: Transducer, text: str, begin: int, end: int):
        self.transducer = transducer
        # a start state lies where a space follows another character; the chunk's first character belongs to the head
        first = 0 if begin == 0 else next((m.start() for m in _RESET.finditer(text, begin, end)), -1)
        self.head = text[begin:first] if first >= 0 else text[begin:end]
        self.rest: tuple[tuple, int] | None = None
        if first >= 0:
            last = text.rfind(SPACE, first, end)
            while last > first and text[last - 1] == SPACE:
                last -= 1
            out, tail = transducer.run(text[last:end])
            self.rest = out, (transducer.plain(text[first:last]) if last > first else 0) + tail
        self.known: dict[tuple, tuple[tuple, int]] = {}
        if begin:
            self.after(transducer.run(text[max(0, begin - RUN_IN) : begin])[0])

    def after(self, state: tuple) -> tuple[tuple, int]:
        found = self.known.get(state)
        if found is None:
            out, count = self.transducer.run(self.head, state) if self.head else (state, 0)
            found = self.known[state] = (out, count) if self.rest is None else (self.rest[0], count + self.rest[1])
        return found


class Composed:
    """The map of one stretch after another's."""

    def __init__(self, first: StateMap | Composed, then: StateMap | Composed):
        self.first, self.then = first, then
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def after(self, state: tuple) -> tuple[tuple, int]:
        found = self.known.get(state)
        if found is None:
            middle, a = self.first.after(state)
            out, b = self.then.after(middle)
            found = self.known[state] = out, a + b
        return found


_compiled: dict[str, Transducer] = kept({})


def transducer(name: str) -> Transducer:
    """One transducer a worker process."""
    if name not in _compiled:
        _compiled[name] = Transducer(Model.load(tokenizer_path(name)))
    return _compiled[name]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shown = docs.select(id_col, text.alias("__text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column(1).to_pylist()
                n = list(map(t.count, texts))
                sizes = [len(x.encode("utf-8", "replace")) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = shown.schema[id_col].dataType.simpleString()
    return shown.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
