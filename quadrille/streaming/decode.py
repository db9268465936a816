"""Decoding frames that arrive as a stream: one decoder per stream_id, kept as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadrille.options import ConformanceError
from quadrille.sources.kernel import Decoder

#: Terms as text columns, so that windows and aggregates apply at once.
OUT = "stream_id string, frame_idx long, row_idx long, s string, p string, o_kind string, o_value string, o_lang string, o_datatype string, g_kind string, g_value string"
STATE = "frames long, rows long, decoder binary"


def decode_stream(frames: DataFrame) -> DataFrame:
    """Statements of streaming frames (stream_id, frame_idx, content). Frames of a stream may share a trigger in any order,
    but one that is missing when a later one is there is an error: the state after it is unknown."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            number, base, kept = state.get
            decoder = pickle.loads(bytes(kept))
        else:
            number, base, decoder = 0, 0, Decoder()
        out = []
        for i, content in sorted((int(i), bytes(c)) for b in batches for i, c in zip(b.frame_idx, b.content, strict=True)):
            if i != number:
                raise ConformanceError(f"stream {key[0]} lacks frame {number}")
            number += 1
            for at, event in decoder.frame(content):
                if event[0] == "statement":
                    s, p, o, g = event[1:]
                    out.append((key[0], i, base + at, s[1], p[1], *o, *((None, None) if g is None else g[:2])))
            base += decoder.n_rows
        state.update((number, base, pickle.dumps(decoder)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
