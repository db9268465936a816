"""FLAC media columns: encode integer samples, decode streams, and write PCM blocks with sample offsets.

Follows the public format (RFC 9639). The decoder reads constant, verbatim, fixed and linear-predictor subframes, Rice
residuals of both methods with escape codes, wasted bits and the stereo modes, and verifies the CRC-8 of every frame
header, the CRC-16 of every frame and the MD5 of the samples. The encoder writes one channel with constant, verbatim,
fixed (orders 0 to 2) or linear-predictor subframes, whichever is smallest, and a seek point for every frame.

All frames of a batch are decoded together: step t restores sample t of every frame with one set of array operations, so
the cost a sample is small though Rice codes must be read in order. Frames are found by the seek table; a stream whose table
does not name every frame is decoded frame after frame, its channels and frames in the same routines.

Defined results: null and empty texts become one block of 64 zero bytes; damaged streams raise ValueError naming the
check that failed; rows repeat as they are given; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, ship_package, slices, strings, table

BLOCK = 4096
RATE = 44100
LPC_ORDER = 4
LPC_PRECISION = 10
PARTITION_ORDER = 2
PAD = 64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1 ^ poly if value & top else value << 1) & mask
        out.append(value)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8_LIST[crc ^ b]
    return crc


#: Row d: the CRC-16 that a byte leaves when d bytes of 0 follow it. CRCs are linear, so a message's is the XOR of its bytes'.
_FOLLOWED = [_CRC16]


def _followed(n: int) -> np.ndarray:
    global _SHIFTED
    while len(_FOLLOWED) < n:
        last = _FOLLOWED[-1]
        _FOLLOWED.append((last << 8) ^ _CRC16[last >> 8])
    if len(_SHIFTED) != len(_FOLLOWED):
        _SHIFTED = np.array(_FOLLOWED)
    return _SHIFTED


_SHIFTED = np.zeros((0, 256), np.uint16)


def crc16_many(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each of the slices of data."""
    out = np.zeros(len(starts), np.uint16)
    long = sizes > 1 << 15
    for i in np.flatnonzero(long):  # by blocks: what a block leaves is shifted past the next
        crc, step = 0, 1 << 14
        for at in range(0, int(sizes[i]), step):
            part = data[starts[i] + at : starts[i] + min(at + step, int(sizes[i]))]
            rows = _followed(len(part))
            high, low = (rows[len(part) - 1][crc >> 8], rows[len(part) - 2][crc & 255]) if len(part) > 1 else (0, 0)
            if len(part) == 1:
                crc = int(((crc << 8) & 0xFFFF) ^ int(_CRC16[(crc >> 8) ^ int(part[0])]))
                continue
            crc = int(high) ^ int(low) ^ int(np.bitwise_xor.reduce(rows[np.arange(len(part) - 1, -1, -1), part]))
        out[i] = crc
    short = np.flatnonzero(~long & (sizes > 0))
    if len(short):
        rows = _followed(int(sizes[short].max()))
        n = sizes[short]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        terms = rows[np.repeat(n, n) - 1 - inside, data[np.repeat(starts[short], n) + inside]]
        out[short] = np.bitwise_xor.reduceat(terms, first)
    return out


class Bits:
    """Reads bits of a few bytes (headers)."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends inside a header")
        first, last = self.at >> 3, (end + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - end) & ((1 << n) - 1)
        self.at = end
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value


# ---------------------------------------------------------------- encoding


def _coded_number(n: int) -> bytes:
    """A frame number as UTF-8 codes numbers."""
    if n < 128:
        return bytes([n])
    out = []
    limit = 0x3F
    while n > limit:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(0xFE << (6 - len(out))) & 0xFF | n, *out[::-1]])


def _frame_header(number: int, size: int, depth_code: int) -> bytes:
    code, tail = (12, b"") if size == 4096 else (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4 | 9, depth_code << 1]) + _coded_number(number) + tail
    return head + bytes([crc8(head)])


def _predictors(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Quantised linear predictors of each frame (frames, LPC_ORDER) and their shift, by Levinson and Durbin."""
    total = len(x)
    wide = x.astype(np.float64)
    frame_end = np.repeat(starts + sizes, sizes)
    auto = np.empty((len(starts), LPC_ORDER + 1))
    for lag in range(LPC_ORDER + 1):
        product = np.zeros(total)
        product[: total - lag] = wide[: total - lag] * wide[lag:]
        product[np.arange(total) + lag >= frame_end] = 0
        auto[:, lag] = np.add.reduceat(product, starts)
    error = auto[:, 0] * (1 + 1e-6) + 1e-3
    coefs = np.zeros((len(starts), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - sum((coefs[:, j] * auto[:, i - j] for j in range(i)), np.zeros(len(starts)))) / error
        coefs[:, : i + 1] = np.column_stack([coefs[:, j] - k * coefs[:, i - 1 - j] for j in range(i)] + [k])
        error = np.maximum(error * (1 - k * k), 1e-6)
    shift = LPC_PRECISION - 3  # coefficients of up to 4 in size fit
    top = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(coefs * (1 << shift)), -top, top - 1).astype(np.int32), shift


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def encode_batch(streams: list[np.ndarray], depth: int = 8, rate: int = RATE) -> list[bytes]:
    """Each of the arrays of signed samples (one channel of `depth` bits, 8 or 16, not empty) as a FLAC stream."""
    if not streams:
        return []
    depth_code = {8: 1, 16: 4}[depth]
    frame_stream, frame_number, sizes = [], [], []
    for s, samples in enumerate(streams):
        full, rest = divmod(len(samples), BLOCK)
        parts = [BLOCK] * full + ([rest] if rest else [])
        frame_stream += [s] * len(parts)
        frame_number += range(len(parts))
        sizes += parts
    sizes = np.array(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    x = np.concatenate(streams).astype(np.int32)
    n_frames, total = len(sizes), len(x)
    position = np.arange(total) - np.repeat(starts, sizes)

    # residuals of every candidate; a frame takes the one with the smallest sum of sizes
    before = [x] + [np.concatenate([np.zeros(j, np.int32), x[:-j]]) if j < total else np.zeros(total, np.int32) for j in range(1, LPC_ORDER + 1)]
    candidates = [x, x - before[1], x - 2 * before[1] + before[2]]
    coefs, shift = _predictors(x, starts, sizes)
    guess = np.zeros(total, np.int64)
    for j in range(LPC_ORDER):
        guess += np.repeat(coefs[:, j], sizes) * before[j + 1].astype(np.int64)
    candidates.append((x - (guess >> shift)).astype(np.int32))
    orders = np.array([0, 1, 2, LPC_ORDER])
    cost = np.empty((n_frames, 4))
    for c, residual in enumerate(candidates):
        cost[:, c] = np.add.reduceat(np.where(position >= orders[c], np.abs(residual), 0).astype(np.float64), starts) + 4 * orders[c]
    cost[sizes[:, None] <= np.where(orders == LPC_ORDER, 64, orders)] = np.inf
    kind = cost.argmin(axis=1)
    residual = np.choose(np.repeat(kind, sizes), candidates)
    order = orders[kind]
    valid = position >= np.repeat(order, sizes)

    # partitions, and the Rice parameter of each
    parts_log = np.where((sizes >= 256) & (sizes % (1 << PARTITION_ORDER) == 0), PARTITION_ORDER, 0)
    n_parts = 1 << parts_log
    part_frame = np.repeat(np.arange(n_frames), n_parts)
    part_first = np.cumsum(n_parts) - n_parts
    first_of_frame = np.zeros(len(part_frame), bool)
    first_of_frame[part_first] = True
    part_sizes = (sizes >> parts_log)[part_frame] - np.where(first_of_frame, order[part_frame], 0)
    u = residual[valid].astype(np.int64)
    u = (u << 1) ^ (u >> 63)
    u_starts = np.cumsum(part_sizes) - part_sizes
    mean = np.add.reduceat(u, u_starts) / part_sizes
    guess_k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9))), 0, 13).astype(np.int64)
    best_bits, best_k = None, None
    for k in (guess_k, guess_k + 1):
        bits = np.add.reduceat(u >> np.repeat(k, part_sizes), u_starts) + part_sizes * (1 + k)
        if best_bits is None:
            best_bits, best_k = bits, k
        else:
            best_bits, best_k = np.minimum(bits, best_bits), np.where(bits < best_bits, k, best_k)
    rice_bits = np.add.reduceat(best_bits + 4, part_first)
    head_bits = 8 + order * depth + np.where(kind == 3, 9 + LPC_ORDER * LPC_PRECISION, 0) + 6
    constant = (np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts))
    verbatim = ~constant & (rice_bits + head_bits >= 8 + sizes * depth)
    body_bits = np.where(constant, 8 + depth, np.where(verbatim, 8 + sizes * depth, head_bits + rice_bits))

    # where the frames lie
    headers = [_frame_header(n, int(s), depth_code) for n, s in zip(frame_number, sizes, strict=True)]
    head_sizes = np.array([len(h) for h in headers])
    frame_sizes = head_sizes + (body_bits + 7) // 8 + 2
    frame_starts = np.cumsum(frame_sizes) - frame_sizes
    bits_out = np.zeros(8 * int(frame_sizes.sum()), np.uint8)

    # Rice codes: parameter fields stand before the codes of their partition
    riced = ~constant & ~verbatim
    part_used, u_used = riced[part_frame], np.repeat(riced[part_frame], part_sizes)
    code_k = np.repeat(best_k, part_sizes)
    place = np.arange(len(u)) + np.repeat(np.arange(len(part_frame)) + 1, part_sizes)
    n_fields = len(u) + len(part_frame)
    length, value, width = np.zeros(n_fields, np.int64), np.zeros(n_fields, np.int64), np.zeros(n_fields, np.int64)
    length[place] = np.where(u_used, (u >> code_k) + 1 + code_k, 0)
    value[place] = (1 << code_k) | u & ((1 << code_k) - 1)
    width[place] = np.where(u_used, code_k + 1, 0)
    own = u_starts + np.arange(len(part_frame))
    length[own], value[own], width[own] = np.where(part_used, 4, 0), best_k, np.where(part_used, 4, 0)
    ends = np.cumsum(length)
    frame_field = own[part_first]
    into = np.repeat(8 * (frame_starts + head_sizes) + head_bits - (ends[frame_field] - length[frame_field]), np.diff(np.concatenate([frame_field, [n_fields]])))
    ends += into
    for b in range(int(width.max(initial=0))):
        hit = np.flatnonzero((width > b) & (value >> b & 1 == 1))
        bits_out[ends[hit] - 1 - b] = 1
    out = np.packbits(bits_out)
    del bits_out, length, value, width, ends, into, place

    # headers, subframe heads and verbatim samples, which are whole bytes or short
    mask = (1 << depth) - 1
    for f in range(n_frames):
        at = int(frame_starts[f])
        out[at : at + len(headers[f])] = np.frombuffer(headers[f], np.uint8)
        at += len(headers[f])
        own_x = x[starts[f] : starts[f] + sizes[f]]
        if constant[f]:
            head, n = int(own_x[0]) & mask, 8 + depth
        elif verbatim[f]:
            out[at] = 1 << 1
            out[at + 1 : at + 1 + len(own_x) * depth // 8] = np.frombuffer(own_x.astype(f">i{depth // 8}").tobytes(), np.uint8)
            continue
        else:
            o = int(order[f])
            head, n = 0b001000 | o if kind[f] < 3 else 0b100000 | o - 1, 7
            head, n = head << 1, 8
            for value_ in own_x[:o].tolist():
                head, n = head << depth | value_ & mask, n + depth
            if kind[f] == 3:
                head, n = (head << 4 | LPC_PRECISION - 1) << 5 | shift, n + 9
                for c in coefs[f].tolist():
                    head, n = head << LPC_PRECISION | c & (1 << LPC_PRECISION) - 1, n + LPC_PRECISION
            head, n = head << 6 | int(parts_log[f]), n + 6
        n_bytes = (n + 7) // 8
        out[at : at + n_bytes] |= np.frombuffer((head << (8 * n_bytes - n)).to_bytes(n_bytes, "big"), np.uint8)
    crc = crc16_many(out, frame_starts, frame_sizes - 2)
    out[frame_starts + frame_sizes - 2], out[frame_starts + frame_sizes - 1] = crc >> 8, crc & 255

    done, f = [], 0
    for samples in streams:
        end = f + -(-len(samples) // BLOCK)
        own_sizes, base = frame_sizes[f:end], int(frame_starts[f])
        md5 = hashlib.md5(samples.astype(f"<i{depth // 8}").tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + int(own_sizes.min()).to_bytes(3, "big") + int(own_sizes.max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | depth - 1 << 36 | len(samples)).to_bytes(8, "big") + md5
        seek = np.zeros(end - f, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        seek["sample"], seek["offset"], seek["size"] = np.arange(end - f) * BLOCK, frame_starts[f:end] - base, sizes[f:end]
        points = seek.tobytes()
        stop = int(frame_starts[end - 1] + frame_sizes[end - 1])
        done.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + out[base:stop].tobytes())
        f = end
    return done


# ---------------------------------------------------------------- decoding


@dataclass
class StreamInfo:
    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    #: (first sample, byte from the first frame on, samples) of each seek point
    seek: np.ndarray
    #: Byte at which the frames begin.
    frames_at: int


def read_info(data: bytes) -> StreamInfo:
    """The metadata blocks."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, seek, last = 4, None, np.zeros((0, 3), np.int64), False
    while not last:
        if at + 4 > len(data):
            raise ValueError("the stream ends inside its metadata")
        last, kind, size = bool(data[at] >> 7), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points = np.frombuffer(body[: size // 18 * 18], np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            points = points[points["s"] != 0xFFFFFFFFFFFFFFFF]
            seek = np.column_stack([points["s"].astype(np.int64), points["o"].astype(np.int64), points["n"].astype(np.int64)])
        at += 4 + size
    if info is None:
        raise ValueError("no STREAMINFO")
    return StreamInfo(*info, seek, at)


@dataclass
class FrameHeader:
    first: int  # number of the frame's first sample, or the frame's number where block sizes are fixed
    variable: bool
    size: int
    mode: int
    depth: int
    length: int  # bytes


def read_frame_header(data: bytes, at: int, depth: int) -> FrameHeader:
    head = data[at : at + 16]
    bits = Bits(head)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame begins here")
    variable = bool(bits.take(1))
    size_code, rate_code, mode, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    number = bits.take(8)
    if number >= 0xC0:
        more = 1
        while number >> (6 - more) & 1:
            more += 1
        number &= (1 << (6 - more)) - 1
        for _ in range(more):
            number = number << 6 | bits.take(8) & 0x3F
    if size_code == 6:
        size = bits.take(8) + 1
    elif size_code == 7:
        size = bits.take(16) + 1
    else:
        size = 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
    if rate_code in (12, 13, 14):
        bits.take(8 if rate_code == 12 else 16)
    length = bits.at // 8
    if crc8(head[:length]) != bits.take(8):
        raise ValueError("a frame header's CRC-8 is wrong")
    return FrameHeader(number, variable, size, mode, (depth, 8, 12, depth, 16, 20, 24, 32)[depth_code], length + 1)


def _subframes(buffer: np.ndarray, at: np.ndarray, sizes: np.ndarray, depths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Decode one subframe at each bit position: its samples, and the bit after it. buffer ends in 16 spare bytes."""
    n = len(at)
    out: list[np.ndarray | None] = [None] * n
    after = at.copy()
    raw = buffer.data
    jobs = []  # (frame, first residual's bit, order, coefficients, shift, warm-up, Rice method, partition order, wasted)
    for i in range(n):
        size, depth = int(sizes[i]), int(depths[i])
        first = int(at[i]) >> 3
        bits = Bits(bytes(raw[first : first + 8 + (33 * (depth + 2) + 32 * 16) // 8]), int(at[i]) & 7)
        bits.take(1)
        kind, wasted = bits.take(6), 0
        if bits.take(1):
            wasted = 1
            while not bits.take(1):
                wasted += 1
            depth -= wasted
        if kind == 0:
            out[i] = np.full(size, bits.signed(depth) << wasted, np.int64)
            after[i] = 8 * first + bits.at
        elif kind == 1:
            start = 8 * first + bits.at
            if depth in (8, 16) and start % 8 == 0:
                samples = np.frombuffer(raw[start // 8 : start // 8 + size * depth // 8], f">i{depth // 8}").astype(np.int64)
            else:
                every = np.unpackbits(buffer[start // 8 : (start + size * depth) // 8 + 1])[start % 8 :][: size * depth].reshape(size, depth).astype(np.int64)
                samples = every @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int64))
                samples -= every[:, 0] << depth
            out[i] = samples << wasted
            after[i] = start + size * depth
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = [bits.signed(depth) for _ in range(order)]
            coefs, shift = FIXED[order] if kind < 32 else (), 0
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                coefs = [bits.signed(precision) for _ in range(order)]
            method, parts = bits.take(2), bits.take(4)
            if method > 1:
                raise ValueError("unknown residual coding")
            jobs.append((i, 8 * first + bits.at, order, coefs, shift, warm, method, parts, wasted))
        else:
            raise ValueError("reserved subframe type")
    if jobs:
        _residuals(buffer, jobs, sizes, out, after)
    return out, after


#: Zeros before the first one in a 16-bit number.
_LEADING = np.array([16, *(15 - int(x).bit_length() + 1 for x in range(1, 1 << 16))], np.int64)


def _residuals(buffer: np.ndarray, jobs: list[tuple], sizes: np.ndarray, out: list, after: np.ndarray) -> None:
    """Rice codes and prediction of all jobs, sample by sample and all jobs at once, longest first."""
    jobs = sorted(jobs, key=lambda j: -sizes[j[0]])
    n, most, widest = len(jobs), int(sizes[jobs[0][0]]), max(j[2] for j in jobs)
    size = np.array([sizes[j[0]] for j in jobs])
    at, order = np.array([j[1] for j in jobs], np.int64), np.array([j[2] for j in jobs])
    shift, method, parts = np.array([j[4] for j in jobs], np.int64), np.array([j[6] for j in jobs]), np.array([j[7] for j in jobs])
    coefs, samples = np.zeros((widest, n), np.int64), np.zeros((most, n), np.int64)
    for c, j in enumerate(jobs):
        coefs[: j[2], c] = j[3]
        samples[: j[2], c] = j[5]
    words = np.ndarray(len(buffer) - 8, ">u8", buffer, strides=(1,))
    each = size >> parts
    rice, escape, left = np.zeros(n, np.uint64), np.zeros(n, np.int64), each - order
    fresh = np.ones(n, bool)
    any_escape = False
    one, full = np.uint64(1), np.uint64(64)

    def look(bit: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, at the top."""
        return words[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)

    def begin(which: np.ndarray) -> None:
        """Read the parameter of the partition that begins in each of these jobs; empty ones follow at once."""
        nonlocal any_escape
        while len(which):
            width = np.where(method[which] == 0, 4, 5)
            k = (look(at[which]) >> (64 - width).astype(np.uint64)).astype(np.int64)
            at[which] += width
            raw = k == (1 << width) - 1
            escape[which] = -1
            if raw.any():
                any_escape = True
                odd = which[raw]
                escape[odd] = (look(at[odd]) >> np.uint64(59)).astype(np.int64)
                at[odd] += 5
            rice[which] = np.where(raw, 0, k).astype(np.uint64)
            which = which[left[which] == 0]
            left[which] = each[which]

    step_sizes = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # jobs with at least t samples
    limit = 8 * (len(buffer) - 16)
    for t in range(most):
        m = int(step_sizes[t])
        if t < widest:
            use = np.flatnonzero(order[:m] <= t)
            if not len(use):
                continue
            starting = use[fresh[use]]
            if len(starting):
                fresh[starting] = False
                begin(starting)
            p, k = at[use], rice[use]
        else:
            if t == widest and fresh[:m].any():
                starting = np.flatnonzero(fresh[:m])
                fresh[starting] = False
                begin(starting)
            use = slice(0, m)
            p, k = at[:m], rice[:m]
        window = look(p)
        zeros = _LEADING[(window >> np.uint64(48)).astype(np.int64)]
        if zeros.max(initial=0) == 16:
            p, zeros = p.copy(), zeros.copy()
            total = zeros.copy()
            more = np.flatnonzero(zeros == 16)
            if any_escape:
                more = more[escape[use][more] < 0]
            while len(more):
                p[more] += 16
                if p[more].max() >= limit:
                    raise ValueError("the stream ends inside a residual")
                window[more] = look(p[more])
                zeros[more] = _LEADING[(window[more] >> np.uint64(48)).astype(np.int64)]
                total[more] += zeros[more]
                more = more[zeros[more] == 16]
        else:
            total = zeros
        shown = window << (zeros.astype(np.uint64) + one)
        low = np.where(k > 0, shown >> np.minimum(full - k, np.uint64(63)), np.uint64(0)).astype(np.int64)
        u = total << k.astype(np.int64) | low
        value = (u >> 1) ^ -(u & 1)
        ahead = p + zeros + 1 + k.astype(np.int64)
        if any_escape:
            raw = escape[use] >= 0
            if raw.any():
                bit, width = at[use][raw], escape[use][raw]
                read = (look(bit) >> np.minimum(64 - width, 63).astype(np.uint64)).astype(np.int64)
                read = np.where(width > 0, read - np.where(read >> np.maximum(width - 1, 0) & 1 == 1, 1 << width, 0), 0)
                value[raw], ahead[raw] = read, bit + width
        guess = 0
        top = min(widest, t)
        for j in range(top):
            guess = guess + coefs[j, use] * samples[t - 1 - j, use]
        samples[t, use] = value + (guess >> shift[use] if top else 0)
        at[use] = ahead
        left[use] -= 1
        ending = np.flatnonzero(left[use] == 0)
        if len(ending):
            which = (use if isinstance(use, np.ndarray) else np.arange(m))[ending]
            which = which[size[which] > t + 1]
            left[which] = each[which]
            begin(which)
    for c, j in enumerate(jobs):
        # a partition that holds only the warm-up still has a parameter
        if fresh[c]:
            begin(np.array([c]))
        out[j[0]] = samples[: size[c], c] << j[8]
        after[j[0]] = at[c]


def _frames(buffer: np.ndarray, ats: list[int], depths: list[int], channels: list[int]) -> list[tuple[FrameHeader, np.ndarray, int]]:
    """Header, samples (channels, size) and the byte after, of the frames that begin at these bytes."""
    raw = buffer.data
    heads = [read_frame_header(bytes(raw[a : a + 16]), 0, d) for a, d in zip(ats, depths, strict=True)]
    at = np.array([8 * (a + h.length) for a, h in zip(ats, heads, strict=True)], np.int64)
    sizes = np.array([h.size for h in heads])
    modes = np.array([h.mode for h in heads])
    counts = np.where(modes < 8, modes + 1, 2)
    got: list[list[np.ndarray]] = [[] for _ in heads]
    for channel in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > channel)
        side = (channel == 1) & ((modes[own] == 8) | (modes[own] == 10)) | (channel == 0) & (modes[own] == 9)
        samples, at[own] = _subframes(buffer, at[own], sizes[own], np.array([heads[i].depth for i in own]) + side)
        for i, s in zip(own, samples, strict=True):
            got[i].append(s)
    ends = (at + 7) // 8
    starts = np.array(ats, np.int64)
    if len(ends) and int(ends.max()) + 2 > len(buffer) - 16:
        raise ValueError("the stream ends inside a frame")
    crc = crc16_many(buffer, starts, ends - starts)
    told = buffer[ends].astype(np.uint16) << 8 | buffer[ends + 1]
    if (crc != told).any():
        raise ValueError("a frame's CRC-16 is wrong")
    done = []
    for i, h in enumerate(heads):
        s = got[i]
        if h.mode == 8:
            s = [s[0], s[0] - s[1]]
        elif h.mode == 9:
            s = [s[0] + s[1], s[1]]
        elif h.mode == 10:
            middle = s[0] << 1 | s[1] & 1
            s = [(middle + s[1]) >> 1, (middle - s[1]) >> 1]
        done.append((h, np.array(s), int(ends[i]) + 2))
    return done


@dataclass
class Decoded:
    info: StreamInfo
    #: (first sample, byte of its frame in the stream, samples as (channels, n)) of each block, in order
    blocks: list[tuple[int, int, np.ndarray]]

    def pcm(self) -> bytes:
        width = (self.info.depth + 7) // 8
        return b"".join(pcm_bytes(s, width) for _, _, s in self.blocks)


def pcm_bytes(samples: np.ndarray, width: int) -> bytes:
    """Channel-interleaved little-endian signed samples."""
    whole = np.ascontiguousarray(samples.T)
    return whole.astype(f"<i{width}").tobytes() if width in (1, 2, 4) else whole.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def decode_batch(streams: list[bytes], verify: bool = True) -> list[Decoded]:
    """Decode whole streams; frames that seek tables name are decoded at once."""
    infos = [read_info(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    buffer = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    ats, owners, walk = [], [], []
    for i, info in enumerate(infos):
        named = len(info.seek) and info.seek[0, 0] == 0 and info.seek[:, 2].sum() == info.samples and (info.seek[1:, 0] == np.cumsum(info.seek[:-1, 2])).all()
        if named:
            ats += (base[i] + info.frames_at + info.seek[:, 1]).tolist()
            owners += [i] * len(info.seek)
        else:
            walk.append(i)
    out = [Decoded(info, []) for info in infos]

    def keep(i: int, at: int, head: FrameHeader, samples: np.ndarray) -> None:
        blocks = out[i].blocks
        first = blocks[-1][0] + blocks[-1][2].shape[1] if blocks else 0
        blocks.append((first, at - int(base[i]), samples))

    for (head, samples, _), i, at in zip(_frames(buffer, ats, [infos[i].depth for i in owners], [infos[i].channels for i in owners]), owners, ats, strict=True):
        keep(i, at, head, samples)
    place = {i: int(base[i]) + infos[i].frames_at for i in walk}
    while place:
        place = {i: a for i, a in place.items() if a < base[i + 1]}
        now = list(place)
        for (head, samples, end), i in zip(_frames(buffer, [place[i] for i in now], [infos[i].depth for i in now], [infos[i].channels for i in now]), now, strict=True):
            keep(i, place[i], head, samples)
            place[i] = end
    for d in out if verify else []:
        if d.info.md5 != bytes(16) and hashlib.md5(d.pcm()).digest() != d.info.md5:
            raise ValueError("the MD5 of the samples is wrong")
        if d.info.samples and sum(s.shape[1] for _, _, s in d.blocks) != d.info.samples:
            raise ValueError("samples are missing")
    return out


def read_range(data: bytes, first: int, n: int) -> np.ndarray:
    """Samples first to first + n of a stream as (channels, n), decoding only the frames that hold them."""
    info = read_info(data)
    if not len(info.seek):
        return np.concatenate([s for _, _, s in decode_batch([data])[0].blocks], axis=1)[:, first : first + n]
    begin = max(int(np.searchsorted(info.seek[:, 0], first, side="right")) - 1, 0)
    end = int(np.searchsorted(info.seek[:, 0], first + n, side="left"))
    buffer = np.frombuffer(data + bytes(16), np.uint8)
    ats = (info.frames_at + info.seek[begin:end, 1]).tolist()
    found = _frames(buffer, ats, [info.depth] * len(ats), [info.channels] * len(ats))
    skip = first - int(info.seek[begin, 0])
    return np.concatenate([s for _, s, _ in found], axis=1)[:, skip : skip + n]


# ---------------------------------------------------------------- DataFrames


def payload_of(text: bytes) -> bytes:
    """A text's bytes with 0 appended up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: every whole text's payload, byte b stored as the 8-bit sample b - 128."""
    ship_package(docs.sparkSession)
    shown = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                data, offsets = strings(batch.column(1))
                payloads = [payload_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                media = encode_batch([np.frombuffer(p, np.uint8).astype(np.int16) - 128 for p in payloads])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return shown.mapInArrow(run, f"`{id_col}` {shown.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def _blocks(streams: list[bytes]) -> list[list]:
    """Columns stream, block, first_sample, n_samples, byte_offset, rate, channels, depth and pcm of the streams' blocks."""
    rows: list[list] = [[] for _ in range(9)]
    for r, d in enumerate(decode_batch(streams)):
        for b, (first, at, samples) in enumerate(d.blocks):
            for column, v in zip(rows, (r, b, first, samples.shape[1], at, d.info.rate, d.info.channels, d.info.depth, pcm_bytes(samples, (d.info.depth + 7) // 8)), strict=True):
                column.append(v)
    return rows


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id_col, block, first_sample, n_samples, byte_offset (of its frame in the stream), rate,
    channels, depth, pcm (interleaved, little-endian, signed). Checksums are verified; null media gives no row."""
    ship_package(media.sparkSession)
    shown = media.select(id_col, media_col).where(F.col(media_col).isNotNull())

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for whole in batches:
            for batch in slices(whole, media_col, 2 << 20):
                rows = _blocks([bytes(x) for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, k) for c, k in zip(rows[1:], kinds[1:], strict=True))], [id_col, "block", "first_sample", "n_samples", "byte_offset", "rate", "channels", "depth", "pcm"])

    return shown.mapInArrow(run, f"`{id_col}` {shown.schema[id_col].dataType.simpleString()}, block int, first_sample long, n_samples long, byte_offset long, rate int, channels int, depth int, pcm binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the stored streams back as PCM blocks and describe what those hold: sums of the payload, of the stored form,
    a short description of the signal, and blocks_sha256 over each block's first sample, place in the stream, size (64-bit
    little-endian numbers) and PCM bytes, in order."""
    ship_package(media.sparkSession)
    shown = media.select(id_col, "n_bytes", "media")
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "blocks_sha256"]

    @in_worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 2 << 20):
                streams = [bytes(x) for x in batch.column(2).to_pylist()]
                out: list[list] = [[] for _ in range(8)]
                rows = _blocks(streams)
                begin = np.searchsorted(rows[0], np.arange(len(streams) + 1))
                for i, stored in enumerate(streams):
                    own = range(begin[i], begin[i + 1])
                    pcm = b"".join([rows[8][k] for k in own])
                    digest, ahead = hashlib.sha256(), 0
                    for k in own:
                        if rows[2][k] != ahead:
                            raise ValueError("blocks do not follow each other")
                        ahead += rows[3][k]
                        digest.update(b"".join(int(rows[c][k]).to_bytes(8, "little") for c in (2, 4, 3)) + rows[8][k])
                    signal = np.frombuffer(pcm, np.int8).astype(np.int64)
                    payload = (signal + 128).astype(np.uint8).tobytes()
                    steps = np.abs(np.diff(signal))
                    feature = f"frames={len(own)};sum={int(signal.sum())};energy={int((signal * signal).sum())};turns={int(steps.sum())};peak={int(np.abs(signal).max())}"
                    for column, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(own), digest.hexdigest()), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    kind = shown.schema[id_col].dataType.simpleString()
    return shown.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks int, blocks_sha256 string")


def op1_flac(spark, sf_dir: str) -> DataFrame:
    """Every document's payload through a FLAC stream and back."""
    return media_features(encode_texts(table(spark, sf_dir, "documents")))
