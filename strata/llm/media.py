"""Media columns: bytes as 8-bit mono FLAC, and back to PCM blocks with sample offsets.

Streams follow RFC 9639: STREAMINFO with the samples' MD5, a SEEKTABLE with a point for every
frame, frames of up to BLOCK samples with CRC-8 and CRC-16.  The encoder chooses per frame between
constant, verbatim, fixed predictors of order 0 to 4 and a second-order linear predictor, and a
Rice parameter per partition.  The decoder takes any mono stream of up to 8 bits a sample with
fixed or linear predictors up to order 32, checks every CRC and the MD5, and fails on a mismatch.

Frames of many rows are coded side by side in numpy; a row costs time in proportion to its bytes,
and a group of at most GROUP frames bounds the memory.

Defined results: null is the empty payload; payloads are padded with zero bytes to a positive
multiple of 64, so an empty text is one block of 64; equal texts give equal bytes; other columns
pass through, and a new column whose name a table has already gets underscores.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import fresh, table

BLOCK, PARTITION, RATE, UNIT = 1024, 256, 8000, 64
#: Frames coded side by side.
GROUP = 2048
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
_PRECISION, _SHIFT = 9, 7


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        r = i << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ (poly if r >> (bits - 1) & 1 else 0)
        out[i] = r & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    r = 0
    for x in data:
        r = int(_CRC8[r ^ x])
    return r


def _crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start : start + size]."""
    order = np.argsort(-sizes, kind="stable")
    at, n, r = starts[order].astype(np.int64), sizes[order], np.zeros(len(order), np.uint32)
    left = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    for i, m in enumerate(left):
        c = r[:m]
        r[:m] = (c << 8 & 0xFFFF) ^ _CRC16[(c >> 8) ^ data[at[:m] + i]]
    out = np.empty_like(r)
    out[order] = r
    return out


def _number(n: int) -> bytes:
    """A frame's number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> (6 * i) & 0x3F for i in range(k - 1)][::-1]
    return bytes([(0xFF00 >> k & 0xFF) | n >> (6 * (k - 1)), *tail])


@lru_cache(65536)
def _head(number: int, n: int) -> bytes:
    body = b"\xff\xf8" + (b"\xa4\x02" if n == 1024 else b"\x74\x02") + _number(number) + (b"" if n == 1024 else (n - 1).to_bytes(2, "big"))
    return body + bytes([_crc8(body)])


def _pack(out: np.ndarray, pos: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Puts values of up to 16 bits at bit positions of out, whose bits there are 0."""
    wide = (value.astype(np.int64) << (24 - bits - (pos & 7))).astype(np.int64)
    at = pos >> 3
    if not len(at):
        return
    first, n = int(at.min()), int(at.max() - at.min()) + 3
    for i in range(3):
        out[first : first + n] |= np.bincount(at - first + i, wide >> (16 - 8 * i) & 255, n).astype(np.uint8)


def _encode_group(samples: np.ndarray, sizes: np.ndarray, heads: list[bytes]) -> list[bytes]:
    """Frames of consecutive runs of samples."""
    x, f = samples.astype(np.int32), len(sizes)
    starts = np.cumsum(sizes) - sizes
    frame = np.repeat(np.arange(f), sizes)
    place = np.arange(len(x)) - starts[frame]

    def total(v):
        return np.add.reduceat(v.astype(np.int64), starts)

    residuals = [x]
    for _ in range(4):
        r = residuals[-1].copy()
        r[1:] -= residuals[-1][:-1]
        residuals.append(r)
    # Second-order predictor from each frame's autocorrelation.
    x1, x2 = np.r_[0, x[:-1]] * (place >= 1), np.r_[0, 0, x[:-2]][: len(x)] * (place >= 2)
    r0, r1, r2 = total(x * x), total(x * x1), total(x * x2)
    det = np.maximum((r0 * 1.0) ** 2 - (r1 * 1.0) ** 2, 1)
    lim = (1 << (_PRECISION - 1)) - 1
    q1 = np.clip(np.rint(r1 * (1.0 * r0 - r2) / det * (1 << _SHIFT)), -lim, lim).astype(np.int32)
    q2 = np.clip(np.rint((1.0 * r0 * r2 - (1.0 * r1) ** 2) / det * (1 << _SHIFT)), -lim, lim).astype(np.int32)
    residuals.append(x - ((q1[frame] * x1 + q2[frame] * x2) >> _SHIFT))
    orders = np.array([0, 1, 2, 3, 4, 2])
    cost = np.stack([total(np.abs(r) * (place >= o)) + 8 * o for r, o in zip(residuals, orders, strict=True)])
    cost[:, :] += np.where(orders[:, None] >= sizes, 1 << 40, 0)
    best = np.argmin(cost, 0)
    order = orders[best]
    r = np.choose(best[frame], residuals)
    zz = np.where(r < 0, -2 * r - 1, 2 * r).astype(np.int64)
    warm = place < order[frame]
    zz[warm] = 0
    # Partitions, each with the Rice parameter that makes it shortest.
    split = (sizes % PARTITION == 0) & (sizes // PARTITION & (sizes // PARTITION - 1) == 0)
    width = np.where(split, PARTITION, sizes)
    heads_of_part = np.flatnonzero(place % width[frame] == 0)
    part = np.cumsum(np.isin(np.arange(len(x)), heads_of_part, assume_unique=True)) - 1
    coded = np.add.reduceat((~warm).astype(np.int64), heads_of_part)
    sums = np.stack([np.add.reduceat(zz >> k, heads_of_part) + coded * (1 + k) for k in range(15)])
    k = np.argmin(sums, 0)
    rice = np.add.reduceat(sums[k, np.arange(len(k))] + 4, np.flatnonzero(place[heads_of_part] == 0))
    lpc = best == 5
    lead = 8 + 8 * order + lpc * (9 + 2 * _PRECISION) + 6
    constant = np.minimum.reduceat(x, starts) == np.maximum.reduceat(x, starts)
    verbatim = ~constant & (lead + rice >= 8 + 8 * sizes)
    kind = np.where(constant, 0, np.where(verbatim, 1, 2))
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * sizes, lead + rice))
    head = np.array([len(h) for h in heads])
    length = head + (body + 7) // 8 + 2
    at = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) + 3, np.uint8)
    data = b"".join(heads)
    out[np.repeat(at, head) + np.arange(len(data)) - np.repeat(np.cumsum(head) - head, head)] = np.frombuffer(data, np.uint8)
    bit = (at + head) * 8
    put = lambda pos, value, bits: _pack(out, pos, value, np.broadcast_to(bits, pos.shape))
    put(bit, np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + order - 1, 8 + order))) << 1, 8)
    raw = x & 255
    coded_frame = kind[frame]
    flat = np.flatnonzero((coded_frame == 1) | ((coded_frame == 0) & (place == 0)) | ((coded_frame == 2) & warm))
    put(bit[frame[flat]] + 8 + 8 * place[flat], raw[flat], 8)
    l = np.flatnonzero(lpc & (kind == 2))  # noqa: E741
    if len(l):
        p = bit[l] + 8 + 8 * order[l]
        put(p, np.full(len(l), _PRECISION - 1), 4)
        put(p + 4, np.full(len(l), _SHIFT), 5)
        put(p + 9, q1[l] & ((1 << _PRECISION) - 1), _PRECISION)
        put(p + 9 + _PRECISION, q2[l] & ((1 << _PRECISION) - 1), _PRECISION)
    w = np.flatnonzero(kind == 2)
    put(bit[w] + lead[w] - 6, np.zeros(len(w), np.int64) + np.log2(np.maximum(sizes[w] // width[w], 1)).astype(np.int64), 6)
    own = np.flatnonzero(coded_frame == 2)
    ks = k[part[own]]
    q = zz[own] >> ks
    bits = np.where(warm[own], 0, q + 1 + ks) + 4 * (place[own] % width[frame[own]] == 0)
    if len(own):
        first = np.flatnonzero(place[own] == 0)
        before = np.cumsum(bits) - bits
        pos = bit[frame[own]] + lead[frame[own]] + before - np.repeat(before[first], sizes[w])
        opens = place[own] % width[frame[own]] == 0
        put(pos[opens], ks[opens], 4)
        c = np.flatnonzero(~warm[own])
        put(pos[c] + 4 * opens[c] + q[c], (1 << ks[c]) | (zz[own][c] & ((1 << ks[c]) - 1)), ks[c] + 1)
    crc = _crc16(out, at, length - 2)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 255
    whole = out.tobytes()
    return [whole[a : a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; none of them empty."""
    frames: list[bytes] = []
    jobs = [(i, n, min(BLOCK, len(p) - n * BLOCK)) for i, p in enumerate(payloads) for n in range(-(-len(p) // BLOCK))]
    for g in range(0, len(jobs), GROUP):
        job = jobs[g : g + GROUP]
        data = b"".join([payloads[i][n * BLOCK : n * BLOCK + size] for i, n, size in job])
        samples = (np.frombuffer(data, np.uint8) ^ 128).view(np.int8)
        frames += _encode_group(samples, np.array([size for *_, size in job]), [_head(n, size) for _, n, size in job])
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        own, at = frames[at : at + n], at + n
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = b"".join([
            min(len(p), BLOCK).to_bytes(2, "big") * 2, min(sizes).to_bytes(3, "big"), max(sizes).to_bytes(3, "big"),
            (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big"), hashlib.md5(signed).digest(),
        ])
        points, offset = [], 0
        for i, s in enumerate(sizes):
            points.append((i * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, len(p) - i * BLOCK).to_bytes(2, "big"))
            offset += s
        table_ = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table_).to_bytes(3, "big") + table_ + b"".join(own))
    return out


class Broken(ValueError):
    """A stream that does not decode or fails a checksum."""


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v


@lru_cache(65536)
def _checked(head: bytes) -> None:
    if _crc8(head[:-1]) != head[-1]:
        raise Broken("frame header checksum")


def _open(stream: bytes):
    """(total samples, bits a sample, MD5, block size, seek points, first frame's offset)."""
    if stream[:4] != b"fLaC":
        raise Broken("no stream marker")
    at, points, last = 4, [], False
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            block, packed, md5 = int.from_bytes(body[2:4], "big"), int.from_bytes(body[10:18], "big"), body[18:34]
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n, 18)]
    total, depth = packed & ((1 << 36) - 1), (packed >> 36 & 31) + 1
    if packed >> 41 & 7 or depth > 8:
        raise Broken("not mono of at most 8 bits")
    return total, depth, md5, block, [p for p in points if p[0] != (1 << 64) - 1], at


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _frame(stream: bytes, at: int, depth: int):
    """(samples, kind, warm-up or raw samples, coefficients, shift, partition order, escape bits of k, bit position of the first partition)."""
    if stream[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise Broken("no frame where one was expected")
    size_code, rate_code = stream[at + 2] >> 4, stream[at + 2] & 15
    first = stream[at + 4]
    i = at + 4 + (1 if first < 0x80 else 8 - ((first ^ 0xFF).bit_length()))
    if size_code in (6, 7):
        n, i = int.from_bytes(stream[i : i + size_code - 5], "big") + 1, i + size_code - 5
    else:
        n = _SIZES[size_code]
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    _checked(stream[at : i + 1])
    b = _Bits(stream, i + 1)
    kind = b.read(8)
    wasted, kind = kind & 1, kind >> 1
    if wasted:
        raise Broken("wasted bits are not supported")
    if kind == 0:
        return n, 0, [b.signed(depth)], (), 0, 0, 0, b.at
    if kind == 1:
        a = b.at
        raw = [b.signed(depth) for _ in range(n)] if depth != 8 or a & 7 else (np.frombuffer(stream, np.int8, n, a >> 3))
        return n, 1, raw, (), 0, 0, 0, a + depth * n
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if order < 0:
        raise Broken("unknown subframe")
    warm = [b.signed(depth) for _ in range(order)]
    shift, coefs = 0, _FIXED.get(order, ())
    if kind >= 32:
        precision = b.read(4) + 1
        shift = b.signed(5)
        coefs = tuple(b.signed(precision) for _ in range(order))
    method = b.read(2)
    if method > 1:
        raise Broken("unknown residual coding")
    return n, 2, warm, coefs, shift, b.read(4), 4 + method, b.at


def _decode_group(data: bytes, starts: list[int], depth: int) -> tuple[list[np.ndarray], list[int]]:
    """The frames at byte offsets of data: samples, and the offset where each ends."""
    parsed = [_frame(data, a, depth) for a in starts]
    out: list = [None] * len(parsed)
    ends = np.zeros(len(parsed), np.int64)
    for j, p in enumerate(parsed):
        if p[1] < 2:
            out[j] = np.full(p[0], p[2][0], np.int32) if p[1] == 0 else np.asarray(p[2], np.int32)
            ends[j] = p[7]
    coded = sorted((j for j, p in enumerate(parsed) if p[1] == 2), key=lambda j: -parsed[j][0])
    if coded:
        buf = np.frombuffer(data + bytes(16), np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
        n = np.array([parsed[j][0] for j in coded])
        f, deep = len(coded), max(len(parsed[j][3]) for j in coded)
        coefs, shift = np.zeros((deep, f), np.int64), np.array([parsed[j][4] for j in coded])
        x = np.zeros((deep + int(n[0]), f), np.int64)
        for c, j in enumerate(coded):
            coefs[: len(parsed[j][3]), c] = parsed[j][3]
            x[deep : deep + len(parsed[j][2]), c] = parsed[j][2]
        order = np.array([len(parsed[j][2]) for j in coded])
        width = n >> np.array([parsed[j][5] for j in coded])
        kbits = np.array([parsed[j][6] for j in coded])
        pos, k, raw = np.array([parsed[j][7] for j in coded]), np.zeros(f, np.int64), np.full(f, -1)

        def window(p):
            return np.ascontiguousarray(eight[p >> 3]).view(">u8").ravel().astype(np.uint64) << (p & 7).astype(np.uint64)

        left = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
        plain = True
        for i, m in enumerate(left.tolist()):
            opens = np.flatnonzero(i % width[:m] == 0)
            if len(opens):
                k[opens] = (window(pos[opens]) >> (64 - kbits[opens]).astype(np.uint64)).astype(np.int64)
                pos[opens] += kbits[opens]
                escaped = opens[k[opens] == (1 << kbits[opens]) - 1]
                raw[opens] = -1
                if len(escaped):
                    raw[escaped] = (window(pos[escaped]) >> np.uint64(59)).astype(np.int64)
                    pos[escaped] += 5
                plain = not (raw >= 0).any()
            at = slice(0, m) if i >= deep else np.flatnonzero(order[:m] <= i)
            p, kk = pos[at], k[at]
            if plain:
                w = window(p)
                skip = np.zeros(len(p), np.int64)
                while True:  # all-zero windows: 53 more zero bits each
                    empty = w >> np.uint64(11) == 0
                    if not empty.any():
                        break
                    skip[empty] += 53
                    if (p + skip > len(data) * 8).any():
                        raise Broken("a code runs past the end")
                    w = np.where(empty, window(p + skip), w)
                zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1]
                q, p = zeros + skip, p + zeros + skip + 1
                low = np.where(kk > 0, window(p) >> np.minimum(64 - kk, 63).astype(np.uint64), 0).astype(np.int64)
                z = q << kk | low
                r, p = z >> 1 ^ -(z & 1), p + kk
            else:
                r, p = np.zeros(len(p), np.int64), p.copy()
                for c, bit in enumerate(p.tolist()):
                    b, own = _Bits(data, 0), np.arange(m)[at][c]
                    b.at = bit
                    if raw[own] >= 0:
                        r[c] = b.signed(int(raw[own]))
                    else:
                        q = 0
                        while not b.read(1):
                            q += 1
                            if b.at > len(data) * 8:
                                raise Broken("a code runs past the end")
                        z = q << int(kk[c]) | b.read(int(kk[c]))
                        r[c] = z >> 1 ^ -(z & 1)
                    p[c] = b.at
            pos[at] = p
            guess = np.zeros(len(r), np.int64)
            for d in range(deep):
                guess += coefs[d][at] * x[deep + i - 1 - d][at]
            x[deep + i][at] = r + (guess >> shift[at])
        flat = x[deep:].T.astype(np.int32)
        for c, j in enumerate(coded):
            out[j] = flat[c, : n[c]]
        ends[coded] = pos
    ends = (ends + 7) // 8
    sizes = ends - np.array(starts)
    all_bytes = np.frombuffer(data, np.uint8)
    if len(ends) and int(ends.max()) + 2 > len(data):
        raise Broken("the stream ends early")
    crc = _crc16(all_bytes, np.array(starts), sizes)
    if (crc != all_bytes[ends].astype(np.uint32) * 256 + all_bytes[ends + 1]).any():
        raise Broken("frame checksum")
    return out, (ends + 2).tolist()


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The bytes (8-bit samples, offset binary) of each stream, its checksums verified."""
    opened = [_open(s) for s in streams]
    found: list[list[np.ndarray]] = [[] for _ in streams]
    jobs = []
    for i, (total, depth, _, block, points, first) in enumerate(opened):
        if depth == 8 and len(points) == -(-total // max(block, 1)) and [p[0] for p in points] == [j * block for j in range(len(points))]:
            jobs += [(i, first + p[1]) for p in points]
        else:  # no point for each frame: one frame after the other
            at = first
            while sum(map(len, found[i])) < total:
                (own,), (at,) = _decode_group(streams[i], [at], depth)
                found[i].append(own)
    for g in range(0, len(jobs), GROUP):
        job = jobs[g : g + GROUP]
        base, parts = {}, []
        size = 0
        for i in dict.fromkeys(i for i, _ in job):
            own = [a for j, a in job if j == i] if len(streams[i]) > 1 << 20 else [0]
            base[i] = size - min(own)  # of a very long stream only the part from the group's first frame on
            parts.append(streams[i][min(own) : max(own) + 65536 if len(streams[i]) > 1 << 20 else None])
            size += len(parts[-1])
        samples, _ = _decode_group(b"".join(parts), [base[i] + a for i, a in job], 8)
        for (i, _), own in zip(job, samples, strict=True):
            found[i].append(own)
    out = []
    for (total, depth, md5, *_), own in zip(opened, found, strict=True):
        x = np.concatenate(own) if own else np.zeros(0, np.int32)
        if len(x) != total:
            raise Broken("sample count")
        signed = x.astype(np.int8).tobytes()
        if any(md5) and hashlib.md5(signed).digest() != md5:
            raise Broken("MD5")
        out.append((np.frombuffer(signed, np.uint8) ^ (128 if depth == 8 else 0)).tobytes())
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Samples start to start + count, from the frames that hold them alone."""
    total, depth, _, _, points, first = _open(stream)
    stop = min(total, start + count)
    own = [p for i, p in enumerate(points) if p[0] < stop and (points[i + 1][0] if i + 1 < len(points) else total) > start]
    if not own:
        return b""
    x = np.concatenate(_decode_group(stream, [first + p[1] for p in own], depth)[0])
    return (x[start - own[0][0] : stop - own[0][0]].astype(np.int8).view(np.uint8) ^ 128).tobytes()


def _payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _groups(values: list, size=len, most: int = 2 << 20) -> Iterator[list]:
    held, n = [], 0
    for v in values:
        held.append(v)
        n += size(v)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def to_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df plus its texts' padded bytes as FLAC streams."""
    at, out = df.columns.index(text), fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            payloads = [_payload(t) for t in b.column(at).to_pylist()]
            media = [m for g in _groups(payloads) for m in encode_many(g)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, f"{_fields(df)}, `{out}` binary")


def from_media(df: DataFrame, media: str = "media", out: str = "payload") -> DataFrame:
    """df plus the bytes its streams hold; null stays null."""
    at, out = df.columns.index(media), fresh(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            streams = b.column(at).to_pylist()
            found = iter([p for g in _groups([s for s in streams if s is not None]) for p in decode_many(g)])
            plain = [None if s is None else next(found) for s in streams]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plain, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, f"{_fields(df)}, `{out}` binary")


#: Samples of a PCM block.
PCM = 4096


def blocks_of(payload: bytes, samples: int = PCM) -> list[tuple[int, bytes]]:
    """(sample offset, PCM) of a payload's blocks; block n starts at sample n * samples."""
    return [(at, payload[at : at + samples]) for at in range(0, len(payload), samples)]


def pcm_blocks(df: DataFrame, doc_id: str = "doc_id", media: str = "media", samples: int = PCM) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): what streams hold, as PCM blocks that a sample offset finds."""
    names, i, k = ["doc_id", "block", "sample_offset", "n_samples", "pcm"], df.columns.index(doc_id), df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 100):
            ids, streams = b.column(i), b.column(k).to_pylist()
            held = [n for n, s in enumerate(streams) if s is not None]
            found = iter([p for g in _groups([streams[n] for n in held]) for p in decode_many(g)])
            rows = [(n, at, pcm) for n, p in zip(held, found, strict=True) for at, pcm in blocks_of(p, samples)]
            cols = [ids.take(pa.array([n for n, _, _ in rows], pa.int64())), pa.array([at // samples for _, at, _ in rows], pa.int32()), pa.array([at for _, at, _ in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(p) for _, _, p in rows], pa.int32()), pa.array([p for _, _, p in rows], pa.binary())], names=names)

    return df.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, block int, sample_offset bigint, n_samples int, pcm binary")


def feature(payload: bytes) -> str:
    """Peak, mean absolute level (thousandths) and zero crossings of the samples."""
    x = (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8).astype(np.int32)
    level = int(np.abs(x).sum()) * 1000 // len(x)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};peak={int(np.abs(x).max())};level={level};crossings={crossings}"


def digests(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """doc_id and the digests of each stored stream and of what is read back from it, as PCM blocks in order of their offsets."""
    i, j, k = df.columns.index("doc_id"), df.columns.index("n_bytes"), df.columns.index(media)
    fields = [("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("pcm_blocks", "bigint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            streams = b.column(k).to_pylist()
            blocks = [blocks_of(p) for g in _groups(streams) for p in decode_many(g)]
            plain = [b"".join(p for _, p in sorted(x)) for x in blocks]
            cols = [
                pa.array([len(p) for p in plain], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in plain]),
                pa.array([zlib.crc32(p[-64:]) for p in plain], pa.int64()), pa.array([len(s) for s in streams], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([feature(p) for p in plain]),
                pa.array([len(x) for x in blocks], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(i), b.column(j), *cols], names=["doc_id", "n_bytes", *(n for n, _ in fields)])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, " + ", ".join(f"{n} {t}" for n, t in fields))


def query(spark, sf_dir):
    """op5: every whole text of documents, stored as FLAC and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return digests(to_media(docs).drop("text"))
