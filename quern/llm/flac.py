"""FLAC media columns: lossless 8-bit streams, written and decoded in numpy for many frames at once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import materialise

#: Samples to a frame, and to the frames that are encoded (they stay in cache) or decoded (in step) together.
BLOCK, ENCODE_SAMPLES, DECODE_SAMPLES = 4096, 1 << 16, 1 << 22
RATE, PAD = 16_000, 64
VERBATIM, CONSTANT = 1, 0
#: The APPLICATION block that lists a stream's byte values in the order of their ranks.
RANKS = b"rank"


@cache
def _crc_table(poly: int, bits: int) -> np.ndarray:
    """CRC of every single byte, most significant bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly) & mask if crc & top else (crc << 1) & mask
        out.append(crc)
    return np.array(out, np.uint16)


@cache
def _crc16_powers(length: int) -> np.ndarray:
    """[d * 256 + byte]: what a byte with d bytes after it adds to the CRC-16 of a message; CRCs are linear."""
    one = _crc_table(0x8005, 16)
    rows = np.empty((length, 256), np.uint16)
    rows[0] = one
    for d in range(1, length):
        last = rows[d - 1]
        rows[d] = (last << np.uint16(8)) ^ one[last >> np.uint16(8)]
    return rows.ravel()


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for every range; the ranges are in order, not empty and don't overlap."""
    lengths = ends - starts
    most = int(lengths.max())
    powers = _crc16_powers(1 << (max(most, 4352) - 1).bit_length())
    offset = np.cumsum(lengths) - lengths
    index = np.arange(int(lengths.sum()))
    behind = np.repeat(lengths - 1 + offset, lengths) - index
    source = data[index + np.repeat(starts - offset, lengths)]
    return np.bitwise_xor.reduceat(powers[behind * 256 + source], offset)


def crc8(data: bytes) -> int:
    table, crc = _crc_table(0x07, 8), 0
    for byte in data:
        crc = int(table[crc ^ byte])
    return crc


def _coded_number(n: int) -> bytes:
    """The frame number in the extended UTF-8 form, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << (6 * m + 6 - m))  # bytes that follow the first
    first = (0xFF << (7 - more)) & 0xFF
    return bytes([first | n >> 6 * more, *(0x80 | n >> 6 * j & 0x3F for j in range(more - 1, -1, -1))])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 0
    while first & (0x80 >> more):
        more += 1
    value = first & (0x7F >> more)
    for k in range(1, more):
        value = value << 6 | data[at + k] & 0x3F
    return value, at + more


def _frame_head(number: int, samples: int) -> bytes:
    """Fixed block size, mono, 8 bits; the block size as 16 bits unless it has a code of its own."""
    code = 12 if samples == 4096 else 7
    body = b"\xff\xf8" + bytes([code << 4, 0x02]) + _coded_number(number) + (b"" if code == 12 else struct.pack(">H", samples - 1))
    return body + bytes([crc8(body)])


def _residuals(x: np.ndarray, inside: np.ndarray, order: int) -> np.ndarray:
    """Zigzag residuals of the fixed linear predictor of an order; the first samples of a frame (warm-up) give 0."""
    r = x
    for _ in range(order):
        r = np.diff(r, prepend=np.int16(0))
    z = (r << 1) ^ (r >> 15)
    if order:
        z[inside < order] = 0
    return z


def encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the given sizes over signed 8-bit samples: for each the shortest of a constant, a Rice-coded fixed predictor
    of order 0 to 2, and verbatim samples."""
    x = samples.astype(np.int16)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    inside = np.arange(len(x)) - np.repeat(begin, sizes)
    coded = [_residuals(x, inside, o) for o in range(3)]
    sums = np.stack([np.add.reduceat(z, begin, dtype=np.int64) for z in coded])
    order = sums.argmin(axis=0)
    z = coded[0]
    for o in (1, 2):
        if (order == o).any():
            z = np.where(np.repeat(order == o, sizes), coded[o], z)
    counts = sizes - order
    guess = np.clip(np.floor(np.log2(np.maximum(sums.min(axis=0) / np.maximum(counts, 1), 1.0))).astype(np.int16), 0, 13)
    best, k = None, guess
    for step in (-1, 0, 1):
        trial = np.clip(guess + step, 0, 14)
        bits = np.add.reduceat(z >> np.repeat(trial, sizes), begin, dtype=np.int64) + counts * (trial + 1)
        if best is None:
            best, k = bits, trial
        else:
            k = np.where(bits < best, trial, k)
            best = np.minimum(bits, best)
    rice_bits = best + 8 + 8 * order + 6 + 4
    kind = np.where(rice_bits < 8 * sizes + 8, 2, VERBATIM)
    low, high = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    kind[low == high] = CONSTANT

    heads = [_frame_head(int(n), int(s)) for n, s in zip(numbers, sizes)]
    head_len = np.array([len(h) for h in heads])
    body_bits = np.where(kind == 2, rice_bits, np.where(kind == VERBATIM, 8 + 8 * sizes, 16))
    total = head_len + (body_bits + 7) // 8 + 2
    stop = np.cumsum(total)
    first = stop - total
    out = np.zeros(int(stop[-1]) + 8, np.uint8)
    rice = np.repeat(kind == 2, sizes)
    if rice.any():
        kk, oo = np.repeat(k.astype(np.int16), sizes), np.repeat(order.astype(np.int16), sizes)
        length = np.where(inside >= oo, (z >> kk) + np.int16(1) + kk, np.int16(8))  # warm-up samples are 8 bits as they are
        length[~rice] = 0
        run = np.cumsum(length, dtype=np.int64)
        lead = np.repeat((first + head_len) * 8 + 8, sizes)
        lead += np.where(inside >= oo, 10, 0)
        end = run - np.repeat(run[begin] - length[begin], sizes) + lead
        warm = inside < oo
        width = np.where(warm, np.int16(8), kk + np.int16(1))
        value = np.where(warm, x & np.int16(0xFF), (np.int16(1) << kk) | (z & ((np.int16(1) << kk) - np.int16(1))))
        start = (end - width)[rice]
        word = value[rice].astype(np.int64) << (24 - width[rice] - (start & 7))
        at = start >> 3
        n = len(out)
        out += (np.bincount(at, word >> 16, n) + np.bincount(at + 1, word >> 8 & 0xFF, n)[:n] + np.bincount(at + 2, word & 0xFF, n)[:n]).astype(np.uint8)
    raw = samples.view(np.uint8)
    for f, head in enumerate(heads):
        p, o = int(first[f]), int(order[f])
        q = p + len(head)
        out[p:q] = np.frombuffer(head, np.uint8)
        if kind[f] == 2:
            out[q] = (8 | o) << 1
            bit = q * 8 + 8 + 8 * o  # method 0, partition order 0, then the Rice parameter
            word = int(k[f]) << (16 - 10 - (bit & 7))
            out[bit >> 3] |= word >> 8
            out[(bit >> 3) + 1] |= word & 0xFF
        elif kind[f] == VERBATIM:
            out[q] = VERBATIM << 1
            out[q + 1 : q + 1 + int(sizes[f])] = raw[begin[f] : ends[f]]
        else:
            out[q + 1] = raw[begin[f]]
    sums16 = crc16(out, first, stop - 2)
    out[stop - 2], out[stop - 1] = sums16 >> np.uint16(8), sums16 & np.uint16(0xFF)
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(first.tolist(), stop.tolist())]


def ranked(payload: bytes) -> tuple[bytes, bytes]:
    """A payload's byte values, the most frequent first, and the payload with each value replaced by the sample of its rank.

    Samples 0, -1, 1, -2, 2 and so on are those that residuals of order 0 code shortest. Bytes of texts are symbols and no
    waves: no predictor comes near what the order of their frequencies saves.
    """
    raw = np.frombuffer(payload, np.uint8)
    counts = np.bincount(raw, minlength=256)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint8)
    sample = np.zeros(256, np.uint8)
    rank = np.arange(len(order))
    sample[order] = ((rank >> 1) ^ -(rank & 1)).astype(np.int8).view(np.uint8) ^ 0x80
    return order.tobytes(), sample[raw].tobytes()


def unranked(order: bytes, pcm: bytes) -> bytes:
    """The payload that ranked() made unsigned samples of."""
    signed = (np.frombuffer(pcm, np.uint8) ^ 0x80).view(np.int8).astype(np.int16)
    place = (signed << 1) ^ (signed >> 15)
    if len(place) and int(place.max()) >= len(order):
        raise ValueError("a sample that stands for no byte value")
    return np.frombuffer(order, np.uint8)[place].tobytes()


def encode_streams(payloads: list[bytes], by_rank: bool = False) -> list[bytes]:
    """A FLAC stream for each payload of unsigned 8-bit samples: STREAMINFO with the MD5 of the samples, a seek point for every
    frame, frames. With by_rank the samples are the ranks of the payload's byte values, which an APPLICATION block lists."""
    orders = [b""] * len(payloads)
    if by_rank:
        orders, payloads = map(list, zip(*map(ranked, payloads))) if payloads else ([], [])
    plan: list[tuple[int, int, bytes]] = []
    for d, payload in enumerate(payloads):
        plan += [(d, n, payload[n * BLOCK : (n + 1) * BLOCK]) for n in range(-(-len(payload) // BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for at in range(0, len(plan), ENCODE_SAMPLES // BLOCK):
        part = plan[at : at + ENCODE_SAMPLES // BLOCK]
        signed = (np.frombuffer(b"".join(x[2] for x in part), np.uint8) ^ 0x80).view(np.int8)
        for (d, _, _), frame in zip(part, encode_frames(signed, np.array([len(x[2]) for x in part]), np.array([x[1] for x in part]))):
            frames[d].append(frame)
    out = []
    for payload, own, order in zip(payloads, frames, orders):
        lengths = [len(f) for f in own]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        block = min(BLOCK, max(len(payload), 16))
        rate = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", block, block) + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big") + rate.to_bytes(8, "big") + hashlib.md5(signed).digest()
        place, points = 0, []
        for n, length in enumerate(lengths):
            points.append(struct.pack(">QQH", n * BLOCK, place, min(BLOCK, len(payload) - n * BLOCK)))
            place += length
        seek = b"".join(points)
        listed = b"\x02" + (4 + len(order)).to_bytes(3, "big") + RANKS + order if by_rank else b""
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + listed + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


class Stream:
    """What the metadata of a FLAC stream says."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.points, self.order = 4, False, [], None
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                word = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.total, self.md5 = (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1, body[18:34]
            elif kind == 2 and body[:4] == RANKS:
                self.order = body[4:]
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        if (self.channels, self.bits) != (1, 8):
            raise ValueError("only mono streams of 8 bits are read")
        self.data, self.audio = data, at

    def offsets(self) -> list[int] | None:
        """Byte offsets of all frames if the seek points name every one."""
        seen = 0
        for sample, _, count in self.points:
            if sample != seen:
                return None
            seen += count
        return [self.audio + p[1] for p in self.points] if seen == self.total else None


#: Block size codes of the frame header that name a size outright.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def _read_head(data: bytes, at: int) -> tuple[int, int, int]:
    """(frame or sample number, block size, first byte of the subframe); raises where the header's CRC-8 is wrong."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or data[at + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("only mono frames of 8 bits are read")
    number, p = _read_number(data, at + 4)
    if code == 6:
        size, p = data[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = SIZES[code]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError(f"wrong CRC-8 in the frame header at byte {at}")
    return number, size, p + 1


@cache
def _leading_zeros() -> np.ndarray:
    v = np.arange(1 << 16)
    return np.where(v == 0, 16, 15 - np.floor(np.log2(np.maximum(v, 1)))).astype(np.uint64)


def _rice(words: np.ndarray, pos: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals [step, frame] of frames decoded in step, and the bits where they end. Frames come in falling order of
    residuals. pos is where the residual block starts; words[b] holds the 64 bits from byte b on."""
    one, seven = np.uint64(1), np.uint64(7)
    zeros = _leading_zeros()

    def take(p: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.uint64), p.shape)
        return ((words[p >> np.uint64(3)] << (p & seven)) >> one) >> (np.uint64(63) - width)

    pos = pos.astype(np.uint64)
    method = take(pos, 2)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    part_order = take(pos + np.uint64(2), 4).astype(np.int64)
    pos = pos + np.uint64(6)
    width = np.uint64(4) + method
    counts = sizes - orders
    steps = int(counts[0]) if len(counts) else 0
    out = np.zeros((steps, len(counts)), np.int32)
    k = np.zeros(len(counts), np.uint64)
    raw = np.zeros(len(counts), bool)
    border = np.zeros(len(counts), np.int64)
    part = np.zeros(len(counts), np.int64)
    alive = np.searchsorted(-counts, -np.arange(steps), side="left")  # frames with more than i residuals
    turn, any_raw = 0, False
    for i in range(steps):
        n = int(alive[i])
        if i == turn:
            due = np.flatnonzero(border[:n] == i)
            while len(due):
                k[due] = take(pos[due], width[due])
                pos[due] += width[due]
                raw[due] = k[due] == (one << width[due]) - one
                for f in due[raw[due]]:
                    k[f] = take(pos[f : f + 1], 5)[0]
                    pos[f] += np.uint64(5)
                part[due] += 1
                border[due] = np.minimum((sizes[due] >> part_order[due]) * part[due] - orders[due], counts[due])
                due = due[(border[due] == i) & (part[due] < 1 << part_order[due])]
            any_raw = bool(raw[:n].any())
            turn = int(border[:n].min(initial=steps))
        p, kk = pos[:n], k[:n]
        w = words[p >> np.uint64(3)] << (p & seven)
        top = w >> np.uint64(48)
        q = zeros[top]
        if not top.all() or any_raw:
            for f in np.flatnonzero((top == 0) | raw[:n]):
                if raw[f]:
                    v = int(take(p[f : f + 1], int(kk[f]))[0]) if kk[f] else 0
                    signed = v - (1 << int(kk[f])) if kk[f] and v >> (int(kk[f]) - 1) else v
                    out[i, f] = signed * 2 if signed >= 0 else -2 * signed - 1
                    pos[f] += kk[f]
                    continue
                at, count = int(p[f]), 0
                while not int(words[at >> 3] << np.uint64(at & 7)) >> 48:
                    at, count = at + 16, count + 16
                rest = int(zeros[int(words[at >> 3] << np.uint64(at & 7)) >> 48])
                q[f] = count + rest
                tail = np.array([at + rest + 1], np.uint64)
                out[i, f] = int(q[f]) << int(kk[f]) | int(take(tail, int(kk[f]))[0])
            plain = np.flatnonzero((top != 0) & ~raw[:n])
            value = ((w << (q + one)) >> one) >> (np.uint64(63) - kk)
            out[i, plain] = ((q << kk) | value)[plain]
            coded = ~raw[:n]
            pos[:n][coded] += (q + one + kk)[coded]
            continue
        out[i, :n] = (q << kk) | (((w << (q + one)) >> one) >> (np.uint64(63) - kk))
        pos[:n] = p + q + one + kk
    return out, pos


def _predicted(subframes: list[tuple[np.ndarray, np.ndarray, list[int], int]]) -> list[np.ndarray]:
    """Samples of linear-prediction subframes (warm-up, residuals, coefficients, shift): the i-th samples of all in one step."""
    if not subframes:
        return []
    most = max(len(w) for w, *_ in subframes)
    sizes = [len(w) + len(r) for w, r, *_ in subframes]
    held = np.zeros((len(subframes), most + max(sizes)), np.int64)
    added, weights = np.zeros_like(held), np.zeros((len(subframes), most), np.int64)
    orders, shifts = np.array([len(w) for w, *_ in subframes]), np.array([x[3] for x in subframes])
    for row, (warm, r, coefficients, _) in enumerate(subframes):
        held[row, most : most + len(warm)] = warm
        added[row, most + len(warm) : most + sizes[row]] = r
        weights[row, most - len(coefficients) :] = coefficients[::-1]
    for i in range(int(orders.min()), max(sizes)):
        guess = (held[:, i : i + most] * weights).sum(1) >> shifts
        held[:, most + i] = np.where(i >= orders, guess + added[:, most + i], held[:, most + i])
    return [held[row, most : most + n].astype(np.int8) for row, n in enumerate(sizes)]


def decode_frames(data: bytes, starts: list[int]) -> list[tuple[int, np.ndarray, int]]:
    """(number, signed samples, byte where the frame ends) of the frames that start at these bytes, checksums verified.

    Rice residuals of all frames are read in step: one pass of the loop decodes the i-th residual of every frame.
    """
    heads = [_read_head(data, s) for s in starts]
    raw = np.frombuffer(data + bytes(16), np.uint8)
    kinds = [data[h[2]] >> 1 & 63 for h in heads]
    if any(data[h[2]] & 0x81 for h in heads):
        raise ValueError("a subframe with wasted or reserved bits")
    found: list[np.ndarray | None] = [None] * len(starts)
    ends = [0] * len(starts)
    coded = []
    for f, ((_, size, p), kind) in enumerate(zip(heads, kinds)):
        if kind == CONSTANT:
            found[f], ends[f] = np.full(size, raw[p + 1 : p + 2].view(np.int8)[0], np.int8), p + 2
        elif kind == VERBATIM:
            found[f], ends[f] = raw[p + 1 : p + 1 + size].view(np.int8), p + 1 + size
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            coefficients, shift, bit = None, 0, (p + 1 + order) * 8
            if kind >= 32:
                bits = lambda at, n: int.from_bytes(data[at >> 3 : (at >> 3) + 4], "big") << (at & 7) >> (32 - n) & (1 << n) - 1
                precision, shift = bits(bit, 4) + 1, bits(bit + 4, 5)
                if shift >= 16:
                    raise ValueError("a negative shift")
                bit += 9
                values = [bits(bit + j * precision, precision) for j in range(order)]
                coefficients = [v - (1 << precision) if v >> (precision - 1) else v for v in values]
                bit += order * precision
            coded.append((size - order, f, order, bit, coefficients, shift))
        else:
            raise ValueError(f"unknown subframe type {kind}")
    if coded:
        coded.sort(key=lambda c: (-c[0], c[1]))
        view = np.lib.stride_tricks.as_strided(raw, (len(raw) - 8, 8), (1, 1))
        words = np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)
        sizes = np.array([heads[c[1]][1] for c in coded])
        z, end = _rice(words, np.array([c[3] for c in coded]), sizes, np.array([c[2] for c in coded]))
        residual = np.ascontiguousarray(((z >> 1) ^ -(z & 1)).T)
        linear = []
        for row, (count, f, order, _, coefficients, shift) in enumerate(coded):
            p = heads[f][2] + 1
            warm = raw[p : p + order].view(np.int8).astype(np.int64)
            r = residual[row, :count].astype(np.int64)
            if coefficients is None:
                for level in range(order, 0, -1):
                    r = np.cumsum(np.concatenate([np.diff(warm[:level], level - 1), r]))
                samples = r
            else:
                linear.append((f, warm, r, coefficients, shift))
                samples = warm
            found[f], ends[f] = samples.astype(np.int8), (int(end[row]) + 7) // 8
        for (f, *_), samples in zip(linear, _predicted([x[1:] for x in linear])):
            found[f] = samples
    first, stop = np.array(starts), np.array(ends)
    rank = np.argsort(first)
    wrong = crc16(raw, first[rank], stop[rank]) != (raw[stop[rank]].astype(np.uint16) << np.uint16(8) | raw[stop[rank] + 1])
    if wrong.any():
        raise ValueError(f"wrong CRC-16 in the frame at byte {int(first[rank][wrong][0])}")
    return [(h[0], s, e + 2) for h, s, e in zip(heads, found, ends)]


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks (sample offset, unsigned 8-bit samples; of ranks the byte values they stand for). Frames
    of all streams are decoded together where seek points name them; else a stream is decoded one frame after another. MD5
    sums are verified."""
    parsed = [Stream(s) for s in streams]
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in parsed]
    work: list[tuple[int, int, int]] = []
    for d, stream in enumerate(parsed):
        offsets = stream.offsets()
        if offsets is None:
            at, seen = stream.audio, 0
            while seen < stream.total or (not stream.total and at < len(stream.data)):
                _, samples, at = decode_frames(stream.data, [at])[0]
                blocks[d].append((seen, samples))
                seen += len(samples)
            continue
        work += [(d, o, p[0]) for o, p in zip(offsets, stream.points)]
    per = DECODE_SAMPLES // BLOCK
    for top in range(0, len(work), per):
        part = work[top : top + per]
        pieces, starts, at = [], [], 0
        for n, (d, offset, _) in enumerate(part):
            stop = next((o for e, o, _ in part[n + 1 : n + 2] if e == d), None)
            if stop is None:
                following = [p[1] + parsed[d].audio for p in parsed[d].points if p[1] + parsed[d].audio > offset]
                stop = following[0] if following else len(parsed[d].data)
            pieces.append(parsed[d].data[offset:stop])
            starts.append(at)
            at += stop - offset
        for (d, _, sample), (_, samples, _) in zip(part, decode_frames(b"".join(pieces), starts)):
            blocks[d].append((sample, samples))
    out = []
    for stream, own in zip(parsed, blocks):
        signed = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.int8)
        if len(signed) != stream.total or stream.md5.strip(b"\0") and hashlib.md5(signed.tobytes()).digest() != stream.md5:
            raise ValueError("the samples are not those the stream was made of")
        pcm = [(sample, (s.view(np.uint8) ^ 0x80).tobytes()) for sample, s in own]
        out.append(pcm if stream.order is None else [(sample, unranked(stream.order, b)) for sample, b in pcm])
    return out


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of PAD."""
    return data + bytes(-len(data) % PAD if data else PAD)


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
        for part in _groups([len(t) for t in texts], DECODE_SAMPLES):
            media = encode_streams([padded(t) for t in texts[part]], by_rank=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[part], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )


BLOCKS = "blocks array<struct<sample_offset:bigint,pcm:binary>>"
#: PCM tables are written once and read in parts: pages of 8 MB, compressed well.
PCM_PAGES = {"parquet.compression.codec.zstd.level": "11", "parquet.page.size": str(8 << 20)}


def feature(blocks: list[tuple[int, bytes]]) -> str:
    """Whole-number features of the samples of a stream: count, peak, energy, sign changes and the offset of the last block."""
    x = np.concatenate([np.frombuffer(b, np.uint8) for _, b in blocks]).astype(np.int64) - 128 if blocks else np.zeros(0, np.int64)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={changes};last={blocks[-1][0] if blocks else 0}"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))
    for batch in batches:
        media = batch.column(2).to_pylist()
        for part in _groups([len(m) for m in media], DECODE_SAMPLES):
            found = decode_streams(media[part])
            blocks = pa.array([[{"sample_offset": s, "pcm": b} for s, b in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], batch.column(2)[part], blocks], ["doc_id", "n_bytes", "media", "blocks"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a table of decoded streams, all columns but the blocks, and what the samples say. Blocks are hashed one after another."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        hashes, sizes, tails, features = [], [], [], []
        for row in batch.column(4):
            blocks = [(b["sample_offset"], b["pcm"]) for b in row.as_py()]
            whole, size, tail = hashlib.sha256(), 0, b""
            for offset, pcm in blocks:
                if offset != size:
                    raise ValueError("a PCM block does not follow the one before it")
                whole.update(pcm)
                size += len(pcm)
                tail = (tail + pcm)[-PAD:]
            hashes.append(whole.hexdigest())
            sizes.append(size)
            tails.append(zlib.crc32(tail))
            features.append(feature(blocks))
        found = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(tails, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found, batch.column(2), batch.column(3), pa.array(features, pa.string())], names)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a FLAC stream of its UTF-8 bytes, zero-padded to a multiple of 64.

    A byte is one sample of 8 bits, its value's rank of frequency in the text; the stream lists the values in that order.
    Null counts as empty (64 zero bytes). Repeated rows stay; equal texts give equal streams; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """Adds blocks (PCM with the sample offset each starts at) to (doc_id, n_bytes, media).

    A stream with a wrong frame checksum or MD5 sum fails the task: media are never passed on unverified.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, f"doc_id long, n_bytes long, media binary, {BLOCKS}")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """One row for each PCM block: doc_id, block, sample_offset, samples, pcm."""
    blocks = decoded.select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return blocks.select("doc_id", "block", "b.sample_offset", F.octet_length("b.pcm").cast("long").alias("samples"), "b.pcm")


def write_pcm(media: DataFrame, path: str) -> DataFrame:
    """Decodes a column of media and writes its PCM blocks as a table under path; the table, read back."""
    pcm_blocks(decode_column(media)).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def seek(blocks: DataFrame, doc_id: int, first: int, count: int) -> DataFrame:
    """(sample_offset, pcm) of the samples from first to first + count of a document; only blocks that hold some are read."""
    last = first + count
    held = blocks.where((F.col("doc_id") == doc_id) & (F.col("sample_offset") < last) & (F.col("sample_offset") + F.col("samples") > first))
    start = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0))
    stop = F.least(F.lit(last) - F.col("sample_offset"), F.col("samples"))
    return held.select((F.col("sample_offset") + start).alias("sample_offset"), F.substring("pcm", (start + 1).cast("int"), (stop - start).cast("int")).alias("pcm")).orderBy("sample_offset")


def store_decoded(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, blocks): a column of media decoded and written as a table in the shared folder,
    read back. A row holds a stream's PCM blocks with the sample offset each starts at; pcm_blocks and seek read parts of it."""
    stored = ["doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "blocks"]
    return materialise(decode_column(media).select(*stored), "pcm", **PCM_PAGES)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The streams are written as a table in the shared folder and read back; their PCM blocks are decoded into a second table,
    which is read back too. All of the payload and the feature is taken from the blocks in it. Null texts are empty; an empty
    table gives an empty result.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_decoded(materialise(encode_column(docs, id_col, text_col), "media")).mapInArrow(_digest, kinds)
