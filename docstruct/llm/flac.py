"""FLAC media columns: texts as 8-bit mono samples in frames of 192, encoded and decoded in numpy.

All frames of a step move through the format together: sample t of every frame is decoded at once, and every byte of the
frames' checksums. Layout as in the published format description: stream info, seek table, frames with CRC-8 headers,
constant, verbatim, fixed and linear-prediction subframes, Rice-coded residuals in partitions, CRC-16 footers. The decoder
reads streams of this profile (mono, 8 bits, blocks of 192) and refuses others.

Text has no slope that a predictor could follow. Its samples are ranks of its bytes by frequency, the frequent ones near
zero, and an application block lists the bytes (`palette`); payloads that predictors fit better keep their bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column, steps

BLOCK, RATE, STEP_FRAMES = 192, 8000, 8192
#: Frames between two points of the seek table.
SEEK_EVERY = 64
#: Bits of the quantised coefficients and their shift; orders of the linear predictors tried; greatest partition order tried.
PRECISION, SHIFT, ORDERS, PARTITIONS = 10, 8, (2, 4), 3
#: Fixed predictors' coefficients of the samples before, latest first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CONSTANT, VERBATIM, FIXED_TYPE, LPC_TYPE = 0, 1, 8, 32
#: Kinds of metadata blocks, and the name of the application block that holds a palette.
INFO, APPLICATION, SEEK, PALETTE = 0, 2, 3, b"rank"
#: Payload byte of each sample's byte where there is no palette: sample s is the byte s + 128.
_SHIFTED = bytes(b ^ 0x80 for b in range(256))


def _table(poly: int, width: int) -> np.ndarray:
    """Of a checksum that takes the highest bit first."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        x = byte << (width - 8)
        for _ in range(8):
            x = (x << 1 ^ poly) & mask if x & top else x << 1 & mask
        out.append(x)
    return np.array(out, np.int32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _checksum(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Of data[start : start + size] for each pair."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(start), np.int32)
    alive = len(start) - np.searchsorted(size[::-1], np.arange(int(size.max(initial=0))), side="right")
    for j, n in enumerate(alive.tolist()):
        x = data[start[:n] + j] ^ (crc[:n] >> (width - 8))
        crc[:n] = table[x] if width == 8 else (crc[:n] << 8 & 0xFFFF) ^ table[x]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: (frames, 7) bytes and their sizes."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26, n < 1 << 31], [1, 2, 3, 4, 5, 6], 7)
    out = np.zeros((len(n), 7), np.uint8)
    for k in range(1, 8):
        rows = size == k
        if rows.any():
            v = n[rows]
            for i in range(k):
                part = v >> 6 * (k - 1 - i)
                out[rows, i] = v if k == 1 else (part | (0xFF << (8 - k) & 0xFF)) if i == 0 else (part & 63 | 128)
    return out, size


def _predict(s: np.ndarray, order: int, coefs: np.ndarray | tuple[int, ...], shift: int = 0) -> np.ndarray:
    """Residual of samples (frames, BLOCK) from `order` on; coefs: of the fixed predictor, or (frames, order)."""
    total = np.zeros((len(s), BLOCK - order), np.int32)
    for i in range(order):
        c = coefs[i] if isinstance(coefs, tuple) else coefs[:, i, None]
        total += c * s[:, order - 1 - i : BLOCK - 1 - i]
    return s[:, order:] - (total >> shift)


def _linear(s: np.ndarray) -> dict[int, np.ndarray]:
    """Quantised coefficients (frames, order) of the predictors of ORDERS: autocorrelation and Levinson-Durbin recursion."""
    x = s.astype(np.float32)
    r = [(x[:, k:] * x[:, : BLOCK - k]).sum(axis=1).astype(np.float64) for k in range(max(ORDERS) + 1)]
    error, a, found = r[0] * 1.0001 + 1, np.zeros((len(s), 0)), {}
    most = (1 << (PRECISION - 1)) - 1
    for order in range(1, max(ORDERS) + 1):
        reach = r[order] - sum((a[:, i] * r[order - 1 - i] for i in range(order - 1)), np.zeros(len(s)))
        k = reach / error
        a = np.concatenate([a - k[:, None] * a[:, ::-1], k[:, None]], axis=1)
        error = np.maximum(error * (1 - k * k), 1e-9)
        if order in ORDERS:
            found[order] = np.clip(np.rint(a * (1 << SHIFT)), -most - 1, most).astype(np.int32)
    return found


def _parameters(u: np.ndarray, order: int, partition: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameters (frames, partitions) of the folded residuals u (frames, BLOCK - order), and the bits of the coded partitions."""
    parts = 1 << partition
    if parts == 1:
        count, total, most = np.array([BLOCK - order]), u.sum(axis=1)[:, None], u.max(axis=1)[:, None]
    else:
        full = np.concatenate([np.zeros((len(u), order), u.dtype), u], axis=1).reshape(len(u), parts, -1)
        count, total, most = np.full(parts, BLOCK // parts), full.sum(axis=2), full.max(axis=2)
        count[0] -= order
    k = np.clip(np.floor(np.log2(np.maximum(total / count * 0.7, 1))), np.ceil(np.log2(np.maximum(most, 1) / 28 + 1e-9)), 14).astype(np.int32)
    k = np.maximum(k, 0)
    quotients = (u >> (k if parts == 1 else np.repeat(k, BLOCK // parts, axis=1)[:, order:])).sum(axis=1)
    return k, quotients + (count * (1 + k) + 4).sum(axis=1)


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """samples: (frames, BLOCK) int32 of -128 to 127; number: of each frame in its stream. The frames' bytes, one after another, and their sizes."""
    frames = len(samples)
    kind = np.full(frames, VERBATIM)
    cost = np.full(frames, 8 * BLOCK)
    linear = _linear(samples)

    def residual(name: int, rows: np.ndarray | slice) -> tuple[np.ndarray, int, int]:
        """Folded residuals, order, and the bits before the partitions."""
        order = name - FIXED_TYPE if name < LPC_TYPE else name - LPC_TYPE + 1
        e = _predict(samples[rows], order, FIXED[order]) if name < LPC_TYPE else _predict(samples[rows], order, linear[order][rows], SHIFT)
        return (e << 1) ^ (e >> 31), order, 8 * order + 6 + (order * PRECISION + 9) * (name >= LPC_TYPE)

    for name in (*(FIXED_TYPE + k for k in range(5)), *(LPC_TYPE + k - 1 for k in ORDERS)):
        u, order, before = residual(name, slice(None))
        bits = _parameters(u, order, 0)[1] + before
        better = bits < cost
        kind[better], cost[better] = name, bits[better]
    still = (samples == samples[:, :1]).all(axis=1)
    kind[still], cost[still] = CONSTANT, 8
    coded = []
    for name in np.unique(kind[kind >= FIXED_TYPE]).tolist():
        rows = np.nonzero(kind == name)[0]
        u, order, before = residual(name, rows)
        tried = [_parameters(u, order, p) for p in range(PARTITIONS + 1)]
        bits = np.stack([t[1] for t in tried], axis=1)
        best = bits.argmin(axis=1)
        cost[rows] = bits[np.arange(len(rows)), best] + before
        coded += [(name, order, p, rows[best == p], u[best == p], tried[p][0][best == p]) for p in np.unique(best).tolist()]
    numbers, digits = _coded_number(number)
    head = 4 + digits + 1
    size = head + 1 + (cost + 7) // 8 + 2
    at = np.cumsum(size) - size
    body = at + head + 1
    bits = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[where + j] = value >> (width - 1 - j) & 1

    for name, order, partition, rows, u, params in coded:
        where = 8 * body[rows] + 8 * order
        if name >= LPC_TYPE:
            put(where, np.full(len(rows), PRECISION - 1), 4)
            put(where + 4, np.full(len(rows), SHIFT), 5)
            for i in range(order):
                put(where + 9 + i * PRECISION, linear[order][rows, i] & ((1 << PRECISION) - 1), PRECISION)
            where = where + 9 + order * PRECISION
        put(where + 2, np.full(len(rows), partition), 4)  # method 0 is two zero bits
        where = where + 6
        span = BLOCK >> partition
        k = np.repeat(params, span, axis=1)[:, order:]
        sizes = (u >> k) + 1 + k
        first = np.maximum(np.arange(1 << partition) * span - order, 0)
        sizes[:, first] += 4
        ends = where[:, None] + np.cumsum(sizes, axis=1)
        for i, at_ in enumerate(first.tolist()):
            put(ends[:, at_] - sizes[:, at_], params[:, i], 4)
        stop = ends - k - 1
        bits[stop] = 1
        for j in range(int(k.max(initial=0))):
            deep = k > j
            bits[(stop + 1 + j)[deep]] = (u >> np.maximum(k - 1 - j, 0))[deep] & 1
    out = np.packbits(bits)
    for i, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):  # sync, 192 samples at 8 kHz, mono of 8 bits
        out[at + i] = byte
    for i in range(int(digits.max(initial=0))):
        some = digits > i
        out[at[some] + 4 + i] = numbers[some, i]
    out[at + head - 1] = _checksum(out, at, head - 1, CRC8, 8)
    out[at + head] = kind << 1
    for i in range(4):
        some = np.nonzero((kind == CONSTANT) & (i < 1) | (kind > FIXED_TYPE) & (kind < LPC_TYPE) & (kind - FIXED_TYPE > i) | (kind >= LPC_TYPE) & (kind - LPC_TYPE + 1 > i))[0]
        out[body[some] + i] = samples[some, i].astype(np.uint8)
    plain = np.nonzero(kind == VERBATIM)[0]
    out[body[plain, None] + np.arange(BLOCK)] = samples[plain].astype(np.uint8)
    crc = _checksum(out, at, size - 2, CRC16, 16)
    out[at + size - 2], out[at + size - 1] = crc >> 8, crc & 0xFF
    return out, size


def _peek(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At least 57 bits from bit `at`, the first at the top of a 64-bit word."""
    return words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


def decode_frames(data: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(frames, BLOCK) int32 samples of the frames at the byte offsets `at`; raises ValueError at a wrong header, number or checksum."""
    numbers, digits = _coded_number(number)
    head = 4 + digits + 1
    for i, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        if (data[at + i] != byte).any():
            raise ValueError("not a frame of this kind")
    for i in range(int(digits.max(initial=0))):
        some = digits > i
        if (data[at[some] + 4 + i] != numbers[some, i]).any():
            raise ValueError("frame number out of order")
    if (_checksum(data, at, head, CRC8, 8) != 0).any() or (_checksum(data, at, size, CRC16, 16) != 0).any():
        raise ValueError("checksum mismatch")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, ">u8", padded, 0, (1,))
    kind, body = data[at + head] >> 1, at + head + 1
    out = np.empty((BLOCK, len(at)), np.int32)
    for name in np.unique(kind).tolist():
        rows = np.nonzero(kind == name)[0]
        if name == CONSTANT:
            out[:, rows] = data[body[rows]].astype(np.int8)
        elif name == VERBATIM:
            out[:, rows] = data[body[rows] + np.arange(BLOCK)[:, None]].astype(np.int8)
        elif FIXED_TYPE <= name <= FIXED_TYPE + 4 or name >= LPC_TYPE:
            out[:, rows] = _decode_rice(data, words, body[rows], name)
        else:
            raise ValueError("reserved subframe")
    return out.T


def _decode_rice(data: np.ndarray, words: np.ndarray, body: np.ndarray, name: int) -> np.ndarray:
    """Samples (BLOCK, frames) of subframes of one type."""
    order = name - FIXED_TYPE if name < LPC_TYPE else name - LPC_TYPE + 1
    out = np.empty((BLOCK, len(body)), np.int64)
    for i in range(order):
        out[i] = data[body + i].astype(np.int8)
    at = 8 * (body + order)
    take = lambda n: (_peek(words, at) >> np.uint64(64 - n)).astype(np.int64)
    shift, coefs = 0, [np.int64(c) for c in FIXED[order]] if name < LPC_TYPE else []
    if name >= LPC_TYPE:
        precision = take(4) + 1
        at += 4
        shift = take(5)
        at += 5
        for _ in range(order):
            c = (_peek(words, at) >> (64 - precision).astype(np.uint64)).astype(np.int64)
            coefs.append(c - ((c >> precision - 1) << precision))
            at += precision
    if (take(2) != 0).any():
        raise ValueError("another residual coding")
    at += 2
    parts = 1 << take(4)
    at += 4
    span = BLOCK // parts
    one = np.uint64(1)
    k = np.zeros(len(body), np.int64)
    for t in range(order, BLOCK):
        fresh = np.nonzero(t % span == 0)[0] if t > order else np.arange(len(body))
        if len(fresh):
            k[fresh] = (_peek(words, at[fresh]) >> np.uint64(60)).astype(np.int64)
            if (k[fresh] == 15).any():
                raise ValueError("unencoded partition")
            at[fresh] += 4
            low, high = k.astype(np.uint64), (63 - k).astype(np.uint64)
        w = _peek(words, at)
        q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        far = np.nonzero(q == 32)[0]
        while len(far):  # a run of zeros beyond the window
            at[far] += 32
            w[far] = _peek(words, at[far])
            more = 32 - np.frexp((w[far] >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
            q[far] += more
            far = far[more == 32]
        lead = (q & 31).astype(np.uint64)
        rest = (w << (lead + one)) >> one >> high
        u = q << k | rest.astype(np.int64)
        at += (lead + one + low).astype(np.int64)
        e = (u >> 1) ^ -(u & 1)
        if order:
            guess = coefs[0] * out[t - 1]
            for i in range(1, order):
                guess = guess + coefs[i] * out[t - 1 - i]
            e += guess >> shift
        out[t] = e
    return out


def payload(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of BLOCK."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def palette(data: bytes) -> bytes:
    """The bytes of a payload by falling frequency, equal ones in order; none where the differences of fixed predictors make shorter Rice codes than the ranks and the list."""
    x = np.frombuffer(data, np.uint8)
    count = np.bincount(x, minlength=256)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    ranks = int((count[order] * np.arange(len(order))).sum())
    plain = x.astype(np.int16) - 128
    left = min(2 * int(np.abs(np.diff(plain, n=k)).sum(dtype=np.int64)) for k in range(3))
    bits = lambda total: len(x) * np.log2(1 + total / len(x))
    return order.astype(np.uint8).tobytes() if bits(ranks) + 8 * (len(order) + 12) < bits(left) else b""


def _samples_of(order: bytes) -> bytes:
    """The sample's byte of each payload byte: ranks 0, 1, 2, 3 are the samples 0, -1, 1, -2, which Rice codes fold back to the ranks."""
    if not order:
        return _SHIFTED
    table = bytearray(256)
    for rank, byte in enumerate(order):
        table[byte] = (rank >> 1 ^ -(rank & 1)) & 0xFF
    return bytes(table)


def _bytes_of(order: bytes) -> bytes:
    """The payload byte of each sample's byte."""
    if not order:
        return _SHIFTED
    table = bytearray(256)
    for rank, byte in enumerate(order):
        table[(rank >> 1 ^ -(rank & 1)) & 0xFF] = byte
    return bytes(table)


def _metadata(kind: int, body: bytes, last: bool = False) -> bytes:
    return bytes([kind | last << 7]) + len(body).to_bytes(3) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of BLOCK bytes); byte b is the sample b - 128, or its rank's in the palette."""
    count = np.array([len(p) // BLOCK for p in payloads], np.int64)
    palettes = [palette(p) for p in payloads]
    raw = np.frombuffer(b"".join(p.translate(_samples_of(o)) for p, o in zip(payloads, palettes)), np.int8)
    samples = raw.reshape(-1, BLOCK)
    number = np.arange(len(samples)) - np.repeat(np.cumsum(count) - count, count)
    parts, sizes = zip(*(encode_frames(samples[i : i + STEP_FRAMES].astype(np.int32), number[i : i + STEP_FRAMES]) for i in range(0, len(samples), STEP_FRAMES)))
    coded, size = b"".join(p.tobytes() for p in parts), np.concatenate(sizes)
    ends, first = np.cumsum(size), np.cumsum(count) - count
    out = []
    for i, (f, n) in enumerate(zip(first.tolist(), count.tolist())):
        own, begin = size[f : f + n], int(ends[f] - size[f])
        offsets = np.cumsum(own) - own
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (RATE << 44 | 7 << 36 | n * BLOCK).to_bytes(8) + hashlib.md5(raw[f * BLOCK : (f + n) * BLOCK].tobytes()).digest()
        seek = b"".join(struct.pack(">QQH", j * BLOCK, int(offsets[j]), BLOCK) for j in range(0, n, SEEK_EVERY))
        order = palettes[i]
        listed = _metadata(APPLICATION, PALETTE + zlib.crc32(order).to_bytes(4) + order, True) if order else b""
        out.append(b"fLaC" + _metadata(INFO, info) + _metadata(SEEK, seek, not order) + listed + coded[begin : int(ends[f + n - 1])])
    return out


def parse(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], bytes]:
    """(offset of the first frame, samples, MD5, seek points as (sample, byte offset from the first frame), payload byte of each sample's byte)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, md5, seek, order, last = 4, 0, b"", [], b"", False
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4])
        block = media[at + 4 : at + 4 + size]
        if kind == INFO:
            total, md5 = int.from_bytes(block[10:18]) & (1 << 36) - 1, block[18:34]
        elif kind == SEEK:
            seek = [struct.unpack(">QQ", block[i : i + 16]) for i in range(0, size, 18)]
        elif kind == APPLICATION and block[:4] == PALETTE:
            order = block[8:]
            if zlib.crc32(order).to_bytes(4) != block[4:8] or len(set(order)) < len(order):
                raise ValueError("palette mismatch")
        at += 4 + size
    return at, total, md5, seek, _bytes_of(order)


def frame_starts(media: bytes, first: int, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of the frames: where the sync code and the next number of the sequence stand with a right CRC-8."""
    data = np.frombuffer(media, np.uint8)
    sync = np.nonzero((data[first:-3] == 0xFF) & (data[first + 1 : -2] == 0xF8) & (data[first + 2 : -1] == 0x14) & (data[first + 3 :] == 0x02))[0] + first
    starts, j = [], 0
    if len(sync) == frames:
        starts = sync
    else:
        numbers, digits = _coded_number(np.arange(frames))
        for at in sync.tolist():
            if j < frames and media[at + 4 : at + 4 + digits[j]] == numbers[j, : digits[j]].tobytes() and _checksum(data, np.array([at]), np.array([5 + digits[j]]), CRC8, 8)[0] == 0:
                starts.append(at)
                j += 1
    starts = np.array(starts, np.int64)
    if len(starts) != frames:
        raise ValueError("frames are missing")
    return starts, np.diff(starts, append=len(media))


def decode(media: list[bytes]) -> list[bytes]:
    """The payloads of streams made by encode(), each frame's checksums and each stream's MD5 verified."""
    starts, sizes, numbers, sums, counts, tables, base = [], [], [], [], [], [], 0
    for m in media:
        first, total, md5, seek, table = parse(m)
        at, size = frame_starts(m, first, total // BLOCK)
        if any(sample % BLOCK or at[sample // BLOCK] - first != offset for sample, offset in seek if sample < total) or any(sample >= total for sample, _ in seek):
            raise ValueError("seek table mismatch")
        starts.append(at + base)
        sizes.append(size)
        numbers.append(np.arange(len(at)))
        sums.append(md5)
        tables.append(table)
        counts.append(total)
        base += len(m)
    data = np.frombuffer(b"".join(media), np.uint8)
    at, size, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, numbers))
    pcm = b"".join(_decode_step(data, at[i : i + STEP_FRAMES], size[i : i + STEP_FRAMES], number[i : i + STEP_FRAMES]) for i in range(0, len(at), STEP_FRAMES))
    out, base = [], 0
    for n, md5, table in zip(counts, sums, tables):
        own = pcm[base : base + n]
        if hashlib.md5(own).digest() != md5:
            raise ValueError("MD5 mismatch")
        out.append(own.translate(table))
        base += n
    return out


def _decode_step(data: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray) -> bytes:
    begin, end = int(at[0]), int(at[-1] + size[-1])
    return decode_frames(data[begin:end], at - begin, size, number).astype(np.int8).tobytes()


def seek_block(media: bytes, sample: int) -> bytes:
    """The payload bytes of the frame that holds a sample, read from the nearest seek point before it."""
    first, total, _md5, points, table = parse(media)
    begin, offset = max((p for p in points if p[0] <= sample), default=(0, 0))
    frame, behind = sample // BLOCK, begin // BLOCK
    tail = media[first + offset :]
    numbers, digits = _coded_number(np.arange(behind, total // BLOCK))
    at, found = 0, []
    for j in range(frame - behind + 2):  # up to the start of the frame after it
        if behind + j == total // BLOCK:
            found.append(len(tail))
            break
        mark = bytes((0xFF, 0xF8, 0x14, 0x02)) + numbers[j, : digits[j]].tobytes()
        at = tail.index(mark, at)
        while _checksum(np.frombuffer(tail, np.uint8), np.array([at]), np.array([len(mark) + 1]), CRC8, 8)[0]:
            at = tail.index(mark, at + 1)
        found.append(at)
        at += 1
    own = tail[found[-2] : found[-1]]
    return _decode_step(np.frombuffer(own, np.uint8), np.array([0]), np.array([len(own)]), np.array([frame])).translate(table)


def write_flac(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes and media (the FLAC stream of the padded text) to the columns `keep` of docs (None: all). Null texts are empty; columns named like a result are replaced."""
    own = Carried(docs, keep, ("n_bytes", "media"))
    schema = T.StructType([*own.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*own.of(part), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema).select(*own.back(), "n_bytes", "media")


def read_blocks(media: DataFrame, column_: str = "media", keep: list[str] | None = None, frames: int = SEEK_EVERY) -> DataFrame:
    """(the columns `keep`, samples, sample_offset, pcm): the PCM blocks of each stream in order, `frames` frames in each, a row a block; samples: of the whole stream.

    Every frame's checksums and the stream's own are verified while it is decoded. Written as a table, a sample is found by
    its offset (read_samples). Null media have no blocks.
    """
    own = Carried(media, keep, ("samples", "sample_offset", "pcm"))
    schema = T.StructType([*own.fields, T.StructField("samples", T.LongType()), T.StructField("sample_offset", T.LongType()), T.StructField("pcm", T.BinaryType())])
    span = frames * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in steps(batches, "_media"):
            some = [i for i, m in enumerate(streams) if m]
            found = decode([streams[i] for i in some]) if some else []
            rows = [(i, len(x), at, x[at : at + span]) for i, x in zip(some, found) for at in range(0, len(x), span)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.take(which) for x in own.of(part)), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.binary())], names=schema.names)

    return media.select(*own.into(), column(column_).alias("_media")).mapInArrow(run, schema).select(*own.back(), "samples", "sample_offset", "pcm")


def read_samples(blocks: DataFrame, first: int, count: int) -> DataFrame:
    """The blocks that hold samples from `first` on, pcm cut to them and sample_offset with it: the offset is a filter that reaches a written table's scan."""
    size = F.length("pcm")
    some = blocks.where((F.col("sample_offset") < first + count) & (F.col("sample_offset") + size > first))
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0)).cast("int")
    until = F.least(F.lit(first + count) - F.col("sample_offset"), size.cast("long")).cast("int")
    return some.withColumns({"pcm": F.substring(F.col("pcm"), skip + 1, until - skip), "sample_offset": F.col("sample_offset") + skip})


class Summary:
    """What is known of a stream's payload after its blocks so far: digest, last bytes, and the sums of its feature."""

    def __init__(self):
        self.digest, self.tail = hashlib.sha256(), b""
        self.n = self.sum = self.square = self.cross = 0
        self.side = None

    def add(self, pcm: bytes) -> None:
        self.digest.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        side = x >= 0
        self.cross += int(np.count_nonzero(side[1:] != side[:-1])) + (self.side is not None and bool(side[0]) != self.side)
        self.n, self.sum, self.square, self.side = self.n + len(x), self.sum + int(x.sum()), self.square + int((x * x).sum()), bool(side[-1])

    def feature(self) -> str:
        """Whole numbers only: samples, their sum and sum of squares about 128, and changes of side."""
        return f"n={self.n};sum={self.sum};square={self.square};cross={self.cross}"


def describe_blocks(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, payload_bytes, payload_sha256, tail_crc32, feature) of each stream of read_blocks(): its blocks stand in order in one task, so that one row after another is added up."""
    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType())]
    own = Carried(blocks, keep, ())
    schema = T.StructType([*own.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Summary()
        for batch in batches:
            samples, offsets, pcm = (batch.column(len(own.names) + k).to_pylist() for k in range(3))
            last, rows = [], []
            for i, (total, at, block) in enumerate(zip(samples, offsets, pcm)):
                if at != state.n:
                    raise ValueError("blocks out of order")
                state.add(block)
                if state.n == total:
                    last.append(i)
                    rows.append((total, state.digest.hexdigest(), zlib.crc32(state.tail), state.feature()))
                    state = Summary()
            which = pa.array(last, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.take(which) for x in own.of(batch)), *(pa.array([r[k] for r in rows], pa.string() if k % 2 else pa.int64()) for k in range(4))], names=schema.names)

    return blocks.select(*own.into(), "samples", "sample_offset", "pcm").mapInArrow(run, schema).select(*own.back(), *(n for n, _ in added))


def media_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Store each text as FLAC in a table's media column, read its PCM blocks back from that table with all checks, and describe both.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature to the columns `keep` of
    docs (None: all); columns with these names are replaced, whatever their case. Null and empty texts are 192 blanks;
    equal texts give equal values; a damaged stream raises; an empty table gives an empty result. Bounded by a step of
    texts, or one text where that is larger. Nothing is shuffled.

    The table is written to `path`, or to the folder of spark.checkpoint.dir without one. PCM blocks go from there to the
    features in one stage; read_blocks() gives them as rows, to be written as a table too.
    """
    added = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    own = Carried(docs, keep, added)
    inner = docs.select(*own.into(), column(text).alias("_text"))
    stored = write_flac(inner, "_text", own.inner)
    if path:
        stored.write.parquet(path)
        stored = docs.sparkSession.read.schema(stored.schema).parquet(path)
    else:
        stored = stage(stored, "media")
    named = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    about = [*own.inner, "n_bytes", "media_bytes", "media_sha256"]
    return describe_blocks(read_blocks(named, "media", about), about).select(*own.back(), *added)
