"""Operator 4: media columns in FLAC.

`encode` stores bytes losslessly as 8-bit mono samples (a byte less 128) in a FLAC stream: STREAMINFO with the samples'
MD5, a SEEKTABLE with a point for every frame, and frames of up to `BLOCK` samples whose subframes are constant, verbatim,
a fixed predictor of order 0 to 2 or a linear predictor of order 1 or 2, with partitioned Rice residuals. `decode` reads a
stream back: it parses metadata, checks the headers' CRC-8 and the frames' CRC-16, decodes Rice residuals and fixed or linear
predictors (any order, any coefficients), compares the MD5 and returns PCM blocks with their sample offsets. Without a full seek
table the frames are found by their sync codes and checksums. `read_at` decodes only the frames that hold the samples asked for.
Whatever is damaged raises `Broken`. Both directions work on `RUN` frames of many streams at once, a sample of every frame at a time, in numpy.

`pcm_blocks` writes the decoded samples as blocks with their offsets; features and `samples` read from those.

A null text counts as empty; an empty text is 64 zero bytes. Null doc_ids and repeated rows are kept as they are. Texts
are stored whole; memory follows blocks of about 2 MB of text, or a longer text's own size and its stream's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import by_bytes, spans

BLOCK = 1024
RUN = 512  # frames that are worked on at once
RATE = 8000
UNIT = 64
LPC_PRECISION = 8
POINT = [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]  # of a seek table
MOST_POINTS = ((1 << 24) - 1) // 18
WARM = np.array([0, 1, 2, 1, 2])  # warm-up samples of the predictors that are written: fixed 0 to 2, linear 1 and 2


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = np.zeros(256, dtype=np.int64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        table[i] = c
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each stretch of data: the longest first, so that those still open are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    c = np.zeros(len(s), dtype=np.int64)
    open_ = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # how many are longer than i
    for i, k in enumerate(open_):
        byte = data[s[:k] + i]
        c[:k] = ((c[:k] << 8) & 0xFFFF) ^ table[(c[:k] >> 8) ^ byte] if bits == 16 else table[c[:k] ^ byte]
    out = np.empty_like(c)
    out[order] = c
    return out


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out, first = [], 0x3F
    while n > first:
        out.append(0x80 | (n & 0x3F))
        n >>= 6
        first >>= 1
    return bytes([((~first << 1) & 0xFF) | n, *out[::-1]])


# ---------------------------------------------------------------- encoding


def residuals(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predictor of each frame, its residuals, quantised coefficients of the linear predictor). x: frames x BLOCK.

    Predictors 0, 1, 2 are the fixed ones of that order; 3 and 4 are linear of order 1 and 2 with a shift of LPC_PRECISION - 2 bits.
    """
    n = valid.sum(axis=1)
    first = np.zeros_like(x)
    first[:, 1:] = x[:, 1:] - x[:, :-1]
    second = np.zeros_like(x)
    second[:, 2:] = first[:, 2:] - first[:, 1:-1]
    shift = LPC_PRECISION - 2
    quantised = lambda c: np.clip(np.round(c * (1 << shift)), -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1).astype(np.int32)
    y = np.where(valid, x, 0).astype(np.float64)
    now, one, two = y[:, 2:], y[:, 1:-1] * valid[:, 2:], y[:, :-2] * valid[:, 2:]
    product = lambda a, b: (a * b).sum(axis=1)
    c11, c12, c22, c01, c02 = product(one, one), product(one, two), product(two, two), product(now, one), product(now, two)
    alone = quantised(c01 / np.maximum(c11, 1))
    det = c11 * c22 - c12 * c12
    safe = np.where(det > 1e-6 * np.maximum(c11 * c22, 1), det, np.inf)
    pair = quantised((c01 * c22 - c02 * c12) / safe), quantised((c02 * c11 - c01 * c12) / safe)
    linear, linear_two = np.zeros_like(x), np.zeros_like(x)
    linear[:, 1:] = x[:, 1:] - ((x[:, :-1] * alone[:, None]) >> shift)
    linear_two[:, 2:] = x[:, 2:] - ((x[:, 1:-1] * pair[0][:, None] + x[:, :-2] * pair[1][:, None]) >> shift)
    candidates = [x, first, second, linear, linear_two]
    cost = np.stack([(np.abs(r[:, w:]) * valid[:, w:]).sum(axis=1) for r, w in zip(candidates, WARM, strict=True)])
    cost = cost + np.array([0, 8, 16, 25, 41])[:, None] // 2
    best = cost.argmin(axis=0)
    best[n <= 2] = 0
    chosen = np.choose(best[:, None], candidates)
    return best, chosen, np.stack([np.where(best == 4, pair[0], alone), np.where(best == 4, pair[1], 0)])


class Bits:
    """Bits written at given places, each once, summed up in 32-bit words."""

    def __init__(self, n: int):
        self.words = np.zeros((n >> 5) + 2, dtype=np.uint64)

    def put(self, at: np.ndarray, value: np.ndarray, width) -> None:
        """The `width` (up to 32) low bits of each value from its place on."""
        word = value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        np.add.at(self.words, at >> 5, word >> np.uint64(32))
        np.add.at(self.words, (at >> 5) + 1, word & np.uint64(0xFFFFFFFF))

    def packed(self, n: int) -> np.ndarray:
        return np.frombuffer(self.words.astype(">u4").tobytes(), dtype=np.uint8)[:n].copy()


def encode_frames(data: np.ndarray, begin: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(frames one after another, length of each): frame i has the n[i] bytes of data from begin[i] on."""
    place = np.arange(BLOCK)
    valid = place < n[:, None]
    x = np.where(valid, data[np.minimum(begin[:, None] + place, len(data) - 1)].astype(np.int32) - 128, 0)
    constant = (np.where(valid, x, x[:, :1]) == x[:, :1]).all(axis=1)
    kind, r, coefficients = residuals(x, valid)
    warm = WARM[kind]
    linear, order = kind >= 3, np.where(kind >= 3, kind - 2, 0)
    coded = valid & (place >= warm[:, None]) & ~constant[:, None]
    u = np.where(coded, (r << 1) ^ (r >> 31), 0)
    m = coded.sum(axis=1)
    # the Rice parameter with the fewest bits, around the mean's logarithm
    mean = u.sum(axis=1) / np.maximum(m, 1)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 12)
    options = np.stack([np.clip(guess + d, 0, 14) for d in (-1, 0, 1)])
    bits = np.stack([((u >> k[:, None].astype(np.int32)) * coded).sum(axis=1) + m * (1 + k) for k in options])
    k = options[bits.argmin(axis=0), np.arange(len(n))]
    rice_bits = bits.min(axis=0)
    described = np.where(linear, 4 + 5 + LPC_PRECISION * order, 0)
    subframe = described + 8 * warm + 2 + 4 + 4 + rice_bits
    verbatim = ~constant & (subframe >= 8 * n)
    subframe = np.where(constant, 8, np.where(verbatim, 8 * n, subframe))

    # frame headers: sync and fixed block size, block size code 6 or 7 (or 1024), rate from STREAMINFO, mono, 8 bits
    heads = []
    for i in range(len(n)):
        code = 0x7 if n[i] > 256 and n[i] != 1024 else 0xA if n[i] == 1024 else 0x6
        tail = b"" if n[i] == 1024 else int(n[i] - 1).to_bytes(2 if code == 7 else 1, "big")
        heads.append(bytes([0xFF, 0xF8, code << 4, 0x02]) + utf8_number(int(number[i])) + tail)
    head_len = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
    head_data = np.frombuffer(b"".join(heads), dtype=np.uint8)
    head_at = np.cumsum(head_len) - head_len
    crc8 = crcs(head_data, head_at, head_len, CRC8, 8)
    body = head_len + 1 + (8 + subframe + 7) // 8
    frame_len = body + 2
    at = np.cumsum(frame_len) - frame_len
    out = Bits(int(frame_len.sum()) * 8)
    p = (at + head_len + 1) * 8
    type_code = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31 + order, 8 + kind)))
    out.put(p, type_code << 1, 8)
    p = p + 8
    out.put(p[constant], x[constant, 0] & 0xFF, 8)
    rows, cols = np.nonzero(valid & verbatim[:, None])
    out.put(p[rows] + 8 * cols, x[rows, cols] & 0xFF, 8)
    predicted = ~constant & ~verbatim
    for j in range(2):
        on = predicted & (warm > j)
        out.put(p[on] + 8 * j, x[on, j] & 0xFF, 8)
    p = p + 8 * warm
    on = predicted & linear
    out.put(p[on], np.full(on.sum(), LPC_PRECISION - 1), 4)
    out.put(p[on] + 4, np.full(on.sum(), LPC_PRECISION - 2), 5)
    for j in range(2):
        on = predicted & (order > j)
        out.put(p[on] + 9 + LPC_PRECISION * j, coefficients[j, on] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    p = p + described
    out.put(p[predicted] + 6, k[predicted], 4)  # method 0 and partition order 0 before it
    p = p + 10
    mask = coded & predicted[:, None]
    held = mask.sum(axis=1)
    value, param = u[mask].astype(np.int64), np.repeat(k, held)
    length = (value >> param) + 1 + param
    total = np.cumsum(length)
    starts = np.concatenate([[0], total])[np.cumsum(held) - held]
    # a one and the low bits, after as many zeros as the value's high part
    out.put(np.repeat(p - starts, held) + total - 1 - param, (1 << param) | (value & ((1 << param) - 1)), param + 1)
    packed = out.packed(int(frame_len.sum()))
    index = np.repeat(at, head_len) + spans(head_len)
    packed[index] = head_data
    packed[at + head_len] = crc8
    crc16 = crcs(packed, at, body, CRC16, 16)
    packed[at + body], packed[at + body + 1] = crc16 >> 8, crc16 & 0xFF
    return packed.tobytes(), frame_len


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (bytes, none empty)."""
    sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    frames_of = -(-sizes // BLOCK)
    number = spans(frames_of)
    n = np.minimum(BLOCK, np.repeat(sizes, frames_of) - number * BLOCK)
    begin = np.repeat(np.cumsum(sizes) - sizes, frames_of) + number * BLOCK
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    runs = [encode_frames(data, begin[a : a + RUN], n[a : a + RUN], number[a : a + RUN]) for a in range(0, len(n), RUN)]
    frame_len = np.concatenate([r[1] for r in runs]) if runs else np.empty(0, dtype=np.int64)
    view = memoryview(b"".join(r[0] for r in runs))
    at = np.cumsum(frame_len) - frame_len
    result = []
    edges = np.concatenate([[0], np.cumsum(frames_of)])
    for i, payload in enumerate(payloads):
        a, b = edges[i], edges[i + 1]
        lens, lo = frame_len[a:b], int(at[a])
        points = np.zeros(b - a, dtype=POINT)
        points["sample"], points["offset"], points["n"] = number[a:b] * BLOCK, at[a:b] - lo, n[a:b]
        samples = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        packed_info = (RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        info = BLOCK.to_bytes(2, "big") * 2 + int(lens.min()).to_bytes(3, "big") + int(lens.max()).to_bytes(3, "big") + packed_info.to_bytes(8, "big") + hashlib.md5(samples).digest()
        # a table of more points than a block can hold has those of every second frame, or fewer; readers find the others
        points = points[:: -(-len(points) // MOST_POINTS)]
        table = points.tobytes()
        result.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + bytes(view[lo : lo + int(lens.sum())]))
    return result


# ---------------------------------------------------------------- decoding


#: Leading zeros of 16 bits.
CLZ16 = np.array([16, *(16 - i.bit_length() for i in range(1, 1 << 16))], dtype=np.int64)
MASK40 = np.uint64((1 << 40) - 1)


class Reader:
    """Places in a bit string, one for each frame."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        # 40 bits from each byte on
        self.words = sum((padded[i : len(padded) - 7 + i] << np.uint64(32 - 8 * i)) for i in range(5))

    def bits(self, at: np.ndarray, width) -> np.ndarray:
        """`width` bits (up to 32) from each place."""
        width = np.asarray(width, dtype=np.uint64)
        word = self.words[at >> 3] >> (np.uint64(40) - (at & 7).astype(np.uint64) - width)
        return (word & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unsigned value, place after it) of the Rice code at each place."""
        word = (self.words[at >> 3] << (at & 7).astype(np.uint64)) & MASK40
        zeros = CLZ16[word >> np.uint64(24)]
        low = ((word << (zeros + 1).astype(np.uint64)) & MASK40) >> (40 - k).astype(np.uint64)
        u, after = (zeros << k) | low.astype(np.int64), at + zeros + 1 + k
        if (zeros == 16).any():
            for i in np.flatnonzero(zeros == 16):  # a long run of zeros
                one = int(at[i])
                while not self.data[one >> 3] & (0x80 >> (one & 7)):
                    one += 1
                low = self.bits(np.array([one + 1]), np.array([k[i]]))[0]
                u[i], after[i] = (one - at[i]) << k[i] | low, one + 1 + k[i]
        return u, after


class Broken(ValueError):
    """A stream that is not what its checksums say."""


def signed(value: np.ndarray, width) -> np.ndarray:
    return value - ((value >> (np.asarray(width) - 1) & 1) << np.asarray(width))


def header(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a frame header with a right checksum is there, samples, header length without the checksum, frame number) at each place.
    data has 16 bytes more than its last frame needs."""
    ok = (data[at] == 0xFF) & (data[at + 1] == 0xF8) & (data[at + 3] == 0x02)
    # the frame number in UTF-8 form, then the block size
    lead = data[at + 4]
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], range(6), 6)
    number = np.where(more == 0, lead, lead & (0x3F >> np.minimum(more, 6))).astype(np.int64)
    for j in range(6):
        number = np.where(more > j, number << 6 | data[at + 5 + j] & 0x3F, number)
    code = data[at + 2] >> 4
    size_at = at + 5 + more
    n = np.where(code == 6, data[size_at].astype(np.int64) + 1, np.where(code == 7, (data[size_at].astype(np.int64) << 8 | data[size_at + 1]) + 1, np.where(code >= 8, 256 << (np.maximum(code, 8).astype(np.int64) - 8), np.where(code == 1, 192, 576 << (np.clip(code, 2, 5).astype(np.int64) - 2)))))
    head = 5 + more + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    ok &= (code > 0) & (crcs(data, at, head, CRC8, 8) == data[at + head])
    return ok, n, head, number


def metadata(stream: bytes) -> tuple[int, bytes, int, np.ndarray | None, tuple[int, int, int, int]]:
    """(samples, their MD5, place of the first frame, a full seek table or None, least and greatest block and frame sizes) of a stream."""
    if stream[:4] != b"fLaC":
        raise Broken("no FLAC stream")
    p, last, points, total, digest, sizes = 4, False, None, None, b"", (0, 0, 0, 0)
    while not last:
        last, kind, size = bool(stream[p] & 0x80), stream[p] & 0x7F, int.from_bytes(stream[p + 1 : p + 4], "big")
        block = stream[p + 4 : p + 4 + size]
        if kind == 127 or len(block) < size:
            raise Broken("metadata beyond the stream")
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if total is not None or size != 34 or packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise Broken("not 8-bit mono")
            total, digest = packed & ((1 << 36) - 1), block[18:34]
            sizes = tuple(int.from_bytes(block[i:j], "big") for i, j in ((0, 2), (2, 4), (4, 7), (7, 10)))
        elif kind == 3:
            points = np.frombuffer(block, dtype=POINT)
        p += 4 + size
    if not total:
        raise Broken("no samples")
    if points is not None and (not len(points) or int(points["n"].sum(dtype=np.int64)) != total):
        points = None  # placeholders, or fewer points than frames
    return total, digest, p, points, sizes


def frames(streams: list[bytes], data: np.ndarray) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples and MD5 of each stream; place in data, length, samples and stream of every frame). data: the streams one after another and 16 bytes more."""
    found = [metadata(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    begins, stops = base[:-1] + np.array([f[2] for f in found]), base[1:]
    starts, told, owner = [], [], []
    for i, (total, _, _, points, _) in enumerate(found):
        if points is None:
            at = np.array(scanned(np.concatenate([data[begins[i] : stops[i]], np.zeros(16, dtype=np.uint8)]), total), dtype=np.int64)
            n = np.full(len(at), -1)
        else:
            at, n = points["offset"].astype(np.int64), points["n"].astype(np.int64)
            if int(points["sample"][-1]) != total - int(n[-1]):
                raise Broken("the seek table's samples do not follow each other")
        starts.append(at + begins[i])
        told.append(n)
        owner.append(np.full(len(at), i))
    at, told, owner = np.concatenate(starts), np.concatenate(told), np.concatenate(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    inner = np.diff(owner) == 0
    if (at[first] != begins).any() or (np.diff(at)[inner] <= 0).any() or (at >= stops[owner]).any():
        raise Broken("frames that are not in order")
    ok, n, _, number = header(data, at)
    total = np.array([f[0] for f in found])
    if not ok.all() or (number != np.arange(len(at)) - first[owner]).any() or (np.add.reduceat(n, first) != total).any() or ((told >= 0) & (n != told)).any():
        raise Broken("a frame header is not what it should be")
    length = np.append(at[1:], 0) - at
    length[last] = stops - at[last]
    least, most, small, large = np.array([f[4] for f in found]).T
    wrong = lambda known, seen: ((known != 0) & (known != seen)).any()
    if wrong(small, np.minimum.reduceat(length, first)) or wrong(large, np.maximum.reduceat(length, first)):
        raise Broken("frames of other sizes than STREAMINFO says")
    inside = np.ones(len(at), dtype=bool)
    inside[last] = False
    if (least != most).any() or (n[inside] != least[owner[inside]]).any() or (n[last] > least).any():
        raise Broken("blocks of other sizes than STREAMINFO says")
    return total.tolist(), [f[1] for f in found], at, length, n, owner


def scanned(data: np.ndarray, total: int) -> list[int]:
    """The frames' places by their sync codes: one that follows ends the one before, if that one's checksum is right there."""
    body = data[:-16]
    sync = np.flatnonzero((body[:-1] == 0xFF) & (body[1:] == 0xF8))
    sync = sync[sync + 16 <= len(data)]
    ok, n, _, number = header(data, sync)
    places, begin, done = [], 0, 0
    for at, samples, i in zip(sync[ok].tolist(), n[ok].tolist(), number[ok].tolist(), strict=True):
        if i == len(places) and (not places or at > begin + 2 and crcs(data, np.array([begin]), np.array([at - 2 - begin]), CRC16, 16)[0] == (int(data[at - 2]) << 8 | int(data[at - 1]))):
            places.append(at)
            begin, done = at, done + samples
    if done != total:
        raise Broken("the frames do not reach every sample")
    return places


def decode_frames(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> bytes:
    """The samples plus 128 of all frames one after another."""
    data = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    ok, n, head, _ = header(data, at)
    if not ok.all():
        raise Broken("a frame header's checksum is wrong")
    order = np.argsort(-n, kind="stable")  # the frames that have a sample i are a prefix
    at_o, n_o, head_o, length_o = at[order], n[order], head[order], length[order]
    reader = Reader(data)
    p = (at_o + head_o + 1) * 8
    kind = reader.bits(p, 8) >> 1
    if (reader.bits(p, 8) & 1).any():
        raise Broken("wasted bits are not used here")
    p = p + 8
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise Broken("unknown subframe")
    warm = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    x = np.zeros((int(n_o.max(initial=1)), len(n_o)), dtype=np.int32)  # a row for each place in a frame
    x[:, constant] = signed(reader.bits(p[constant], 8), 8)
    for j in range(int(warm.max(initial=0))):
        on = warm > j
        x[j, on] = signed(reader.bits(p[on] + 8 * j, 8), 8)
    p = p + 8 * warm
    on = np.flatnonzero(verbatim)
    for i in range(int(n_o[on].max(initial=0))):
        on = on[n_o[on] > i]
        x[i, on] = signed(reader.bits(p[on] + 8 * i, 8), 8)
    p = np.where(verbatim, p + 8 * n_o, p)
    most = int(warm.max(initial=0))
    coefficients = np.zeros((max(most, 1), len(n_o)), dtype=np.int64)
    fixed_rows = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values of the format
    for w, row in enumerate(fixed_rows[: most + 1]):
        for j, c in enumerate(row):
            coefficients[j, fixed & (warm == w)] = c
    precision = np.where(linear, reader.bits(p, 4) + 1, 0)
    shift = np.where(linear, signed(reader.bits(p + 4, 5), 5), 0)
    if (shift < 0).any():
        raise Broken("a negative shift")
    p = np.where(linear, p + 9, p)
    for j in range(most):
        on = linear & (warm > j)
        coefficients[j, on] = signed(reader.bits(p[on] + precision[on] * j, precision[on]), precision[on])
    p = p + np.where(linear, precision * warm, 0)
    coded = np.flatnonzero(fixed | linear)  # by falling size, so the frames with a sample i are a prefix
    c_p, c_n, c_warm, c_shift, c_coef, lane = p[coded], n_o[coded], warm[coded], shift[coded], coefficients[:, coded], x[:, coded]
    method = reader.bits(c_p, 2)
    if (method > 1).any():
        raise Broken("unknown residual coding")
    partitions = reader.bits(c_p + 2, 4)
    c_p = c_p + 6
    per = c_n >> partitions  # samples of a partition
    param, raw, escaped = np.zeros((3, len(coded)), dtype=np.int64)  # raw: an escaped partition's bits a sample
    counts = np.searchsorted(-c_n, -np.arange(len(x)), "left")
    several = bool(partitions.any())
    if (c_n & ((1 << partitions) - 1)).any() or (per < c_warm).any():
        raise Broken("partitions that do not fit the frame")
    for i in range(len(x)):
        c = counts[i]
        if not c:
            break
        on = slice(0, c) if i >= most else np.flatnonzero(i >= c_warm[:c])
        if i <= most or several:
            turn = np.arange(c)[on]
            turn = turn[(i % per[turn] == 0) | (i == c_warm[turn])]
            width = 4 + method[turn]
            param[turn] = reader.bits(c_p[turn], width)
            c_p[turn] += width
            escaped[turn] = param[turn] == (1 << width) - 1
            esc = turn[escaped[turn] == 1]
            raw[esc] = reader.bits(c_p[esc], 5)
            param[esc] = 0
            c_p[esc] += 5
        place = c_p[on]
        value, after = reader.rice(place, param[on])
        value = (value >> 1) ^ -(value & 1)
        if escaped[on].any():
            esc = np.flatnonzero(escaped[on])
            width = raw[on][esc]
            value[esc] = np.where(width > 0, signed(reader.bits(place[esc], width), np.maximum(width, 1)), 0)
            after[esc] = place[esc] + width
        c_p[on] = after
        guess = 0
        for j in range(min(most, i)):
            guess = guess + c_coef[j, on] * lane[i - 1 - j, on]
        lane[i, on] = value + (guess >> c_shift[on])
    x[:, coded] = lane
    p[coded] = c_p
    end = np.where(constant, p + 8, p)
    end = -(-end // 8)
    if (end + 2 != at_o + length_o).any():
        raise Broken("a frame of another length than its place says")
    crc = crcs(data, at_o, end - at_o, CRC16, 16)
    if (crc != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
        raise Broken("a frame's checksum is wrong")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    pcm = (x + 128).astype(np.uint8).T[back]
    return pcm[np.arange(pcm.shape[1]) < n[:, None]].tobytes()


def guarded(f):
    """Damage of any kind is `Broken`: a wrong length or place shows itself in many ways."""

    def run(*args):
        try:
            return f(*args)
        except Broken:
            raise
        except (IndexError, ValueError, OverflowError, MemoryError) as error:
            raise Broken(f"the stream is damaged: {error}") from error

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@guarded
def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(samples as bytes plus 128, [(sample offset, samples) of each frame]) of each stream."""
    if not streams:
        return []
    data = np.frombuffer(b"".join(streams) + bytes(16), dtype=np.uint8)
    total, digest, at, length, n, owner = frames(streams, data)
    pieces = []
    for a in range(0, len(at), RUN):
        some, lens = at[a : a + RUN], length[a : a + RUN]
        lo, hi = int(some[0]), int(some[-1] + lens[-1])
        pieces.append(decode_frames(data[lo:hi], some - lo, lens))
    view, done, result = memoryview(b"".join(pieces)), 0, []
    edges = np.searchsorted(owner, np.arange(len(streams) + 1))
    for i, size in enumerate(total):
        payload = bytes(view[done : done + size])
        done += size
        if hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest() != digest[i]:
            raise Broken("the samples' MD5 is wrong")
        sizes = n[edges[i] : edges[i + 1]]
        result.append((payload, list(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True))))
    return result


@guarded
def read_at(stream: bytes, first: int, count: int) -> bytes:
    """`count` samples (bytes plus 128) from sample `first` on, fewer at the end: only the frames that hold them are decoded."""
    data = np.frombuffer(stream + bytes(16), dtype=np.uint8)
    (total,), _, at, length, n, _ = frames([stream], data)
    first, last = max(first, 0), min(first + count, total)
    if first >= last:
        return b""
    ends = np.cumsum(n)
    a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last - 1, "right")) + 1
    pieces = []
    for i in range(a, b, RUN):
        j = min(i + RUN, b)
        pieces.append(decode_frames(data[at[i] : at[j - 1] + length[j - 1]], at[i:j] - at[i], length[i:j]))
    begin = int(ends[a] - n[a])
    return b"".join(pieces)[first - begin : last - begin]


# ---------------------------------------------------------------- columns


BLOCKS = "array<struct<sample: long, pcm: binary>>"


def media_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded with zeros to a positive multiple of UNIT, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, most=2 << 20):
            raw = [b or b"" for b in batch.column(text).cast(pa.large_binary()).to_pylist()]
            padded = [b + bytes(max(-len(b) % UNIT, UNIT if not b else 0)) for b in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(encode(padded), pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, blocks: the decoded samples as blocks with their offsets, for a table as `media_column` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", most=2 << 20):
            streams = batch.column("media").to_pylist()
            read = decode(streams)
            frames = np.array([f for _, fs in read for f in fs], dtype=np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum(frames[:, 1])])
            pcm = pa.Array.from_buffers(pa.large_binary(), len(frames), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(p for p, _ in read))]).cast(pa.binary())
            edges = np.concatenate([[0], np.cumsum([len(fs) for _, fs in read])])
            blocks = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(frames[:, 0]), pcm], ["sample", "pcm"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(list(map(len, streams)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in streams]), blocks],
                ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks {BLOCKS}")


def samples(first: int, count: int, blocks: str = "blocks"):
    """A column of `count` samples from sample `first` on: the blocks that hold them are cut, others are not read."""
    have = F.filter(blocks, lambda b: (b["sample"] < first + count) & (b["sample"] + F.length(b["pcm"]) > first))
    part = lambda b: F.substring(b["pcm"], (F.greatest(F.lit(first) - b["sample"], F.lit(0)) + 1).cast("int"), F.least(F.lit(first + count) - b["sample"], F.lit(count)).cast("int"))
    return F.aggregate(F.transform(have, part), F.lit(b""), lambda s, x: F.concat(s, x))


def features(blocks: DataFrame) -> DataFrame:
    """The contract's columns, from samples that were read back (`pcm_blocks`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, made = batch.column("blocks"), []
            edges = column.offsets.to_numpy() - column.offsets[0].as_py()
            pcm = column.flatten().flatten()[1]
            ends = np.frombuffer(pcm.buffers()[1], dtype=np.int32)[pcm.offset : pcm.offset + len(pcm) + 1] if len(pcm) else np.zeros(1, dtype=np.int32)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                payload = bytes(pcm.buffers()[2][int(ends[a]) : int(ends[b])])
                x = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).view(np.int8)
                below, wide = x < 0, x.astype(np.int32)
                crossings = int(np.count_nonzero(below[1:] != below[:-1]))
                feature = f"frames={b - a};sum={int(wide.sum(dtype=np.int64))};energy={int((wide * wide).sum(dtype=np.int64))};peak={int(np.abs(wide).max())};crossings={crossings}"
                made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature))
            size, sha, crc, feature = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(feature, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return blocks.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return features(pcm_blocks(media_column(docs)))
