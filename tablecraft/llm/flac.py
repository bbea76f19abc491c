"""FLAC streams of 8-bit mono samples, coded and decoded many frames at a time.

Frames are independent, and the seek table says where each begins, so the
decoder works on lanes: step ``i`` reads residual ``i`` of every frame of a
batch. A lane's Rice code is a run of zeros, a one and a few low bits, read
from a 64-bit window at the lane's bit position. Fixed predictors are undone
by running sums, general linear predictors sample by sample across the lanes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK = 1024
RATE = 8000
LANES = 2048
_U = np.uint64


def _table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ polynomial if x & top else x << 1
        out.append(x & mask)
    return np.array(out, dtype=np.uint16)


#: Fixed values of the format: generators x^8+x^2+x+1 and x^16+x^15+x^2+1.
_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


class CorruptFlac(ValueError):
    """A stream whose marks, checksums or digests do not fit."""


def crc8(data: bytes) -> int:
    x = 0
    for byte in data:
        x = _CRC8_LIST[x ^ byte]
    return x


def crc16_lanes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of ``data[start:start + length]`` for every lane."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    x = np.zeros(len(order), dtype=np.uint16)
    n = len(order)
    for i in range(int(left[0]) if n else 0):
        while left[n - 1] <= i:
            n -= 1
        x[:n] = (x[:n] << 8) ^ _CRC16[(x[:n] >> 8) ^ data[at[:n] + i]]
    out = np.empty_like(x)
    out[order] = x
    return out


def _number(n: int) -> bytes:
    """A frame number in the variable-length code of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    head = (0xFF << (7 - more)) & 0xFF | n >> (6 * more)
    return bytes([head, *(0x80 | n >> (6 * k) & 0x3F for k in range(more - 1, -1, -1))])


def _header(number: int, n: int) -> bytes:
    full = n == BLOCK
    head = bytes([0xFF, 0xF8, 0xA4 if full else 0x74, 0x02]) + _number(number)  # 1024 or stated; 8 kHz; mono, 8 bits
    if not full:
        head += (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _metadata(payload: bytes, sizes: np.ndarray, lengths: list[int]) -> bytes:
    info = BLOCK.to_bytes(2, "big") * 2 + int(min(sizes)).to_bytes(3, "big") + int(max(sizes)).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big")
    info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    points = np.zeros(len(sizes), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"] = np.arange(len(sizes)) * BLOCK
    points["offset"][1:] = np.cumsum(sizes)[:-1]
    points["n"] = lengths
    table = points.tobytes()
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, none of them empty; a byte is a sample plus 128."""
    streams: list[bytes] = []
    run: list[bytes] = []
    frames = 0
    for payload in payloads:
        run.append(payload)
        frames += -(-len(payload) // BLOCK)
        if frames >= LANES:
            streams += _encode(run)
            run, frames = [], 0
    return streams + (_encode(run) if run else [])


def _encode(payloads: list[bytes]) -> list[bytes]:
    chunks = [(p, k) for p in payloads for k in range(0, len(p), BLOCK)]
    lengths = np.array([min(BLOCK, len(p) - k) for p, k in chunks])
    heads = [_header(k // BLOCK, int(n)) for (_, k), n in zip(chunks, lengths, strict=True)]
    sizes: list[np.ndarray] = []
    bodies: list[bytes] = []
    for i in range(0, len(chunks), LANES):
        some = slice(i, i + LANES)
        x = np.zeros((len(lengths[some]), BLOCK), dtype=np.int32)
        for row, (p, k) in zip(x, chunks[some], strict=True):
            part = np.frombuffer(p, np.uint8, min(BLOCK, len(p) - k), k)
            row[: len(part)] = part
        size, body = _frames(x - 128, lengths[some], heads[some])
        sizes.append(size)
        bodies.append(body)
    size, body = np.concatenate(sizes), b"".join(bodies)
    out, frame, at = [], 0, 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        own = size[frame : frame + n]
        end = at + int(own.sum())
        out.append(_metadata(p, own, lengths[frame : frame + n].tolist()) + body[at:end])
        frame, at = frame + n, end
    return out


def _frames(x: np.ndarray, lengths: np.ndarray, heads: list[bytes]) -> tuple[np.ndarray, bytes]:
    """The frames of blocks ``x`` (rows, padded): their sizes and bytes."""
    rows, columns = x.shape
    inside = np.arange(columns)[None, :] < lengths[:, None]
    best_sum, order, residual = None, np.zeros(rows, dtype=np.int64), x
    diff = x
    for p in range(5):
        if p:
            diff = np.diff(diff, axis=1, prepend=0)
        valid = inside & (np.arange(columns)[None, :] >= p)
        total = np.where(valid, np.abs(diff), 0).sum(axis=1) + 8 * p
        better = np.full(rows, True) if best_sum is None else total < best_sum
        best_sum = total if best_sum is None else np.where(better, total, best_sum)
        order = np.where(better, p, order)
        residual = np.where(better[:, None], diff, residual)
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    coded = inside & (np.arange(columns)[None, :] >= order[:, None])
    folded = np.where(coded, folded, 0)
    n = lengths - order
    costs = np.stack([n * (1 + k) + (folded >> k).sum(axis=1) for k in range(9)])
    k = costs.argmin(axis=0)
    rice_bits = 18 + 8 * order + costs.min(axis=0)
    verbatim = rice_bits >= 8 + 8 * lengths
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    verbatim &= ~constant
    rice = ~constant & ~verbatim
    bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * lengths, rice_bits))
    head = np.array([len(h) for h in heads])
    size = head + -(-bits // 8) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.zeros(int(size.sum()) * 8, dtype=np.uint8)
    data = lambda at, value, width: [out.__setitem__(at + j, value >> (width - 1 - j) & 1) for j in range(width)]
    body = (start + head) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, 8 + order))
    data(body, kind << 1, 8)
    data(body[constant] + 8, x[constant, 0] & 0xFF, 8)
    for row in np.flatnonzero(verbatim):
        at = body[row] + 8
        part = (x[row, : lengths[row]] & 0xFF).astype(np.uint8)
        out[at : at + 8 * len(part)] = np.unpackbits(part)
    for p in range(1, 5):
        for j in range(p):
            own = rice & (order == p)
            data(body[own] + 8 + 8 * j, x[own, j] & 0xFF, 8)
    method = body + 8 + 8 * order
    data(method[rice] + 6, k[rice], 4)
    coded &= rice[:, None]
    value = folded[coded]
    each = np.repeat(np.arange(rows), coded.sum(axis=1))
    low = k[each]
    width = (value >> low) + 1 + low
    ends = np.cumsum(width)
    counts = coded.sum(axis=1)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before = np.concatenate([[0], ends])[first]
    stop = (method + 10 - before)[each] + ends - low - 1
    out[stop] = 1
    for j in range(8):
        has = low > j
        if not has.any():
            break
        out[(stop + 1 + j)[has]] = (value >> (low - 1 - j).clip(0) & 1)[has]
    packed = np.packbits(out)
    for at, h in zip(start.tolist(), heads, strict=True):
        packed[at : at + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16_lanes(packed, start, size - 2)
    packed[start + size - 2] = check >> 8
    packed[start + size - 1] = check & 0xFF
    return size, packed.tobytes()


@dataclass
class Stream:
    samples: int
    digest: bytes
    points: np.ndarray  # first sample, offset, samples of each frame
    frames: int  # where frames begin


def parse(media: bytes) -> Stream:
    """Metadata of a stream; it must have a seek point for every frame."""
    if media[:4] != b"fLaC":
        raise CorruptFlac("no FLAC mark")
    at, last, info, points = 4, False, None, None
    while not last:
        last, kind = media[at] >> 7, media[at] & 0x7F
        n = int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + n]
        if kind == 0:
            info = block
        elif kind == 3:
            points = np.frombuffer(block, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        at += 4 + n
    if info is None or points is None:
        raise CorruptFlac("no stream information or seek table")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 0xFF != 7:
        raise CorruptFlac("not mono with 8 bits")
    return Stream(packed & (1 << 36) - 1, info[18:34], points, at)


def _frame_header(media: bytes, at: int) -> tuple[int, int, int]:
    """Frame number, samples and header length; checks the header's checksum."""
    if media[at] != 0xFF or media[at + 1] != 0xF8 or media[at + 3] != 0x02:
        raise CorruptFlac("no frame of mono 8-bit samples")
    code, head, size = media[at + 2] >> 4, media[at + 4], 5
    number = head
    if head & 0x80:
        more = 8 - (head ^ 0xFF).bit_length() - 1
        number = head & (0x3F >> more)
        for k in range(more):
            number = number << 6 | media[at + 5 + k] & 0x3F
        size += more
    if code == 6:
        n, size = media[at + size] + 1, size + 1
    elif code == 7:
        n, size = int.from_bytes(media[at + size : at + size + 2], "big") + 1, size + 2
    elif code >= 8:
        n = 256 << (code - 8)
    else:
        n = 192 if code == 1 else 576 << (code - 2)
    if crc8(media[at : at + size]) != media[at + size]:
        raise CorruptFlac("frame header checksum")
    return number, n, size + 1


def decode(streams: list[bytes]) -> list[list[bytes]]:
    """The PCM blocks of each stream, a byte a sample plus 128, in the order of its frames.

    Frame checksums and the streams' digests are verified.
    """
    out: list[list[bytes]] = []
    run: list[bytes] = []
    frames = 0
    for media in streams:
        run.append(media)
        frames += len(media) // BLOCK + 1
        if frames >= LANES:
            out += _decode(run)
            run, frames = [], 0
    return out + (_decode(run) if run else [])


def _decode(streams: list[bytes]) -> list[list[bytes]]:
    parsed = [parse(m) for m in streams]
    base, starts, sizes, heads, lengths = 0, [], [], [], []
    for media, s in zip(streams, parsed, strict=True):
        offsets = [*s.points["offset"].tolist(), len(media) - s.frames]
        for nth, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
            number, n, head = _frame_header(media, s.frames + a)
            if number != nth or n != s.points["n"][nth]:
                raise CorruptFlac("a frame is not where the seek table has it")
            starts.append(base + s.frames + a)
            sizes.append(b - a)
            heads.append(head)
            lengths.append(n)
        base += len(media)
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    start, size, n = np.array(starts), np.array(sizes), np.array(lengths)
    blocks: list[bytes] = []
    for i in range(0, len(start), LANES):
        some = slice(i, i + LANES)
        stored = data[start[some] + size[some] - 2].astype(np.uint16) << 8 | data[start[some] + size[some] - 1]
        if (crc16_lanes(data, start[some], size[some] - 2) != stored).any():
            raise CorruptFlac("frame checksum")
        x = _lanes(data, (start[some] + np.array(heads[some])) * 8, n[some])
        pcm = (x + 128).astype(np.uint8)
        blocks += [row[:m].tobytes() for row, m in zip(pcm, n[some].tolist(), strict=True)]
    out, frame = [], 0
    for s in parsed:
        own = blocks[frame : frame + len(s.points)]
        frame += len(s.points)
        signed = (np.frombuffer(b"".join(own), np.uint8) ^ 0x80).tobytes()
        if len(signed) != s.samples or hashlib.md5(signed).digest() != s.digest:
            raise CorruptFlac("stream digest")
        out.append(own)
    return out


def _bits(windows: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits, at most 32, at each bit position."""
    w = windows[at >> 3].astype(_U) << (at & 7).astype(_U)
    return (w >> _U(64 - width)).astype(np.int64)


def _signed(x: np.ndarray, width: int) -> np.ndarray:
    return x - ((x >> (width - 1)) << width)


_ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.int64)


def _lanes(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples of subframes that begin at bit ``at``: a row per lane."""
    windows = np.ndarray((len(data) - 8,), dtype=">u8", buffer=data, strides=(1,))
    kind = _bits(windows, at, 8)
    if (kind & 0x81).any():
        raise CorruptFlac("wasted bits or padding set in a subframe")
    kind >>= 1
    at = at + 8
    x = np.zeros((len(at), int(n.max())), dtype=np.int64)
    for lane in np.flatnonzero(kind == 0):
        x[lane, : n[lane]] = _signed(_bits(windows, at[lane : lane + 1], 8), 8)
    for lane in np.flatnonzero(kind == 1):
        first = int(at[lane]) >> 3  # a header of whole bytes precedes
        x[lane, : n[lane]] = data[first : first + int(n[lane])].astype(np.int8)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind < 2)).all():
        raise CorruptFlac("a reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    coded = np.flatnonzero(fixed | linear)
    if not len(coded):
        return x
    for j in range(int(order.max())):
        own = coded[order[coded] > j]
        x[own, j] = _signed(_bits(windows, at[own] + 8 * j, 8), 8)
    at = at + 8 * order
    lanes = coded[linear[coded]]
    coefficients = np.zeros((len(at), 32), dtype=np.int64)
    shift = np.zeros(len(at), dtype=np.int64)
    for lane in lanes:
        one = at[lane : lane + 1]
        precision = int(_bits(windows, one, 4)[0]) + 1
        shift[lane] = _signed(_bits(windows, one + 4, 5), 5)[0]
        for j in range(order[lane]):
            coefficients[lane, j] = _signed(_bits(windows, one + 9 + precision * j, precision), precision)[0]
        at[lane] += 9 + precision * order[lane]
    _residuals(windows, at, x, n, order, coded)
    for p in range(1, 5):
        own = coded[fixed[coded] & (order[coded] == p)]
        if len(own):
            x[own] = _integrated(x[own], p)
    if len(lanes):
        for i in range(1, x.shape[1]):
            own = lanes[(order[lanes] <= i) & (n[lanes] > i)]
            most = int(order[own].max()) if len(own) else 0
            past = x[own, max(0, i - most) : i][:, ::-1]
            x[own, i] += (past * coefficients[own, : past.shape[1]]).sum(axis=1) >> shift[own]
    return x


def _residuals(windows, at, x, n, order, coded) -> None:
    """Reads Rice-coded residuals of the lanes ``coded`` into ``x``."""
    coded = coded[np.argsort(-n[coded], kind="stable")]
    pos, length, skip = at[coded], n[coded], order[coded]
    head = _bits(windows, pos, 6)
    if (head >> 4).any():
        raise CorruptFlac("Rice parameters of five bits")
    part = length >> (head & 15)
    pos = pos + 6
    k = np.zeros(len(coded), dtype=np.int64)
    live = len(coded)
    for i in range(int(length[0])):
        while length[live - 1] <= i:
            live -= 1
        fresh = np.flatnonzero(i % part[:live] == 0) if i else np.arange(live)
        if len(fresh):
            k[fresh] = _bits(windows, pos[fresh], 4)
            if (k[fresh] == 15).any():
                raise CorruptFlac("escaped residuals")
            pos[fresh] += 4
        own = slice(None, live) if i >= 4 and (skip <= i).all() else np.flatnonzero(skip[:live] <= i)
        p, low = pos[own], k[own]
        w = windows[p >> 3].astype(_U) << (p & 7).astype(_U)
        zeros = _ZEROS[(w >> _U(48)).astype(np.int64)]
        q = zeros
        long = np.flatnonzero(zeros == 16)
        while len(long):  # runs of 16 zeros and more
            p[long] += 16
            more = windows[p[long] >> 3].astype(_U) << (p[long] & 7).astype(_U)
            w[long] = more
            zeros = zeros.copy() if zeros is q else zeros
            zeros[long] = _ZEROS[(more >> _U(48)).astype(np.int64)]
            q = q.copy()
            q[long] += zeros[long]
            long = long[zeros[long] == 16]
        rest = ((w << (zeros + 1).astype(_U)) >> _U(1)) >> (63 - low).astype(_U)
        value = (q << low) | rest.astype(np.int64)
        x[coded[own], i] = (value >> 1) ^ -(value & 1)
        pos[own] = p + zeros + 1 + low


def _integrated(x: np.ndarray, p: int) -> np.ndarray:
    """Undoes the fixed predictor of order ``p``; the first ``p`` columns are samples."""
    starts = [x[:, :p]]  # differences of each order, from the sample of that index on
    for _ in range(1, p):
        starts.append(np.diff(starts[-1], axis=1))
    level = x[:, p:]
    for back in range(p - 1, -1, -1):
        level = np.cumsum(np.concatenate([starts[back][:, :1], level], axis=1), axis=1)
    return level
