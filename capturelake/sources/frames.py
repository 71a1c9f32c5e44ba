"""The samples in FLAC frames: decoding them, and writing new ones.

A frame has a header, a subframe for each channel and a CRC-16.  Numpy does
what is one operation on many samples (bit fields, Rice remainders, sums of
differences); only where each code begins, and linear prediction, go step by step.
"""

from __future__ import annotations

import numpy as np

from capturelake.sources.flac import _CRC, parse_frame

# Bits of a sample by their code, and how two channels are stored together.
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
#: Rice parameters that the writer tries, and the largest of them.
MOST_RICE = 14


def _crc16_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint16) << np.uint16(8)
    for _ in range(8):
        out = (out << np.uint16(1)) ^ np.where(out & 0x8000, 0x8005, 0).astype(np.uint16)
    return out


_CRC16 = _crc16_table()
_CRC16_LIST = _CRC16.tolist()
#: Bytes up to which a checksum is taken one by one: lanes only pay for more.
SHORT = 8192


def _advanced(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (state << np.uint16(8)) ^ _CRC16[(state >> np.uint16(8)) ^ byte]


def crc16_of(data: bytes) -> int:
    """The CRC-16 of bytes, in about as many steps as the root of their number:
    lanes are advanced together and then put together, each behind the last."""
    n = len(data)
    if n <= SHORT:
        crc, table = 0, _CRC16_LIST
        for x in data:
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ x]
        return crc
    lanes = max(1, int(n**0.5))
    size = -(-n // lanes)
    x = np.zeros(lanes * size, np.uint8)  # zeros before the first byte change nothing
    x[lanes * size - n :] = np.frombuffer(data, np.uint8)
    x = x.reshape(lanes, size)
    state = np.zeros(lanes + 16, np.uint16)
    state[lanes:] = 1 << np.arange(16)  # what ``size`` bytes of zeros make of each bit
    column = np.zeros(lanes + 16, np.uint8)
    for i in range(size):
        column[:lanes] = x[:, i]
        state = _advanced(state, column)
    after, out = state[lanes:].tolist(), 0
    for here in state[:lanes].tolist():
        out = _shifted(out, after) ^ here
    return out


def _shifted(crc: int, columns: list[int]) -> int:
    out = 0
    while crc:
        low = crc & -crc
        out ^= columns[low.bit_length() - 1]
        crc ^= low
    return out


def _zeros() -> list[list[int]]:
    """What 1, 2, 4 ... bytes of zeros make of each bit of a CRC-16."""
    out = [_advanced((1 << np.arange(16)).astype(np.uint16), 0).tolist()]
    while len(out) < 32:
        out.append([_shifted(_shifted(1 << i, out[-1]), out[-1]) for i in range(16)])
    return out


_ZEROS = _zeros()


def _behind(crc: int, n: int) -> int:
    """The CRC-16 after ``n`` bytes of zeros."""
    for i, columns in enumerate(_ZEROS):
        if n >> i & 1:
            crc = _shifted(crc, columns)
    return crc


class _Bits:
    """Bit fields of bytes, most significant first."""

    def __init__(self, data: bytes, pos: int) -> None:
        self.data, self.pos = data, pos
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        at = np.where(self.bits, np.arange(len(self.bits), dtype=np.int32), np.int32(1 << 30))
        self.ones = memoryview(np.ascontiguousarray(np.minimum.accumulate(at[::-1])[::-1]))

    def read(self, n: int) -> int:
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the frame ends early")
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.pos - n) & ((1 << n) - 1)
        self.pos += n
        return value

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        one = self.ones[self.pos]
        n, self.pos = one - self.pos, one + 1
        return n

    def fields(self, n: int, width: int) -> np.ndarray:
        """``n`` signed fields of ``width`` bits."""
        if not width:
            return np.zeros(n, np.int64)
        if self.pos + n * width > len(self.bits):
            raise ValueError("the frame ends early")
        x = self.bits[self.pos : self.pos + n * width].reshape(n, width).astype(np.int64)
        self.pos += n * width
        x[:, 0] = -x[:, 0]
        return x @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))

    def rice(self, n: int, k: int) -> np.ndarray:
        """``n`` Rice codes of parameter ``k``."""
        p, ones, stops = self.pos, self.ones, []
        for _ in range(n):
            p = ones[p] + 1 + k
            stops.append(p)
        after = np.array(stops, np.int64)
        if n and after[-1] > len(self.bits):
            raise ValueError("the frame ends early")
        high = after - k - 1 - np.concatenate([[self.pos], after[:-1]])
        low = self.bits[(after - k)[:, None] + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
        self.pos = p
        folded = (high << k) | low
        return (folded >> 1) ^ -(folded & 1)


def _residual(b: _Bits, block: int, order: int) -> np.ndarray:
    method = b.read(2)
    if method > 1:
        raise ValueError("an unknown coding of residuals")
    width, parts = 4 + method, 1 << b.read(4)
    if block % parts or block // parts < order:
        raise ValueError("partitions that do not fit the block")
    out = []
    for i in range(parts):
        n, k = block // parts - (order if i == 0 else 0), b.read(width)
        out.append(b.fields(n, b.read(5)) if k == (1 << width) - 1 else b.rice(n, k))
    return np.concatenate(out)


def _summed(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The samples whose differences of order len(first) are ``rest``."""
    for j in range(len(first), 0, -1):
        rest = np.diff(first, j - 1)[-1] + np.cumsum(rest)
    return np.concatenate([first, rest])


def _predicted(first: list[int], rest: list[int], taps: list[int], shift: int) -> np.ndarray:
    x, order, back = list(first), len(first), taps[::-1]
    for r in rest:
        x.append(r + (sum(a * b for a, b in zip(back, x[-order:], strict=True)) >> shift))
    return np.array(x, np.int64)


def _subframe(b: _Bits, block: int, bps: int) -> np.ndarray:
    if b.read(1):
        raise ValueError("not a subframe")
    kind = b.read(6)
    waste = 1 + b.unary() if b.read(1) else 0
    bps -= waste
    if bps < 1:
        raise ValueError("more wasted bits than a sample has")
    if kind == 0:
        x = np.full(block, b.signed(bps), np.int64)
    elif kind == 1:
        x = b.fields(block, bps)
    elif 8 <= kind <= 12:
        x = _summed(b.fields(kind - 8, bps), _residual(b, block, kind - 8))
    elif kind >= 32:
        order = kind - 31
        first = b.fields(order, bps)
        width = b.read(4) + 1
        shift = b.signed(5)
        if width == 16 or shift < 0:
            raise ValueError("an unknown prediction")
        taps = b.fields(order, width)
        x = _predicted(first.tolist(), _residual(b, block, order).tolist(), taps.tolist(), shift)
    else:
        raise ValueError("an unknown kind of subframe")
    return x << waste


def decode_frame(data: bytes, bps: int | None = None) -> tuple[np.ndarray, int]:
    """The samples of the frame that ``data`` begins with, a row a channel, and
    its bytes.  ``bps`` counts where the header says that of the stream.  What
    is no whole frame, or does not have its checksum, is a ValueError."""
    head = parse_frame(data)
    if head is None:
        raise ValueError("not a frame")
    block, size, _, _ = head
    layout, code = data[3] >> 4, data[3] >> 1 & 7
    bps = SAMPLE_BITS.get(code, bps)
    if bps is None:
        raise ValueError("the frame does not say how many bits a sample has")
    b = _Bits(data, 8 * size)
    channels = 2 if layout >= LEFT_SIDE else layout + 1
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(layout)
    try:
        x = [_subframe(b, block, bps + (c == side)) for c in range(channels)]
    except IndexError:
        raise ValueError("the frame ends early") from None
    if layout == LEFT_SIDE:
        x[1] = x[0] - x[1]
    elif layout == SIDE_RIGHT:
        x[0] = x[0] + x[1]
    elif layout == MID_SIDE:
        mid = (x[0] << 1) | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    end = (b.pos + 7) // 8
    if end + 2 > len(data):
        raise ValueError("the frame ends early")
    if crc16_of(data[:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("the frame's checksum differs")
    return np.stack(x), end + 2


def coded_number(n: int) -> bytes:
    """A number as frame headers have it."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >> (5 * size + 1) and size < 7:
        size += 1
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size) | n >> 6 * (size - 1)) & 0xFF if size < 7 else 0xFE, *tail])


def frame_header(block: int, number: int, variable: bool, layout: int, bps: int) -> bytes:
    code = {b: c for c, b in SAMPLE_BITS.items()}.get(bps, 0)
    head = bytes([0xFF, 0xF9 if variable else 0xF8, 0x70, layout << 4 | code << 1]) + coded_number(number) + (block - 1).to_bytes(2, "big")
    crc = 0
    for x in head:
        crc = _CRC[crc ^ x]
    return head + bytes([crc])


def _field_bits(x: np.ndarray, width: int) -> np.ndarray:
    return (x[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)


def _number_bits(value: int, width: int) -> np.ndarray:
    return _field_bits(np.array([value], np.int64), width)


def _rice_bits(x: np.ndarray, k: int) -> np.ndarray:
    folded = np.where(x >= 0, 2 * x, -2 * x - 1)
    size = (folded >> k) + 1 + k
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - k - 1] = 1
    for j in range(k):
        out[end - 1 - j] = folded >> j & 1
    return out


def subframe_bits(x: np.ndarray, bps: int, kind: str | None = None, taps: tuple[int, ...] = (1,), shift: int = 0) -> np.ndarray:
    """One channel as ``constant``, ``verbatim``, ``fixed0`` to ``fixed4`` or
    ``lpc`` of ``taps``; without a kind the smallest of those but the last."""
    if kind is None:
        if (x == x[0]).all():
            kind = "constant"
        else:
            cost = [(int(np.abs(np.diff(x, o)).sum()), o) for o in range(min(5, len(x)))]
            kind = f"fixed{min(cost)[1]}"
            packed = subframe_bits(x, bps, kind)
            return packed if len(packed) < 8 + bps * len(x) else subframe_bits(x, bps, "verbatim")
    if kind == "constant":
        return np.concatenate([_number_bits(0, 8), _field_bits(x[:1], bps)])
    if kind == "verbatim":
        return np.concatenate([_number_bits(1 << 1, 8), _field_bits(x, bps)])
    if kind == "lpc":
        order, parts = len(taps), [_number_bits((31 + len(taps)) << 1, 8), _field_bits(x[: len(taps)], bps), _number_bits(14, 4), _number_bits(shift, 5), _field_bits(np.array(taps, np.int64), 15)]
        past = np.stack([x[order - 1 - i : len(x) - 1 - i] for i in range(order)])
        rest = x[order:] - ((np.array(taps, np.int64) @ past) >> shift)
    else:
        order = int(kind.removeprefix("fixed"))
        parts, rest = [_number_bits((8 + order) << 1, 8), _field_bits(x[:order], bps)], np.diff(x, order)
    folded = np.where(rest >= 0, 2 * rest, -2 * rest - 1)
    tried = np.arange(MOST_RICE + 1)
    k = int(np.argmin((folded >> tried[:, None]).sum(axis=1) + tried * len(folded)))
    return np.concatenate([*parts, _number_bits(0, 6), _number_bits(k, 4), _rice_bits(rest, k)])


def encode_frame(x: np.ndarray, bps: int, number: int, variable: bool = True, layout: int | None = None, kinds: tuple[str | None, ...] = (), **more: object) -> bytes:
    """A frame of samples, a row a channel; ``layout`` stores two of them together."""
    x = np.asarray(x, np.int64)
    rows, wide = list(x), {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(layout)
    if layout == LEFT_SIDE:
        rows = [x[0], x[0] - x[1]]
    elif layout == SIDE_RIGHT:
        rows = [x[0] - x[1], x[1]]
    elif layout == MID_SIDE:
        rows = [(x[0] + x[1]) >> 1, x[0] - x[1]]
    bits = [subframe_bits(r, bps + (c == wide), kinds[c] if c < len(kinds) else None, **more) for c, r in enumerate(rows)]
    body = frame_header(x.shape[1], number, variable, len(x) - 1 if layout is None else layout, bps) + np.packbits(np.concatenate(bits)).tobytes()
    return body + crc16_of(body).to_bytes(2, "big")


def stream_header(rate: int, channels: int, bps: int, total: int, least: int, most: int) -> bytes:
    """The marker and one metadata block; a total of 2**36 and more is unknown."""
    word = rate << 44 | (channels - 1) << 41 | (bps - 1) << 36 | (total if total < 1 << 36 else 0)
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + least.to_bytes(2, "big") + most.to_bytes(2, "big") + bytes(6) + word.to_bytes(8, "big") + bytes(16)


def renumbered(frame: bytes, number: int) -> bytes:
    """The same frame of a stream of variable blocks with another first sample:
    its header changes, its subframes are not touched.  A frame whose checksum
    did not fit has one that does not fit."""
    block, size, _, _ = parse_frame(frame)
    sizes, layout = frame[2], frame[3]
    rate = {12: 1, 13: 2, 14: 2}.get(sizes & 15, 0)
    head = bytes([0xFF, 0xF9, 0x70 | sizes & 15, layout]) + coded_number(number) + (block - 1).to_bytes(2, "big") + frame[size - 1 - rate : size - 1]
    crc = 0
    for x in head:
        crc = _CRC[crc ^ x]
    head += bytes([crc])
    n = len(frame) - 2 - size
    # a checksum is linear: the old header's part is taken out, the new one's put in
    own = int.from_bytes(frame[-2:], "big") ^ _behind(crc16_of(frame[:size]) ^ crc16_of(head), n)
    return head + frame[size:-2] + own.to_bytes(2, "big")
