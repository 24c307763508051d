"""Bit streams and a range coder, for grouped maps: array operations where widths are known, plain Python for what is sequential by nature."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np


class BitWriter:
    """Appends the low bits of values, the first in the highest bit; the last byte is filled with zeros."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def write(self, value: int, width: int) -> None:
        self.held = self.held << width | (value & ((1 << width) - 1))
        self.n += width
        spare = (self.n % 8) if self.n >= 512 else None
        if spare is not None:
            self.out += (self.held >> spare).to_bytes((self.n - spare) // 8, "big")
            self.held &= (1 << spare) - 1
            self.n = spare

    def __len__(self) -> int:
        return 8 * len(self.out) + self.n

    def __bytes__(self) -> bytes:
        pad = -self.n % 8
        return bytes(self.out) + (self.held << pad).to_bytes((self.n + pad) // 8, "big")


class BitReader:
    """Reads what BitWriter wrote; beyond the end it raises EOFError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, width: int) -> int:
        end = self.at + width
        if end > 8 * len(self.data):
            raise EOFError(f"{width} bits at {self.at} of {8 * len(self.data)}")
        first, last = self.at // 8, (end + 7) // 8
        self.at = end
        return (int.from_bytes(self.data[first:last], "big") >> (8 * last - end)) & ((1 << width) - 1)


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """What BitWriter gives for all values at once, by array operations."""
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(widths.max()) if len(widths) else 0):  # the k-th bit from the right of each value that has one
        some = np.flatnonzero(widths > k)
        out[ends[some] - 1 - k] = values[some] >> min(k, 63) & 1
    return np.packbits(out).tobytes()


class Bits:
    """Reads numbers of given widths from a stream, many at once where their widths are known."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def many(self, widths: np.ndarray) -> np.ndarray:
        ends = self.at + np.cumsum(widths)
        if len(ends) and ends[-1] > len(self.bits):
            raise EOFError(f"bit {ends[-1]} of {len(self.bits)}")
        out = np.zeros(len(widths), np.int64)
        for k in range(int(widths.max()) if len(widths) else 0):
            some = np.flatnonzero(widths > k)
            out[some] |= self.bits[ends[some] - 1 - k].astype(np.int64) << k
        self.at = int(ends[-1]) if len(ends) else self.at
        return out

    def one(self, width: int) -> int:
        return int(self.many(np.array([width]))[0])


def cdf(weights: Sequence[float], precision: int = 16, floor: float = 0.0) -> list[int]:
    """0 and the running sums of the weights, each within floor and 1, scaled to 2^precision - 1 and cut to whole numbers."""
    clipped = [min(1.0, max(floor, w)) for w in weights]
    total, run, out = sum(clipped), 0.0, [0]
    for w in clipped:
        run += w / total
        out.append(int(min(run, 1.0) * ((1 << precision) - 1)))
    return out


#: Bits of the coder's interval.
PRECISION = 48


class RangeEncoder:
    """Symbols by their cumulative counts (start, end, total); ends that agree are written out, and near misses counted."""

    def __init__(self):
        self.low, self.high, self.pending, self.bits = 0, (1 << PRECISION) - 1, 0, BitWriter()

    def _put(self, bit: int) -> None:
        self.bits.write(bit, 1)
        for _ in range(self.pending):
            self.bits.write(1 - bit, 1)
        self.pending = 0

    def encode(self, start: int, end: int, total: int) -> None:
        if not 0 <= start < end <= total:
            raise ValueError(f"no range: {start} to {end} of {total}")
        half, quarter, top = 1 << PRECISION - 1, 1 << PRECISION - 2, (1 << PRECISION) - 1
        width = self.high - self.low + 1
        self.low, self.high = self.low + width * start // total, self.low + width * end // total - 1
        while True:
            if self.high < half:
                self._put(0)
            elif self.low >= half:
                self._put(1)
                self.low, self.high = self.low - half, self.high - half
            elif self.low >= quarter and self.high < half + quarter:
                self.pending += 1
                self.low, self.high = self.low - quarter, self.high - quarter
            else:
                return
            self.low, self.high = self.low << 1 & top, self.high << 1 & top | 1

    def finish(self) -> bytes:
        self.pending += 1
        self._put(int(self.low >= 1 << PRECISION - 2))
        return bytes(self.bits)


class RangeDecoder:
    def __init__(self, data: bytes):
        self.low, self.high, self.bits = 0, (1 << PRECISION) - 1, BitReader(data)
        self.code = 0
        for _ in range(PRECISION):
            self.code = self.code << 1 | self._bit()

    def _bit(self) -> int:
        try:
            return self.bits.read(1)
        except EOFError:
            return 0

    def decode(self, cumulative: Sequence[int]) -> int:
        """The next symbol, by cumulative counts that start with 0 and end with the total."""
        half, quarter, top = 1 << PRECISION - 1, 1 << PRECISION - 2, (1 << PRECISION) - 1
        total, width = cumulative[-1], self.high - self.low + 1
        target = ((self.code - self.low + 1) * total - 1) // width
        symbol = bisect_right(cumulative, target) - 1
        start, end = cumulative[symbol], cumulative[symbol + 1]
        self.low, self.high = self.low + width * start // total, self.low + width * end // total - 1
        while True:
            if self.high < half:
                shift = 0
            elif self.low >= half:
                shift = half
            elif self.low >= quarter and self.high < half + quarter:
                shift = quarter
            else:
                return symbol
            self.low, self.high = (self.low - shift) << 1 & top, (self.high - shift) << 1 & top | 1
            self.code = (self.code - shift) << 1 & top | self._bit()


def encode(symbols: Iterable[int], cumulative: Sequence[int]) -> bytes:
    out = RangeEncoder()
    for s in symbols:
        out.encode(cumulative[s], cumulative[s + 1], cumulative[-1])
    return out.finish()


def decode(data: bytes, cumulative: Sequence[int], n: int) -> Iterator[int]:
    source = RangeDecoder(data)
    return (source.decode(cumulative) for _ in range(n))


class Adaptive:
    """Order-0 counts that follow the symbols: each seen adds one, after all are scaled by gate."""

    def __init__(self, size: int, gate: float = 1.0):
        self.counts, self.gate = [1.0] * size, gate

    def cumulative(self, scale: int = 1 << 16) -> list[int]:
        total, run, out = sum(self.counts), 0.0, [0]
        for k, c in enumerate(self.counts):
            run += c
            out.append(int(run / total * scale) + k + 1)  # each symbol keeps a range of its own
        return out

    def see(self, symbol: int) -> None:
        if self.gate != 1.0:
            self.counts = [c * self.gate for c in self.counts]
        self.counts[symbol] += 1
