"""Elias-Fano lists: rising integers in some two bits each above the bits of their mean gap, with random access.

The low bits of all values lie end to end; the high parts are written in unary, so that the one of value i stands at bit ``high + i``. The
places of every SAMPLE-th one are kept as 32-bit numbers: a selection starts at such a place and reads on for at most SAMPLE ones.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")


def encode(values: np.ndarray) -> bytes:
    """The list of ``values``, unsigned and never falling, as bytes."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    shift = np.arange(low, dtype=np.uint64)
    lows = b"".join(  # SAMPLE * 64 values at a time have whole bytes, whatever the width
        np.packbits(((values[k : k + SAMPLE * 64, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        for k in range(0, n if low else 0, SAMPLE * 64)
    )
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n, dtype=np.int64)
    bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    if len(bits) >= 1 << 32:
        raise ValueError("an Elias-Fano list is limited to 2**32 bits of high parts; cut the values into several lists")
    bits[places] = 1
    highs = np.packbits(bits, bitorder="little").tobytes()
    return _HEAD.pack(n, low, len(lows), len(highs)) + lows + highs + places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Read access to an encoded list, without decoding it."""

    def __init__(self, data: bytes):
        self.n, self.low, lows, highs = _HEAD.unpack_from(data)
        raw, at = np.frombuffer(data, dtype=np.uint8), _HEAD.size
        self._lows, self._highs = raw[at : at + lows], raw[at + lows : at + lows + highs]
        self._samples = np.frombuffer(data, dtype="<u4", offset=at + lows + highs)

    def __len__(self) -> int:
        return self.n

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1."""
        if not 0 <= first <= last <= self.n:
            raise IndexError(f"{first} to {last} of {self.n} values")
        if first == last:
            return np.empty(0, np.uint64)
        j, k = first // SAMPLE, -(-last // SAMPLE)
        from_bit = int(self._samples[j])
        to_bit = int(self._samples[k]) if k < len(self._samples) else 8 * len(self._highs)
        bits = np.unpackbits(self._highs[from_bit // 8 : -(-to_bit // 8)], bitorder="little")
        bits[: from_bit % 8] = 0
        ones = np.flatnonzero(bits)[first - j * SAMPLE :][: last - first] + from_bit // 8 * 8
        values = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            a, b = first * self.low, last * self.low
            own = np.unpackbits(self._lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.low)
            for bit in range(self.low):
                values |= own[:, bit].astype(np.uint64) << np.uint64(bit)
        return values

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def first_not_below(self, value: int) -> int:
        """The place of the first value that is at least ``value`` (the length, if none is)."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self[middle] < value else (low, middle)
        return low
