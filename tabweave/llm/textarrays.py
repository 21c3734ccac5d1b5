"""Words, lines and their hashes of whole Arrow string columns, without a Python loop over words.

A column's UTF-8 bytes are one numpy array. Words are runs of bytes outside [\\x20\\x09-\\x0D] that do not cross
from one text into the next. Hashes are 64-bit and chained over eight bytes at a time; they have a seed, and hashes of
two seeds are independent. Every task on every machine gets the same ones."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator: a bijection on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers for a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


_CHUNK_STEP, _LONG_RANGE = _U(0x9E3779B97F4A7C15), 2048
_KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], _U)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of data[start:end] of every range: its length and then its bytes, eight at a time, each step mixed.

    Equal lengths up to eight bytes cannot collide, as every step is a bijection; ranges beyond 2,048 bytes, which are
    few, get the first eight bytes of a keyed BLAKE2b digest."""
    size = ends - starts
    out = mix(size.astype(_U) + numbers(1, 1000 + seed))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= _LONG_RANGE))
    at = 0
    while len(left):
        chunk = eight[starts[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]
        out[left] = mix((out[left] ^ chunk) * _CHUNK_STEP)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > _LONG_RANGE).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")
    return out


@dataclass
class Texts:
    """One Arrow string column: bytes, and where each text starts (n + 1 offsets)."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def parts(self, most: int = 4 << 20):
        """(first, last, Texts) of neighbouring texts with about ``most`` bytes; one longer text is a part of its own."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1)
            yield i, j, Texts(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i])
            i = j

    def heads(self) -> np.ndarray:
        """True at the first byte of every text that has bytes."""
        head = np.zeros(len(self.data) + 1, bool)
        head[self.offsets[:-1]] = True
        return head[:-1]

    def words(self) -> Spans:
        return self._spans(~IS_WHITE[self.data])

    def lines(self) -> Spans:
        """Parts between line feeds, without empty ones."""
        return self._spans(self.data != 0x0A)

    def _spans(self, inside: np.ndarray) -> Spans:
        head = self.heads()
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | head))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:] & ~head[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return Spans(self, starts, ends, np.searchsorted(starts, self.offsets))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Spans:
    """Byte ranges of a Texts; ``first`` has each text's first span (n + 1 numbers)."""

    of: Texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return range_hashes(self.of.data, self.starts, self.ends, seed)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` neighbouring word hashes; shorter inputs have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    step = numbers(size, 100 + seed) | _U(1)
    out = hashes[:n] * step[0]
    for k in range(1, size):
        out = out + mix_light(hashes[k : k + n], step[k])
    return mix(out)


def mix_light(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    y = x * factor
    return y ^ (y >> _U(29))


def inside(spans: Spans, size: int) -> np.ndarray:
    """True where a window of ``size`` spans starts that does not leave its text (one flag per possible window)."""
    n = len(spans.starts) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    owner = spans.text_of()
    return owner[:n] == owner[size - 1 :]
