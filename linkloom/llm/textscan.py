"""Vectorised word and line scans over batches of texts, for use inside Arrow tasks.

A scan covers whole texts. It never holds more than about ``CHUNK_BYTES`` of text at a time, or one text if that is
longer, so memory does not depend on the partition. Word and line codes are 64-bit polynomial hashes that come out the
same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes along."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES // 2, 2 * len(self.up) if len(self.up) < n // 2 else 0)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()


class Scan:
    """Words of a list of texts: ``codes``, byte ranges, and per text the range ``first[i]:first[i + 1]`` of its words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _IS_SPACE[self.raw]
        edges = np.flatnonzero(np.concatenate(([True], space[:-1])) != space)
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.space = space
        _powers.reach(len(self.raw) + 1)
        self._sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.raw] * _powers.up[: len(self.raw)], out=self._sums[1:])
        self.codes = self.range_codes(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.begins)

    def range_codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One code per byte range."""
        value = (self._sums[ends] - self._sums[starts]) * _powers.down[starts]
        return mix(value + (ends - starts).astype(np.uint64))

    @property
    def word_counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.word_counts)

    def count_bytes(self, flag: np.ndarray) -> np.ndarray:
        """Per text: how many of its bytes are flagged; line ends must not be."""
        if not self.texts:
            return np.zeros(0, np.int64)
        return np.add.reduceat(flag.view(np.uint8), self.begins[:-1], dtype=np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line that holds a word; lines end at ``\\n`` or with the text."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
        words_before = np.concatenate(([0], np.cumsum(~self.space)))
        full = words_before[breaks] > words_before[starts]
        starts, ends = starts[full], breaks[full]
        return starts, ends, np.searchsorted(self.begins, starts, side="right") - 1


def windows(codes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """The code of each run of ``size`` neighbouring words, ignoring where texts end."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n] + np.uint64(salt)
    for i in range(1, size):
        out = out * _BASE + codes[i : i + n]
    return mix(out)


def long_windows(codes: np.ndarray, size: int) -> np.ndarray:
    """As ``windows``, in a fixed number of passes whatever the size."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _powers.reach(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers.up[: len(codes)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` neighbours."""
    n, reach = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach : width - reach + n])


def runs(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run; ``breaks`` flag neighbours (i, i + 1) that do not belong together."""
    cut = np.flatnonzero(np.logical_or.reduce(breaks))
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(breaks[0])]))


def inside(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Flags, per word, whether a window of ``size`` words that starts there stays in its text."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left >= size


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the keys that occur more than once, and of all but the first of each."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    common = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(common):
        near = np.searchsorted(common, keys)
        found = np.flatnonzero(common[np.minimum(near, len(common) - 1)] == keys)
        order = found[np.argsort(keys[found], kind="stable")]
        again[found] = True
        later[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return again, later


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Scan]]:
    """Cut batches by bytes of text and scan each piece; NULL counts as the empty text."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > CHUNK_BYTES:
                yield batch.slice(start, i - start), Scan(texts[start:i])
                start, size = i, 0
            size += len(text) + 1
        if start < len(texts):
            yield batch.slice(start), Scan(texts[start:])
