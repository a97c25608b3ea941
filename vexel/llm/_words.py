"""Vectorised word and window hashing over Arrow text columns.

Words are found on UTF-8 bytes, since every separator is ASCII. A word's hash is a polynomial in a fixed odd base
modulo 2**64, taken from prefix sums, so one batch costs a handful of numpy passes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once; the working arrays take about 40 times as much.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_pow = _inv = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        keep = _powers(BASE, n), _powers(INVERSE, n)
        if n > 2 * CHUNK:  # one very long text: not kept
            return keep
        _pow, _inv = keep
    return _pow, _inv


class Words:
    """The words of some texts: bytes (lower-cased), starts and ends of words in it, first word of each text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data = data = _LOWER[data]
        n = len(data)
        inside = table[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts], after[cuts - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        power, inverse = _tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64) * STEP)

    def __len__(self) -> int:
        return len(self.first) - 1

    def windows(self, size: int) -> np.ndarray:
        """A hash of each run of `size` words; runs that cross texts are there too and mean nothing."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.hashes[:n].copy()
        for k in range(1, size):
            out *= STEP
            out += self.hashes[k : k + n]
        return mix(out + np.uint64(size))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, start: int, end: int) -> bytes:
        """Words start to end, joined by spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[start:end], self.ends[start:end], strict=True))


def chunks(texts: pa.Array, table: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) of runs of texts of about CHUNK bytes; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], table)
        at = end
