"""Vectorised word and shingle hashes over Arrow string buffers.

Words are maximal runs of bytes other than ASCII space, tab, line feed, vertical
tab, form feed and carriage return; A-Z is folded to a-z and nothing else is.
Everything works on blocks of whole documents of about ``BLOCK`` bytes, so memory
doesn't follow the size of an Arrow batch (a longer document is a block alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = _BYTE[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Block:
    """Some consecutive documents of a batch.

    ``first``/``last`` are their row numbers in the batch, ``starts`` and ``ends``
    the byte bounds of words within ``data``, ``words`` their hashes, and
    ``word_at[i]:word_at[i + 1]`` the words of document ``first + i``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, space: np.ndarray = SPACE):
        self.data, self.bounds, self.first, self.last = data, bounds, first, first + len(bounds) - 1
        n = len(data)
        solid = ~space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.word_at = np.searchsorted(self.starts, bounds)
        self.words = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(self.starts):  # stretch by stretch, so that a long document needs no more
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + BLOCK, side="right")))
            at, end = self.starts[i], self.ends[j - 1]
            up, down = _powers.get(end - at + 1)
            total = np.zeros(end - at + 1, dtype=np.uint64)
            np.cumsum(_FOLDED[data[at:end]] * up[:-1], out=total[1:])
            first, last = self.starts[i:j] - at, self.ends[i:j] - at
            self.words[i:j] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
            i = j

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k-word shingles and their bounds by document.

        A document of 1 to k - 1 words has its whole sequence as its one shingle.
        """
        counts = np.diff(self.word_at)
        w, n = self.words, len(self.words)
        size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(counts)), size)
        at = self.word_at[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
        used = np.minimum(counts, k)[owner]
        out = used.astype(np.uint64) * _PLACE[4]
        for j in range(k):
            here = used > j
            place = _PLACE[j % 4] + np.uint64(2 * (j // 4))
            if here.all():
                out += mix(w[at + j] + place) * place
            elif n:
                out += np.where(here, mix(w[np.minimum(at + j, n - 1)] + place) * place, np.uint64(0))
        return mix(out), bounds


def blocks(text: pa.Array, space: np.ndarray = SPACE) -> Iterator[Block]:
    """Blocks of whole documents; a null is an empty document. ``space`` marks the bytes between words."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    rows = len(text)
    if not rows:
        return
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + rows + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    if text.null_count:  # a null's bytes, if it has any, don't count
        dead = text.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[dead] > 0).any():
            yield from blocks(text.fill_null(""), space)
            return
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, space)
        first = last
