"""Literal containment of many strings in many texts, by anchors.

Each sought string is represented by one window of its bytes (its anchor). Texts hash all
their windows and look them up in a bitmap of fixed size; what passes is joined with the
anchors by hash, and the strings are then compared literally. Work grows with the texts and
the real hits, not with texts times strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths of anchors in bytes; a string takes the widest that fits.
WIDTHS = (1, 2, 4, 8, 16, 32)
#: Windows, spread over a string, of which its anchor is chosen. Any one would do.
PICKS = 64
#: Address bits of the bitmap, and bytes of text hashed at a time.
BITS, CHUNK = 26, 1 << 20

_rng = np.random.default_rng(0xA11C)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _scramble(x: np.ndarray, width: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(width)) * _TURN
    return x ^ (x >> np.uint64(29))


class Windows:
    """Hashes of byte windows of given widths; those of one width come from one running sum."""

    def __init__(self, widths):
        self.widths, size = sorted(widths), CHUNK + WIDTHS[-1]
        self.up, self.down = _powers(_BASE, size), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), size)

    def of(self, data: np.ndarray):
        """(width, a hash for each place) of at most ``CHUNK`` + 32 bytes."""
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=total[1:])
        for width in self.widths:
            if len(data) >= width:
                yield width, _scramble((total[width:] - total[:-width]) * self.down[: len(data) - width + 1], width)

    def some(self, data: np.ndarray) -> tuple[int, np.ndarray]:
        """The widest width that fits and hashes of ``PICKS`` of its windows at most."""
        width = max(w for w in self.widths if w <= len(data))
        at = np.unique(np.linspace(0, len(data) - width, PICKS).astype(np.int64))
        return width, _scramble((_BYTE[data[at[:, None] + np.arange(width)]] * self.up[:width]).sum(axis=1, dtype=np.uint64), width)


def _picked(batches):
    """Arrow batches (key, string) -> (key, width, hash of some of its widest windows)."""
    windows = Windows(WIDTHS)
    for batch in batches:
        rows, widths, found = [], [], []
        for i, s in enumerate(batch.column(1)):
            width, hashes = windows.some(np.frombuffer(s.as_buffer(), dtype=np.uint8))
            rows.append(np.full(len(hashes), i))
            widths.append(np.full(len(hashes), width, dtype=np.int32))
            found.append(hashes)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(widths)), pa.array(np.concatenate(found).view(np.int64))], ["key", "width", "anchor"])


def anchors_of(strings: DataFrame, text: str) -> DataFrame:
    """``strings`` with ``_anchor`` and ``_width``: of its picked windows the one in the fewest strings; empty ones go.

    Strings travel by their hash; a string of any length makes ``PICKS`` rows at most.
    """
    keyed = strings.where(F.col(text) != "").withColumn("_key", F.sha2(text, 256))
    some = keyed.select(F.col("_key").alias("key"), F.col(text).alias("string")).dropDuplicates(["key"])
    windows = some.mapInArrow(_picked, "key string, width int, anchor long").distinct()
    often = windows.groupBy("anchor").agg(F.count("*").alias("n"))
    best = windows.join(often, "anchor").groupBy("key").agg(F.min(F.struct("n", "anchor", "width")).alias("b"))
    return keyed.join(best.select(F.col("key").alias("_key"), F.col("b.anchor").alias("_anchor"), F.col("b.width").alias("_width")), "_key").drop("_key")


def anchor_bitmap(anchors: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each anchor at its lowest ``BITS`` bits, and the widths in use; executors build the pages."""
    place = F.expr(f"(_anchor & {(1 << BITS) - 1}) + 1")
    pages = anchors.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes"), F.collect_set("_width").alias("widths"))
    out, widths = np.zeros((1 << BITS) // 8, dtype=np.uint8), set()
    for page, part, used in pages.collect():
        out[(page - 1) * len(part) : page * len(part)] = np.frombuffer(bytes(part), dtype=np.uint8)
        widths |= set(used)
    return out, sorted(widths)


def _hits(shared, at: int):
    """Arrow batches -> rows whose text has windows that the bitmap knows, with their hashes."""
    mask = np.uint64((1 << BITS) - 1)

    def of(bitmap: np.ndarray, windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of hits in a buffer of texts; windows across two texts don't count."""
        rows, hashes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        for start in range(0, len(data), CHUNK):
            for width, h in windows.of(data[start : start + CHUNK + WIDTHS[-1] - 1]):
                place = h & mask
                found = np.flatnonzero((bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(offsets, found + start, side="right") - 1
                whole = found + start + width <= offsets[row + 1]
                rows.append(row[whole])
                hashes.append(h[found[whole]])
        return np.concatenate(rows), np.concatenate(hashes)

    def run(batches):
        bitmap, widths = shared.value
        windows = Windows(widths)
        for batch in batches:
            text = batch.column(at).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            raw = text.buffers()[2]
            if not len(offsets) or raw is None or not len(widths):
                continue
            data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
            rows, hashes = of(bitmap, windows, data, offsets - offsets[0])
            if len(rows):
                pairs = np.unique(np.rec.fromarrays([rows, hashes], names="r,h"))
                used, first = np.unique(pairs.r, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)).astype(np.int32)), pa.array(pairs.h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(used)).columns, lists], [*batch.schema.names, "_hits"])

    return run


def contained(texts: DataFrame, text: str, strings: DataFrame, string: str) -> DataFrame:
    """Pairs of rows of which ``text`` holds ``string`` literally; null and empty strings match nothing.

    The sides' columns must have different names.
    """
    sought = anchors_of(strings, string)
    shared = texts.sparkSession.sparkContext.broadcast(anchor_bitmap(sought))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    hits = texts.mapInArrow(_hits(shared, texts.columns.index(text)), f"{schema}, _hits array<long>")
    met = hits.select(*texts.columns, F.explode("_hits").alias("_anchor")).join(sought.drop("_width"), "_anchor")
    return met.where(F.contains(text, F.col(string))).drop("_anchor")
