"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmill.llm.hashing import blocks, mix
from contentmill.llm.workspace import Workspace

#: Seeds read the words at 1 and ignore those at 0.
MASKS = ("11111", "111011", "110111", "1101101", "1011011", "11010011", "101111", "111101")
#: Items with fewer words than this are found by the hash of all of them, under a mask of their own length.
WHOLE = 5
#: A hit counts if, of so many aligned words of the item (all, if it has fewer), this share agrees.
SPAN, AGREEING = 20, 0.8
#: Words kept on either side of hits for verifying.
MARGIN = 64
#: Hits at most so far apart share a row.
GAP = 16
#: Address bits of the filter of benchmark hashes; its size is fixed.
COARSE_BITS, FINE_BITS = 20, 26

#: Words here are runs of ASCII letters, digits and non-ASCII bytes.
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _masks(lengths) -> list[tuple[int, str]]:
    """Numbers and masks: all of ``MASKS``, and one of ones for each length of a short item."""
    return [*enumerate(MASKS), *((len(MASKS) + n, "1" * n) for n in sorted(lengths))]


def _mask_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """One hash for each place at which the mask fits."""
    size = len(words) - len(mask) + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(size, np.uint64(2 * number + 1))
    for j, use in enumerate(mask):
        if use == "1":
            out = (out ^ words[j : j + size]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix(out)


def _item_seeds(batches):
    for batch in batches:
        for block in blocks(batch.column(1), BREAKS):
            for i, row in enumerate(range(block.first, block.last)):
                words = block.words[block.word_at[i] : block.word_at[i + 1]]
                short = [len(words)] if 0 < len(words) < WHOLE else []
                found = [_mask_hashes(words, m, k) for k, m in _masks(short)]
                n = sum(map(len, found))
                at = np.concatenate([np.arange(len(x)) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, row))), pa.array(at), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.full(n, short[0] if short else 0, dtype=np.int32))], ["item_id", "at", "seed", "short"])


def _item_words(batches):
    for batch in batches:
        for block in blocks(batch.column(1), BREAKS):
            lists = [block.words[block.word_at[i] : block.word_at[i + 1]].view(np.int64) for i in range(block.last - block.first)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[block.first : block.last], pa.array(lists, pa.list_(pa.int64()))], ["item_id", "item"])


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of fixed size: one coarse and two fine bits for each seed.

    Executors build its pages; the driver gets their bytes, at most the bitmap's size.
    """
    fine = 1 << FINE_BITS
    bits = F.array(F.expr(f"seed & {fine - 1}"), F.expr(f"shiftrightunsigned(seed, {FINE_BITS}) & {fine - 1}"), F.expr(f"{fine} + shiftrightunsigned(seed, {64 - COARSE_BITS})"))
    places = seeds.select(F.explode(F.transform(bits, lambda b: b + 1)).alias("bit"))
    pages = places.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bytes"))
    out = np.zeros((fine + (1 << COARSE_BITS)) // 8, dtype=np.uint8)
    for page, part in pages.collect():
        at = (page - 1) * len(part)
        out[at : at + len(part)] = np.frombuffer(bytes(part), dtype=np.uint8)[: len(out) - at]
    return out


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    fine = np.uint64((1 << FINE_BITS) - 1)

    def test(address):
        return (bitmap[address >> np.uint64(3)] >> (address & np.uint64(7)).astype(np.uint8)) & 1

    at = np.flatnonzero(test((hashes >> np.uint64(64 - COARSE_BITS)) + (fine + np.uint64(1))))
    at = at[test(hashes[at] & fine) == 1]
    return at[test((hashes[at] >> np.uint64(FINE_BITS)) & fine) == 1]


def _hits(bitmap, margin: int, lengths: list[int]):
    """Arrow batches (id, text) -> clusters of hits with the words around them; ``lengths`` are those of short items."""
    masks = _masks(lengths)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), BREAKS):
                found = []
                for k, mask in masks:
                    hashes = _mask_hashes(block.words, mask, k)
                    at = _passes(bitmap.value, hashes)
                    found.append((at, hashes[at], np.full(len(at), len(mask))))
                at, seed, width = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed, width = at[order], seed[order], width[order]
                doc = np.searchsorted(block.word_at, at, side="right") - 1
                inside = at + width <= block.word_at[doc + 1]
                at, seed, doc = at[inside], seed[inside], doc[inside]
                if not len(at):
                    continue
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > GAP)) + 1
                lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
                rows: list[list] = [[], [], [], [], []]
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    d = doc[a]
                    first, last = block.word_at[d], block.word_at[d + 1]
                    w0, w1 = max(first, at[a] - margin), min(last, at[b - 1] + margin)
                    rows[0].append(block.first + int(d))
                    rows[1].append(int(w0 - first))
                    rows[2].append(block.words[w0:w1].view(np.int64))
                    rows[3].append(at[a:b] - first)
                    rows[4].append(seed[a:b].view(np.int64))
                ids = batch.column(0).take(pa.array(rows[0]))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows[1], pa.int64()), pa.array(rows[2], longs), pa.array(rows[3], longs), pa.array(rows[4], longs)], ["doc_id", "start", "near", "at", "seed"])

    return run


def _verify(span: int, agreeing: float):
    """Arrow batches of alignments -> those with enough agreeing words."""

    def run(batches):
        for batch in batches:
            keep, best = [], []
            near, item, start, shift = (batch.column(batch.schema.get_field_index(c)) for c in ("near", "item", "start", "shift"))
            for i in range(batch.num_rows):
                x, y = near[i].values.to_numpy(), item[i].values.to_numpy()
                lo = start[i].as_py() - shift[i].as_py()  # item place of the first word of x
                a, b = max(0, lo), min(len(y), lo + len(x))
                size = min(len(y), span)
                # Item words beyond the document's edge disagree.
                first, last = max(0, a - size), min(len(y), b + size)
                equal = np.zeros(last - first, dtype=np.int64)
                equal[a - first : b - first] = x[a - lo : b - lo] == y[a:b]
                same = np.concatenate([[0], np.cumsum(equal)])
                most = int((same[size:] - same[:-size]).max())
                if most >= max(min(size, WHOLE), agreeing * size):
                    keep.append(i)
                    best.append((most, size))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([m for m, _ in best], pa.int64()), pa.array([s for _, s in best], pa.int64())], ["doc_id", "item_id", "agreeing", "compared"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, agreeing: float = AGREEING) -> DataFrame:
    """Pairs (doc, item) in which the document holds a passage of the benchmark item.

    Every place of every document is hashed under each mask and tested against a filter
    of fixed size; what passes is joined with the items' seeds by hash. A pair counts if
    on the line of a hit, in some ``span`` consecutive words of the item (all of them, if
    it has fewer), at least ``agreeing`` of the words are equal, so substitutions are
    tolerated; item words beyond the document's start or end count as unequal; case and
    ASCII punctuation don't count. Items of one to four words are found where all of their
    words stand in order, by the hash of their whole sequence. One row for each pair: the ids,
    ``agreeing`` and ``compared`` words at the best place.

    Null and empty texts, items without words, and rows with a null id match nothing; ids of both may have any type; repeated rows give one pair, and rows that
    repeat an id with different texts count together; texts of any length are read whole;
    other columns are ignored; without documents or items the result is empty. A line is
    compared up to ``MARGIN`` words beyond its hits, which is more than any window of
    ``span`` words that holds one of them needs.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    item_type, doc_type = items.schema["item_id"].dataType.simpleString(), texts.schema["doc_id"].dataType.simpleString()
    margin = max(MARGIN, 2 * span)
    seeds = ws.table(items.mapInArrow(_item_seeds, f"item_id {item_type}, at long, seed long, short int").withColumnRenamed("at", "item_at"), "seeds")
    lengths = [r[0] for r in seeds.where("short > 0").select("short").distinct().collect()]  # four at most
    bitmap = spark.sparkContext.broadcast(seed_filter(seeds))
    hits = texts.mapInArrow(_hits(bitmap, margin, lengths), f"doc_id {doc_type}, start long, near array<long>, at array<long>, seed array<long>")
    hits = ws.table(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    met = hits.select("row", "doc_id", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("row", "doc_id", "h.at", "h.seed").join(seeds.drop("short"), "seed")
    lines = met.select("row", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    words = ws.table(items.mapInArrow(_item_words, f"item_id {item_type}, item array<long>"), "items")
    aligned = lines.join(hits.select("row", "doc_id", "start", "near"), "row").join(words, "item_id").select("doc_id", "item_id", "start", "near", "shift", "item")
    good = aligned.mapInArrow(_verify(span, agreeing), f"doc_id {doc_type}, item_id {item_type}, agreeing long, compared long")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("agreeing", "compared")).alias("best")).select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "best.agreeing", "best.compared")
    result = ws.finish(best)
    bitmap.unpersist()
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
