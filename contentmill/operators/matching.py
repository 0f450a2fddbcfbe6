"""Joins of the content bank: as-of, interval, fuzzy, tiered, positional and aligned."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmill.functions.text import fold, names_match, quotation_key, tokens
from contentmill.operators.anchors import contained

#: Names of one block of a fuzzy join, and the most keys that are dealt out in several; a key beyond those has
#: less than one in ``HOT_KEYS`` of all index rows.
BLOCK_NAMES, HOT_KEYS = 1000, 1000
#: Rows that one task may take of a key in order, and the stretches that a larger key is cut into.
SPLIT_ROWS, STRETCHES = 200_000, 256


def latest_row_join(old: DataFrame, new: DataFrame, keys: Sequence[str], position: str, *, value: str, changed: str) -> DataFrame:
    """Inner join on ``keys`` with the old row of the highest ``position`` (the last wins),
    kept where ``changed`` differs and the new ``value`` isn't blank."""
    last = old.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in old.columns if c not in keys]), position).alias("old"))
    return new.join(last, list(keys)).where((F.col(changed) != F.col(f"old.{changed}")) & F.col(value).rlike(r"(?U)\S"))


def _stretches(rows: DataFrame, by: Sequence[str], position: str) -> DataFrame | None:
    """Keys with many rows and the positions that cut them into ``STRETCHES`` of about as many rows; None without any.

    Such a key has over ``SPLIT_ROWS`` rows and over one in ``STRETCHES`` of all, so there
    are fewer than ``STRETCHES`` of them to hold on the driver.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    least = max(SPLIT_ROWS, (total or 0) / STRETCHES)
    if (most or 0) <= least:
        return None
    names = [f"_k{i}" for i in range(len(by))]
    hot = sizes.where(F.col("_n") > least).select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)])
    some = rows.select(*by, position).join(F.broadcast(hot), _same(by), "inner")
    cuts = some.groupBy(*names).agg(F.percentile_approx(position, [i / STRETCHES for i in range(1, STRETCHES)], F.lit(10 * STRETCHES)).alias("_cuts"))
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _same(by: Sequence[str]) -> Column:
    """The keys ``by`` are those of ``_k0``, ``_k1``, ...; nulls are the same."""
    here = F.lit(True)
    for i, c in enumerate(by):
        here = here & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return here


def _running(rows: DataFrame, by: Sequence[str], position: str, order: Sequence, values: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``rows`` with a running value for each name, in ``order`` from ``position`` on, by key.

    A value is given over a window and over a group, and stands until there is a next one.
    A key with a large part of the rows is dealt out in stretches of positions, and the
    last values of a stretch are carried over to the later ones.
    """
    cuts = _stretches(rows, by, position)
    window = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cuts is None:
        return rows.withColumns({name: over.over(window(*by)) for name, (over, _) in values.items()})
    keys = [c for c in cuts.columns if c != "_cuts"]
    dealt = rows.join(F.broadcast(cuts), _same(by), "left").drop(*keys)
    before = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(position))))
    dealt = dealt.withColumns({"_hot": F.col("_cuts").isNotNull(), "_stretch": before}).drop("_cuts")
    lasts = dealt.where("_hot").groupBy(*by, "_stretch").agg(*[of.alias(name) for name, (_, of) in values.items()])
    every = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_at"))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(lasts, _same(by) & (F.col("_at") == F.col("_stretch")), "left").select(*keys, "_at", *[F.last(name, ignorenulls=True).over(earlier).alias(f"_before{i}") for i, name in enumerate(values)])
    found = dealt.withColumns({name: over.over(window(*by, "_stretch")) for name, (over, _) in values.items()})
    found = found.join(F.broadcast(carried), _same(by) & (F.col("_at") == F.col("_stretch")), "left")
    return found.withColumns({name: F.coalesce(name, f"_before{i}") for i, name in enumerate(values)}).drop(*keys, "_at", "_stretch", "_hot", *[f"_before{i}" for i in range(len(values))])


def asof_backward(probes: DataFrame, anchors: DataFrame, by: Sequence[str], position: str, label: str, *, out: str | None = None) -> DataFrame:
    """Each probe with the label of the latest anchor at or before it, else null.

    One shuffle: both sides are united and the label is carried forward in order; at one
    position anchors come first. A null label isn't carried. A key with a large part of the
    rows is spread over many tasks (``_running``).
    """
    out = out or label
    p = probes.withColumns({"_side": F.lit(1), "_label": F.lit(None).cast(anchors.schema[label].dataType), "_all": F.struct(*probes.columns)}).select(*by, position, "_side", "_label", "_all")
    a = anchors.withColumns({"_side": F.lit(0), "_label": F.col(label), "_all": F.lit(None).cast(p.schema["_all"].dataType)}).select(*by, position, "_side", "_label", "_all")
    last = F.max_by("_label", F.when(F.col("_label").isNotNull(), F.struct(position, "_label")))
    order = [position, "_side", F.col("_label").asc_nulls_first()]
    seen = _running(p.unionByName(a), by, position, order, {"_seen": (F.last("_label", ignorenulls=True), last)})
    return seen.where("_side = 1").select("_all.*", F.col("_seen").alias(out))


def inside_item(probes: DataFrame, starts: DataFrame, ends: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Each probe with ``inside``: its latest start at or before it is later than its latest end."""
    none = F.lit(None).cast("long")
    p = probes.select(*by, position, F.struct(*probes.columns).alias("_all"), none.alias("_s"), none.alias("_e"), F.lit(1).alias("_side"))
    kind = p.schema["_all"].dataType
    s = starts.select(*by, position, F.lit(None).cast(kind).alias("_all"), F.col(position).cast("long").alias("_s"), none.alias("_e"), F.lit(0).alias("_side"))
    e = ends.select(*by, position, F.lit(None).cast(kind).alias("_all"), none.alias("_s"), F.col(position).cast("long").alias("_e"), F.lit(0).alias("_side"))
    latest = _running(p.unionByName(s).unionByName(e), by, position, [position, "_side"], {"_start": (F.max("_s"), F.max("_s")), "_end": (F.max("_e"), F.max("_e"))})
    return latest.where("_side = 1").select("_all.*", (F.coalesce("_start", F.lit(-1)) > F.coalesce("_end", F.lit(-1))).alias("inside"))


def _whole(df: DataFrame, column: str) -> Column:
    """A position as a whole number that keeps its order: days of dates, microseconds of timestamps, else the floor."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    return F.unix_date(c).cast("bigint") if kind == "date" else F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.floor(c).cast("bigint")


def _bins(low: Column, high: Column) -> Column:
    """The aligned dyadic bins, structs of level and number, that a span of whole numbers falls into: two a level at most."""
    width = F.when(high >= low, F.log2((high - low + 1).cast("double")))
    levels = F.when(width.isNotNull(), F.sequence(F.lit(0), F.floor(width).cast("int") + 1)).otherwise(F.array().cast("array<int>"))
    bin_ = lambda level, number: F.array(F.struct(level.alias("level"), number.alias("number")))

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        odd, even, none = lo % 2 != 0, hi % 2 == 0, F.slice(acc["out"], 1, 0)
        first = F.when((lo <= hi) & odd, bin_(level, lo)).otherwise(none)
        from_ = F.when(odd, lo + 1).otherwise(lo)
        last = F.when((from_ <= hi) & even, bin_(level, hi)).otherwise(none)
        to = F.when(even, hi - 1).otherwise(hi)
        return F.when(lo > hi, acc).otherwise(F.struct(F.shiftright(from_, 1).alias("lo"), F.shiftright(to, 1).alias("hi"), F.concat(acc["out"], first, last).alias("out")))

    start = F.struct(low.alias("lo"), high.alias("hi"), F.array().cast("array<struct<level:int,number:bigint>>").alias("out"))
    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def _span_candidates(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, carried: Mapping[str, str]) -> DataFrame:
    """Points with spans (``carried``: new names of their columns) that share a bin; a point without any has one row of nulls.

    A span is cut into its bins, a point lies in one bin of each level in use (63 at most),
    and the two meet by key, level and number. Bins hold nothing beyond the span, so only
    real hits meet, however many spans and points a key has.
    """
    low, high = _whole(spans, start), _whole(spans, end)
    binned = spans.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.col(c).alias(n) for c, n in carried.items()], F.explode(_bins(low, high)).alias("_bin")).select("*", F.col("_bin.level").alias("_level"), F.col("_bin.number").alias("_number")).drop("_bin")
    levels = sorted(r[0] for r in binned.select("_level").distinct().collect())
    own = _whole(points, at)
    placed = points.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright(own, v).alias("number")) for v in levels or [0]])))
    same = (F.col("_b.level") == F.col("_level")) & (F.col("_b.number") == F.col("_number"))
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_by{i}"))
    return placed.join(binned, same, "left").drop("_b", "_level", "_number", *[f"_by{i}" for i in range(len(by))])


def first_interval(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, *, start: str, end: str, order: str, value: str) -> DataFrame:
    """Each point with the value of the first span (by ``order``) that holds it, ends included; else null.

    An empty value counts as null, but still ends the search. Equal points are looked up
    once. Points and spans of a key meet by dyadic bins, not all with all.
    """
    different = points.groupBy(*points.columns).agg(F.count("*").alias("_copies"))
    met = _span_candidates(different, spans, by, at, start, end, {start: "_start", end: "_end", order: "_order", value: "_value"})
    here = F.col(at).between(F.col("_start"), F.col("_end"))
    first = met.groupBy(*points.columns, "_copies").agg(F.min_by(F.struct("_value"), F.when(here, F.struct("_order"))).alias("_first"))
    found = F.nullif(F.col("_first._value").cast("string"), F.lit(""))
    return first.select(*points.columns, found.alias(value), F.explode(F.expr("sequence(1L, _copies)"))).drop("col")


def _worded(names: DataFrame, column: str) -> DataFrame:
    """Different names with their folded form and tokens; names without tokens match nothing."""
    folded = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("folded", fold(F.col("name")))
    return folded.withColumn("words", tokens(F.col("folded"))).where(F.size("words") > 0)


def _begins(word: Column, upto: Column) -> Column:
    """The word's beginnings of two letters to ``upto``; none for numbers."""
    sizes = F.when(word.rlike("^[0-9]+$") | (upto < 2), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), upto))
    return F.transform(sizes, lambda n: F.substring(word, F.lit(1), n))


def _index_keys(word: Column) -> Column:
    """Under what a word is found: ``=`` itself, ``<`` each beginning that is shorter."""
    return F.concat(F.array(F.concat(F.lit("="), word)), F.transform(_begins(word, F.length(word) - 1), lambda p: F.concat(F.lit("<"), p)))


def _probe_keys(word: Column) -> Column:
    """Keys of the words that are the same as this one: itself, its beginnings as words, and words that it begins."""
    itself = F.array(F.concat(F.lit("="), word))
    shorter = F.transform(_begins(word, F.length(word) - 1), lambda p: F.concat(F.lit("="), p))
    longer = F.transform(F.filter(_begins(word, F.length(word)), lambda p: p == word), lambda p: F.concat(F.lit("<"), p))
    return F.concat(itself, shorter, longer)


def _within_candidates(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of names (``short``, ``long``) that meet in the short one's rarest token.

    Each token of a run is the same as one of the longer name, so one token is enough to
    meet by: the one that the fewest names of the other side have a word for. The keys with
    the most names, up to ``HOT_KEYS``, are dealt out in blocks of about ``BLOCK_NAMES``.
    """
    index = long.select(F.col("name").alias("long"), F.explode(F.array_distinct(F.flatten(F.transform("words", _index_keys)))).alias("key"))
    often = index.groupBy("key").agg(F.count("*").alias("rows"))
    probes = short.select(F.col("name").alias("short"), F.posexplode("words").alias("place", "word")).select("short", "place", F.explode(_probe_keys(F.col("word"))).alias("key"))
    met = probes.join(often, "key", "left").groupBy("short", "place").agg(F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.collect_list(F.when(F.col("rows") > 0, F.col("key"))).alias("keys"))
    # A token that no name has a word for rules its name out.
    rarest = met.groupBy("short").agg(F.min_by("keys", F.struct("rows", "place")).alias("keys"), F.min("rows").alias("rows")).where("rows > 0")
    probes = rarest.select("short", F.explode("keys").alias("key"))
    return _dealt(probes, index, often)


def _dealt(probes: DataFrame, index: DataFrame, often: DataFrame) -> DataFrame:
    """Probes and index joined by ``key``, keys over the bound in blocks of index rows that each probe visits."""
    hot = often.where(F.col("rows") > BLOCK_NAMES).orderBy(F.desc("rows"), "key").limit(HOT_KEYS)
    hot = F.broadcast(hot.select("key", F.ceil(F.col("rows") / BLOCK_NAMES).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    held = index.join(hot, "key", "left").withColumn("block", F.pmod(F.xxhash64("long"), blocks)).drop("blocks")
    asked = probes.join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("blocks")
    return asked.join(held, ["key", "block"]).select("short", "long")


def candidate_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of names to compare, each name of ``left`` and ``right`` with its ``words``.

    The name with fewer words is looked up among the others; of as many, the left one.
    """
    sized = lambda df: df.withColumn("n", F.size("words"))
    a, b = sized(left), sized(right)
    one, two = _within_candidates(a, b), _within_candidates(b, a)
    sizes = lambda pairs, x, y: pairs.distinct().join(a.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("folded").alias("a_folded")), F.col(x) == F.col("a")).join(b.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("folded").alias("b_folded")), F.col(y) == F.col("b"))
    upward = sizes(one, "short", "long").where("na <= nb")
    downward = sizes(two, "long", "short").where("na > nb")
    columns = ["a", "b", "a_folded", "b_folded"]
    return upward.select(*columns).unionByName(downward.select(*columns))


def matching_names(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Pairs of different names, one of each side, of which one's tokens are a run of the other's.

    Names meet in the rarest token of the one with fewer tokens (``candidate_names``); all
    but those pairs are never made.
    """
    pairs = candidate_names(_worded(left, left_col), _worded(right, right_col))
    return pairs.where(names_match(F.col("a_folded"), F.col("b_folded"))).select("a", "b")


def fuzzy_semi(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    good = matching_names(left, left_col, right, right_col).select(F.col("a").alias(left_col)).distinct()
    return left.join(good, left_col, "left_semi")


def fuzzy_anti(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Rows whose name matches none; null names stay."""
    bad = matching_names(left, left_col, right, right_col).select(F.col("a").alias(left_col)).distinct()
    return left.join(bad, left_col, "left_anti")


def unseen(new: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def zip_positional(left: DataFrame, right: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The i-th row of each side together, to the shorter: ``by``, ``i`` (from 0), ``left``, ``right``."""
    w = Window.partitionBy(*by).orderBy(order)
    a = left.select(*by, (F.row_number().over(w) - 1).alias("i"), F.struct(*left.columns).alias("left"))
    b = right.select(*by, (F.row_number().over(w) - 1).alias("i"), F.struct(*right.columns).alias("right"))
    return a.join(b, [*by, "i"])


def zip_mismatches(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of which the sides differ in length, with both lengths."""
    a, b = left.groupBy(*by).agg(F.count("*").alias("n_left")), right.groupBy(*by).agg(F.count("*").alias("n_right"))
    both = a.join(b, list(by), "full").select(*by, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def common_subsequence(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence.

    From the start, equal items pair; otherwise the left side advances unless only
    advancing the right keeps the length.

    A row holds, for one suffix of ``a``, the lengths with all suffixes of ``b``. Rows are
    made from the last up, and one in about sqrt(len(a)) is kept; on the way back each
    stretch between two kept ones is made again. So memory is sqrt(len(a)) times len(b).
    """
    codes: dict = {}
    x, y = (np.array([codes.setdefault(item, len(codes)) for item in side], dtype=np.int64) for side in (a, b))
    n, m = len(x), len(y)
    size = np.uint16 if min(n, m) < 1 << 16 else np.int32
    step = max(1, round(n**0.5))

    def rows(below: np.ndarray, first: int, last: int):
        """Rows ``last`` - 1 down to ``first``, given row ``last``."""
        for i in range(last - 1, first - 1, -1):
            row = np.zeros(m + 1, dtype=size)
            np.maximum(below[:-1], np.where(y == x[i], below[1:] + size(1), size(0)), out=row[:-1])
            below = np.maximum.accumulate(row[::-1])[::-1]
            yield i, below

    kept = {n: np.zeros(m + 1, dtype=size)}
    for i, row in rows(kept[n], 0, n):
        if i % step == 0:
            kept[i] = row
    pairs, i, j, near = [], 0, 0, {}
    while i < n and j < m:
        if i + 1 not in near:
            stop = min(n, i - i % step + step)
            near = dict([(stop, kept[stop]), *rows(kept[stop], i, stop)])
        if not near[i][j]:
            break
        if x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif near[i + 1][j] == near[i][j]:
            i += 1
        else:
            j += 1
    return pairs


def lcs_align(left: DataFrame, right: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Left rows paired with right ones in order, by a longest common subsequence of ``item``.

    One row for each left row: ``by``, ``i``, ``j`` (null if unpaired), both 0-based. A
    group is one document; its two sequences are aligned in one task.
    """
    a = left.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("a"))
    b = right.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("b"))
    both = a.join(b, by, "left").select(by, F.transform("a", lambda x: x[item].cast("string")).alias("a"), F.coalesce(F.transform("b", lambda x: x[item].cast("string")), F.array().cast("array<string>")).alias("b"))

    def align(frames):
        for f in frames:
            rows = []
            for key, x, y in f.itertuples(index=False):
                pair = dict(common_subsequence(list(x), list(y)))
                rows += [(key, i, pair.get(i)) for i in range(len(x))]
            yield pd.DataFrame({by: pd.Series([r[0] for r in rows], dtype=f[by].dtype), "i": pd.Series([r[1] for r in rows], dtype="int64"), "j": pd.Series([r[2] for r in rows], dtype="Int64")})

    return both.mapInPandas(align, f"{by} {dict(both.dtypes)[by]}, i long, j long")


def first_tier(sources: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """For each key the row of the first source that has it; within a source the lowest ``order``."""
    united = None
    for tier, df in enumerate(sources):
        part = df.withColumn("tier", F.lit(tier))
        united = part if united is None else united.unionByName(part)
    rest = [c for c in united.columns if c not in keys]
    best = united.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("tier", order)).alias("best"))
    return best.select(*keys, "best.*")


def contains_all(passage: Column, pieces: Column) -> Column:
    """Whether every non-empty piece is literally in the passage, both as quotation keys."""
    key = quotation_key(passage)
    return F.forall(pieces, lambda p: (quotation_key(p) == "") | F.contains(key, quotation_key(p)))


def literal_matches(passages: DataFrame, passage_col: str, quotes: DataFrame, quote_col: str, key: Callable[[Column], Column] = quotation_key) -> DataFrame:
    """Pairs of passages and quotations held literally, both as keys: quotation keys, if no others are given."""
    p = passages.withColumn("_passage", key(F.col(passage_col)))
    q = quotes.withColumn("_quote", key(F.col(quote_col)))
    return contained(p, "_passage", q, "_quote").drop("_passage", "_quote")
