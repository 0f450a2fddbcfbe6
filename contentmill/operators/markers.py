"""Markers in texts: where a pattern's matches stand, as arrays for whole documents.

Matches are found in one pass of the JVM's regular expressions, left to right and without
overlap unless a function says otherwise. Two code points that stand for no character
part a text at its matches; ``clean`` drops them from what comes in. Patterns are Java's,
with ``(?U)`` where classes must know all of Unicode. Places count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT = "\ufdd0", "\ufdd1"

#: Characters that a folded text leaves out: neither letter, number nor white space.
DROPPED = r"[^\p{L}\p{N}\s]"


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), OPEN + SHUT, "")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """Lines without their ends, at every kind of line end."""
    return F.split(text, r"\R|[\x1c-\x1e]")


def kept_lines(text: Column) -> Column:
    """Lines with their ends."""
    return F.split(text, r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)")


def _placed(pieces: Column, size, fields) -> Column:
    """Structs of ``at`` and ``fields`` of every piece but the first, ``size`` being what a piece holds of the text.

    Only places are summed up in the fold, as it copies its state at each step.
    """
    sizes = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: size(p).cast("bigint"))
    start = F.array(F.length(F.get(pieces, F.lit(0))).cast("bigint"))
    ats = F.aggregate(sizes, start, lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    return F.transform(F.arrays_zip(F.slice(pieces, F.lit(2), F.size(pieces)).alias("p"), F.slice(ats, F.lit(1), F.size(sizes)).alias("at")), lambda x: F.struct(x["at"].alias("at"), *fields(x["p"])))


def held(df: DataFrame) -> DataFrame:
    """The same rows, whose columns are computed here, once a row.

    The optimizer moves a column's expression to the one place that names it; inside a
    function over an array that would be once an element. It doesn't move it past a generator.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def with_marks(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """``name``: an array of structs ``at``, ``match`` and ``rest`` (up to the next match) of the column ``text``."""
    half = lambda p, i: F.get(F.split(p, SHUT), F.lit(i))
    found = df.withColumn("_pieces", F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}"), OPEN))
    marks = _placed(F.col("_pieces"), lambda p: F.length(p) - 1, lambda p: [half(p, 0).alias("match"), half(p, 1).alias("rest")])
    return found.withColumn(name, marks).drop("_pieces")


def end(mark: Column) -> Column:
    return mark["at"] + F.length(mark["match"])


def piece_of(text: Column, start: Column, stop: Column) -> Column:
    """The text between two places; empty where they are the wrong way round."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def piece_after(mark: Column, stop: Column, text: Column) -> Column:
    """The text from a mark's end to a place. Up to the next mark it is cut from the mark's own ``rest``, so that the whole text isn't gone through for each mark."""
    return F.when(stop <= end(mark) + F.length(mark["rest"]), piece_of(mark["rest"], F.lit(0), stop - end(mark))).otherwise(piece_of(text, end(mark), stop))


# Titles: many short texts looked up in a long one at once.


def folded(s: Column) -> Column:
    """Letters, numbers and white space in upper case."""
    return F.upper(F.regexp_replace(s, f"(?U){DROPPED}", ""))


def letters(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def loose_pattern(key: Column) -> Column:
    """A pattern for texts that fold to ``key``: any dropped characters may stand within."""
    return F.regexp_replace(key, r"(?s)(.)(?=.)", "$1" + DROPPED.replace("\\", "\\\\") + "*+")


def spaced_pattern(key: Column) -> Column:
    """A pattern for ``key`` as written, with any white space where it has a space."""
    quoted = F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), F.replace(quoted, F.lit(" "), F.lit("\\E\\s+\\Q")), F.lit("\\E"))


def with_hits(df: DataFrame, name: str, text: str, keys: Column, pattern, key, flags: str, window: Column | None = None) -> DataFrame:
    """``name``: an array of structs ``at``, ``key`` and ``window``, wherever one of ``keys`` stands, overlaps included.

    One pattern of all keys is tried at each place that begins like one of them, the longest
    key first; ``key`` is what was found, folded as the keys are, so that each key that it
    begins with stands there too. ``window`` is that much of the text from the place on.
    """
    known = F.array_sort(F.filter(F.array_distinct(keys), lambda k: k != ""), lambda a, b: F.length(b) - F.length(a))
    firsts = F.array_distinct(F.transform(F.col("_keys"), lambda k: F.substring(k, 1, 1)))
    given = df.withColumn("_keys", known)
    # Grouped by first letter: a place is compared with the keys of its own letter only.
    groups = F.transform(firsts, lambda c: F.array_join(F.transform(F.filter(F.col("_keys"), lambda k: F.substring(k, 1, 1) == c), pattern), "|"))
    begins = F.array_join(F.transform(firsts, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "|")
    size = F.coalesce(window, F.lit(0)) if window is not None else F.lit(0)
    whole = F.concat(F.lit(f"(?{flags})(?="), begins, F.lit(")(?=("), F.array_join(F.transform(groups, lambda g: F.concat(F.lit("(?:"), g, F.lit(")"))), "|"), F.lit("))(?=((?s:.{0,"), size.cast("string"), F.lit("})))"))
    given = given.withColumn("_pattern", F.when(F.size("_keys") > 0, whole))
    cut = F.when(F.col("_pattern").isNull(), F.array(F.lit(""))).otherwise(F.split(F.regexp_replace(F.col(text), F.col("_pattern"), F.lit(f"{OPEN}$1{SHUT}$2{SHUT}")), OPEN))
    given = given.withColumn("_pieces", cut)
    part = lambda p, i: F.get(F.split(p, SHUT), F.lit(i))
    hits = _placed(F.col("_pieces"), lambda p: F.length(part(p, 2)), lambda p: [key(part(p, 0)).alias("key"), part(p, 1).alias("window")])
    return given.withColumn(name, hits).drop("_keys", "_pattern", "_pieces")


def places(hits: Column, key: Column) -> Column:
    """The hits of one key."""
    return F.when(key == "", F.slice(hits, F.lit(1), F.lit(0))).otherwise(F.filter(hits, lambda h: F.startswith(h["key"], key)))


def first_part(s: Column) -> Column:
    """The part of a title that is looked for where the whole isn't found."""
    return F.substring(s, F.lit(1), F.greatest(F.lit(8), F.floor(F.length(s) * F.lit(0.6)).cast("int")))


# Alignment of two sequences.


def with_common_pairs(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """``name``: an array of structs i, j, the index pairs of one longest common subsequence of the arrays ``a`` and ``b``.

    From the start, equal items pair; otherwise the left side advances unless only
    advancing the right keeps the length.

    Only places where both sides agree are looked at. Going up through ``a``, an array holds
    how far right in ``b`` a common subsequence of 1, 2, ... items can begin (negated, so
    ascending), which ranks each such place by the length that begins there. The pairs are
    then read off by falling rank.
    """
    spots = lambda item: F.filter(F.transform(b, lambda y, j: F.when(y == item, j)), lambda j: j.isNotNull())
    below = lambda reach, j: F.size(F.filter(reach, lambda x: x < -j))
    put = lambda reach, j: F.concat(F.slice(reach, F.lit(1), below(reach, j)), F.array(-j), F.slice(reach, below(reach, j) + 2, F.size(reach)))

    def rank(acc: Column, item: Column) -> Column:
        found = F.transform(item["spots"], lambda j: F.struct(item["i"].alias("i"), j.alias("j"), (below(acc["reach"], j) + 1).alias("rank")))
        return F.struct(F.aggregate(item["spots"], acc["reach"], put).alias("reach"), F.concat(acc["out"], found).alias("out"))

    items = F.reverse(F.transform(a, lambda x, i: F.struct(i.alias("i"), spots(x).alias("spots"))))
    start = F.struct(F.array().cast("array<int>").alias("reach"), F.array().cast("array<struct<i:int,j:int,rank:int>>").alias("out"))
    ranked = held(held(df.withColumn("_items", items)).withColumn("_ranked", F.aggregate("_items", start, rank, lambda acc: acc["out"])).drop("_items"))

    def read(s: Column, k: Column) -> Column:
        least = lambda c, good: F.array_min(F.transform(F.filter("_ranked", lambda p: (p["rank"] >= k) & (p["i"] >= s["i"]) & (p["j"] >= s["j"]) & good(p)), lambda p: c(p)))
        here = least(lambda p: p["i"], lambda p: p["j"] == s["j"])
        last = -least(lambda p: -p["i"], lambda p: F.lit(True))
        i = F.coalesce(here, last)
        j = F.when(here.isNotNull(), s["j"]).otherwise(least(lambda p: p["j"], lambda p: p["i"] == last))
        pair = F.struct(i.alias("i"), j.alias("j"))
        return F.struct((i + 1).alias("i"), (j + 1).alias("j"), F.array_append(s["out"], pair).alias("out"))

    longest = F.coalesce(F.array_max(F.transform("_ranked", lambda p: p["rank"])), F.lit(0))
    steps = F.when(longest > 0, F.sequence(longest, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))
    return held(ranked.withColumn(name, F.aggregate(steps, begin, read, lambda s: s["out"])).drop("_ranked"))
