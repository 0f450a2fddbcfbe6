"""Spans of regular expressions in whole texts, as Spark expressions only.

Positions are code points; ends are exclusive. ``regexp_extract_all`` and ``split``
run the same matcher, so the i-th piece of the split is the gap before match i and
starts follow from lengths. Running sums go over chunks of ``CHUNK`` matches, so a text
with very many matches costs about linear time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running_starts(steps: Column) -> Column:
    """For an array of structs (gap, own), where each own part starts."""
    count = F.size(steps)
    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))

    def grow(state: Column, step: Column) -> Column:
        at = state["at"] + step["gap"]
        return F.struct((at + step["own"]).alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    def grow_part(state: Column, part: Column) -> Column:
        inside = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast("array<int>").alias("out")), grow)
        return F.struct(inside["at"].alias("at"), F.concat(state["out"], F.array(inside["out"])).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(parts, empty, grow_part)["out"])


def gated(needed: Column, pattern: str, text: str = "text") -> Column:
    """All matches of ``pattern``; texts without what any match needs aren't scanned."""
    return F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def spans(text: str, found: str, pattern: str) -> Column:
    """Spans (start, end, body) of ``pattern``; column ``found`` holds its matches.

    Null when ``found`` is empty, so that texts without a match pay for one scan only.
    """
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.col(found), lambda gap, own: F.struct(F.length(gap).alias("gap"), F.length(own).alias("own"), own.alias("body")))
    placed = F.zip_with(running_starts(steps), steps, lambda at, s: F.struct(at.alias("start"), (at + s["own"]).cast("int").alias("end"), s["body"].alias("body")))
    return F.when(F.size(found) > 0, placed)


def pieces(text: str, found: str, pattern: str) -> Column:
    """The texts before, between and after the matches; null when there are none."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def spans_in_context(gaps: str, found: str) -> Column:
    """Spans as in ``spans``, from ``pieces``, with up to two words ``left`` and ``right``.

    Words are whole, however long; a match of the same kind beside this one ends them.
    """
    count = F.size(found)
    two = r"^\s*(\S+(?:\s+\S+)?)"

    def step(gap: Column, own: Column) -> Column:
        left = F.reverse(F.regexp_extract(F.reverse(gap), two, 1))
        return F.struct(F.length(gap).alias("gap"), F.length(own).alias("own"), own.alias("body"), left.alias("left"))

    steps = F.zip_with(F.slice(gaps, F.lit(1), count), F.col(found), step)
    rights = F.transform(F.slice(gaps, F.lit(2), count), lambda gap: F.regexp_extract(gap, two, 1))
    placed = F.zip_with(running_starts(steps), steps, lambda at, s: F.struct(at.alias("start"), (at + s["own"]).cast("int").alias("end"), s["body"].alias("body"), s["left"].alias("left")))
    both = F.zip_with(placed, rights, lambda s, right: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["body"].alias("body"), s["left"].alias("left"), right.alias("right")))
    return F.when(count > 0, both)


def tagged(found: Column, kind: str, rank: int) -> Column:
    """Sortable spans of one kind; an empty array for null."""
    out = F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), s["end"].cast("int").alias("end"), F.lit(kind).alias("kind")))
    return F.coalesce(out, F.array().cast(SPAN))


def joined(found: Column) -> Column:
    """kind:start:end by start and rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column) -> Column:
    return F.size(found).cast("long")
