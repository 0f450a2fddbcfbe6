"""Personal data: fixed forms, and identifiers in contexts learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmill.llm.skew import join_hot
from contentmill.llm.spans import SPAN, count, gated, joined, pieces, spans_in_context, tagged
from contentmill.llm.workspace import Workspace

# The base forms. Possessive parts match what greedy ones would, and
# neither backtrack over long runs nor recurse.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Identifier-like strings that a learned pattern may reveal: up to four letters, then groups
#: that begin with a digit, parted by single spaces, dots, slashes or hyphens; with so many
#: letters and digits, and so many digits, in all.
CANDIDATE = r"(?<![A-Za-z0-9+@._/-])[A-Za-z]{0,4}+-?[0-9][0-9A-Za-z]*+(?:[\x20./-][0-9][0-9A-Za-z]*+)*+(?![A-Za-z0-9@])"
CANDIDATE_CHARS, CANDIDATE_DIGITS = 6, 4
#: A pattern is trusted from so many different trusted instances and this confidence; an
#: instance that nothing is known of counts as this part of one against it.
SEEDS_LEAST, CONFIDENCE_LEAST, UNKNOWN = 5, 0.8, 0.25
KINDS = ("email", "ip", "card", "phone")

def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _good_ip(s: Column) -> Column:
    plain = F.transform(F.split(s["body"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _good_card(s: Column) -> Column:
    digits = _digits(s["body"])
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _patterns(s: Column) -> Column:
    """Lexical patterns around a slot: two words before, one on either side, two after.

    Words are in lower case, digits in them are 0, and punctuation at their ends is dropped.
    """
    clean = lambda words: F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"(?U)^[^\w\s]+|[^\w\s]+(?=\s|$)|(?<=\s)[^\w\s]+", "")
    left, right = F.split(F.trim(clean(s["left"])), r"\s+"), F.split(F.trim(clean(s["right"])), r"\s+")
    near = F.get(left, F.size(left) - 1)
    two = lambda w: F.size(w) == 2
    both = (near != "") & (F.get(right, F.lit(0)) != "")
    found = F.array(F.when(two(left), F.concat(F.array_join(left, " "), F.lit(" _"))), F.when(both, F.concat(near, F.lit(" _ "), F.get(right, F.lit(0)))), F.when(two(right), F.concat(F.lit("_ "), F.array_join(right, " "))))
    return F.array_compact(found)


def _slots(found: Column, kind: str | None) -> Column:
    out = F.transform(found, lambda s: F.struct(_patterns(s).alias("patterns"), F.lower(s["body"]).alias("instance"), F.lit(kind).cast("string").alias("kind"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return F.coalesce(out, F.array().cast("array<struct<patterns:array<string>,instance:string,kind:string,start:int,end:int>>"))


def learn_patterns(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Trusted patterns (pattern, kind, confidence, and ``rows``, their occurrences) that introduce identifiers.

    ``edges`` (pattern, instance, kind) is the graph of patterns and instances; ``kind`` is
    null for what isn't a seed. Seeds are trusted with 1. In each round a pattern's
    confidence is the trust in its different instances over that trust, plus ``UNKNOWN`` for
    each instance that isn't trusted, plus one. Instances of a trusted pattern are trusted
    with the highest confidence around them, take its kind, and count like seeds in the next
    round, so one pattern reveals instances that reveal another. Trust only grows; rounds
    end when no further pattern is trusted. All are sums and maxima by key, combined before
    shuffles; patterns with fewer instances than ``SEEDS_LEAST`` are dropped at the start.
    """
    graph = edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.count("*").alias("times"))
    graph = ws.table(graph, "edges")
    often = graph.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("times").alias("rows")).where(F.col("n") >= SEEDS_LEAST).drop("n")
    # ``rows`` (a pattern's occurrences) and ``around`` (an instance's patterns) tell which keys are hot.
    graph = ws.table(join_hot(graph.drop("times"), ws.table(often, "often"), ["pattern"], "rows"), "graph")
    around = ws.table(graph.where("kind is null").groupBy("instance").agg(F.count("*").alias("around")), "around")
    scored = graph.select("pattern", "instance", "kind", "rows", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    known, step = -1, 0
    while True:
        by_kind = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.first("rows").alias("rows"))
        trusted = F.col("kind").isNotNull()
        rated = by_kind.groupBy("pattern").agg(F.max_by("kind", F.when(trusted, F.struct("score", "kind"))).alias("kind"), F.sum("score").alias("score"), F.sum(F.when(trusted, F.col("n")).otherwise(0)).alias("trusted"), F.sum(F.when(trusted, 0).otherwise(F.col("n"))).alias("unknown"), F.first("rows").alias("rows"))
        rated = rated.select("pattern", "kind", "trusted", "rows", (F.col("score") / (F.col("score") + UNKNOWN * F.col("unknown") + 1)).alias("confidence"))
        patterns = ws.table(rated.where((F.col("trusted") >= SEEDS_LEAST) & (F.col("confidence") >= CONFIDENCE_LEAST)).select("pattern", "kind", "confidence", "rows"), f"patterns-{step}")
        now = patterns.count()
        if now == known or not now:
            return patterns
        known, step = now, step + 1
        told = join_hot(graph.where("kind is null").drop("rows"), patterns.withColumnRenamed("kind", "told"), ["pattern"], "rows")
        best = told.groupBy("instance").agg(F.max(F.struct("confidence", "told")).alias("best")).join(around, "instance")
        best = ws.table(best, f"instances-{step}")
        scored = join_hot(graph, best, ["instance"], "around", "left").select("pattern", "instance", "rows", F.coalesce("kind", "best.told").alias("kind"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("best.confidence", F.lit(0.0))).alias("score"))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text, one row per input row.

    Columns: the id and ``email``, ``ip``, ``card``, ``phone`` and ``context`` (arrays of
    spans). The first four are fixed forms, leftmost and non-overlapping by kind.
    ``context`` has further identifier-like strings in lexical patterns that, over the
    whole corpus, hold nearly nothing but personal data (``learn_patterns``); the kind of
    such a span is that of the seeds its pattern comes from, as in ``context-phone``.

    A null text is empty and has no spans; repeated rows are each scanned (their patterns
    and instances count once); a null id stays null; other columns are ignored; an empty
    table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "pii")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("numeric", F.col("text").rlike("[0-9]"))
    forms = dict(zip((*KINDS, "more"), (EMAIL, IP, CARD, PHONE, CANDIDATE), strict=True))
    found = base.select(
        "id",
        "text",
        gated(F.contains("text", F.lit("@")), EMAIL).alias("m_email"),
        gated(F.col("numeric") & F.contains("text", F.lit(".")), IP).alias("m_ip"),
        gated(F.col("numeric"), CARD).alias("m_card"),
        gated(F.contains("text", F.lit("+")), PHONE).alias("m_phone"),
        gated(F.col("numeric"), CANDIDATE).alias("m_more"),
    )
    # Most runs of digits are short: texts without one that counts need no positions.
    none = F.array().cast("array<string>")
    found = found.withColumn("m_card", F.when(F.exists("m_card", lambda m: F.length(m) >= 12), F.col("m_card")).otherwise(none))
    found = found.withColumn("m_more", F.when(F.exists("m_more", lambda m: F.length(m) >= CANDIDATE_CHARS), F.col("m_more")).otherwise(none))
    gaps = found.select("id", *[f"m_{k}" for k in forms], *[pieces("text", f"m_{k}", form).alias(f"g_{k}") for k, form in forms.items()])
    placed = gaps.select("id", *[spans_in_context(f"g_{k}", f"m_{k}").alias(k) for k in forms])
    plain = lambda s: F.regexp_replace(s["body"], "[^0-9A-Za-z]", "")
    good = placed.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "email",
        F.filter("ip", _good_ip).alias("ip"),
        F.filter("card", _good_card).alias("card"),
        F.filter("phone", lambda s: F.length(_digits(s["body"])).between(9, 15)).alias("phone"),
        F.filter("more", lambda s: (F.length(plain(s)) >= CANDIDATE_CHARS) & (F.length(_digits(s["body"])) >= CANDIDATE_DIGITS)).alias("more"),
    )
    good = good.select("row", "id", *[tagged(F.col(k), k, i).alias(k) for i, k in enumerate(KINDS)], F.concat(*[_slots(F.col(k), k) for k in KINDS]).alias("seeds"), _slots(F.col("more"), None).alias("others"))
    good = ws.table(good, "found")
    slots = good.where("size(seeds) > 0 or size(others) > 0")
    edges = slots.select(F.explode(F.concat("seeds", "others")).alias("e")).select(F.explode("e.patterns").alias("pattern"), "e.instance", "e.kind")
    patterns = learn_patterns(ws, edges)
    # Occurrences in trusted patterns; those that a base span of the same text touches go.
    loose = slots.select("row", F.explode("others").alias("o")).select("row", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    loose = join_hot(loose, patterns, ["pattern"], "rows")
    marked = ws.table(loose.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("row", "start", "end", F.concat(F.lit("context-"), F.col("b.kind")).alias("kind"), F.lit(1).alias("side")), "marked")
    beside = slots.join(marked.select("row").distinct(), "row", "left_semi").select("row", F.explode("seeds").alias("s")).select("row", "s.start", "s.end", "s.kind", F.lit(0).alias("side"))
    order = Window.partitionBy("row").orderBy("start", "side", "end")
    seed_end, seed_start = F.when(F.col("side") == 0, F.col("end")), F.when(F.col("side") == 0, F.col("start"))
    apart = marked.unionByName(beside).withColumns({"before": F.max(seed_end).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.min(seed_start).over(order.rowsBetween(1, Window.unboundedFollowing))})
    apart = apart.where("side = 1 and coalesce(before, 0) <= start and coalesce(after, end) >= end")
    unseen = apart.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind"))).cast(SPAN).alias("context"))
    out = good.drop("seeds", "others").join(unseen, "row", "left")
    return ws.finish(out.select(F.col("id").alias(id_col), *KINDS, F.coalesce("context", F.array().cast(SPAN)).alias("context")))


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.concat(*KINDS)
    return found.select(id_col, *[count(F.col(k)).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "context")).alias("spans"))
