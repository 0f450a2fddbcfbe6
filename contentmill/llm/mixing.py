"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from contentmill.llm.workspace import Workspace

#: Least blocks of a source, and the rows of all sources for each block beyond that; blocks
#: bound the rows that are put in order together.
BLOCKS, BLOCK_ROWS = 4096, 65_536
#: Halvings of the exponent's interval done by one aggregation, and aggregations.
HALVINGS, ROUNDS = 8, 4

_SPACE = r"[\x20\x09-\x0D]"


def token_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    edges = F.rlike(text, F.lit(f"^{_SPACE}")).cast("int") + F.rlike(text, F.lit(f"{_SPACE}\\z")).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{_SPACE}+", -1)) - edges).cast("long")


def solve_exponent(sources: DataFrame, *, entropy: float, repeats: float, budget: float) -> float:
    """Exponent a in 0..1 of weights ~ share ** a, by bisection.

    Entropy falls and repetition doesn't rise as a grows. The result is the largest a
    whose weights have at least ``entropy`` (a share of its maximum, log of the number of
    sources), but no less than the smallest a that repeats no source more than
    ``repeats`` times for this budget: the repetition limit wins. ``sources`` has
    ``tokens`` > 0; each aggregation evaluates the midpoints of ``HALVINGS`` halvings.
    """
    total, count = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not count:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def evaluate(points: list[float]) -> dict[float, tuple[float, float]]:
        grid = sources.select(share.alias("p"), F.explode(F.lit(points)).alias("a"))
        power = F.pow("p", F.col("a"))
        sums = grid.groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("t"), F.max(F.pow("p", F.col("a") - 1)).alias("m"))
        return {r["a"]: (r["s"], r["t"], r["m"]) for r in sums.collect()}

    def high_enough(a: float, s: float, t: float) -> bool:
        return log(s) - a * t / s >= entropy * log(count) - 1e-12

    def spare_enough(m: float, s: float) -> bool:
        return m / s * budget / total <= repeats * (1 + 1e-12)

    span = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    for _ in range(ROUNDS):
        cells = 1 << HALVINGS
        points = sorted({lo + (hi - lo) * i / cells for lo, hi in span.values() for i in range(cells + 1)})
        at = evaluate(points)
        lo, hi = span["entropy"]
        good = [a for a in points if lo <= a <= hi and high_enough(a, at[a][0], at[a][1])]
        top = max(good, default=lo)
        span["entropy"] = (top, min([a for a in points if a > top], default=top))
        lo, hi = span["repeats"]
        good = [a for a in points if lo <= a <= hi and spare_enough(at[a][2], at[a][0])]
        low = min(good, default=hi)
        span["repeats"] = (max([a for a in points if a < low], default=low), low)
    return max(span["entropy"][0], span["repeats"][1])


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.98, repeats: float = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """A training order of the documents under temperature-mixed source weights.

    Each source's share of tokens is raised to the exponent that ``solve_exponent`` finds;
    normalised weights times ``budget`` (all tokens, if not given) are its tokens. A
    source is read in passes. A pass takes the source's blocks (by a hash of the id) and
    the documents of a block in orders drawn anew by hashes; full passes take all, the
    last pass stops before the document that would exceed the source's tokens.

    One row for each document and pass: the id, source, ``pass`` (0-based), ``n_tokens``,
    ``weight`` of the source, and the place in the order: sort by ``block_order``, then
    ``doc_order``, then id. Null sources are a source of their own (null in the result);
    documents without tokens come along in the passes that their block is in; repeated
    rows are documents of their own; a source without tokens has no pass; other columns
    are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col).cast("string")).alias("tokens"))
    key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    rows = ws.table(rows.withColumn("key", key), "rows")
    count = max(BLOCKS, rows.count() // BLOCK_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "tokens", F.lit(seed)), F.lit(count)))
    blocks = ws.table(rows.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = ws.table(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    exponent = solve_exponent(sources, entropy=entropy, repeats=repeats, budget=budget)
    norm = sources.agg(F.sum(F.pow("tokens", F.lit(exponent)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(norm)
    plan = sources.select("key", F.col("tokens").alias("all"), weight.alias("weight"), F.floor(weight * budget + F.lit(1e-6)).cast("long").alias("want"))
    plan = plan.select("key", "weight", F.expr("want div all").alias("passes"), F.expr("want % all").alias("rest"))

    def order(column: str, number: Column) -> Column:
        return F.xxhash64(F.lit(seed), number, "key", column)

    # The last pass: blocks in order until the rest is used up.
    drawn = Window.partitionBy("key").orderBy(order("block", F.col("passes")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = blocks.join(plan, "key").withColumn("up_to", F.sum("tokens").over(drawn))
    dealt = dealt.select("key", "block", "weight", "passes", (F.col("rest") - F.col("up_to") + F.col("tokens")).alias("left"), (F.expr("up_to <= rest and rest > 0")).alias("whole"))
    dealt = dealt.withColumn("split", ~F.col("whole") & (F.col("left") > 0))
    placed = rows.join(dealt, ["key", "block"])
    within = Window.partitionBy("key", "block").orderBy(order("id", F.col("passes")), "id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.where("split").withColumn("last", F.sum("tokens").over(within) <= F.col("left"))
    rest = placed.where("not split").withColumn("last", F.col("whole"))
    taken = rest.unionByName(cut).select("*", F.explode(F.expr("filter(sequence(0L, passes), p -> p < passes or last)")).alias("pass"))
    result = taken.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        F.col("pass"),
        F.col("tokens").alias("n_tokens"),
        F.col("weight"),
        order("block", F.col("pass")).alias("block_order"),
        order("id", F.col("pass")).alias("doc_order"),
    )
    return ws.finish(result)
