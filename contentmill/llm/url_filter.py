"""URL filters: prefix rules, and a path-template tree for what no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmill.llm.skew import join_hot
from contentmill.llm.workspace import Workspace

#: Up to so many rules are compared in place; more are joined by host.
RULES_IN_PLACE = 256
#: A level whose different segments are at least so many, and this share of the different
#: paths below it, varies. Copies and the number of rows don't count.
VARIETY_LEAST, VARIETY_SHARE = 8, 0.3
#: Two branches are alike if both have so many labels and their shares differ by no more
#: than this many standard errors.
MERGE_LABELS, MERGE_ERRORS = 5, 2.0
#: A node counts its parent's share as so many labels; the root's parent has PRIOR_SHARE.
#: A template is rejected from a smoothed share of REJECT_FROM.
PARENT_WEIGHT, PRIOR_SHARE, REJECT_FROM = 4.0, 0.25, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _smoothed(bad: Column, labels: Column, parent: Column) -> Column:
    return (bad + PARENT_WEIGHT * parent) / (labels + PARENT_WEIGHT)


def match_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) of the longest fitting rule, or nulls.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains if the
    path starts with the rule's. ``pages`` has row, host and path. A list of up to
    ``RULES_IN_PLACE`` is compared in place; others are joined by host suffix.
    """
    if not isinstance(rules, DataFrame):
        if not rules:
            return pages.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
        if len(rules) <= RULES_IN_PLACE:
            fits = [F.when(((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("ruled"))) for v, h, p in rules]
            return pages.withColumn("best", F.array_max(F.array(*fits))).select(*pages.columns, "best.rule", "best.ruled")
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    rules = rules.toDF("verdict", "rule_host", "rule_path")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = pages.select("row", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where(F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = tried.groupBy("row").agg(F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("verdict").alias("ruled"))).alias("best"))
    return pages.join(best, "row", "left").select(*pages.columns, "best.rule", "best.ruled")


def shares_around(ws: Workspace, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What other hosts tell: ``host``, ``n`` (its keys), ``share``; and ``host``, ``prefix``, ``told``, ``n``.

    A prefix is a path's first segment. Every suffix of a host (org, example.org,
    a.example.org) and the root of all sum up the labels of their hosts, prefix by prefix.
    ``share`` is smoothed from the root over the suffixes down to the host; there each
    labelled prefix counts as one label, so that one that a rule has labelled throughout
    doesn't speak for all others. ``told`` lists, for the root and the suffixes above the
    host, the blocked and all labels of the same prefix.
    """
    pairs = keys.groupBy("host", F.coalesce(F.get("segments", F.lit(0)), F.lit("")).alias("prefix")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("labels").alias("labels"))
    pairs = ws.table(pairs, "pairs")
    hosts = ws.table(pairs.groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("*")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), ".")))
    spread = pairs.select("prefix", F.explode(suffixes).alias("node"), "bad", "labels")
    nodes = ws.table(spread.groupBy("node", "prefix").agg(F.count("*").alias("rows"), F.sum("bad").alias("bad"), F.sum("labels").alias("labels")).where("labels > 0"), "prefixes")
    # How many hosts have a suffix, for the join; a prefix is one label of its average.
    sizes = hosts.select(F.explode(suffixes).alias("node")).groupBy("node").agg(F.count("*").alias("rows"))
    whole = ws.table(nodes.groupBy("node").agg(F.sum(F.col("bad") / F.col("labels")).alias("bad"), F.count("*").cast("double").alias("labels")).join(sizes, "node"), "suffixes")
    met = join_hot(hosts.select("host", F.posexplode(suffixes).alias("at", "node")), whole, ["node"], "rows")
    chain = met.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "bad", "labels"))).alias("chain"))
    share = F.aggregate(F.coalesce("chain", F.array().cast("array<struct<at:int,bad:double,labels:double>>")), F.lit(PRIOR_SHARE), lambda share, n: _smoothed(n["bad"], n["labels"], share))
    shares = ws.table(hosts.join(chain, "host", "left").select("host", "n", share.alias("share")), "shares")
    above = pairs.select("host", "prefix", "n", F.posexplode(F.slice(suffixes, F.lit(1), F.size(labels))).alias("at", "node"))
    told = join_hot(above, nodes, ["node", "prefix"], "rows").groupBy("host", "prefix").agg(F.array_sort(F.collect_list(F.struct("at", "bad", "labels"))).alias("told"), F.first("n").alias("n"))
    return shares, ws.table(told, "told")


def path_templates(ws: Workspace, keys: DataFrame) -> DataFrame:
    """``host``, ``segments``, ``template`` and ``share`` of every key (host, segments, bad, labels).

    The tree of each host is walked from the root, all hosts side by side. At a node the
    keys' next segments are counted: a varying level becomes a wildcard, and so do branches
    whose labels don't tell them from their siblings together. A node's share of blocked
    labels is smoothed toward its parent's. A node of too few keys and labels to generalise
    keeps them as they are, each a leaf; a stretch that all keys of a node share is passed
    at once, so there are no more steps than real forks on a path, and no limit to depth.
    Counts are sums by key; no host's paths are gathered.
    """
    shares, told = shares_around(ws, keys)
    rooted = join_hot(keys, shares, ["host"], "n").drop("n").withColumn("prefix", F.coalesce(F.get("segments", F.lit(0)), F.lit("")))
    rooted = join_hot(rooted, told, ["host", "prefix"], "n", "left")
    state = rooted.select("host", "segments", "bad", "labels", F.lit("").alias("template"), F.lit(0).alias("level"), "share", F.lit(False).alias("done"), "told")
    state = ws.table(state, "tree-0")
    done, step = [], 0
    node, rest = ["host", "template"], F.expr("array_join(slice(segments, level + 1, size(segments)), '/')")
    while not state.isEmpty():
        at = state.withColumn("segment", F.coalesce(F.get("segments", F.col("level")), F.lit("")))
        going = F.when(F.col("segment") != "", F.col("segments"))
        values = at.groupBy(*node, "segment").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("labels").alias("labels"), F.min(going).alias("lo"), F.max(going).alias("hi"), F.first("level").alias("level"), F.first("share").alias("parent"))
        values = ws.table(values, f"values-{step}")
        inner = F.col("segment") != ""
        whole = values.groupBy(*node).agg(F.count("*").alias("all_values"), F.count_if(inner).alias("kinds"), F.sum(F.when(inner, F.col("n"))).alias("all_n"), F.sum(F.when(inner, F.col("bad"))).alias("all_bad"), F.sum(F.when(inner, F.col("labels"))).alias("all_labels"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"), _smoothed(F.sum("bad"), F.sum("labels"), F.first("parent")).alias("share"))
        v = join_hot(values, ws.table(whole, f"nodes-{step}"), node, "all_values")
        mine, others = F.col("labels"), F.expr("all_labels - labels")
        pooled = F.expr("(all_bad + 1) / (all_labels + 2)")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(mine, F.lit(1.0)) + 1 / F.greatest(others, F.lit(1.0))))
        told = (mine >= MERGE_LABELS) & (others >= MERGE_LABELS)
        close = F.abs(F.col("bad") / F.greatest(mine, F.lit(1.0)) - F.expr("all_bad - bad") / F.greatest(others, F.lit(1.0))) <= MERGE_ERRORS * error
        varies = (F.col("kinds") >= VARIETY_LEAST) & (F.col("kinds") >= VARIETY_SHARE * F.col("all_n"))
        small = (F.col("all_n") < VARIETY_LEAST) & (F.col("all_labels") < 2 * MERGE_LABELS)
        shared = F.expr("coalesce(array_min(filter(sequence(level, least(size(all_lo), size(all_hi)) - 1), i -> all_lo[i] <> all_hi[i])), least(size(all_lo), size(all_hi)))")
        # A branch whose labels tell it from its siblings keeps its name on a varying level too.
        name = F.when(F.col("segment") == "", "end").when(small, "leaf").when(F.col("kinds") == 1, "stretch").when(F.when(told, close).otherwise(varies), "any").otherwise("own")
        named = v.select(*node, "segment", "n", name.alias("name"), F.col("share").alias("own"), F.when(F.col("kinds") == 1, shared).alias("shared"))
        own = F.replace("segment", F.lit("*"), F.lit("%2A"))
        share = F.col("own")
        if step == 0:
            elsewhere = F.aggregate(F.coalesce("told", F.array().cast(state.schema["told"].dataType)), F.col("own"), lambda share, n: _smoothed(n["bad"], n["labels"], share))
            share = F.when(F.col("name").isin("own", "stretch", "leaf"), elsewhere).otherwise(share)
        named = ws.table(named, f"named-{step}")
        grown = join_hot(at, named, [*node, "segment"], "n").select(
            "host",
            "segments",
            "bad",
            "labels",
            F.when(F.col("name") == "end", F.col("template")).when(F.col("name") == "leaf", F.concat("template", F.lit("/"), rest)).when(F.col("name") == "any", F.concat("template", F.lit("/*")))
            .when(F.col("name") == "own", F.concat("template", F.lit("/"), own)).otherwise(F.concat("template", F.lit("/"), F.expr("array_join(slice(segments, level + 1, shared - level), '/')"))).alias("template"),
            F.when(F.col("name") == "stretch", F.col("shared")).otherwise(F.col("level") + 1).alias("level"),
            F.when(F.col("name") == "leaf", _smoothed(F.col("bad"), F.col("labels"), share)).otherwise(share).alias("share"),
            F.col("name").isin("end", "leaf").alias("done"),
        )
        step += 1
        grown = ws.table(grown, f"tree-{step}")
        ws.drop(*[f"{name}-{step - 1}" for name in ("values", "nodes", "named")], *(["tree-0"] if step == 1 else []))
        done.append(grown.where("done").select("host", "segments", "template", "share"))
        state = grown.where("not done")
    out = keys.select("host", "segments", F.lit("").alias("template"), F.lit(PRIOR_SHARE).alias("share")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, labels: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on every url, one row per input row.

    Columns: the id, ``host``, ``path``, ``rule`` (of the longest fitting one, else null),
    ``verdict`` (block or allow), ``template`` and ``impurity``. Urls that a rule decides
    are labels for the tree, besides ``labels`` (the id and verdict of some more); a
    different path counts as one label however often it occurs. A template is rejected when
    its share of blocked labels, smoothed toward that of its branch, of the same first
    segment on other hosts, of its host and of the host's domain, is at least ``REJECT_FROM``.

    A null url or one without :// has an empty host and path and is judged like others of
    that host; repeated rows each get a row; a null id stays; paths of any depth are walked
    to their end; other columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = match_rules(ws.table(rows, "rows"), rules)
    if labels is not None:
        more = labels.select(F.col(id_col).alias("id"), F.col("verdict").alias("told")).groupBy("id").agg(F.min("told").alias("told"))
        rows = rows.join(more, "id", "left")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("string"))
    rows = ws.table(rows.withColumn("segments", segments_of(F.col("path"))), "ruled")
    blocked = (F.coalesce("ruled", "told") == "block").cast("double")
    keys = rows.groupBy("host", "segments").agg(F.coalesce(F.avg(blocked), F.lit(0.0)).alias("bad"), (F.count(blocked) > 0).cast("double").alias("labels"))
    judged = path_templates(ws, ws.table(keys, "keys"))
    verdict = F.coalesce("ruled", "told", F.when(F.col("share") >= REJECT_FROM, "block").otherwise("allow"))
    out = rows.join(judged, ["host", "segments"]).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", F.col("share").alias("impurity"))
    return ws.finish(out)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
