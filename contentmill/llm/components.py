"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmill.llm.skew import join_hot
from contentmill.llm.workspace import Workspace


def connected_components(ws: Workspace, links: DataFrame, prefix: str = "cc") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node of ``links(a, b)``.

    Each round moves every neighbour to the smallest one known around it, so rounds
    grow with the logarithm of the longest path. A round only joins and takes minima
    by key; no neighbourhood is gathered in one place, and the links of a hub stay where
    they are. Stars around their smallest node are a result and need no round. Self-links
    and repeats are allowed, rows with a null end are ignored.
    """
    edges = ws.table(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{prefix}-0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.keep(_smallest(both))
        # Done when whoever has a smaller neighbour has no other one.
        total, most, open_ends = low.agg(F.sum("n"), F.max("n"), F.count_if(F.expr("m < u and n > 1"))).first()
        if not open_ends:
            ws.free(low)
            break
        large = ws.table(join_hot(both, low, ["u"], "n", totals=(total, most)).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")), f"{prefix}-large-{step}")
        near = ws.keep(_smallest(large))
        moved = join_hot(large, near, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = ws.table(moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), f"{prefix}-{step + 1}")
        ws.free(low, near)
        ws.drop(f"{prefix}-{step}", f"{prefix}-large-{step}")
        step += 1
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _smallest(edges: DataFrame) -> DataFrame:
    """``u``, ``m``, its smallest neighbour, and ``n``, how many there are."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def smallest_ids(ws: Workspace, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``smallest``: the smallest ``id`` of its component, for the nodes in ``found``.

    ``nodes`` has ``node`` and ``id``; ids may have any type that can be compared.
    """
    named = ws.table(found.join(nodes.select("node", "id"), "node"), "smallest-ids")
    least = ws.keep(named.groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("n")))
    return join_hot(named.select("node", "component"), least, ["component"], "n").select("node", "smallest")
