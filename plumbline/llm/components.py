"""Connected components of a graph of longs, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, written


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent), parent < node or itself: every jump halves the paths."""
    now = written(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        then = written(now.join(up, "root", "left").select("node", "root", F.coalesce("above", "root").alias("next")), "roots")
        moved = not then.where("next <> root").isEmpty()
        dropped(now)
        now = then.select("node", F.col("next").alias("root"))
        now._written_path = then._written_path
        if not moved:
            return now


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (columns a, b); comp is the smallest node of its component.

    Every node points to its smallest neighbour, the trees so formed become one node each, and the links between trees remain for
    the next step, which has at most half the nodes. A node with a third of all links only takes a minimum of them.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    comps = None
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("parent"))
        roots = _roots(parents)
        if comps is None:
            merged = written(roots.withColumnRenamed("root", "comp"), "comps")
        else:
            up = roots.select(F.col("node").alias("comp"), "root")
            merged = written(comps.join(up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comps")
        of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        rest = written(
            edges.join(of("a"), "a").join(of("b"), "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        for old in (edges, comps, roots):
            dropped(old)
        comps, edges = merged, rest
        if edges.isEmpty():
            dropped(edges)
            return comps
