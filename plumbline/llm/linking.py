"""Which of many sets are alike, as components, without listing the pairs of a group.

Candidates come as postings (key, node): two nodes that are alike share at least one key. A list is the nodes of one key.

1. Every list has a leader, its smallest node, and each of its nodes is compared with it. That joins the bulk of any group of near
   copies, with one comparison a copy.
2. Lists whose nodes are then in one component are done. The others are gathered by the component most of their nodes are in. Any pair
   not yet decided has a node outside that component, so only those nodes search, and they search all nodes of the group. A group
   is cut into blocks of ``CHUNK`` nodes; a task has one block of searchers and one of searched, and each set travels once a block.

So every pair that shares a key is either compared or connected through others.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, written
from plumbline.llm.components import components

#: nodes of a block
CHUNK = 1000

#: index(rows) -> search(row) -> positions of the rows that are alike; a row is (node, n, grams)
Index = Callable[[list[tuple]], Callable[[tuple], list[int]]]
_LINKS = "a long, b long"


def _rows(table: pa.Table, prefix: str = "") -> list[tuple]:
    return list(zip(*(table.column(prefix + c).to_pylist() for c in ("node", "n", "grams"))))


def _links(a: list[int], b: list[int]) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _stars(pairs: DataFrame, sets: DataFrame, index: Index) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets are alike; the sets of b travel to the leader a, in blocks."""
    sizes = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / CHUNK).alias("blocks"))
    dealt = pairs.join(sizes, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    followers = dealt.join(sets, "node")
    leaders = dealt.select(F.col("a").alias("node"), F.col("block").alias("s_block")).distinct().join(sets, "node").select(
        "s_block", *[F.col(c).alias(f"s_{c}") for c in ("node", "n", "grams")])

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _links([], [])
        leader, others = _rows(left, "s_")[0], _rows(right)
        found = index(others)(leader)
        return _links([leader[0]] * len(found), [others[i][0] for i in found])

    return leaders.groupBy("s_node", "s_block").cogroup(followers.groupBy("a", "block")).applyInArrow(alike, _LINKS)


def _searched(rest: DataFrame, sets: DataFrame, index: Index) -> DataFrame:
    """Links between different components inside the open lists ``rest`` (key, node, comp); of those that join the same two
    components in one task only one."""
    common = rest.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    placed = rest.join(common, "key").select("main", "node", "comp").distinct()
    sizes = placed.groupBy("main").agg(
        F.ceil(F.count("*") / CHUNK).alias("blocks"), F.ceil(F.count_if(F.col("comp") != F.col("main")) / CHUNK).alias("turns"))
    each = placed.join(sizes, "main").withColumn("own", F.xxhash64("node")).join(sets, "node")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    searched = each.withColumn("block", F.pmod("own", "blocks")).withColumn("turn", numbers("turns"))
    searchers = each.where("comp <> main").withColumn("s_turn", F.pmod("own", "turns")).withColumn("s_block", numbers("blocks"))
    columns = ["node", "comp", "n", "grams"]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            others = _rows(right)
            search, comps, up = index(others), right.column("comp").to_pylist(), {}

            def top(c):
                while up.get(c, c) != c:
                    c = up[c]
                return c

            for row, comp in zip(_rows(left, "s_"), left.column("s_comp").to_pylist()):
                for i in search(row):
                    x, y = top(comp), top(comps[i])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a.append(row[0])
                        b.append(others[i][0])
        return _links(a, b)

    left = searchers.select(F.col("main").alias("s_main"), "s_turn", "s_block", *[F.col(c).alias(f"s_{c}") for c in columns]).groupBy("s_main", "s_turn", "s_block")
    return left.cogroup(searched.select("main", "turn", "block", *columns).groupBy("main", "turn", "block")).applyInArrow(block, _LINKS)


def linked(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], index: Index, shortest: float = 0.75) -> DataFrame:
    """(node, comp) for every node with a link. ``postings``: key, node, n; ``sets_of`` gives node, n, grams (one row a node) for a
    frame of nodes. Sets whose n differ by more than the factor ``shortest`` are not compared with a leader."""
    heads = postings.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("na"), F.max("node").alias("last"))
    lists = written(postings.join(heads.where("a <> last").drop("last"), "key"), "lists")
    sets = sets_of(lists.select("node").distinct())
    close = (F.col("n") >= shortest * F.col("na")) & (F.col("na") >= shortest * F.col("n"))
    pairs = lists.where("node <> a").where(close).select("a", F.col("node").alias("b")).distinct()
    links = written(_stars(pairs, sets, index), "alike")
    comps = components(links)
    own = lists.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    several = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = written(own.join(several, "key", "left_semi"), "open-lists")
    if not rest.isEmpty():
        more = written(_searched(rest, sets, index).unionByName(links), "alike")
        old, comps = comps, components(more)
        dropped(old)
        dropped(more)
    for done in (links, lists, rest):
        dropped(done)
    return comps
