"""Operator 11, Merkle dataset manifest: a hash tree over the rows of each group, and one over the groups' roots.

Leaves are ordered by one range sort, which cuts a hot group like any other run of rows, and get their place in the group from
the row counts of the sorted partitions. A block is ``FANOUT ** LEVELS`` leaves in a row; one task hashes a block's lower levels
alone. The upper levels are a butterfly: in round r every block holds the root of its aligned group of ``FANOUT ** r`` blocks and
swaps it with the blocks that differ from it in digit r of their number only. All of them hash the parent, so after the last
round each block has the root and all siblings above it, and nothing travels downward. A last group with too few blocks sends the
copies that the missing ones would have sent. A round moves one short row a block (and at most half as many copies again).

The groups' roots are the leaves of one more tree of the same kind, built by the same functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import dropped, read_docs, written

FANOUT = 3
#: levels hashed inside a block (729 leaves)
LEVELS = 6

_STEP = "struct<before:string,after:string>"
_BLOCKS = "group string, block long, leaves long, node string"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves: int, fanout: int = FANOUT) -> int:
    """Levels above so many leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def climbed(nodes: Sequence[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level over neighbouring nodes, the given ones first; a run of one has a parent too."""
    out = [list(nodes)]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """For node ``at`` of the lowest level, per level the siblings before and after it, joined."""
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
        at //= fanout
    return out


def folded(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        node = _digest(before + node + after)
    return node


# ---------------------------------------------------------------- leaves
def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values one after the other, each with its length in bytes; NULL is ``-``."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def group_key(column: Column) -> Column:
    """A text that is never NULL and sorts like the column, NULL first, else bytewise."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("s"), column.cast("string")))


def placed(leaves: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``leaves`` with pos, the place in its ``group`` by ``order``, and n, the leaves of the group.

    ``group`` is the first column. The columns of ``order`` tell all rows apart, so the range sort can cut anywhere.
    """
    keys = ["group", *order]
    names = ["part", "local", *leaves.columns]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), *leaves.schema.fields])

    def numbered(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for group in batch.column(0).to_pylist():
                n = n + 1 if group == last else 0
                last = group
                local.append(n)
            first = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays([*first, *batch.columns], names)

    rows = written(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(numbered, schema), name)
    # a row for each sorted partition and group in it
    counts = rows.groupBy("group", "part").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0)))
    sizes = counts.groupBy("group").agg(F.sum("own").alias("n"))
    where = starts.join(sizes, "group").select("group", "part", "start", "n")
    return rows.join(where, ["group", "part"]).select(*leaves.columns, (F.col("start") + F.col("local")).alias("pos"), "n")


# ---------------------------------------------------------------- blocks
def _sorted_nodes(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def block_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """group, block, leaves (of the group), node: the root of each block of ``fanout ** levels`` leaves."""

    def root(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        nodes = _sorted_nodes(table).column("leaf").to_pylist()
        top = climbed(nodes, min(levels, levels_of(n, fanout)), fanout)[-1][0]
        return pa.table({"group": table.column("group")[:1], "block": table.column("block")[:1], "leaves": pa.array([n], pa.int64()), "node": [top]})

    return leaves.select("group", "block", "pos", "n", "leaf").groupBy("group", "block").applyInArrow(root, _BLOCKS)


def exchanged(blocks: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """group, block, node (the group's root), path (siblings before and after from the blocks' roots up): the butterfly.

    The number of rounds is that of the largest group; a group whose root is reached takes no further part.
    """
    size = fanout ** levels
    state = blocks.select(
        "group", "block", F.ceil(F.col("leaves") / size).cast("long").alias("blocks"), "node", F.array().cast(f"array<{_STEP}>").alias("path"))
    state = written(state, name)
    most = state.agg(F.max("blocks")).first()[0] or 0
    for r in range(levels_of(most, fanout)):
        width = fanout ** r
        open_now = F.col("blocks") > width  # more than one node on this level
        own, low = F.floor(F.col("block") / width), F.col("block") % width
        # blocks that hold the same node; the last node may have too few
        last = F.floor((F.col("blocks") - 1) / width)
        held = F.when(own == last, F.col("blocks") - last * width).otherwise(F.lit(width))
        # low digits this block answers for: its own, and those of missing holders
        lows = F.when(held == width, F.array(low)).otherwise(F.sequence(low, F.lit(width - 1).cast("long"), held))
        sent = state.where(open_now).select(
            "group", F.floor(own / fanout).alias("parent"), F.explode(lows).alias("low"), F.struct(
                own.alias("own"), "node", F.col("block"), "blocks", "path", low.alias("at")).alias("from"))
        met = sent.groupBy("group", "parent", "low").agg(F.array_sort(F.collect_list("from")).alias("all"))  # ``fanout`` at most
        one = F.col("all")[F.col("i")]
        joined = lambda kept: F.array_join(F.transform(kept, lambda x: x["node"]), "")
        real = met.select("group", "low", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1)).alias("i")).where(one["at"] == F.col("low"))
        step = F.struct(
            joined(F.slice("all", F.lit(1), F.col("i"))).alias("before"), joined(F.slice("all", F.col("i") + 2, F.lit(fanout))).alias("after"))
        after = real.select(
            "group", one["block"].alias("block"), one["blocks"].alias("blocks"), F.sha2(joined(F.col("all")), 256).alias("node"),
            F.concat(one["path"], F.array(step)).alias("path"))
        now = written(after.unionByName(state.where(~open_now)), name)
        dropped(state)
        state = now
    return state


def proofs(leaves: DataFrame, fanout: int, levels: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The leaves with their block, and the blocks with root and upper path."""
    cut = leaves.withColumn("block", F.floor(F.col("pos") / fanout ** levels))
    return cut, exchanged(block_roots(cut, fanout, levels), fanout, levels, name)


def _with_upper(leaves: pa.Table, block: pa.Table, fanout: int, levels: int) -> tuple[list, str | None, list]:
    """Of a block's leaves by place: the siblings inside the block; the group's root; the siblings above the block."""
    if not leaves.num_rows:
        return [], None, []
    leaves = _sorted_nodes(leaves)
    tree = climbed(leaves.column("leaf").to_pylist(), min(levels, levels_of(leaves.column("n")[0].as_py(), fanout)), fanout)
    upper = [(s["before"], s["after"]) for s in block.column("path")[0].as_py()]
    return [siblings(tree, i, fanout) for i in range(leaves.num_rows)], block.column("node")[0].as_py(), upper


def _above(groups: DataFrame, fanout: int, levels: int) -> DataFrame:
    """group, root, path: each group's way from its root to the root of all, by the same exchange over the groups' roots."""
    lines = groups.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("node").alias("leaf"))
    cut, blocks = proofs(placed(lines, ["key"], "op11-groups"), fanout, levels, "op11-top")
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def ways(left: pa.Table, right: pa.Table) -> pa.Table:
        own, top, upper = _with_upper(left, right, fanout, levels)
        paths = [[{"before": a, "after": b} for a, b in path + upper] for path in own]
        return pa.table({
            "group": _sorted_nodes(left).column("key"), "root": pa.array([top] * len(paths), pa.string()), "way": pa.array(paths, kind)})

    return cut.groupBy("group", "block").cogroup(blocks.select("group", "block", "node", "path").groupBy("group", "block")).applyInArrow(
        ways, f"group string, root string, way array<{_STEP}>")


def manifest(docs: DataFrame, columns: Sequence[str] = ("source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
             tampered: tuple[Column, dict[str, Column]] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes the id and ``columns``. Leaves of a group (``group_col``; NULL is a group, the first one) ascend by id, NULL ids
    first; rows of one id by leaf. Repeated rows are leaves of their own. Empty texts differ from NULL. ``tampered`` is a condition and
    replacements of columns: where it holds, ``folded_root`` starts from the leaf of the replaced values, and is compared with
    the root; NULL conditions count as false. An empty table gives no rows. Columns that are not named are not read, whatever their names.
    """
    values = [F.col(f"`{c}`") for c in columns]
    ident = F.col(f"`{id_col}`").cast("long")
    leaf = leaf_hash(ident, *values)
    other = leaf
    if tampered is not None:
        changed, instead = tampered
        other = F.when(changed, leaf_hash(ident, *[instead.get(c, v) for c, v in zip(columns, values)])).otherwise(leaf)
    hashed = docs.select(
        group_key(F.col(f"`{group_col}`")).alias("group"), ident.alias("doc_id"), leaf.alias("leaf"), other.alias("other"))
    leaves = written(hashed, "op11-leaves").withColumn("line", F.monotonically_increasing_id())
    cut, blocks = proofs(placed(leaves, ["doc_id", "leaf", "line"], "op11-placed"), fanout, levels, "op11-blocks")
    tops = _above(blocks.where("block = 0"), fanout, levels)
    upper = blocks.join(tops, "group").select("group", "block", "node", "root", F.concat("path", "way").alias("path"))

    def proved(left: pa.Table, right: pa.Table) -> pa.Table:
        own, subroot, upper = _with_upper(left, right, fanout, levels)
        left, rows = _sorted_nodes(left), left.num_rows
        paths = [path + upper for path in own]
        shown = [_digest("".join(a + b for a, b in path)) for path in paths]
        roots = [folded(node, path) for node, path in zip(left.column("other").to_pylist(), paths)]
        root = right.column("root")[0].as_py() if rows else None
        return pa.table({
            "doc_id": left.column("doc_id"), "leaf": left.column("leaf"), "subroot": pa.array([subroot] * rows, pa.string()),
            "root": pa.array([root] * rows, pa.string()), "proof_sha256": pa.array(shown, pa.string()), "folded_root": pa.array(roots, pa.string())})

    out = cut.groupBy("group", "block").cogroup(upper.groupBy("group", "block")).applyInArrow(proved, _PROVED)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(read_docs(spark, sf_dir), tampered=(even, without))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM documents),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM d),
crc AS (SELECT 0 AS i, CAST(i0 AS BIGINT) AS v, i0 FROM range(256) t(i0)
    UNION ALL SELECT i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i0 FROM crc WHERE i < 8),
tab AS (SELECT list(v ORDER BY i0) AS t FROM crc WHERE i = 8),
c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT doc_id FROM documents)
    UNION ALL SELECT doc_id, s, i + 1, xor(tab.t[CAST(xor(v % 256, ord(substr(s, i, 1))) AS BIGINT) + 1], v // 256) FROM c, tab WHERE i <= length(s)),
o AS (SELECT h.doc_id, h.source, h.leaf, CASE WHEN xor(c.v, 4294967295) % 2 = 0 THEN bare ELSE leaf END AS other,
    row_number() OVER (PARTITION BY h.source ORDER BY h.doc_id) - 1 AS pos FROM h JOIN c ON c.doc_id = h.doc_id AND c.i = length(c.s) + 1),
u AS (SELECT source, 0 AS lvl, pos AS idx, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM o
    UNION ALL SELECT source, lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
s AS (SELECT source, lvl AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM u WHERE n = 1),
v AS (SELECT 0 AS lvl, pos AS idx, subroot AS node, count(*) OVER () AS n FROM s
    UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM v WHERE n > 1 GROUP BY lvl, idx // 3, n),
top AS (SELECT node AS root, lvl AS height FROM v WHERE n = 1),
g AS (SELECT o.doc_id, u.lvl, o.pos // CAST(pow(3, u.lvl) AS BIGINT) AS own, u.idx, u.node FROM o JOIN u
        ON u.source IS NOT DISTINCT FROM o.source AND u.n > 1 AND u.idx // 3 = o.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)
    UNION ALL SELECT o.doc_id, s.height + v.lvl, s.pos // CAST(pow(3, v.lvl) AS BIGINT), v.idx, v.node FROM o
        JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN v ON v.n > 1 AND v.idx // 3 = s.pos // CAST(pow(3, v.lvl + 1) AS BIGINT)),
p AS (SELECT doc_id, lvl, coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx < own), '') AS before,
    coalesce(string_agg(node, '' ORDER BY idx) FILTER (idx > own), '') AS after FROM g GROUP BY doc_id, lvl),
q AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM p GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS lvl, other AS node FROM o
    UNION ALL SELECT f.doc_id, f.lvl + 1, sha256(p.before || f.node || p.after) FROM f JOIN p ON p.doc_id = f.doc_id AND p.lvl = f.lvl)
SELECT o.doc_id, o.leaf, s.subroot, top.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = top.root AS verified
FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source CROSS JOIN top LEFT JOIN q ON q.doc_id = o.doc_id
JOIN f ON f.doc_id = o.doc_id AND f.lvl = s.height + top.height
"""
