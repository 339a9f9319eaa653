import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

CLASHING = ["group", "part", "local", "pos", "n", "leaf", "other", "block", "node", "path", "line", "own", "start", "key", "way"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, paths):
    """The root over the nodes; paths[i] gets the (before, after) of node i's way."""
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for j in range(len(run)):
                for i in own[at + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(digest("".join(run)))
            held.append([i for j in range(len(run)) for i in own[at + j]])
        nodes, own = above, held
    return nodes[0] if nodes else None


def want(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths = [[] for _ in mine]
        subroots.append(climb([leaf(r) for r in mine], paths))
        found.append((mine, paths))
    ways = [[] for _ in order]
    root = climb(subroots, ways)
    out = []
    for (mine, paths), way, subroot in zip(found, ways, subroots):
        for r, path in zip(mine, paths):
            path = path + way
            bare = r[:4] + (None if r[4] is None else r[4].replace("\n", ""),)
            node = leaf(bare) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf(r)
            for before, after in path:
                node = digest(before + node + after)
            out.append((r[0], leaf(r), subroot, root, digest("".join(a + b for a, b in path)), node, node == root))
    return collections.Counter(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *[f"{c}-x" for c in CLASHING]) for r in rows], SCHEMA).repartition(parts)


def manifested(docs, levels):
    without = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return collections.Counter(tuple(r) for r in merkle.manifest(docs, tampered=(even, without), levels=levels).collect())


def cases(sizes, rng):
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            i = len(rows) - 3
            rows.append((i, s, rng.choice(["en", "", None]), rng.choice([None, 0, i]), rng.choice([None, "", "a\nb", "\n", f"é🙂 {i}\n", "x" * 3000])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [0, 2])
def test_manifest_against_a_plain_tree(spark, levels):
    """Groups of one leaf to many, with last groups of blocks that lack some or most of their members."""
    rows = cases({"src9": 1, None: 5, "": 3, "src10": 31, "Ünï": 29, "z": 10, "hot": 100, "src1": 4}, random.Random(levels))
    rows += [(500, "z", "en", 1, "same\n")] * 3 + [(None, "z", None, None, None), (500, "z", "en", 1, "another"), ((1 << 62), "big", "en", 3, "w " * 50_000)]
    assert manifested(frame(spark, rows), levels) == want(rows)


@pytest.mark.parametrize("n", [2, 4, 9, 13, 28])
def test_rounds_of_every_shape(spark, n):
    """One leaf a block, so all levels are exchanged."""
    blocks = spark.createDataFrame([("g", i, n, digest(str(i))) for i in range(n)], "group string, block long, leaves long, node string")
    got = {r.block: r for r in merkle.exchanged(blocks, 3, 0, "test").collect()}
    paths = [[] for _ in range(n)]
    root = climb([digest(str(i)) for i in range(n)], paths)
    assert sorted(got) == list(range(n)) and {r.node for r in got.values()} == {root}
    assert [[(s.before, s.after) for s in got[i].path] for i in range(n)] == paths


def test_manifest_of_one_row_and_of_nothing(spark):
    row = (7, None, None, None, None)
    got = merkle.manifest(frame(spark, [row])).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.proof_sha256, r.verified) for r in got] == [(True, digest(""), True)]
    assert merkle.manifest(frame(spark, [])).collect() == []


def test_registered_manifest_finds_what_was_tampered(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert collections.Counter(tuple(r) for r in merkle.op11_merkle_manifest(spark, sf_dir).collect()) == want(rows)
