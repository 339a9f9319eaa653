import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: columns of the operators' own frames, as columns of the input
CLASHING = ["key", "node", "kept", "digest", "norm", "block", "comp", "h1", "salt", "group_size", "fingerprint", "line", "body", "bucket", "rn", "place", "w_id",
            "w_digest", "row", "own_id", "own_digest", "own_hash", "g_id", "g_hash", "g_own", "g_starts", "g_stops"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def cases():
    """(doc_id, text) with NULLs, empty, blank, long and odd texts, ties, repeated rows, and near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    tokens = base.split()
    edited = [" ".join(tokens[:i] + ["changed"] + tokens[i + 1:]) for i in (10, 40, 80)]
    passage = prose(rng, 60)
    long_text = "\n".join(prose(rng, rng.randint(1, 90)) for _ in range(400))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, "ONE two"), (None, "a lonely text without an id"), (None, None),
        (10, base), (11, base.upper()), (12, base), (12, base), *[(20 + i, t) for i, t in enumerate(edited)],
        (30, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 9)), (31, passage + "\n" + prose(rng, 70)), (32, prose(rng, 20) + "\n" + passage),
        (40, long_text), (41, long_text + " end"), (50, "É é Été É\r\nx y'll 12 34  \x1c\x85 z\n\n ünï ￿ 🙂🙂   a b <|endoftext|>"),
        (51, "same line\nsame line\n Same Line \nother"), (52, "w " * 3000), (53, "x" * 5000), (54, "\n\n\n"), (55, "tail line\n"),
        (-(1 << 62), "the smallest id"), ((1 << 62) + 1, "the largest id"),
    ]
    rows += [(100 + i, "shared line\nonly here " + prose(rng, 12)) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


def frame(spark, rows):
    extra = [f"{c}-{i}" for i, c in enumerate(CLASHING)]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], schema)


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """rows -> a frame that reads them from files."""

    def made(rows, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        frame(spark, rows).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return made


@pytest.fixture(scope="session")
def docs(make_docs, rows):
    return make_docs(rows)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no sample data")
    return path


@pytest.fixture(scope="session")
def sample_texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
