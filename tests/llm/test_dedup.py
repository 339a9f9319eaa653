import collections
import hashlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, line_dedup, linking, ngram_join, substring_dedup
from plumbline.llm.components import components
from plumbline.llm.shingles import Hasher, pack_sorted, to_bytes, unpack_sorted, windows


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def exact_want(rows):
    keep, size = {}, collections.Counter()
    for i, t in rows:
        n = brute.lower(t)
        size[n] += 1
        keep[n] = max((x for x in (keep.get(n), i) if x is not None), default=None)
    return collections.Counter(
        (i, keep[n], size[n], i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [brute.lower(t)])


def test_exact_dedup(docs, rows):
    assert counted(exact_dedup.exact_dedup(docs).collect()) == exact_want(rows)


def test_exact_dedup_keeps_one_row_of_each_text(docs, rows):
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    got = kept.select("doc_id", "text").collect()
    assert sorted(brute.lower(r.text) for r in got) == sorted({brute.lower(t) for _, t in rows})
    assert {r.doc_id for r in got} == {k for _, k, *_ in exact_want(rows)}


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == [] and exact_dedup.kept_documents(nothing).collect() == []


def test_a_hot_text_meets_in_salts(spark, make_docs):
    docs = make_docs([(i, "hot" if i % 3 else f"text {i}") for i in range(300)], 8)
    got = exact_dedup.exact_dedup(docs, salts=3).where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(299, 200)]


def line_want(rows, min_docs, min_chars=1):
    key = lambda line: brute.lower(line.strip(brute.BLANKS))
    found = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            found[key(line)].add((i, t or ""))
    hot = {k for k, v in found.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup_of_common_lines(docs, rows, min_docs):
    got = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, min_docs=min_docs, salts=4)).collect()
    assert counted(got) == line_want(rows, min_docs)


def test_form_feeds_are_blanks_and_the_letter_f_is_not(make_docs):
    """Lines of f and lines with form feeds at their ends, in nine documents and in ten."""
    lines = {"f": 10, "ff": 9, "F ": 0, "if": 5, "i": 5, "of": 10, "o": 9, "fee": 9, "\x0cee": 1, "\x0cpage\x0c": 5, "page": 5, "\x0cnine": 9, "\x0c \x0c": 10}
    rows = [(d, "\n".join([f"own {d}"] + [line for line, n in lines.items() if d < n or line == "F " and d == 9])) for d in range(12)]
    docs = make_docs(rows)
    got = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, salts=4)).collect()
    assert counted(got) == line_want(rows, 10)
    left = {x for r in got for x in r.kept_text.split("\n")}
    assert not left & {"f", "F ", "of"} and left >= {"ff", "if", "i", "o", "fee", "\x0cee", "\x0cnine"}


def test_line_dedup_keeps_first_occurrences(make_docs):
    rows = [(1, "a\nb\na"), (2, "B \nc\n\n"), (3, None), (4, "d\nc\ne")]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, min_docs=None, salts=2)).collect()}
    assert [(got[i].kept_text, got[i].n_dropped) for i in (1, 2, 3, 4)] == [("a\nb", 1), ("c\n\n", 1), ("", 0), ("d\ne", 1)]
    runs = {r.doc_id: r.keep_runs for r in line_dedup.keep_bitmaps(docs, min_docs=None, salts=2).collect()}
    assert runs == {1: [2, 1, 0], 2: [0, 1, 3], 4: [1, 1, 1]}


def test_line_dedup_is_native_and_empty_of_nothing(docs, nothing):
    out = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert line_dedup.kept_texts(nothing, line_dedup.keep_bitmaps(nothing)).collect() == []


def test_ngram_join_equals_brute_force(docs, rows):
    got = counted(ngram_join.jaccard_groups(docs).collect())
    assert got == collections.Counter((i, len(brute.shingles(brute.words(t))), c) for (i, t), c in zip(rows, brute.components(rows)))


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.jaccard_groups(nothing).collect() == []


def test_ngram_join_on_sample(spark, sf_dir, sample_texts):
    rows = sorted(sample_texts.items())
    want = {i: c for (i, _), c in zip(rows, brute.components(rows))}
    assert {r.doc_id: r.component_id for r in ngram_join.op3_ngram_join(spark, sf_dir).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40)), st.lists(st.sets(st.integers(0, 40)), max_size=12), st.integers(50, 100))
def test_divide_skip_finds_what_counting_finds(query, sets, percent):
    needed = np.array([ngram_join.overlap_needed(len(query), len(s), percent) for s in sets])
    lists = ngram_join.InvertedLists([np.array(sorted(s), np.uint64) for s in sets])
    want = [i for i, s in enumerate(sets) if len(query & s) >= max(1, needed[i])]
    assert sorted(lists.divide_skip(np.array(sorted(query), np.uint64), needed)) == want


def test_linked_when_most_pairs_are_not_with_a_leader(spark, monkeypatch):
    """Chains inside one long list, in blocks: every pair that shares a key is compared or connected."""
    monkeypatch.setattr(linking, "CHUNK", 16)
    n = 60
    sets = {i: set(range(i * 5, i * 5 + 35)) for i in range(n)}  # neighbours overlap by 30 of 40: alike at 75 percent
    sets |= {1000 + i: set(range(10_000 + 100 * i, 10_035 + 100 * i)) for i in range(n)}  # alone
    postings = spark.createDataFrame([(7, i, 35) for i in sets] + [(i, i, 35) for i in sets], "key long, node long, n int")
    frame = spark.createDataFrame([(i, 35, to_bytes(np.array(sorted(s), np.uint64))) for i, s in sets.items()], "node long, n int, grams binary")
    got = {r.node: r.comp for r in linking.linked(postings, lambda _: frame, ngram_join._index(75)).collect()}
    assert got == {i: 0 for i in range(n)}


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (8, 10), (10, 11), (3, 20), (7, 7)] + [(100, 100 + i) for i in range(1, 50)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: 3 for n in (3, 4, 5, 20)} | {n: 8 for n in (8, 9, 10, 11)} | {100 + i: 100 for i in range(50)} | {i: 200 for i in range(200, 241)}
    assert got == want


def test_sorted_numbers_pack_and_unpack():
    for values in ([], [0], [3, 2**64 - 1], list(range(0, 10**7, 997))):
        a = np.array(values, np.uint64)
        assert np.array_equal(unpack_sorted(pack_sorted(a)), a)


def repeat_want(rows, min_words):
    found = brute.paragraphs(rows, min_words)
    order = sorted(range(len(found)), key=lambda k: (rows[found[k][0]][0] is not None, rows[found[k][0]][0] or 0, found[k][1]))
    found = [found[k] for k in order]
    root = brute.groups([s for *_, s in found])
    size = collections.Counter(root)
    first = [rows[found[r][0]][0] for r in root]
    return collections.Counter(
        (rows[n][0], i, size[r], f, found[r][1]) for (n, i, _), r, f in zip(found, root, first) if size[r] > 1)


def test_repeats_equal_brute_force(docs, rows):
    got = substring_dedup.repeated_paragraphs(docs, min_words=20).select("doc_id", "paragraph", "group_size", "keep_id", "keep_paragraph").collect()
    assert counted(got) == repeat_want(rows, 20)


def test_planted_passage_is_found_and_cut(docs, rows):
    got = substring_dedup.repeated_paragraphs(docs).where("doc_id IN (30, 31, 32)").select("doc_id", "kept").collect()
    assert {(r.doc_id, r.kept) for r in got} == {(30, True), (31, False), (32, False)}
    text = dict(rows)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).where("doc_id IN (4, 30, 31, 32)").collect()}
    cut = lambda t, i: "\n".join(x for n, x in enumerate(t.split("\n")) if n != i)
    assert left == {4: "One", 30: text[30], 31: cut(text[31], 0), 32: cut(text[32], 1)}


def test_windows_of_common_runs_are_common():
    rng = np.random.default_rng(3)
    hasher = Hasher()
    texts = [" ".join(map(str, rng.integers(0, 10**6, n))) for n in (50, 80, 300)]
    for run in texts:
        found = []
        for before, after in ((0, 0), (7, 90), (200, 13)):
            text = " ".join([*map(str, rng.integers(0, 10**6, before)), run, *map(str, rng.integers(0, 10**6, after))]).encode()
            words = hasher.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
            found.append(set(windows(words, 25, 26)[1].tolist()))
        assert set.intersection(*found)
    assert len(windows(np.zeros(24, np.uint64), 25, 26)[0]) == 0 and len(windows(np.zeros(900, np.uint64), 25, 26)[0]) == 1


def test_passages_inside_lines_and_over_lines_are_found_and_cut(make_docs):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    run = [prose(20), prose(20), prose(20)]
    texts = [(1, prose(30) + " " + " ".join(run) + " " + prose(40)), (2, prose(8) + "\n" + "\n".join(run) + "\n" + prose(30)),
             (3, prose(33) + " " + " ".join(run)), (4, prose(200)), (5, "é " * 60), (None, prose(90)), (6, None)]
    docs = make_docs(texts)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(got) == {1, 2, 3} and [got[i].kept for i in (1, 2, 3)] == [True, False, False]
    words = set(" ".join(run).split())
    for i, r in got.items():
        span = dict(texts)[i][r.start:r.start + r.n_chars].split()
        assert set(span) <= words and len(span) == r.n_words >= 25 and r.keep_id == 1
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert all(left[i] == dict(texts)[i] for i in (1, 4, 5, 6, None))
    for i in (2, 3):
        r, whole = got[i], dict(texts)[i]
        assert left[i] == whole[:r.start] + whole[r.start + r.n_chars:]


def covered(texts, spans):
    """(id, kept) -> words covered, by number."""
    out = collections.defaultdict(set)
    for i, start, n_chars, n_words, kept in spans:
        first, n = len(texts[i][:start].split()), len(texts[i][start:start + n_chars].split())
        assert n == n_words
        out[i, kept] |= set(range(first, first + n))
    return dict(out)


def covered_want(texts, size=25, least=50):
    """Every window of ``size`` words, by its earliest place; one that overlaps that place in its own text is neither kept nor dropped,
    and a run of windows that all overlap their copies there is dropped from ``least`` words on."""
    places = collections.defaultdict(list)
    for i, text in sorted(texts.items()):
        tokens = brute.words(text)
        for w in range(len(tokens) - size + 1):
            places[tuple(tokens[w:w + size])].append((i, w))
    gone = collections.defaultdict(dict)
    for (i, w), *others in places.values():
        for (h, u), (j, v) in zip([(i, w), *others], others):
            if j != i or v >= w + size:
                gone[j][v] = j == i == h and v < u + size
    for found in gone.values():
        runs = []
        for v in sorted(found):
            if runs and v <= runs[-1][-1] + size:
                runs[-1].append(v)
            else:
                runs.append([v])
        for run in runs:
            if all(found[v] for v in run) and run[-1] + size - run[0] < least:
                for v in run:
                    del found[v]
    out = collections.defaultdict(set)
    for (i, w), *others in places.values():
        others = [(j, v) for j, v in others if v in gone[j]]
        for j, v, kept in [(i, w, True)] * bool(others) + [(j, v, False) for j, v in others]:
            out[j, kept] |= set(range(v, v + size))
    return dict(out)


def passages_found(make_docs, texts):
    got = substring_dedup.repeated_passages(make_docs(sorted(texts.items()))).select("doc_id", "start", "n_chars", "n_words", "kept").collect()
    return covered(texts, [tuple(r) for r in got])


def test_repeated_passages_are_whole_runs(make_docs):
    """Shared runs of 50 to 130 words, inside and over lines, some part of a longer run whose other part an earlier text has."""
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    texts = {i: prose(40) for i in (90, 91)}
    for k, n in enumerate((50, 51, 52, 60, 75, 76, 101, 130)):
        run = prose(n)
        for j in range(3):
            texts[10 * k + j] = prose(int(rng.integers(0, 70))) + "\n " + (run if j else run.replace(" ", "\n")) + " é " + prose(int(rng.integers(0, 70)))
    head, middle, tail = prose(30), prose(55), prose(31)
    texts |= {200: prose(9) + " " + middle + " " + prose(9), 201: prose(5) + " " + " ".join((head, middle, tail)), 202: " ".join((head, middle, tail)) + " " + prose(7)}
    want = covered_want(texts)
    assert passages_found(make_docs, texts) == want
    assert [len(want[10 * k + 1, False]) for k in range(8)] == [50 + 1, 51 + 1, 52 + 1, 60 + 1, 75 + 1, 76 + 1, 101 + 1, 130 + 1]


def test_passages_repeated_in_one_text(make_docs):
    """A run twice in one text and once in an earlier one, runs that only one text repeats, in and over lines, and a phrase over and over."""
    rng = np.random.default_rng(8)
    prose = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    run, own, phrase = prose(60), prose(70), prose(10)
    texts = {1: prose(20) + " " + run + " " + prose(20), 5: " ".join((prose(9), run, prose(30), run, prose(3))),
             6: prose(12) + " " + own + " " + prose(33) + "\n" + own.replace(" ", "\n") + "\n" + prose(8) + " " + own, 7: " ".join([phrase] * 30), 8: "w " * 300, 9: "v " * 60}
    want = covered_want(texts)
    assert passages_found(make_docs, texts) == want
    assert len(want[5, False]) == 120 and len(want[6, False]) == 140 and (1, False) not in want and len(want[6, True]) == 70
    assert len(want[7, False]) == 270 and len(want[8, False]) == 275 and (9, True) not in want
    left = {r.doc_id: r.text.split() for r in substring_dedup.without_repeats(make_docs(sorted(texts.items()))).collect()}
    for i, text in texts.items():
        if i < 7:  # the last two are lines of 40 words or more that repeat nothing as lines
            assert left[i] == [w for n, w in enumerate(text.split()) if n not in want.get((i, False), ())]


def test_repeats_of_nothing(nothing):
    assert substring_dedup.repeats(nothing).collect() == [] and substring_dedup.without_repeats(nothing).collect() == []


def test_texts_that_lose_everything_go(make_docs):
    line = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, line), (2, line), (3, line + "\n"), (4, "x\n" + line)])
    out = substring_dedup.without_repeats(docs.withColumn("n_chars", F.char_length("text")), length_col="n_chars")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, line, len(line)), (4, "x", 1)]
