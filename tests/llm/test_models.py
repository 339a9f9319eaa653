import collections
import math
import os
import time
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import lm_scoring, packing, quality, substring_dedup
from plumbline.llm.common import read_docs
from plumbline.llm.shingles import slices


def lm_want(rows):
    tokens = [(i, [*brute.words(t), b"\n"]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if not lm_scoring.held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return collections.Counter(
        (i, lm_scoring.held_out(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in tokens)


def test_lm_counts_and_base(docs, rows):
    got = lm_scoring.lm_scores(docs, rounds=1).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lm_want(rows)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_lm_beats_the_base_on_held_out_texts(spark, sf_dir):
    held = [r for r in lm_scoring.op4_lm_scoring(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_of_nothing_and_of_held_out_texts_only(nothing, make_docs):
    assert lm_scoring.lm_scores(nothing).collect() == []
    only = [(i, "a b") for i in range(200) if lm_scoring.held_out(i)]
    assert {(r.base_score, r.score, r.n_known) for r in lm_scoring.lm_scores(make_docs(only)).collect()} == {(0.0, 0.0, 0)}


def test_class_probabilities_sum_to_one():
    c = lm_scoring.Counts(100, 6, 2, 1, 10, {(40, 7): 1}, np.zeros(lm_scoring.CLASSES))
    count, hashes, end = np.array([10, 40, 30, 16, 2, 1, 1, 0]), np.array([1, 7, 9, 9, 9, 3, 4, 5]), np.array([True] + [False] * 7)
    classes = c.class_of(count, hashes, end)
    for k, n in zip(classes[:-1], count):
        c.in_class[k] += n
    inside = 10 ** c.inside(count, classes)
    for k in np.unique(classes):
        assert inside[classes == k].sum() == pytest.approx(1.0)


def test_trainer_learns_what_follows_what():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 4, 4000).astype(np.uint32)
    ends = np.array([2000, 4000])
    rows = lm_scoring.features(hashes, ends)
    classes = np.concatenate([[0], hashes[:-1]]).astype(np.uint8)  # the class is the word before
    classes[2000] = 0
    bias = np.zeros(lm_scoring.CLASSES, np.float32)
    trainer = lm_scoring.Trainer(np.zeros((lm_scoring.WIDTH, lm_scoring.CLASSES), np.float32), bias)
    for _ in range(20):
        trainer.step(rows, classes)
    assert lm_scoring._logits(trainer.weights, bias, rows)[np.arange(4000), classes].mean() > -0.2


def plain_step(trainer, rows, classes):
    """A step as it is defined: softmax, mean slope of each row, adaptive rate; feature by feature."""
    out = sum(trainer.weights[r] for r in rows) + trainer.bias
    slope = np.exp(out - out.max(1, keepdims=True))
    slope /= slope.sum(1, keepdims=True)
    slope[np.arange(len(classes)), classes] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        row, starts, n = np.unique(r[order], return_index=True, return_counts=True)
        mean = np.add.reduceat(slope[order], starts) / n[:, None].astype(np.float32)
        trainer.seen[row] += n
        trainer.squares[row] += (mean * mean).sum(1) * np.float32(4 / mean.shape[1])
        trainer.weights[row] -= mean * (lm_scoring.RATE / np.sqrt(trainer.squares[row]))[:, None]


def test_step_is_the_plain_one_and_quicker():
    rng = np.random.default_rng(3)
    hashes = (rng.zipf(1.3, 20 * 4096) % 65536).astype(np.uint32)
    rows = lm_scoring.features(hashes, np.arange(4096, len(hashes) + 1, 4096))
    classes = rng.integers(0, lm_scoring.CLASSES, len(hashes)).astype(np.uint8)
    bias = np.log(rng.random(lm_scoring.CLASSES)).astype(np.float32)
    took = {}
    for name, step in (("plain", plain_step), ("own", lm_scoring.Trainer.step)) * 3:
        trainer, began = lm_scoring.Trainer(np.zeros((lm_scoring.WIDTH, lm_scoring.CLASSES), np.float32), bias), time.process_time()
        for at in range(0, len(hashes), 4096):
            step(trainer, rows[:, at:at + 4096], classes[at:at + 4096])
        took.setdefault(name, []).append((time.process_time() - began, trainer))
    plain, own = took["plain"][0][1], took["own"][0][1]
    assert np.abs(plain.weights).max() > 0.5 and np.abs(plain.weights - own.weights).max() < 1e-4 and (plain.seen == own.seen).all()
    np.testing.assert_allclose(plain.squares, own.squares, rtol=1e-4)
    assert min(t for t, _ in took["own"]) < 0.75 * min(t for t, _ in took["plain"])


def test_large_weights_stay_finite():
    weights, bias = np.zeros((lm_scoring.WIDTH, lm_scoring.CLASSES), np.float32), np.zeros(lm_scoring.CLASSES, np.float32)
    weights[0], weights[1, 0] = -100, 100
    rows = np.array([[0, 1, 2]] * 4, np.uint16)
    found = lm_scoring._logits(weights, bias, rows)
    assert found[0] == pytest.approx(-np.log(lm_scoring.CLASSES)) and found[2] == pytest.approx(-np.log(lm_scoring.CLASSES))
    assert found[1, 0] == pytest.approx(0) and found[1, 1] == pytest.approx(-400)
    assert (lm_scoring._logits(weights, bias, rows, np.array([5, 1, 0])) == found[[0, 1, 2], [5, 1, 0]]).all()


def test_packing_holds_little_of_a_batch():
    import public_tokenizers

    rng = np.random.default_rng(5)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(8000)]  # 19 MB
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), pa.array(texts)], ["doc_id", "text"])
    known = packing.WordIds(packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    tracemalloc.start()
    tokens = sum(sum(b.column(2).to_pylist()) for b in packing.pieces(iter([batch]), known, packing.SumOfSquares(4096, 0), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens > 8000 * 401 and peak < 100e6
    cut = list(slices(iter([batch, batch.slice(0, 0)]), 1, 10_000))
    assert pa.Table.from_batches(cut).to_batches()[0].schema == batch.schema and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert len(cut) > 1500 and [b.num_rows for b in slices(iter([batch.slice(0, 3)]), 1, 1)] == [1, 1, 1]


def test_quality_accuracy_on_held_out_labels(spark, sf_dir):
    big = "/root/testdata/sf0.01"
    docs, labels = read_docs(spark, big if os.path.isdir(big) else sf_dir), read_docs(spark, big if os.path.isdir(big) else sf_dir, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    grade = {r.doc_id: r.grade for r in quality.graded(labels.where("doc_id % 3 = 0")).collect()}
    kept = {r.doc_id: r.kept for r in quality.scored(docs, model).collect()}
    good, poor = [kept[i] for i, g in grade.items() if g == 2], [kept[i] for i, g in grade.items() if g == 0]
    assert np.mean(good) > 0.9 and np.mean(poor) < 0.3


def test_quality_scores_are_ordered(docs, rows):
    model = quality.Ordinal(np.array([1, 2]), np.array([1.0, -1.0]), np.array([-1.0, 1.0]))
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 2 for r in got)
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_without_labels_keeps_everything(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(docs, quality.train(docs, labels)).count() == len(rows)
    assert {r.kept for r in quality.scored(docs, quality.fit([np.array([1])], np.array([0]))).collect()} == {False}


def test_odd_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 1, None), (4, 1, 1), (None, 1, 0), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality.graded(labels).collect()} == {(1, 0), (4, 1), (5, 2)}


def test_stages_are_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]


def test_pipeline_equals_plain_steps(spark, sf_dir, sample_texts, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    tables = pytest.importorskip("public_tokenizers")
    docs = read_docs(spark, sf_dir)
    model = quality.train(docs, read_docs(spark, sf_dir, "labels"))
    known = quality.Features()
    rows = [(i, t) for i, t in sorted(sample_texts.items()) if model.tails(model.score(known.of(t)))[-1] >= quality.KEEP]
    last = {brute.lower(t): i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[brute.lower(t)] == i]
    rows = [r for r, c in zip(rows, brute.components(rows)) if c == r[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "rows"))
    gone = collections.defaultdict(set)
    for r in substring_dedup.repeats(spark.read.parquet(str(tmp_path / "rows"))).where("NOT kept").collect():
        gone[r.doc_id].update(range(r.start, r.start + r.n_chars + (r.paragraph is not None)))
    found = brute.paragraphs(rows, substring_dedup.MIN_WORDS)
    repeated = {(rows[n][0], i) for k, ((n, i, _), root) in enumerate(zip(found, brute.groups([s for *_, s in found]))) if root != k}
    text_of = dict(rows)
    starts = lambda t: np.cumsum([0] + [len(x) + 1 for x in t.split("\n")])
    assert all(starts(text_of[d])[i] in gone[d] for d, i in repeated)
    left = [(d, "".join(c for k, c in enumerate(t) if k not in gone[d])) for d, t in rows]
    left = [(d, t) for d, t in left if d not in gone or t.strip()]
    tokenizer = tokenizers.Tokenizer.from_file(tables.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert [c.split()[0] for c in packing.PIECES.split(", ")] == list(got[0].asDict())
    held = collections.Counter()
    for r in got:
        held[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(held) == want


def test_stages_return_the_documents_columns(spark, sf_dir, docs):
    rows = docs.withColumnRenamed("kept", "n_chars").withColumn("n_chars", docs["doc_id"])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.schema == rows.schema and out.count() > 0
        assert stage(spark, rows.limit(0), sf_dir).count() == 0


def test_quality_fit_is_at_the_top_of_the_likelihood():
    """The ordinal log-likelihood, written out grade by grade, has no slope at the fitted weights and thresholds (central differences)."""
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 240)
    rows = [np.flatnonzero(rng.random(6) < [[.8, .5, .1, .3, .2, .5], [.3, .6, .4, .3, .7, .5], [.1, .5, .8, .9, .3, .5]][g]) for g in grades]
    ridge = 1e-3
    model = quality.fit(rows, grades, steps=6000, rate=0.02, ridge=ridge)
    assert len(model.features) >= 2 and (np.diff(model.thresholds) > 0).all()

    def likelihood(x):
        weight, cuts = dict(zip(model.features.tolist(), x)), x[len(model.features):]
        total = 0.0
        for row, grade in zip(rows, grades):
            score = sum(weight.get(f, 0.0) for f in row.tolist())
            above = [1.0, *[1 / (1 + math.exp(c - score)) for c in cuts], 0.0]
            total += math.log(above[grade] - above[grade + 1])
        return total / len(rows) - ridge / 2 * sum(w * w for w in weight.values())

    x = np.concatenate([model.weights, model.thresholds])
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-4
        assert abs(likelihood(x + step) - likelihood(x - step)) / 2e-4 < 2e-3
    tails = model.tails(model.score(rows[0]))
    score = sum(w for f, w in zip(model.features.tolist(), model.weights) if f in rows[0])
    assert np.allclose(tails, [1 / (1 + math.exp(c - score)) for c in model.thresholds])


def test_word_ids_are_those_of_the_whole_text():
    """Marks, apostrophes, letters with marks of their own, capitals of many scripts, strings of special tokens; also with a small memory."""
    import public_tokenizers
    import pyarrow as pa

    from plumbline.llm.common import gathered
    from plumbline.llm.shingles import Hasher, buffers

    rng = np.random.default_rng(3)
    signs = list("ab'.,!<|>éñΣ1²_-s t") + ["é", "́", "‍", "…", " ", "<|endoftext|>"]
    texts = ["don't (won't) 'silly 'tis dogs' \"it's\" 've", "a.b,c;d!! ...x… ….  ≠ ≮ é. .é é́. .́a", "x<|startoftext|>y |a| <b> a< >b |", "ΑΣ. Σ! İx ſ K. 12. .34 5's ½. x²",
             "--a--b-- _a_", "́abc. ‍a. ａ．Ｂ！"] + ["".join(rng.choice(signs, 120)) for _ in range(200)]
    for most in (packing.MAX_WORDS, 30):
        known = packing.WordIds(packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")), most)
        assert known.known
        for part in ([texts] if most > 30 else [[t] for t in texts]):
            data, bounds = buffers(pa.array(part))
            hashes, counts, starts, ends = Hasher().placed(data, bounds)
            numbers, at, sizes, flat = known.words(data, hashes, starts, ends)
            for text, own in zip(part, np.split(numbers, np.cumsum(counts)[:-1])):
                assert gathered(flat, at[own], sizes[own]).tolist() == known.plain.encode(text, add_special_tokens=False).ids
