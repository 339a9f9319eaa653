import collections
import hashlib
import zlib

import brute
import numpy as np
import pytest

from plumbline.llm import blocks, byte_bpe, fingerprints, packing, token_counts

P = pytest.importorskip("public_tokenizers")


def best_count(text, pieces):
    """Pieces of the best segmentation of the whole text, by a table over all its prefixes."""
    text = ("▁" + text.replace(" ", "▁")) if text else ""
    longest, unknown = max(map(len, pieces)), min(pieces.values()) - token_counts.UNKNOWN
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] + len(text[end - 1].encode()))] if text[end - 1] not in pieces else []
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            score = pieces.get(text[start:end])
            if score is not None:
                options.append((best[start][0] + score, best[start][1] + 1))
        top = max(o[0] for o in options)
        best.append([o for o in options if o[0] == top][-1])  # of equal scores the longest last piece
    return best[-1][1]


def test_token_counts_equal_a_whole_text_search(docs, rows, spark, sf_dir, sample_texts):
    pytest.importorskip("sentencepiece")
    pieces = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.op1_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(sample_texts)
    some = sorted(sample_texts)[::4]
    assert [got[i] for i in some] == [best_count(sample_texts[i], pieces) for i in some]
    odd = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, pieces).collect())
    assert odd == collections.Counter((i, best_count(t, pieces)) for i, t in rows)


def test_token_counts_of_small_vocabulary(make_docs):
    pieces = {"▁": -1.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁ab": -4.5, "ba": -5.0}
    docs = make_docs([(1, "ab"), (2, "aab ba"), (3, "zé"), (4, None)])
    got = {r.doc_id: (r.n_tokens, r.n_pre_tokens) for r in token_counts.token_counts(docs, pieces).collect()}
    assert got == {1: (1, 1), 2: (5, 2), 3: (4, 1), 4: (0, 0)}


def test_pieces_that_cross_words_are_refused(docs):
    with pytest.raises(ValueError, match="crosses"):
        token_counts.token_counts(docs, {"a▁b": -1.0})


@pytest.fixture(scope="module")
def bpe():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_encoder_and_decodes(docs, rows, bpe):
    ranks, whole = bpe
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    want = collections.Counter((i, np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in got) == want


def test_bpe_query_digests(spark, sf_dir, sample_texts, bpe):
    for r in byte_bpe.op6_byte_bpe(spark, sf_dir).collect():
        ids = np.array(bpe[1].encode_ordinary(sample_texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(sample_texts[r.doc_id].encode()).hexdigest())


def test_blocks_that_changed_between_two_reads_fail():
    import pyarrow as pa

    texts = pa.table({"dictionary": pa.array([5 << 24 | 2])})
    with pytest.raises(RuntimeError, match="other rows"):
        blocks.in_order(texts, pa.table({"code": pa.array([0, 1], pa.int32()), "dictionary": pa.array([6 << 24 | 2] * 2)}))


@pytest.fixture(scope="module")
def word_ids():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def check_sequences(got, length):
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for rows in sequences.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end == length or end & (end - 1) == 0
    return len(sequences)


def test_packing_holds_every_id_once(docs, rows, word_ids):
    got = packing.pack(docs, packing.read_tokenizer(P.path("word_bpe_49k.json")), length=64, max_open=5).collect()
    check_sequences(got, 64)
    once = collections.Counter(i for i, _ in rows)
    for i, text in rows:
        ids = word_ids(text)
        if once[i] == 1:
            end = 0
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (end, len(ids))
                assert r.ids_crc32 == zlib.crc32(np.array(ids[end:end + r.length], "<u4").tobytes())
                end += r.length
            assert end == len(ids)
    assert sum(r.length for r in got) == sum(len(word_ids(t)) for _, t in rows)


def test_packing_query(spark, sf_dir, sample_texts, word_ids):
    got = packing.op7_packing(spark, sf_dir).collect()
    total = sum(len(word_ids(t)) for t in sample_texts.values())
    assert sum(r.length for r in got) == total
    assert check_sequences(got, 4096) <= total // 4096 + 12 * 4


def test_sum_of_squares_picks_the_level_by_its_rule():
    packer = packing.SumOfSquares(10, 0)
    piece = lambda n: (0, 0, np.zeros(n, np.uint32), n)
    for n in (6, 6, 3):
        assert list(packer.add(piece(n))) == []
    # squares now: level 6 twice, level 3 once (3 into a 6 would leave 1 + 1 + 0, a new window 4 + 1)
    assert packer.levels[[3, 6, 9]].tolist() == [0, 1, 1]
    done = list(packer.add(piece(4)))
    assert [d[2] for d in done] == [6, 4] and packer.levels.sum() == 1
    assert [d[2] for d in packer.closed()] == [6, 2, 1] or sum(d[2] for d in packer.closed()) == 0


def test_tokens_of_nothing(nothing, bpe):
    assert token_counts.token_counts(nothing, {"a": -1.0}).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(nothing, bpe[0], P.PATTERN), bpe[0]).collect() == []
    assert packing.pack(nothing, packing.read_tokenizer(P.path("word_bpe_49k.json"))).collect() == []


def test_fingerprints_of_edited_and_next_texts(docs, rows):
    # rows of one id and different texts follow each other by a hash; here they are equal but for the NULL ids
    known = [(i, t) for i, t in rows if i is not None]
    order = sorted(known, key=lambda r: r[0])
    got = [r for r in fingerprints.with_edited(docs.where("doc_id IS NOT NULL"), k=64, buckets=5).collect()]
    assert len(got) == len(known)
    by_id = {r.doc_id: r for r in got}
    errors, equal = [], collections.defaultdict(set)
    for n, (i, t) in enumerate(order):
        follows = order[(n + 1) % len(order)][1] or ""
        text, r = t or "", by_id[i]
        half = len(text) // 2
        edited = text[:len(text) - half] + follows[:half]
        equal[text].add(r.fingerprint)
        if i == 12:
            continue  # repeated: one of them is followed by the other
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - brute.bag_likeness(text, edited), r.near_next - brute.bag_likeness(text, follows)]
    assert all(len(v) == 1 for v in equal.values())
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1 and np.abs(errors).max() < 0.35


def test_fingerprints_are_native_and_empty_of_nothing(docs, nothing):
    plan = fingerprints.with_edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert fingerprints.with_edited(nothing).collect() == [] and fingerprints.fingerprint(nothing).collect() == []


def test_fingerprint_of_one_row(make_docs):
    one = fingerprints.with_edited(make_docs([(7, "abcd")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(7, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    plain = fingerprints.fingerprint(make_docs([(7, "abcd"), (8, "ABCD "), (9, None)])).collect()
    assert len({r.fingerprint for r in plain}) == 2 and {r.fingerprint for r in plain if r.doc_id == 9} == {"empty"}
