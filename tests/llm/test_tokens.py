"""op3 and op9 against the public library, prefix by prefix; op7's counts, gradient and window coverage."""
import hashlib
import inspect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from eventide.llm import attention_lm as lm  # noqa: E402
from eventide.llm.bpe_automaton import Automaton, decode_documents, digest_documents, encode_documents  # noqa: E402
from eventide.llm.bpe_merges import Vocabulary  # noqa: E402
from eventide.llm.token_counts import PrefixCounts, count_documents, longest_within  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", "'s", "'ll", "'re", "don't", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "é", "ß", "日本", "!!", "...", "12", "\u0085",
          " ", "\x1c", "aaa", "  \n ", "\U0001F600", "́", "\x00", "the", "Ünder"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def texts(n=600, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_automaton_equals_library(library, vocabulary):
    a = Automaton(vocabulary, most_pieces=50)  # small memo: emptied again and again
    for t in [*texts(), "x" * 4000, "ab" * 900, " " * 300, "\n" * 99 + "z"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(a.encode(t), dtype="<u4").tolist() == ids
        assert a.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert a.decode(library.encode("é").ids[:1]) == library.decode(library.encode("é").ids[:1])


def test_every_prefix_count(library, vocabulary):
    p = PrefixCounts(vocabulary)
    for t in texts(300, 2):
        counts = p.counts(t)
        assert counts.tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        for budget in (0, 2, 5):
            best = longest_within(counts, budget)
            assert best == max(i for i in range(len(t) + 1) if counts[i] <= budget)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")


def test_documents(spark, library):
    rows = [(1, "Hello there, world", "x", "y"), (2, None, None, None), (3, "", "", ""), (1, "Hello there, world", "x", "y"), (None, "a <|endoftext|> b", None, None)]
    df = table(spark, rows)
    for got, (doc, t, _, _) in zip(sorted(map(tuple, digest_documents(df, PATH).collect()), key=str), sorted(rows, key=str), strict=True):
        t = t or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert got in [(doc, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.chars_within) for r in count_documents(df, PATH, 3).collect()}
    assert got == {(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 3,
                    max(i for i in range(len(t or "") + 1) if len(library.encode((t or "")[:i], add_special_tokens=False).ids) <= 3)) for d, t, _, _ in rows}
    back = {(r.doc_id, r.text) for r in decode_documents(encode_documents(df, PATH), PATH).collect()}
    assert back == {(d, t or "") for d, t, _, _ in rows}
    assert digest_documents(df.limit(0), PATH).count() == 0 and count_documents(df.limit(0), PATH, 3).count() == 0


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 24, 25, 90])
    classes = rng.integers(0, lm.CLASSES, sizes.sum())
    seen, target, first = lm.windows(classes, sizes)
    assert (target >= 0).sum() == sizes.sum()  # each token once
    follows = rng.integers(0, 9, (lm.CLASSES + 1, lm.CLASSES)).astype(float)
    flat = lm.start_weights(np.full(lm.CLASSES, 1 / lm.CLASSES), follows).astype(np.float64)
    loss, g = lm.gradient(flat, seen, target)
    for i in rng.integers(0, len(flat), 15):
        d = np.zeros(len(flat))
        d[i] = 1e-5
        n = (lm.gradient(flat + d, seen, target)[0] - lm.gradient(flat - d, seen, target)[0]) / 2e-5
        assert abs(n - g[i]) < 1e-4 * max(0.01, abs(n))
    logs = lm.class_log_probs(flat, classes, sizes, batch=3)
    assert abs(-logs.mean() - loss) < 1e-3
    alone = np.concatenate([lm.class_log_probs(flat, c, np.array([len(c)])) for c in np.split(classes, np.cumsum(sizes)[:-1])])
    assert np.allclose(logs, alone, atol=1e-4)
    trained = lm.train_locally(flat.astype(np.float32), np.tile(seen, (40, 1)), np.tile(target, (40, 1)), 0.02)
    assert lm.gradient(trained, seen, target)[0] < loss


def test_words_are_coded_in_one_call_as_each_alone(monkeypatch):
    enc, end = lm.coder(RANKS)
    r = random.Random(1)
    parts = ["a", "b", "é", "'", "'s", "1", "23", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "-", "!!", "日", "😀"]
    calls = []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return enc.encode_ordinary(text)

    monkeypatch.setattr(lm, "coder", lambda path: (Counted(), end))
    lm.begins_word.cache_clear()
    monkeypatch.setattr(Counted, "decode_single_token_bytes", lambda self, i: enc.decode_single_token_bytes(i), raising=False)
    for letters in (parts, [p for p in parts if not p.isspace()]):
        words = ["".join(r.choice(letters) for _ in range(r.randint(0, 5))) for _ in range(2_000)]
        calls.clear()
        ids, sizes = lm.code_words(RANKS, [w.encode() for w in words])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [enc.encode_ordinary(" " + w) if w else [end] for w in words]
        assert len(calls) == 1 + sum(any(c.isspace() for c in w) for w in words)
    empty = lm.code_words(RANKS, [])
    assert len(empty[0]) == len(empty[1]) == 0


def test_sharp_attention_leaves_nothing_too_small_to_multiply():
    rng = np.random.default_rng(8)
    sizes = np.array([70, 1, 33])
    classes = rng.integers(0, lm.CLASSES, sizes.sum())
    flat = rng.normal(0, 2.5, sum(int(np.prod(s)) for s in lm.SHAPES.values())).astype(np.float32)
    seen, target, _ = lm.windows(classes, sizes)
    m = lm.Attention(flat)
    m.forward(seen)
    assert (m.w[m.w > 0] >= 1e-20).all() and (m.total >= 1).all() and (m.w == 0).any()
    loss, g = lm.gradient(flat, seen, target)
    assert math.isfinite(loss) and np.isfinite(g).all()
    assert abs(lm.class_log_probs(flat, classes, sizes).mean() + loss) < 1e-3 * loss


def test_id_shares_sum_to_one():
    rng = np.random.default_rng(1)
    classes, counts = rng.integers(0, lm.CLASSES, 500), rng.integers(0, 50, 500).astype(float)
    after = rng.integers(0, 4, (lm.CLASSES + 1, 500)).astype(float)
    shares = np.exp(lm.log_shares(counts, after, classes))
    for k in set(classes):
        assert np.allclose(shares[:, classes == k].sum(axis=1), 1, atol=1e-5)


def test_language_model_scores(spark):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta's", "éa"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (3, "alpha"), (62, "new word " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("extra"))
    train = F.col("doc_id") % 4 != 1
    got = lm.score_documents(df, RANKS, train, share=1, bucket_rows=16).collect()
    counts = Counter(w for d, t in rows if d % 4 != 1 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        ws = [*(t or "").encode().lower().split(), b""]
        want.append((d, d % 4 == 1, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)))
    assert sorted(want) == sorted((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got)
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    again = {(x.doc_id, x.n_tokens): x.score for x in lm.score_documents(df, RANKS, train, share=1, bucket_rows=16).collect()}
    assert all(abs(again[x.doc_id, x.n_tokens] - x.score) < 1e-6 for x in got)
    empty = lm.score_documents(df.limit(0), RANKS, train)
    assert empty.count() == 0
    assert all(math.isfinite(x.score) and x.n_known == 0 for x in lm.score_documents(df, RANKS, F.lit(False)).collect())
    assert zlib.crc32(b"1") % 7 in range(7)


def test_classes_and_start_count_all_training_documents(spark):
    """More windows than any bounded sample would hold, most of them in one document: every document counts."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta's", "éa", "zeta"]
    rows = [(0, " ".join(r.choice(words[:3]) for _ in range(100_000))), *((i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(1, 50))]
    df = spark.createDataFrame([(i, t.encode()) for i, t in rows], "_id long, _text binary").repartition(5)
    coded = [lm.code_words(RANKS, [*t.encode().lower().split(), b""])[0].tolist() for _, t in rows]
    by_id = np.bincount(np.concatenate(coded), minlength=lm.coder(RANKS)[1] + 1)
    column = lm.frequent_ids(by_id)
    company, follows = Counter(), Counter()
    classes = np.arange(len(by_id)) % lm.CLASSES
    for ids in coded:
        for j, b in enumerate(ids):
            follows[classes[ids[j - 1]] if j else lm.CLASSES, classes[b]] += 1
            for a in ids[max(0, j - 4):j]:
                company[b, column[a]] += column[a] >= 0
                company[a, column[b]] += column[b] >= 0
    got = lm._company(df, RANKS, by_id)
    assert {(a, b): int(got[a, b]) for a, b in zip(*np.nonzero(got), strict=True)} == {k: n for k, n in company.items() if n}
    got = lm._follows(df, RANKS, classes)
    assert {(a, b): int(got[a, b]) for a, b in zip(*np.nonzero(got), strict=True)} == dict(follows)


def test_every_training_window_is_trained_on_once(spark):
    """The registered setting: all training documents over the rounds, each in one, and all their windows."""
    share, rounds = (inspect.signature(lm.score_documents).parameters[x].default for x in ("share", "rounds"))
    docs = spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("mix"))
    parts = [[r.id for r in lm._round(docs, n, rounds, share).collect()] for n in range(rounds)]
    assert sorted(x for p in parts for x in p) == list(range(300)) and all(len(p) > 50 for p in parts)
    r = random.Random(6)
    raw = [" ".join(r.choice(["alpha", "Beta", "gamma"]) for _ in range(r.randint(0, 90))).encode() for _ in range(80)]
    tokens = sum(len(lm.code_words(RANKS, [*t.lower().split(), b""])[0]) for t in raw)

    class Counting(lm.Trainer):
        scored = 0

        def over(self, seen, target):
            self.scored += int((target >= 0).sum())
            super().over(seen, target)

    classes = np.arange(lm.coder(RANKS)[1] + 1) % lm.CLASSES
    t = Counting(lm.start_weights(np.full(lm.CLASSES, 1 / lm.CLASSES), np.ones((lm.CLASSES + 1, lm.CLASSES))), 0.02)
    lm._learn((pa.RecordBatch.from_arrays([pa.array(raw[i:i + 9])], ["_text"]) for i in range(0, 80, 9)), RANKS, classes, t, 0, room=20)
    assert t.scored == tokens


def test_texts_are_coded_once_into_buckets_bounded_by_words(spark, monkeypatch):
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma's", "éa", "zeta", "日本", "a\u00a0b"]
    rows = [(i, i % 3 != 1, i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 700])))) for i in range(60)]
    df = spark.createDataFrame([(i, t, m, x.encode()) for i, t, m, x in rows], "_id long, train boolean, mix long, _text binary").coalesce(2)
    got = lm._code(df, RANKS, bucket_rows=16, bucket_words=1_000).collect()
    heads = {x.bucket: x for x in got if x.words is not None}
    texts = {i: [*x.encode().lower().split(), b""] for i, _, _, x in rows}
    assert sorted(x._id for x in got) == sorted(texts) and {x.bucket for x in got} == set(heads)
    for x in got:
        held = [bytes(w) for w in heads[x.bucket].words]
        steps = np.frombuffer(x.places, np.int32)
        assert Counter(held[k] for k in lm._numbers(steps, np.array([len(steps)]))) == Counter(texts[x._id])
        assert np.frombuffer(x.ids, lm._id_kind(RANKS)).tolist() == lm.code_words(RANKS, texts[x._id])[0].tolist()
    for bucket, head in heads.items():
        own = [x._id for x in got if x.bucket == bucket]
        assert len(own) <= 16 and sum(len(texts[i]) for i in own[:-1]) < 1_000
        want = Counter(w for x in got if x.bucket == bucket and x.train for w in texts[x._id])
        assert [want[bytes(w)] for w in head.words] == list(head.counts)
    reads = []
    monkeypatch.setattr(lm, "_code", lambda docs, *a, f=lm._code, **b: reads.append(docs) or f(docs, *a, **b))
    scored = lm.score_documents(df.select("_id", F.col("_text").cast("string").alias("text")), RANKS, F.col("_id") % 3 != 1, doc_id="_id", bucket_rows=16)
    assert len(reads) == 1 and "_text" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_parts_hold_a_bounded_number_of_characters():
    import pyarrow as pa

    from eventide.llm.common import parts_of

    texts = ["ab", None, "", "cdefgh", "i", "jk", "l"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    parts = [p.column(1).to_pylist() for p in parts_of(batch, 1, 3)]
    assert parts == [["ab", None, ""], ["cdefgh"], ["i", "jk"], ["l"]]
    assert not list(parts_of(batch.slice(0, 0), 1, 3))


def test_a_full_memo_keeps_what_is_asked_for_again():
    from eventide.llm.bpe_merges import Memo

    made = []
    memo = Memo(lambda k: made.append(k) or k % 2 == 0, 10)
    for k in range(100):
        assert memo[0] is True and memo[k] is (k % 2 == 0)
        assert len(memo) + len(memo.older) <= 10
    assert made == list(range(100))
