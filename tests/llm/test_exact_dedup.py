"""op12 against brute force, with digests short enough to clash, and its edge cases; the fuse filter by itself."""
import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from eventide.llm.exact_dedup import drop_exact_duplicates, exact_groups
from eventide.llm.fuse_filter import FuseFilter
from tools.compare import connect, rows_of

SCHEMA = "doc_id long, text string, n string, least int, digest string"


def brute(rows):
    groups = {}
    for doc_id, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        out.append((norm, min(known, default=None), len(ids)))
    return {norm: (keep, n, hashlib.sha256(norm.encode()).hexdigest()) for norm, keep, n in out}


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "n", 1, "d") for i, t in rows], SCHEMA)
    want = brute(rows)
    got = exact_groups(df, keep=("doc_id", "text"), **options).collect()
    assert len(got) == len(rows)
    kept = {}
    for g in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", g.text or "")
        assert (g.keep_id, g.group_size, g.text_sha256) == want[norm]
        if g.kept:
            assert g.doc_id == g.keep_id
            kept[norm] = kept.get(norm, 0) + 1
    assert kept == dict.fromkeys(want, 1)
    return df


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "batches": 4, "per_bucket": 20}, {"batches": 1}, {"digest_bytes": 2, "batches": 2}])
def test_equals_brute_force(spark, options):
    r = random.Random(12)
    words = ["ab", "é", "\U0001F600", "x\x1cy", "q"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) + r.choice(["", " ", "\n"]) for _ in range(300)]
    texts += [f"text {k}" for k in range(400)] + ["hot copy"] * 300 + [None, "", None, " ", "\t\n", "long " * 100_000, "long\n" * 100_000]
    rows = [(r.randint(0, 5000), t) for t in texts]
    rows += [(None, "hot  copy"), (None, "only nulls"), (None, "only nulls"), (3, "same row"), (3, "same row"), (3, "another text")]
    df = check(spark, rows, **options)
    left = drop_exact_duplicates(df, **options)
    assert left.columns == df.columns and left.count() == len(brute(rows))


def test_heavy_groups_join_alike(spark, monkeypatch):
    monkeypatch.setattr("eventide.llm.exact_dedup.HEAVY_ROWS", 10)
    check(spark, [(i, f"t{i % 7}" if i % 3 else f"alone {i}") for i in range(200)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and exact_groups(df).count() == 0
    assert drop_exact_duplicates(df).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = entry.queries()["op12_exact_dedup"](spark, sf)
    cur = connect(sf).execute(entry.oracle_sql()["op12_exact_dedup"])
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5_000, 60_000])
def test_filter_never_misses_a_key(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**64, n, dtype=np.uint64)
    f = FuseFilter.from_row(*FuseFilter.build(np.concatenate([keys, keys[: n // 2]])).to_row())
    assert f.may_hold(keys).all()
    assert f.may_hold(r.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.006
