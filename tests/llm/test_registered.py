"""The queries and the pipeline over the smallest tables."""
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from eventide.llm.bktree_simhash import near_duplicates
from eventide.llm.common import settle
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_mixing_equals_sql(spark):
    df = entry.queries()["op6_source_mixing"](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(entry.oracle_sql()["op6_source_mixing"])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_repeat_removal_on_a_table_equals_brute_force(spark):
    least = 400
    raw = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    seen = Counter(b[i:i + least] for b in raw.values() for i in range(len(b) - least + 1))
    got = {r.doc_id: r for r in entry.queries()["op4_repeat_removal"](spark, SF).collect()}
    assert set(got) == set(raw)
    for doc_id, b in raw.items():
        mask = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] > 1:
                mask[i:i + least] = b"\1" * least
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), sum(mask), hashlib.sha256(kept).hexdigest())
        assert r.kept_text.replace("\ufffd", "") == kept.decode("utf-8", "ignore").replace("\ufffd", "")


def test_held_out_languages(spark):
    df = entry.queries()["op10_language_id"](spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in df.collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], SF), f"test-{name}"))
        if name != "tokens":
            assert kept[-1].columns == columns
    raw, known, single, clean, mixture, tokens = kept
    assert {r.doc_id for r in known.collect()} <= {r.doc_id for r in raw.collect()}
    assert known.count() >= 0.95 * raw.filter("text rlike '[a-zA-Z]'").count()
    groups = near_duplicates(known)
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups.collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.text == before[r.doc_id] or "[secret]" in r.text
    assert clean.count() == single.count()
    times = Counter(r.doc_id for r in mixture.collect())
    assert set(times) <= set(before) and max(times.values()) <= 2
    assert tokens.count() == mixture.count() and all(r.ids for r in tokens.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(map(tuple, tokens.collect()), key=str)


def test_language_stage_keeps_every_text_with_a_letter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {}
    for r in docs.filter("text is not null").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).extend(r.text.split())
    one, two, three, four = (texts[x] for x in sorted(texts, key=lambda x: -len(texts[x]))[:4])
    mixed = [" ".join(one[i:i + 40] + two[i:i + 35] + three[i:i + 30] + four[i:i + 30]) for i in range(0, 400, 40)]
    odd = spark.createDataFrame([*((10_000_000 + i, t) for i, t in enumerate(mixed)), (10_000_100, "q"), (10_000_101, "12 - 7"), (10_000_102, None)], "doc_id long, text string")
    df = docs.unionByName(odd, allowMissingColumns=True)
    lettered = sorted(r.doc_id for r in df.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, df, SF).collect()) == lettered
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(spark, unlabelled, SF)
    assert got.columns == columns and got.count() == docs.count()
