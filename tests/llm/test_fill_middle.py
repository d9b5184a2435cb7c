"""op11 against a brute-force version with findall, and its edge cases."""
import hashlib
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventide.llm.fill_middle import cuts, fill_middle, restore
from tools.compare import connect, rows_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, t
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force_and_restores(spark):
    r = random.Random(11)
    pieces = ["a", "wörld", "\U0001F600x", " ", "  ", "\n", "\t\x0b", "\x0c\r", " ", " ", "<", "<P", ">", "S>", "<M", "\x1c", "\x85"]
    texts = [None, "", " ", "\n\n", "one", " one ", "has <P> in it", "<S>", "a<M>b", "word " * 200_000, "x" * 300_000]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(400)]
    texts += texts[20:40]
    rows = [(i, t, "n", "output") for i, t in enumerate(texts)] + [(7, "same id again and again", None, None), (None, "no id but words", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n string")
    out = fill_middle(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restore("output", "form")).collect()
    want = sorted(((i, *brute(i, t)) for i, t, *_ in rows), key=str)
    assert sorted(((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got), key=str) == want
    assert sorted(g.back for g in got) == sorted(t or "" for _, t, *_ in rows)
    assert {g.form for g in got} == {"plain", "spm", "psm"}
    assert fill_middle(df.limit(0)).count() == 0


def test_cuts_count_from_zero_to_all_units():
    assert cuts("", 5, 9) == (0, 0, 0)
    assert cuts("  a b \n", 0, 3) == (3, 0, 7) and cuts("  a b \n", 2, 1) == (3, 3, 5)


def test_one_python_pass_without_shuffle(spark):
    plan = fill_middle(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = entry.queries()["op11_fill_middle"](spark, sf)
    cur = connect(sf).execute(entry.oracle_sql()["op11_fill_middle"])
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
    assert df.filter(F.col("form") != "plain").count() > 0
