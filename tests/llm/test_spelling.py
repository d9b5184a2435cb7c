"""op13 against brute force over all pairs, and its edge cases."""
import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from eventide.llm.spelling import near_words, spelling_variants
from tools.compare import connect, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=str)


def rows_with(r, words, count):
    return [(r.choice([i, i, None]), " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(count)]


@pytest.mark.parametrize("pairs", [1, 20, 20_000])
def test_equals_brute_force(spark, pairs):
    r = random.Random(13)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * r.randint(1, 40)
        for _ in range(3):
            i = r.randint(0, len(s))
            words += [s[:i] + r.choice("abÀz") + s[i:], s[:i] + s[i + 1:], s[:i] + "x" + s[i + 1:]] * r.randint(1, 4)
    words += ["ABCDE", "ÀÉÎÕÜ", "àéîõü", "×abcd", "abcdé9fghij", "l" * 70, "l" * 69 + "m", "l" * 71, "aaaaa", "aaaaaa", "aaaaaaa", "b" * 40, "b" * 41]
    rows = rows_with(r, words, 260) + [(1, None), (2, ""), (3, "1 2 3 ... ab"), *([(4, "l" * 20_000), (5, "l" * 20_001)] if pairs > 20 else [])] * 3
    df = spark.createDataFrame([(i, t, "w", 9, "key") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    got = spelling_variants(df, pairs=pairs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_every_kind_of_edit_at_every_place(spark):
    base = "abcdefghijk"
    others = {base[:i] + "z" + base[i:] for i in range(12)} | {base[:i] + base[i + 1:] for i in range(11)} | {base[:i] + "z" + base[i + 1:] for i in range(11)}
    words = spark.createDataFrame([(w, 1) for w in sorted(others | {base})], "word string, n long")
    for pairs in (1, 20_000):
        met = [frozenset(x) for x in near_words(words, pairs).collect()]
        assert len(met) == len(set(met)) and {w for m in met if base in m for w in m} == others | {base}


def test_chains_are_followed_to_the_last(spark):
    rows = [(k, " ".join(["abcdef"] * 4 + ["abcdeg"] * 9 + ["abcdhg"] * 20 + ["abidhg"] * 50)) for k in (1,)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.word: (x.form, x.root) for x in spelling_variants(df, noise=2**40).collect()}
    assert got == {"abcdef": ("abcdeg", "abidhg"), "abcdeg": ("abcdhg", "abidhg"), "abcdhg": ("abidhg", "abidhg"), "abidhg": (None, "abidhg")}


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = entry.queries()["op13_spelling_variants"](spark, sf)
    cur = connect(sf).execute(entry.oracle_sql()["op13_spelling_variants"])
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
