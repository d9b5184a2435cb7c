"""op1, op4, op5, op6 and op10 against brute force on small tables, and their edge cases."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from eventide.llm.bktree_simhash import BKTree, drop_near_duplicates, near_duplicates
from eventide.llm.components import components
from eventide.llm.crf_language import fit, forward_backward, identify
from eventide.llm.interval_dedup import remove_repeats, repeats
from eventide.llm.mixing import apportion, mix, mixed_documents
from eventide.llm.secret_scan import names, redact, scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, first=0):
    rows = [(first + i, t, None, sources[i] if sources else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"spans": F.lit("x"), "component": F.lit(1), "size": F.lit(2)})


# --- op1

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_base_spans_and_battery(spark):
    r = random.Random(4)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = ["token=password: abcdefgh1234", "é\U0001F600 API_KEY = 'abcdEFGH12' passwd:short", "AKIA" + "A1" * 8 + " AKIAX", None, "", "f" * 31 + " " + "0a" * 16,
             "secret==abcdefghi token:\"x.y-z+/_=12", f"note {key} end", "user_id_2024_summary_table_v2_final_copy", "a" * 30 + "1" * 10,
             "0123456789abcdefghijklmnopqrstuvwxyz", "ſecret=abcdefghijk", "x " * 5000 + "token=abcdefgh"]
    df = docs(spark, texts + [texts[0]])
    got = {r_.doc_id: [tuple(s) for s in r_.spans] for r_ in scan(df).collect()}
    for i, t in enumerate(texts + [texts[0]]):
        assert [s for s in got[i] if s[1] < 3] == base_spans(t), t
    assert [s for s in got[7] if s[1] == 3] == [(5, 3, 53)]
    assert not any(s[1] == 3 for i in range(len(texts)) if i != 7 for s in got[i])
    named = {r_.doc_id: r_.n for r_ in scan(df).select("doc_id", names(F.col("spans")).alias("n")).collect()}
    assert named[0] == "assign:0:14" if base_spans(texts[0]) else named[0] == ""
    out = {r_.doc_id: (r_.text, r_.n_chars) for r_ in redact(df).collect()}
    assert out[7][0] == "note [secret] end" and out[7][1] == len(out[7][0]) and out[3] == (None, None) and out[8][0] == texts[8]
    assert redact(df).columns == df.columns and scan(df.limit(0)).count() == 0


def test_battery_finds_keys_of_every_alphabet_and_leaves_words_alone(spark):
    r = random.Random(11)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base64": small + small.upper() + digits + "+/", "hex": digits + "ABCDEF", "base32": small.upper() + "234567", "base36": small + digits,
                 "letters": small + small.upper(), "small": small, "capitals": small.upper(), "digits": digits}
    words = ("internationalization the quick brown fox jumps over lazy dog counterrevolutionaries get http servlet request factory bean abstract singleton "
             "account settings manager default value configuration transaction response handling number token stream schema validation error").split()
    plain = []
    for _ in range(100):
        ws = [r.choice(words) for _ in range(6)]
        plain += ["".join(ws), "_".join(ws), "-".join(ws), "/".join(ws), "".join(w.capitalize() for w in ws), "_".join(ws).upper()]
    plain += [f"2024010112000000000{i:06d}" for i in range(100)] + ["-" * 30, "0" * 40, "01234567890123456789012345", "a" * 100_000]
    # 32 digits and more are hex by the fixed patterns, no matter for the battery
    keys = [(name, "".join(r.choice(a) for _ in range(30 if name == "digits" else 40))) for name, a in alphabets.items() for _ in range(100)]
    rows = docs(spark, [f"see {t} end" for t in [*(k for _, k in keys), *plain]])
    got = {x.doc_id: [tuple(s) for s in x.spans if s["kind"] == 3] for x in scan(rows).collect()}
    found = Counter(name for i, (name, k) in enumerate(keys) if got[i] == [(4, 3, 4 + len(k))])
    assert all(found[name] >= 90 for name in alphabets), found
    assert sum(bool(got[i]) for i in range(len(keys), len(keys) + len(plain))) <= 0.01 * sum(found.values())  # what the control allows
    assert scan(docs(spark, plain)).filter("exists(spans, s -> s.kind = 3)").count() == 0


def test_one_document_of_each_near_group_by_row(spark):
    r = random.Random(5)
    a, b, c, d = (" ".join(f"w{r.randrange(10_000)}" for _ in range(300)) for _ in range(4))
    near = a + " end"
    rows = [(1, a), (1, b), (1, b), (2, near), (None, c), (None, c), (None, a), (3, ""), (4, None), (None, d), (5, d)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    want = sorted([(1, a), (1, b), (None, c), (3, ""), (5, d)], key=str)
    for x in (df, df.repartition(7, "text")):
        assert sorted(((o.doc_id, o.text) for o in drop_near_duplicates(x).collect()), key=str) == want
    assert drop_near_duplicates(df).columns == df.columns and drop_near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_keep_their_own_spans(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "nothing"), (1, "token=abcdefgh"), (None, "passwd=abcdefgh")], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.spans)) for r in scan(df).collect()) == [(False, 0), (False, 1), (False, 1), (True, 1)]
    assert sorted(r.text for r in redact(df).collect()) == ["[secret]", "[secret]", "[secret]", "nothing"]


# --- op4

def brute_removed(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for b in raws:
        for p in range(len(b) - least + 1):
            seen[b[p:p + least]] = seen.get(b[p:p + least], 0) + 1
    out = []
    for b in raws:
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - least + 1):
            if seen[b[p:p + least]] > 1:
                m[p] += 1
                m[p + least] -= 1
        m = np.cumsum(m[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(n=90):
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(200)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [say(r.randint(60, 160)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            x = r.choice(passages)
            parts.append(x[r.randint(0, len(x) // 2):r.randint(len(x) // 2, len(x))] if r.random() < 0.7 else say(r.randint(5, 60)))
        t = " ".join(parts)
        at = r.randint(0, len(t))
        texts.append(t[:at] + "#" + t[at:] if r.random() < 0.3 else t)
    return [*texts, texts[0], None, "", "x" * 3000, "ab" * 1500, "x" * 399, "x" * 400]


def test_repeats_equal_brute_force(spark):
    texts = repeat_texts()
    for least, most in ((400, 20_000), (400, 3), (250, 20_000)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(spark, texts), least, most=most).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts, least)


def test_repeats_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "q" * 10 + "".join(map(str, range(300)))), (1, "q" * 10 + "".join(map(str, range(300)))), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(0, 0), (800, 800), (800, 800)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_interval_scan_equals_all_pairs():
    r = random.Random(9)
    for _ in range(60):
        stem = "".join(r.choice("ab") for _ in range(100))
        members = [("".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode(), (stem + "".join(r.choice("ab") for _ in range(r.randint(0, 12)))).encode()) for _ in range(r.randint(2, 25))]
        least = 106
        want = []
        for i, (la, ra) in enumerate(members):
            best = (0, 0)
            for j, (lb, rb) in enumerate(members):
                if i != j:
                    left = next((k for k, (x, y) in enumerate(zip(la, lb)) if x != y), min(len(la), len(lb)))
                    right = next((k for k, (x, y) in enumerate(zip(ra, rb)) if x != y), min(len(ra), len(rb)))
                    if left + right >= least:
                        best = max(best[0], left), max(best[1], right)
            want.append(best)
        assert repeats(members, least) == want


# --- op5

def fingerprint_by_bits(t):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_components(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [None, "", " \n", "One", "one", "É b c d", "éa b"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(250)]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    df = docs(spark, texts, first=100)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in near_duplicates(df).collect()}
    fps = [fingerprint_by_bits(t) for t in texts]
    top = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    top[i] = top[j] = min(top[i], top[j])
    assert [got[100 + i] for i in range(len(texts))] == [(f"{f:016x}", 100 + c) for f, c in zip(fps, top, strict=True)]
    # small shards: the same components
    from eventide.llm import bktree_simhash as b
    nodes = spark.createDataFrame([(100 + i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc long, fp long").groupBy("fp").agg(F.min("doc").alias("node"))
    by_small = {x.node: x.component for x in components(b.links(nodes, shard_size=2)).collect()}
    assert all(by_small[n] == got[n][1] for n in by_small)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in got.values()})
    assert near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id) for x in near_duplicates(odd).collect()) == [(0, 7), (7, 7), (7, 7)]


def test_bk_tree_finds_all_within_radius():
    r = random.Random(1)
    values = {r.getrandbits(12) for _ in range(200)}
    tree = BKTree(3)
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert {tree.values[k] for k in tree.within(q)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 100), (50, 100)] + [(200, x) for x in range(201, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50} | {x: 200 for x in range(200, 230)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op6

def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment_equals_seat_by_seat(spark):
    r = random.Random(8)
    rows, want = [], {}
    for g in range(25):
        weights = [float(r.randint(0, 50)) for _ in range(r.randint(1, 12))]
        seats = r.randint(0, 60) if sum(weights) else 0
        rows += [(g, k, w, seats) for k, w in enumerate(weights)]
        want |= {(g, k): n for k, n in enumerate(highest_quotients(weights, seats))}
    df = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    assert {(x.g, x.k): x.won for x in apportion(df, ["g"], "k", "w", "seats", "won").collect()} == want


def test_mix(spark):
    r = random.Random(5)
    texts = [" ".join("w" for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, ""]
    sources = [r.choice(["b", "a", "a", "a", None, "c", "É"]) for _ in texts]
    df = docs(spark, texts, sources)
    rows = mix(df, shard_words=2000).collect()
    size = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    total, order = 1.5 * sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = total - sum(2 * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    got = {}
    for x in rows:
        s = sources[x.doc_id]
        assert x.size == len((texts[x.doc_id] or "").split()) and x.source_size == size[s] and abs(x.target - target[s]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        got[s] = got.get(s, 0) + x.taken
    assert all(abs(got[s] - target[s]) <= 60 + 0.02 * target[s] for s in order)
    assert sorted(map(tuple, mix(df, shard_words=2000).collect())) == sorted(map(tuple, rows))
    assert mix(df.limit(0)).count() == 0
    out = mixed_documents(df)
    assert out.columns == df.columns and abs(sum(len(x.text.split()) for x in out.collect()) - total) < 0.1 * total


# --- op10

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    want, mass = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        mass += w
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(forward_backward(e, np.arange(5), move), want / mass)


def test_language_of_words_and_edges(spark):
    r = random.Random(7)
    alphabets = {"xx": "abcde", "yy": "vwxyz"}
    say = lambda lang, n: " ".join("".join(r.choice(alphabets[lang]) for _ in range(4)) for _ in range(n))
    rows = [(i, say(lang, 30), lang, 1) for i, lang in enumerate(["xx", "yy"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = fit(df, rounds=10, sequences=200)
    asked = spark.createDataFrame([(1, say("xx", 50)), (2, say("yy", 1)), (3, None), (4, ""), (5, "12 -- !"), (6, say("xx", 30) + " " + say("yy", 10)), (1, say("xx", 50))], "doc_id long, text string")
    got = {(x.doc_id): (x.lang_pred, x.lang_score) for x in identify(asked, model).collect()}
    assert got[1][0] == "xx" and got[2][0] == "yy" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "xx" and 0.6 < got[6][1] < 0.9
    words = model.predict([say("xx", 3000) + " é " + "x" * 5000])
    assert words[0] == ["xx"]
    assert identify(asked.limit(0), model).count() == 0
    none = fit(df.limit(0))
    assert {x.lang_pred for x in identify(asked, none).collect()} == {"und"}
    one = fit(df.filter("lang = 'xx'"), rounds=2, sequences=20)
    assert {x.lang_pred for x in identify(asked.filter("doc_id in (1, 2)"), one).collect()} == {"xx"}
