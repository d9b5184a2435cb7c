"""Target encodings against a plain computation on random tables; backoff and codes."""
import random
from statistics import fmean, median

import pytest

from eventide.operators import backoff
from eventide.operators.backoff import fit_backoff, predict_backoff
from eventide.operators.codes import attach_codes, code_dimension, code_sizes
from eventide.operators.encoding import CAP, SMOOTHING, Spec, cross_fit, encode_split, fit_maps, transform
from eventide.plans.settle import settle

PAIR, TRIPLE = Spec("e2", ("g", "h")), Spec("e3", ("g", "h", "k"))
SPECS = (PAIR, TRIPLE)


def random_rows(seed, n=160, blocks=4):
    """(id, block, g, h, k, y): skewed groups, null keys and null targets, some values over the cap."""
    r = random.Random(seed)
    pick = lambda names: r.choice(names[: 1 + int(len(names) * r.random() ** 2)])
    return [(i, r.randrange(blocks), pick(["north", "south", "west"]), r.choice([pick(["p", "q", "r", "s"]), None, "p"]), r.randrange(3),
             r.choice([None, r.randint(50, 2000), r.randint(50, 2000), r.randint(3000, 90_000)])) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, block int, g string, h string, k int, y int")


def plain(source, keys):
    """The encoding of one key tuple from the given rows: (value, support), None for a group that they lack."""
    y = lambda r: min(float(r[5]), CAP)
    of = lambda rows: [y(r) for r in rows if r[5] is not None]
    group = [r for r in source if tuple(r[2:2 + len(keys)]) == keys]
    if not group or None in keys:
        return None, None
    parent = [r for r in source if r[2] == keys[0]]
    grand = fmean(of(source))
    prior = (sum(of(parent)) + SMOOTHING * grand) / (len(parent) + SMOOTHING)
    return (sum(of(group)) + SMOOTHING * prior) / (len(group) + SMOOTHING), len(group)


def check(got, rows, source_of):
    seen = {r["id"]: r for r in got.collect()}
    assert set(seen) == {r[0] for r in rows}
    for r in rows:
        for spec in SPECS:
            value, support = plain(source_of(r), tuple(r[2:2 + len(spec.keys)]))
            assert seen[r[0]][f"{spec.name}_count"] == support
            assert seen[r[0]][spec.name] == (None if value is None else pytest.approx(value, rel=1e-12))


@pytest.mark.parametrize("seed", [11, 12])
def test_each_row_is_encoded_from_the_other_blocks(spark, seed):
    rows = random_rows(seed)
    got = cross_fit(table(spark, rows), "block", SPECS, target="y")
    check(got, rows, lambda r: [x for x in rows if x[1] != r[1]])


def test_other_tables_are_encoded_from_all_rows(spark):
    rows, asked = random_rows(21), random_rows(22, 60)
    fit, (out,) = encode_split(table(spark, rows), [table(spark, asked)], "block", SPECS, target="y")
    check(out, asked, lambda r: rows)
    check(fit, rows, lambda r: [x for x in rows if x[1] != r[1]])
    check(transform(table(spark, asked), fit_maps(table(spark, rows), SPECS, target="y")), asked, lambda r: rows)


def test_own_block_has_no_influence(spark):
    rows = random_rows(31)
    moved = [(*r[:5], None if r[5] is None else r[5] % 977 + 7) if r[1] == 2 else r for r in rows]
    values = [{r["id"]: (r["e2"], r["e3"]) for r in cross_fit(table(spark, x), "block", SPECS, target="y").filter("block = 2").collect()} for x in (rows, moved)]
    assert values[0] == values[1] and len(values[0]) > 10


def test_one_block_is_refused(spark):
    with pytest.raises(ValueError, match="no other rows"):
        cross_fit(table(spark, random_rows(41, 9, blocks=1)), "block", SPECS, target="y")


def test_backoff_support_and_null_keys(spark):
    levels = (("a", "b"), ("a",))
    rows = [("x", "p", i) for i in range(29)] + [("x", "q", 1000 + i) for i in range(30)] + [("y", "p", 5)] * 3
    train = spark.createDataFrame(rows, "a string, b string, y int")
    table = fit_backoff(train, levels, "y")
    assert table.filter("level = 0").count() == 1 and table.filter("level = 1").count() == 1
    ask = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "x", None), (4, "y", "p"), (5, None, "q")], "id int, a string, b string")
    got = {r["id"]: r["pred"] for r in predict_backoff(ask, table, levels).collect()}
    ys = sorted(r[2] for r in rows)
    xs = sorted(r[2] for r in rows if r[0] == "x")
    mid = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert got == {1: mid(xs), 2: 1014.5, 3: mid(xs), 4: mid(ys), 5: mid(ys)}


def test_backoff_counts_a_row_of_many_folds_once(spark, monkeypatch):
    levels = (("a", "b"), ("a",))
    rows = [(m % 7, ("x", "y", None)[m % 3], ("p", "q", None, "r")[m * m % 4], m * m % 11, 1 + m % 3) for m in range(400)]
    train = spark.createDataFrame(rows, "month int, a string, b string, y int, w long")
    made = []
    monkeypatch.setattr(backoff, "settle", lambda df, label: made.append(settle(df, label)) or made[-1])
    months = {"early": (0, 1, 2), "late": (2, 3, 4, 5, 6), "none": (9,)}
    table = fit_backoff(train, levels, "y", min_support=1, folds=("fold", {f: f"if(month in {(*m, -1)}, w, 0L)" for f, m in months.items()}))
    want = {}
    for f, mine in months.items():
        for m, a, b, y, w in rows:
            for level, known in ((0, a is not None and b is not None), (1, a is not None), (2, True)):
                if m in mine and known:
                    want.setdefault((f, level, a if level < 2 else None, b if level < 1 else None), []).extend([y] * w)
    got = {(r.fold, r.level, r.k_a, r.k_b): (r.median, r.support) for r in table.collect()}
    assert got == {k: (median(v), len(v)) for k, v in want.items()}
    values = {(level, a if level < 2 else None, b if level < 1 else None, y) for _, a, b, y, _ in rows
              for level in range(3) if (level > 1 or a is not None) and (level > 0 or b is not None)}
    assert made[0].count() == len(values)


def test_codes_are_ranks_over_both_tables(spark):
    a = spark.createDataFrame([("b", "x1"), ("a", None), ("é", "x10")], "c string, d string")
    b = spark.createDataFrame([("c", "x2"), ("b", "x1")], "c string, d string")
    dim = code_dimension([a, b], ["c", "d"])
    codes = {(r["column"], r["value"]): r["code"] for r in dim.collect()}
    assert codes == {("c", "a"): 0, ("c", "b"): 1, ("c", "c"): 2, ("c", "é"): 3, ("d", "x1"): 0, ("d", "x10"): 1, ("d", "x2"): 2}
    assert {r["column"]: r["categories"] for r in code_sizes(dim).collect()} == {"c": 4, "d": 3}
    out = sorted((r["c"], r["d"] is None) for r in attach_codes(a, dim, ["c", "d"]).collect())
    assert out == [(0, True), (1, False), (3, False)]


def test_settled_parts_have_their_own_size(spark):
    from pyspark.sql import functions as F

    from eventide.plans.settle import settle_parts
    big = spark.range(200_000).select(F.lit(0).alias("spec"), F.col("id").alias("v"))
    parts = settle_parts(big.unionByName(spark.range(3).select(F.lit(1).alias("spec"), F.col("id").alias("v"))), "spec")
    sizes = {k: int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for k, d in parts.items()}
    assert sizes[1] < 20_000 < sizes[0] and sorted(r[0] for r in parts[1].collect()) == [0, 1, 2] and 2 not in parts
