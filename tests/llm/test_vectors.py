"""op2 and op8 against brute force, and their edge cases."""
import numpy as np
from pyspark.sql import functions as F

from eventide.llm.int8_tiles import near_vectors, product, quantised, tile_links
from eventide.llm.nn_descent import _neighbours_of_neighbours, block_starts, make_nodes, nearest, suited_beam


def clustered(n=400, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, dims))
    x = np.concatenate([centers + rng.normal(size=centers.shape) * s for s in (0, 0.02, 0.08, 0.12, 0.15, 0.3, 1, 1)])
    return np.concatenate([x, x[:7], x[:3] * 2.5])


def frame(spark, x, labels, first=0):
    return spark.createDataFrame([(first + i, [float(f) for f in v], label) for i, (v, label) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")


def odd_rows(spark):
    return spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] + [1.0] * 23, 1), (9005, [float("inf")] * 24, 1), (9006, [], 1),
                                  (9007, [1.0, 0.0], 1), (9008, [1.0] * 24, None), (9009, [1.0] * 24, None)], "vec_id long, embedding array<double>, label int")


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 1500)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    unit, codes, scale, error, length = quantised(x)
    exact = unit @ unit.T
    close = product(codes, codes) * scale[:, None] * scale[None, :]
    assert (np.abs(exact - close) <= error[:, None] + length[:, None] * error[None, :] + 1e-9).all()
    a, b = tile_links(clustered(), None, 0.98, rows=37)
    u = clustered() / np.linalg.norm(clustered(), axis=1, keepdims=True)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98), strict=True) if i < j}


def test_links_and_components(spark):
    x = clustered()
    labels = [i % 2 for i in range(len(x))]
    df = frame(spark, x, labels).unionByName(odd_rows(spark)).withColumn("node", F.lit("extra"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    top = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(top[i], *top[link[i]]) if link[i].any() else top[i] for i in range(len(x))])
        if (new == top).all():
            break
        top = new
    for tile in (2048, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, tile=tile).collect()}
        assert [got[i] for i in range(len(x))] == [(int(link[i].sum()), int(top[i]), top[i] == i) for i in range(len(x))]
        assert all(got[i] == (0, i, True) for i in range(9001, 9010))
    assert near_vectors(df.limit(0)).count() == 0
    twice = frame(spark, x[:1], [1]).unionByName(frame(spark, x[:1], [1]))
    assert [(r.n_links, r.component_id, r.kept) for r in near_vectors(twice).collect()] == [(1, 0, True)] * 2


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 16)), clustered(200, 16, 2)])
    df = frame(spark, x, [1] * len(x)).unionByName(odd_rows(spark).filter("vec_id != 9007")).withColumn("score", F.lit("extra"))
    rows = nearest(df, F.col("vec_id") % 50 == 0, degree=12, beam=40, block=128).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit, asked = 0, range(0, len(x), 50)
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    good = {r.query_id for r in rows}
    assert set(asked) <= good and all(q < 9000 or q in (9008, 9009) for q in good)
    v = np.concatenate([u, np.full((2, 16), 0.25)])  # the two rows without a label are vectors of 24 components
    for q in asked:
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:5]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in got)
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(got, got[1:]))
        hit += len(set(want) & {r.vec_id for r in got})
    assert hit / (5 * len(asked)) >= 0.9 and len(v)
    small = nearest(frame(spark, x[:3], [1] * 3), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in small) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(frame(spark, x[:1], [1]), F.lit(True)).count() == 0
    copies = nearest(frame(spark, np.tile(x[:1], (9, 1)), [1] * 9), F.col("vec_id") == 4).collect()
    assert [r.vec_id for r in sorted(copies, key=lambda r: r["rank"])] == [0, 1, 2, 3, 5]


def test_all_pairs_of_a_hub_are_met(spark):
    """Node 0 lists 30 others, whose lists are short: each of them meets all the others."""
    x = np.random.default_rng(5).normal(size=(1200, 12))
    nodes = make_nodes(frame(spark, x, [1] * len(x)), 5).persist()
    graph = spark.createDataFrame([(0, b, 0.5, True) for b in range(1, 31)], "a long, b long, score double, fresh boolean")
    got = {(r.a, r.b) for r in _neighbours_of_neighbours(graph, nodes, 30).collect()}
    assert {(a, b) for a in range(1, 31) for b in range(1, 31) if a != b} <= got
    starts = block_starts(nodes.limit(40).selectExpr("node q", "v"), nodes, 1200, block=100)
    by = starts.groupBy("q").count().collect()
    assert len(by) == 40 and all(4 <= r["count"] <= 16 for r in by)
    assert suited_beam(0) == 128 and suited_beam(10 ** 4) < suited_beam(10 ** 6) < suited_beam(10 ** 9)
