"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors of a group (label and dimension) are cut into tiles of about ``tile`` rows; each pair of tiles is one task. Unit
vectors u are quantised as s * q with q in -127..127, and e = |u - s q| is measured. For two vectors

    |u.v - s_u s_v q_u.q_v| <= e_u |v| + |s_u q_u| e_v,

so a pair whose quantised product plus that bound stays under the threshold cannot reach it; the others are computed again in
double precision. Integer products are exact in single precision (up to 1,024 components at a time).

Exact copies are one node with a weight. A task returns a row per node with links (their weight, and the least node that it
reaches inside the task), never pairs. Work grows with the square of a group's distinct vectors, as tile products do; memory
and rows do not.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import settle, ship
from eventide.llm.components import components
from eventide.llm.vectors import doubles, usable

SLACK = 1e-9  # over the rounding of the double-precision sums
EXACT_DIMS = 1024  # 1024 * 127 * 127 < 2 ** 24


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, their int8 codes, scales, quantisation errors and the lengths of the quantised rows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return unit, codes, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    out = 0.0
    for d in range(0, a.shape[1], EXACT_DIMS):
        out = out + (a[:, d:d + EXACT_DIMS].astype(np.float32) @ b[:, d:d + EXACT_DIMS].astype(np.float32).T).astype(np.float64)
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; y None: pairs i < j of x."""
    ux, qx, sx, ex, lx = quantised(x)
    uy, qy, sy, ey, _ = (ux, qx, sx, ex, lx) if y is None else quantised(y)
    left, right = [], []
    for at in range(0, len(ux), rows):
        part = slice(at, at + rows)
        most = product(qx[part], qy) * sx[part, None] * sy[None, :] + ex[part, None] + lx[part, None] * ey[None, :] + SLACK
        i, j = np.nonzero(most >= threshold)
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65_536):
            a, b = i[k:k + 65_536], j[k:k + 65_536]
            hit = np.einsum("ij,ij->i", ux[a], uy[b]) >= threshold
            left.append(a[hit])
            right.append(b[hit])
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that it reaches over the pairs."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows whose vector, label or id is null, or whose vector is zero or not finite, link with nothing: 0 links, their own id.
    Vectors of different dimension never link. Repeated rows count as vectors of their own. ``kept`` is true for the rows of
    the component's least id.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"), doubles(vector).alias("_v"), F.col(label).alias("_label"))
    sound = rows.filter(usable("_v") & F.col("_label").isNotNull() & F.col("_id").isNotNull())
    nodes = settle(sound.groupBy("_label", "_v").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vector-nodes")
    nodes = nodes.withColumn("dims", F.size("_v"))
    groups = settle(nodes.groupBy("_label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "vector-groups")
    placed = nodes.join(groups, ["_label", "dims"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "_label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "_v")

    def run(key, t):
        i, j = key[2].as_py(), key[3].as_py()
        dims = key[1].as_py()
        own = t.column("own").to_numpy()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        v = t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        if i == j:
            a, b = tile_links(v, None, threshold)
        else:
            first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if len(first) and len(second):
                a, b = tile_links(v[first], v[second], threshold)
                a, b = first[a], second[b]
            else:
                a = b = np.zeros(0, np.int64)
        weight = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        order = np.argsort(node, kind="stable")
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        least = node[order][_least_reached(len(node), place[a], place[b])][place]
        hit = weight > 0
        return pa.table({"node": node[hit], "weight": weight[hit].astype(np.int64), "least": least[hit]})

    ship(vectors.sparkSession)
    linked = settle(sent.groupBy("_label", "dims", "i", "j").applyInArrow(run, "node long, weight long, least long"), "vector-links")
    weights = linked.groupBy("node").agg(F.sum("weight").alias("weight"))
    group = components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = nodes.join(weights, "node", "left").join(group, "node", "left").select(
        "_label", "_v", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = sound.join(named, ["_label", "_v"]).select("_id", "n_links", "component_id")
    rest = rows.filter(~(usable("_v") & F.col("_label").isNotNull() & F.col("_id").isNotNull())).select(
        "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return good.unionByName(rest).select(
        F.col("_id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
