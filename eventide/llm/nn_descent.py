"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from the best neighbours inside random blocks and is improved by joining neighbours of neighbours: every node
gathers its neighbours and those it is a neighbour of, scores the pairs among them of which one is new, and sends each side
its best. Lists keep the ``degree`` nearest. Rounds go on until few entries of the lists change.

Queries walk the graph together, one Spark round per step, from their own node and from the nearest ones in a few random
blocks: each keeps its ``beam`` nearest nodes so far and expands those not
expanded yet, until none is left. The beam grows with the logarithm of the nodes. Exact copies of a vector are one node that names its smallest ids, so copies neither fill
lists nor crowd a task. Every task's groups are bounded: a block, a node's list, a query's beam.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import settle, ship
from eventide.llm.vectors import doubles, usable


def _best(rows: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def make_nodes(vectors: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """node (least id of equal vectors), v (doubles), norm, and ids: the k + 1 smallest ids of the copies."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), doubles(vector).alias("v")).filter(usable("v") & F.col("id").isNotNull()).distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    nodes = first.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"))
    return nodes.select("node", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), "ids")


def _unit(values: pa.Array) -> np.ndarray:
    x = np.stack(values.to_numpy(zero_copy_only=False))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _start(nodes: DataFrame, degree: int, block: int, seed: int) -> DataFrame:
    """(a, b, score): the best neighbours within random blocks of about ``block`` nodes."""
    blocks = nodes.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("long")).first()[0]

    def run(t):
        ids, x = t.column("node").to_numpy(), _unit(t.column("v").combine_chunks())
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, len(ids) - 1)
        at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
        return pa.table({"a": np.repeat(ids, k), "b": ids[at.ravel()], "score": np.take_along_axis(s, at, 1).ravel().astype(np.float64)})

    return nodes.select("node", "v", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(
        run, "a long, b long, score double")


def _neighbours_of_neighbours(graph: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """(a, b, score) candidates: pairs met in some node's neighbourhood, better than the worse end of a's list."""
    back = graph.select(F.col("b").alias("hub"), F.col("a").alias("member"), "score", "fresh")
    back = _best(back, "hub", "score", "member", degree).select("hub", "member", "fresh")
    ahead = graph.select(F.col("a").alias("hub"), F.col("b").alias("member"), "fresh")
    around = ahead.unionByName(back).groupBy("hub", "member").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(F.lit(-2.0)).alias("worst"))
    known = nodes.join(worst, nodes["node"] == worst["a"], "left").select(
        F.col("node").alias("member"), F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("v"), F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    rows = around.join(known, "member").select("hub", "member", "fresh", "worst", "v")

    def pairs(ids, fresh, worst, x):
        s = x @ x.T
        s[~(fresh[:, None] | fresh[None, :])] = -3
        np.fill_diagonal(s, -3)
        i, j = np.nonzero(s > worst[:, None])  # all of them: a pair left out now is not met again
        return ids[i], ids[j], s[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            hub = held.column("hub").to_numpy()
            last = int(np.searchsorted(hub, hub[-1], "left"))
            if last:  # the last hub may go on in the next batch
                yield from emit(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from emit(held)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hub, ids = t.column("hub").to_numpy(), t.column("member").to_numpy()
        fresh, worst = t.column("fresh").to_numpy(zero_copy_only=False).astype(bool), t.column("worst").to_numpy()
        v = t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        cuts = [0, *(np.flatnonzero(np.diff(hub)) + 1).tolist(), len(ids)]
        out = [pairs(ids[s:e], fresh[s:e], worst[s:e], x[s:e]) for s, e in zip(cuts, cuts[1:]) if e - s > 1 and fresh[s:e].any()]
        if out:
            a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float64))], ["a", "b", "score"])

    return rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, "a long, b long, score double")


def build_graph(nodes: DataFrame, degree: int = 30, block: int = 512, settled: float = 0.01, seed: int = 11) -> DataFrame:
    """(a, b, score, fresh): each node's nearest nodes found. All vectors of ``nodes`` have one dimension.

    Every new entry raises a list's scores, so the rounds end by themselves.
    """
    ship(nodes.sparkSession)
    start = _best(_start(nodes, degree, block, seed).unionByName(_start(nodes, degree, block, seed + 1)).groupBy("a", "b").agg(
        F.max("score").alias("score")), "a", "score", "b", degree)
    graph = settle(start.withColumn("fresh", F.lit(True)), "graph")
    while True:
        found = _neighbours_of_neighbours(graph, nodes, degree).withColumn("fresh", F.lit(True))
        merged = graph.withColumn("fresh", F.lit(False)).unionByName(found).groupBy("a", "b").agg(
            F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        graph = settle(_best(merged, "a", "score", "b", degree), "graph")
        changed, all_ = graph.agg(F.sum(F.col("fresh").cast("long")), F.count(F.lit(1))).first()
        if not all_ or changed <= settled * all_:
            return graph


def _cosine(v: Column, w: Column, norms: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / norms


def suited_beam(nodes: int) -> int:
    """Beam of a search among so many nodes: 16 a doubling, 128 at least."""
    return max(128, 16 * nodes.bit_length())


def block_starts(queries: DataFrame, nodes: DataFrame, rows: int, starts: int = 4, block: int = 512, best: int = 4, seed: int = 17) -> DataFrame:
    """(q, node): the ``best`` nodes of each of ``starts`` random blocks of about ``block`` nodes (of ``rows``), for each of ``queries`` (q, v)."""
    blocks = max(1, -(-rows // block))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        s = _unit(asked.column("v").combine_chunks()) @ _unit(there.column("v").combine_chunks()).T
        k = min(best, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pa.table({"q": np.repeat(asked.column("q").to_numpy(), k), "node": there.column("node").to_numpy()[at.ravel()]})

    asked = queries.select("q", "v", F.explode(F.array(*(F.pmod(F.xxhash64("q", F.lit(seed + i)), F.lit(blocks)) for i in range(starts)))).alias("block"))
    there = nodes.select("node", "v", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(blocks)).alias("block"))
    return asked.groupBy("block").cogroup(there.groupBy("block")).applyInArrow(run, "q long, node long").distinct()


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, beam: int | None = None, degree: int = 30) -> DataFrame:
    """(q, node, score): the beam of each query. ``queries``: q, v, norm and start, a node at which it begins besides those of ``block_starts``.

    Walks follow a node's list and the nearest ``degree`` of those that list it.
    """
    targets = nodes.select("node", F.col("v").alias("w"), F.col("norm").alias("node_norm"))
    asked = queries.select("q", "v", "norm")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(targets, "node").join(asked, "q").select(
            "q", "node", _cosine(F.col("v"), F.col("w"), F.col("norm") * F.col("node_norm")).alias("score"))

    ahead = graph.select(F.col("a").alias("node"), F.col("b").alias("next"))
    back = _best(graph.select(F.col("b").alias("node"), F.col("a").alias("next"), "score"), "node", "score", "next", degree).select("node", "next")
    links = settle(ahead.unionByName(back).distinct(), "walks")
    rows = nodes.count()
    beam = beam or suited_beam(rows)
    begin = queries.select("q", F.col("start").alias("node")).unionByName(block_starts(queries, nodes, rows)).distinct()
    state = settle(scored(begin).withColumn("open", F.lit(True)), "beam")
    while True:
        met = state.filter("open").join(links, "node").select("q", F.col("next").alias("node")).distinct()
        met = met.join(state.select("q", "node"), ["q", "node"], "left_anti")
        both = state.withColumn("open", F.lit(False)).unionByName(scored(met).withColumn("open", F.lit(True)))
        state = settle(_best(both, "q", "score", "node", beam), "beam")
        if state.filter("open").isEmpty():
            return state.select("q", "node", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", degree: int = 30,
            beam: int | None = None, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, itself excluded.

    Rows whose vector is null, zero or not finite, or whose id is null, neither ask nor answer. Repeated rows of an id are one.
    Ties go to the smaller id. Each vector dimension is searched by itself.
    """
    nodes = settle(make_nodes(vectors, k, vec_id, vector).withColumn("dims", F.size("v")), "nodes")
    asked = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("q"), doubles(vector).alias("v")).filter(
        usable("v") & F.col("q").isNotNull()).distinct()
    asked = settle(asked.join(nodes.select("v", "norm", "dims", F.col("node").alias("start")), "v"), "queries")
    found = None
    for (dims,) in nodes.select("dims").distinct().collect():  # one row per model that made vectors
        own = nodes.filter(F.col("dims") == dims)
        graph = build_graph(own, degree=degree, **options)
        part = search(asked.filter(F.col("dims") == dims), graph, own, beam, degree).join(own.select("node", "ids"), "node")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {vec_id} long, score double")
    rows = found.select("q", "score", F.explode("ids").alias("id")).filter("id != q")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias(vec_id), "score")
