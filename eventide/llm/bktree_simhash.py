"""SimHash near-duplicates linked through BK-trees.

Fingerprints are made once per document and counted per distinct value. A fingerprint of 64 bits is cut into six blocks; two
that differ in at most four bits agree on at least two whole blocks, so each fingerprint goes to the fifteen buckets named by
a pair of blocks and its bits there, and every link is met in some bucket. A bucket is cut into shards of at most about
``shard_size`` distinct fingerprints; each shard's BK-tree (children keyed by their distance to the parent) is sent the whole
bucket's fingerprints as probes, which follow only edges within the radius. Per shard only links that join two groups are
kept (a spanning forest), so a group of copies gives as many rows as it has members, not pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle, ship
from eventide.llm.components import components

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, bits), lowest first
SHINGLE = 4
RADIUS = 4


def fingerprint(text: str) -> int:
    """64 bits, set where over half of the shingles' hashes have them; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE, len(words))
    starts = (ends - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1:].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and fp (the 64 bits as a signed long). A null text is read as empty: fingerprint 0."""
    ship(docs.sparkSession)
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(made)], names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return docs.select(*keep, blank_text(text).alias("_text")).mapInArrow(run, schema)


class BKTree:
    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's place in the tree (an equal value's own place)."""
        here = 0
        while self.values:
            d = (value ^ self.values[here]).bit_count()
            if not d:
                return here
            below = self.children[here].get(d)
            if below is None:
                self.children[here][d] = len(self.values)
                break
            here = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int) -> list[int]:
        """Places of all values at most the radius away."""
        found, todo, r = [], [0] if self.values else [], self.radius
        while todo:
            here = todo.pop()
            d = (value ^ self.values[here]).bit_count()
            if d <= r:
                found.append(here)
            below = self.children[here]
            if len(below) > 2 * r + 1:
                todo += [below[k] for k in range(d - r, d + r + 1) if k in below]
            else:
                todo += [c for k, c in below.items() if abs(k - d) <= r]
        return found


def _joined(tree: BKTree, ids: list[int], probes: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between probes (id, value) and the tree's values."""
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    own = {i: k for k, i in enumerate(ids)}
    for i, value in probes:
        hits = tree.within(value)
        if i in own:
            first = top(own[i])
        elif hits:
            first = top(hits[0])
            yield i, ids[first]
        for h in hits:
            other = top(h)
            if other != first:
                yield ids[other], ids[first]
                root[other] = first


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = 4096) -> DataFrame:
    """(a, b): enough links between the ids of distinct fingerprints (node, fp) to connect all that are linked.

    Every pair at most ``radius`` bits apart is tested in each bucket that both share; radius 4 or less.
    """
    if radius > 4:
        raise ValueError("six blocks find every pair up to 4 differing bits")
    block = [F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1) for at, bits in BLOCKS]
    keys = [F.shiftleft(F.lit(k).cast("long"), 40) + F.shiftleft(block[i], 11) + block[j]
            for k, (i, j) in enumerate(combinations(range(6), 2))]
    rows = distinct.select("node", "fp", F.explode(F.array(*keys)).alias("bucket"))
    full = settle(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    rows = rows.join(full, "bucket").withColumn("shards", F.ceil(F.col("n") / shard_size).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    rows = rows.withColumn("own", own).select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "own", "node", "fp")
    rows = rows.withColumn("role", (F.col("own") != F.col("shard")).cast("int")).filter("role = 0 or own < shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            """(ids and values of a shard's tree) and its probes, in order, never more than a tree and a batch in memory."""
            for b in batches:
                c = [b.column(n).to_pylist() for n in ("bucket", "shard", "role", "node", "fp")]
                yield from zip(*c, strict=True)

        out: list[tuple[int, int]] = []
        key, tree, ids, members = None, None, [], []
        pending: list[tuple[int, int]] = []

        def flush():
            for i, v in members:
                if tree.add(v) == len(ids):
                    ids.append(i)
            out.extend(_joined(tree, ids, iter([*members, *pending])))

        for bucket, shard, role, node, fp in groups():
            if (bucket, shard) != key:
                if key is not None:
                    flush()
                key, tree, ids, members, pending = (bucket, shard), BKTree(radius), [], [], []
            value = fp & 0xFFFFFFFFFFFFFFFF
            if role == 0:
                members.append((node, value))
            else:
                pending.append((node, value))
                if len(pending) >= 4 * shard_size:
                    flush()
                    pending, members = [], members
                    tree, ids = BKTree(radius), []
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out.clear()
        if key is not None:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    ship(distinct.sparkSession)
    return (rows.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", "role")
            .select("bucket", "shard", "role", "node", "fp").mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links, its own included).

    Rows of null doc_id get a fingerprint and take part in linking without lending an id: their component is the least id of
    the others, null if there is none. Repeated rows are members like any other; an empty table gives an empty one.
    """
    prints = settle(fingerprints(docs, (doc_id,), text), "fingerprints")
    nodes = prints.filter(F.col(doc_id).isNotNull()).groupBy("fp").agg(F.min(F.col(doc_id).cast("long")).alias("node"))
    nodes = settle(nodes, "fingerprint-nodes")
    group = components(links(nodes, radius))
    named = nodes.join(group, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    nulls = prints.filter(F.col(doc_id).isNull())
    known = prints.filter(F.col(doc_id).isNotNull()).join(named, "fp")
    rest = nulls.join(named, "fp", "left")
    columns = [doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    return known.select(*columns).unionByName(rest.select(*columns))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: that of least id, rows without id after all others.

    Rows are told apart by id and text: texts under one id are documents of their own, rows equal in both are one document.
    Null and empty texts are equal and link with each other. An empty table gives an empty one.
    """
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(blank_text(text).cast("binary")))
    rows = docs.withColumn("_near_row", key)
    prints = settle(fingerprints(rows.select("_near_row", doc_id, text), ("_near_row", doc_id), text), "fingerprints")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("unnamed"), F.col(doc_id).alias("id"), "_near_row"))
    nodes = settle(prints.groupBy("fp").agg(first.alias("first")), "fingerprint-nodes")
    group = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    stays = nodes.join(group, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(
        F.min("first")["_near_row"].alias("_near_row"))
    return rows.join(stays, "_near_row", "left_semi").dropDuplicates(["_near_row"]).select(*docs.columns)
