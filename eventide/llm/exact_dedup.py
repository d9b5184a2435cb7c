"""Exact duplicates by immutable snapshots, each with static binary-fuse filters.

Rows come in batches. Within a batch equal texts are grouped by themselves: by digest and text, combined before the shuffle. The
distinct texts of a batch become a snapshot that never changes: its groups, and per bucket of digests a filter of about 1.13
bytes a text. Digests of a later batch meet the filters of all earlier snapshots first; what these exclude is new. What passes
joins the exact groups of the snapshot, where bytes decide; so neither a filter's false positives nor equal digests of different
texts can join two texts.

After the first pass only digests, ids and counts move; texts move once within their batch and again where two batches share a
digest. A bucket holds up to ``per_bucket`` digests, so filters are built and asked in tasks of bounded memory. A document finds
its group by digest. Groups of over a thousandth of all rows are at most a thousand and are broadcast, so no join key
holds more than that share.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle, ship
from eventide.llm.fuse_filter import FuseFilter
from eventide.plans.settle import settle_parts

SPACE = r"[\x20\x09-\x0D]+"
FILTER = "bucket long, seed int, segment int, starts long, prints binary"
HEAVY_ROWS, HEAVY_SHARE = 10_000, 1_000


@dataclass(frozen=True)
class Snapshot:
    """Distinct texts of a batch (gid, digest, text, least, n) and their filters, both written."""
    groups: DataFrame
    filters: DataFrame
    buckets: int


def normal(text: str | Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(blank_text(text) if isinstance(text, str) else text, SPACE, " ")


def _bucket(buckets: int) -> Column:
    return F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long") % buckets


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist()), np.uint64)


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    seed, segment, starts, prints = FuseFilter.build(_keys(rows["digest"])).to_row()
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([seed], pa.int32()), "segment": pa.array([segment], pa.int32()),
                     "starts": pa.array([starts], pa.int64()), "prints": pa.array([prints], pa.binary())})


def _ask(rows: pa.Table, filters: pa.Table) -> pa.Table:
    rows = rows.select(["gid", "digest"])
    if not filters.num_rows:
        return rows.slice(0, 0)
    f = FuseFilter.from_row(*(filters[c][0].as_py() for c in ("seed", "segment", "starts", "prints")))
    return rows.filter(pa.array(f.may_hold(_keys(rows["digest"]))))


def make_snapshot(groups: DataFrame, per_bucket: int = 250_000) -> Snapshot:
    """``groups``: written rows (gid, digest, text, ...), one per distinct text."""
    ship(groups.sparkSession)
    buckets = -(-groups.count() // per_bucket) or 1
    filters = groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInArrow(_build, FILTER)
    return Snapshot(groups, settle(filters, "filters"), buckets)


def screen(groups: DataFrame, snapshot: Snapshot, per_bucket: int = 250_000) -> DataFrame:
    """(gid, digest) of the groups whose digest may be in the snapshot; the others are certainly not.

    A batch much larger than the snapshot is asked in several parts a bucket, each with its copy of the bucket's filter.
    """
    parts = -(-groups.count() // (per_bucket * snapshot.buckets)) or 1
    asked = groups.select("gid", "digest", _bucket(snapshot.buckets).alias("bucket"), F.pmod(F.xxhash64("gid"), F.lit(parts)).alias("part"))
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return settle(asked.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInArrow(_ask, "gid long, digest binary"), "passed")


def confirm(groups: DataFrame, passed: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(gid, root): of the groups that passed, those whose text is byte for byte that of snapshot group ``root``."""
    mine = groups.join(passed.select("gid"), "gid").select("gid", "digest", F.col("text").cast("binary").alias("bytes"))
    theirs = snapshot.groups.join(passed.select("digest").distinct(), "digest", "left_semi")
    return mine.join(theirs.select(F.col("gid").alias("root"), "digest", F.col("text").cast("binary").alias("bytes")), ["digest", "bytes"]).select("gid", "root")


def exact_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", batches: int = 3,
                 per_bucket: int = 250_000, digest_bytes: int = 32) -> DataFrame:
    """``keep`` columns, then keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    Of equal normalised texts the row of least id is kept (nulls last; of equal ids one row). keep_id is its id, null if
    no row of the group has one. Null texts count as empty. An empty table gives an empty one; columns not in ``keep`` do not
    matter. ``batches``: rows are dealt to this many batches by a hash of their id; the result does not depend on it.
    ``digest_bytes``: length of the digest used for screening; the result does not depend on it either.
    """
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(batches)).cast("int").alias("batch"), normal(text).alias("text"))
    rows = settle(rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "rows").withColumn("digest", F.substring("sha", 1, digest_bytes))
    least = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = rows.groupBy("batch", "digest", "text").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("n")).withColumn("gid", F.col("least.row"))
    by_batch = settle_parts(groups, "batch", "groups")
    found, earlier = [], []
    for k in sorted(by_batch):
        found += [confirm(by_batch[k], screen(by_batch[k], s, per_bucket), s).withColumn("age", F.lit(a)) for a, s in enumerate(earlier)]
        if len(earlier) < len(by_batch) - 1:
            earlier.append(make_snapshot(by_batch[k], per_bucket))
    own = [g.select("gid", "digest", "least", "n") for g in by_batch.values()]
    if not own:
        return _result(rows, None, keep)
    every = reduce(DataFrame.unionByName, own)
    if found:
        links = settle(reduce(DataFrame.unionByName, found).groupBy("gid").agg(F.min(F.struct("age", "root"))["root"].alias("root")), "links")
        every = every.join(links, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    else:
        links, every = None, every.withColumn("root", F.col("gid"))
    sums = (F.min("least").alias("least"), F.sum("n").alias("n"))
    by_digest = settle(every.groupBy("digest").agg(F.min("root").alias("low"), F.max("root").alias("high"), *sums), "classes")
    mixed = by_digest.filter("low != high").select("digest")
    one = by_digest.filter("low = high and n > 1").select("digest", "least", "n")
    if mixed.isEmpty():
        return _result(rows, one, keep)
    # digests of several texts: rows find their group by the text itself
    mixed = settle(mixed, "mixed")
    classes = every.join(mixed, "digest").groupBy("root").agg(*sums)
    texts = reduce(DataFrame.unionByName, [g.select("gid", "digest", "text") for g in by_batch.values()]).join(mixed, "digest")
    texts = texts.join(every.select("gid", "root"), "gid").select("digest", "text", "root").distinct().join(classes, "root").drop("root")
    apart = rows.join(mixed, "digest", "left_semi").join(texts, ["digest", "text"])
    return _result(rows.join(mixed, "digest", "left_anti"), one, keep).unionByName(_named(apart, keep))


def _named(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The result's columns; rows without a group stand for themselves."""
    alone = F.col("n").isNull()
    return found.select("_row.*", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        (alone | (F.col("least.row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _result(rows: DataFrame, groups: DataFrame | None, keep: tuple[str, ...]) -> DataFrame:
    if groups is None:
        return _named(rows.withColumns({"n": F.lit(None).cast("long"), "least": F.struct(F.col("id"), F.col("row"))}), keep)
    rows = rows.drop("text")
    heavy_from = max(HEAVY_ROWS, rows.count() // HEAVY_SHARE)
    heavy = F.broadcast(groups.filter(F.col("n") > heavy_from))  # at most HEAVY_SHARE rows, as groups do not overlap
    light = groups.filter(F.col("n") <= heavy_from)
    return _named(rows.join(heavy, "digest"), keep).unionByName(_named(rows.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest", "left"), keep))


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The kept rows with all their columns. For options see ``exact_groups``."""
    columns = docs.columns
    out = exact_groups(docs.select(F.struct(*columns).alias("_doc"), F.col(options.pop("doc_id", "doc_id")).alias("doc_id"),
                                   F.col(options.pop("text", "text")).alias("text")), keep=("_doc",), **options)
    return out.filter("kept").select("_doc.*")
