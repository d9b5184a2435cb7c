"""Exact removal of long repeats with an enhanced suffix array, cut up by content-chosen anchors.

A string of ``least`` bytes contains ``least - K + 1`` strings of K bytes; the one of least hash is its anchor. Equal strings
have equal anchors at equal places, so suffixes need to be compared only among the anchors of one K-byte string, each with
``least - K`` bytes on both sides (its context). Contexts that occur more than once repeat as a whole and are settled by
counting. The others of a group are sorted as suffixes; a stack scan over the common-prefix lengths closes each interval of
the prefix tree bottom-up. When two parts of an interval meet, their members are merged in order of what stands to their left,
small into large, and left neighbours that came from different parts are compared: where left and right extension together
reach ``least``, both occurrences are part of a maximal repeat. Left diversity is thus tested for all occurrences of an
interval, not only for neighbours in suffix order.

Groups of more than ``most`` different contexts are not sorted in one task: their windows are hashed and counted instead,
which gives the same bytes. Nothing grows with the square of a group.
"""
from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle, ship

K = 100
SEGMENT = 1 << 20
#: Kept bytes that a task gathers before it sends them on.
SENT_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


class Anchors:
    """Anchor places of a byte string, by rolling hashes over all its K-byte strings."""

    def __init__(self, least: int):
        self.least, self.width = least, least - K + 1
        n = SEGMENT + least
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(BASE))]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]), dtype=np.uint64)
        self.letters = np.random.default_rng(0).integers(1, 1 << 63, 256, dtype=np.uint64)

    def of(self, b: np.ndarray) -> np.ndarray:
        parts = [self._segment(b[at:at + SEGMENT + self.least - 1]) + at for at in range(0, max(1, len(b) - self.least + 1), SEGMENT)]
        return np.unique(np.concatenate(parts))

    def _segment(self, b: np.ndarray) -> np.ndarray:
        if len(b) < self.least:
            return np.zeros(0, dtype=np.int64)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.letters[b] * self.power[:len(b)], out=total[1:])
        h = (total[K:] - total[:-K]) * self.back[:len(b) - K + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        # the hash's upper bits, then the place: the leftmost of equal hashes wins
        h = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)
        width, span = self.width, 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < width:
            h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
        place = h & np.uint64((1 << 22) - 1)
        return np.unique(place[np.concatenate([[True], place[1:] != place[:-1]])]).astype(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeats(members: list[tuple[bytes, bytes]], least: int) -> list[tuple[int, int]]:
    """For each member (reversed bytes to its left, bytes from it on) how far repeats of ``least`` or more bytes reach.

    (left, right): the union of [-left, right) over all repeats around the member that another member shares; (0, 0): none.
    """
    n = len(members)
    order = sorted(range(n), key=lambda i: members[i][1])
    by_left = sorted(range(n), key=lambda i: members[i][0])
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    reach = [(0, 0)] * n
    stack: list[tuple[list[int], int]] = []

    def close() -> None:
        part, depth = stack.pop()
        whole, above = stack.pop()
        if len(part) > len(whole):
            part, whole = whole, part
        for r in part:
            i = by_left[r]
            at = bisect(whole, r)
            for other in whole[max(0, at - 1):at + 1]:
                j = by_left[other]
                left = common(members[i][0], members[j][0])
                if left + depth >= least:
                    reach[i] = max(reach[i][0], left), max(reach[i][1], depth)
                    reach[j] = max(reach[j][0], left), max(reach[j][1], depth)
            whole.insert(at, r)
        stack.append((whole, above))

    for k, i in enumerate(order):
        depth = common(members[order[k - 1]][1], members[i][1]) if k else 0
        while len(stack) > 1 and stack[-1][1] > depth:
            close()
        stack.append(([rank[i]], depth))
    while len(stack) > 1 and stack[-1][1] >= K:
        close()
    return reach


def _row_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text and _key, equal for rows of equal id and text only."""
    return docs.select(F.col(doc_id).alias("_id"), blank_text(text).cast("binary").alias("_text")).withColumn(
        "_key", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text"))


def _anchors(rows: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, digest = Anchors(least), xxhash.xxh3_64_intdigest
        side = least - K
        for b in batches:
            keys, places, grams, contexts = [], [], [], []
            for key, t in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                raw = t.as_py()
                at = find.of(np.frombuffer(raw, dtype=np.uint8))
                keys.append(np.full(len(at), key, dtype=np.int64))
                places.append(at.astype(np.int32))
                for a in at.tolist():
                    grams.append(digest(raw[a:a + K]))
                    contexts.append(digest(raw[max(0, a - side):a + least], min(a, side)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*places, np.zeros(0, np.int32)])),
                pa.array(np.array(grams, dtype=np.uint64).view(np.int64)), pa.array(np.array(contexts, dtype=np.uint64).view(np.int64))],
                ["_key", "place", "gram", "context"])

    return rows.select("_key", "_text").mapInArrow(run, "_key long, place int, gram long, context long")


def _with_bytes(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """gram, n, _key, place, left (reversed) and right bytes of the wanted contexts."""
    side = least - K
    asked = wanted.groupBy("_key").agg(F.collect_list(F.struct("gram", "n", "place")).alias("asked"))  # a document's own anchors
    met = rows.select("_key", "_text").dropDuplicates(["_key"]).join(asked, "_key")
    one = F.explode("asked").alias("x")
    start = F.greatest(F.col("x.place") - side, F.lit(0))
    return met.select("_key", "_text", one).select(
        "x.gram", "x.n", "_key", "x.place", F.substring("_text", start + 1, F.col("x.place") - start).alias("left"),
        F.substring("_text", F.col("x.place") + 1, F.lit(least)).alias("right"))


def _reaches(found: DataFrame, least: int) -> DataFrame:
    """_key, start, stop of what repeats around each context that occurs once, group by group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        out: list[tuple[int, int, int]] = []

        def flush() -> None:
            if len(group) > 1:
                for (_, n, key, place, _, _), (left, right) in zip(group, repeats([(g[4][::-1], g[5]) for g in group], least), strict=True):
                    if n == 1 and right:
                        out.append((key, place - left, place + right))
            group.clear()

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if group and row[0] != group[0][0]:
                    flush()
                group.append(row)
            if len(out) > 20_000:
                yield batch(out)
                out.clear()
        flush()
        yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()),
                                           pa.array([x[2] for x in out], pa.int32())], ["_key", "start", "stop"])

    return found.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "_key long, start int, stop int")


def _counted_windows(found: DataFrame, least: int) -> DataFrame:
    """The same bytes for groups of any size: hash every window of every context and count equal ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, key, place, left, right in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                whole = left + right
                starts = range(len(whole) - least + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(whole[s:s + least]) for s in starts], pa.binary()), pa.array([n] * len(starts), pa.int64()),
                    pa.array([key] * len(starts), pa.int64()), pa.array([place - len(left) + s for s in starts], pa.int32())],
                    ["window", "n", "_key", "start"])

    windows = found.mapInArrow(run, "window binary, n long, _key long, start int").groupBy("window", "_key", "start").agg(F.max("n").alias("n"))
    again = windows.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1")
    return windows.join(again, "window").select("_key", "start", (F.col("start") + least).alias("stop"))


def repeated_ranges(rows: DataFrame, least: int, most: int = 20_000) -> DataFrame:
    """_key, places (anchors whose whole context repeats) and ranges (start, stop): what is covered, by document."""
    anchors = settle(_anchors(rows, least), "anchors")
    contexts = settle(anchors.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "place")).alias("first")), "contexts")
    mixed = settle(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("fewest")).filter("g > 1 and fewest = 1").select("gram", "g"), "mixed")
    wanted = contexts.join(mixed, "gram").select("gram", "g", "n", "first._key", "first.place")
    bytes_of = [_with_bytes(rows, wanted.filter(F.col("g") <= most), least)]
    ranges = _reaches(bytes_of[0], least)
    if not mixed.filter(F.col("g") > most).isEmpty():
        ranges = ranges.unionByName(_counted_windows(_with_bytes(rows, wanted.filter(F.col("g") > most), least), least))
    whole = anchors.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"]).select(
        "_key", F.col("place").alias("start"), F.lit(-1).alias("stop"))
    return whole.unionByName(ranges).groupBy("_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def covered(raw: bytes, ranges: list[tuple[int, int]], least: int) -> np.ndarray:
    """A mask of the bytes in the ranges; a stop of -1 stands for an anchor's whole context."""
    edges = np.zeros(len(raw) + 1, dtype=np.int32)
    for start, stop in ranges:
        if stop < 0:
            start, stop = max(0, start - (least - K)), min(len(raw), start + least)
        if stop - start >= least:
            edges[start] += 1
            edges[stop] -= 1
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, least: int = 400, doc_id: str = "doc_id", text: str = "text", most: int = 20_000,
                   with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if ``with_text``.

    Every byte of a ``least``-byte string that also starts anywhere else, in any document or the same one, is removed. Null
    texts are empty; repeated rows are occurrences of each other; rows may share an id. Cuts fall between bytes, so the
    kept bytes may hold a part of a character.
    """
    if least <= K:
        raise ValueError(f"least must be over {K}")
    spark = docs.sparkSession
    ship(spark)
    rows = _row_key(docs, doc_id, text)
    ranges = settle(repeated_ranges(rows, least, most), "ranges")
    met = rows.join(ranges, "_key", "left").select("_id", "_text", "ranges")
    names = [doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def batch(ids: list, made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([m[k] for m in made], kinds[k]) for k in range(len(names) - 1))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, made, held = [], [], 0
            for i, t, r in zip(*b.columns, strict=True):
                raw = t.as_py()
                mask = covered(raw, [(x["start"], x["stop"]) for x in r.as_py() or ()], least)
                kept = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes() if mask.any() else raw
                row = (len(raw), len(raw) - len(kept), int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
                ids.append(i.as_py())
                made.append((*row, kept))
                held += len(kept)
                if held > SENT_BYTES:
                    yield batch(ids, made, b.column(0).type)
                    ids, made, held = [], [], 0
            yield batch(ids, made, b.column(0).type)

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return met.mapInArrow(run, schema)
