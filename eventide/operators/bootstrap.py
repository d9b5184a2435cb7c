"""Paired Poisson bootstrap.

Resampling n of n rows gives each row a count that is close to Poisson(1) and independent of the
others, so every row draws its own count per replicate from a hash of its id. Nothing is
shuffled but one partial sum per task and replicate, and a lost task redraws the same counts.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

REPLICATES = 2000
_DRAWS = 4  # an md5 holds four draws of eight hex digits
_BLOCK = 250_000  # counts a task holds at a time: about 10 MB with their digests


def poisson_steps() -> list[str]:
    """Upper ends of the counts 0, 1, 2, .. as eight hex digits, until the distribution is full."""
    steps, p, total = [], math.exp(-1), 0.0
    k = 0
    while True:
        total += p
        edge = math.floor(total * 2**32)
        if edge >= 2**32 - 1 or (steps and format(edge, "08x") == steps[-1]):
            return steps
        steps.append(format(edge, "08x"))
        k += 1
        p /= k


def poisson_count(digits: str) -> str:
    """SQL text: Poisson(1) count of an eight-digit lower-case hex draw; hex text sorts like its value."""
    steps = poisson_steps()
    tests = " ".join(f"when {digits} < '{edge}' then {i}" for i, edge in enumerate(steps))
    return f"case {tests} else {len(steps)} end"


def replicate_sums(df: DataFrame, id_col: str, values: Sequence[str], replicates: int,
                   by: Sequence[str], many_groups: bool = False) -> DataFrame:
    """(by, rep): drawn row count and drawn sum of each value column; null values add nothing.

    A row is never copied per replicate: a task draws all counts of a block of rows from hashes of
    their ids and adds them up as one matrix product per group, so it sends on one row per group
    and replicate, whatever its number of rows. Tasks read their rows group by group and hold one
    dense block of replicates at a time, however many groups there are.

    Rows stay where they are, so every task may meet every group. With ``many_groups`` they are first
    brought together in ranges of (group, hash of the id): a small group then lies in one task, and a
    large one is still spread over many.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    suffixes = [str(g).encode() for g in range(-(-replicates // _DRAWS))]
    edges = [int(e, 16) for e in poisson_steps()]
    names = [*by, "rep", "drawn", *values]
    block = max(1, _BLOCK // replicates)

    # This function uses nothing of this package, so tasks need not import it.
    def run(batches):
        key = total = None

        def done():
            columns = [pa.array([k] * replicates, kind) for k, kind in zip(key, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(x) for x in total)], names)

        for t in batches:
            for at in range(0, t.num_rows, block):
                part = t.slice(at, block)
                ids = part.column(0).to_pylist()
                texts = [b"" if i is None else i.encode() + b"-" for i in ids]
                drawn = np.frombuffer(b"".join(hashlib.md5(i + g).digest() for i in texts for g in suffixes), dtype=">u4")
                counts = np.searchsorted(edges, drawn.reshape(len(ids), -1)[:, :replicates], "right").astype(np.float64)
                keys = list(zip(*(part.column(1 + k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * len(ids)
                v = np.array([[x or 0.0 for x in part.column(1 + len(by) + k).to_pylist()] for k in range(len(values))], dtype=np.float64)
                ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
                for a, b in zip([0, *ends], [*ends, len(keys)], strict=True):
                    c = counts[a:b]
                    sums = [x @ c if np.isfinite(x).all() else np.where(c > 0, c * x[:, None], 0.0).sum(axis=0) for x in v[:, a:b]]
                    new = np.stack([c.sum(axis=0), *sums])
                    if key == keys[a]:
                        total += new
                        continue
                    if key is not None:
                        yield done()
                    key, total = keys[a], new
        if key is not None:
            yield done()

    kinds = [to_arrow_type(df.schema[c].dataType) for c in by]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "rep int", "drawn double", *(f"`{c}` double" for c in values)])
    narrow = df.select(F.col(id_col).cast("string"), *by, *[F.col(c).cast("double") for c in values])
    if by and many_groups:
        narrow = narrow.repartitionByRange(*by, F.xxhash64(F.col(id_col)))
    partial = (narrow.sortWithinPartitions(*by) if by else narrow).mapInArrow(run, schema)
    return partial.groupBy(*by, "rep").agg(F.sum("drawn").cast("long").alias("drawn"), *[F.sum(c).alias(c) for c in values]).filter("drawn > 0")


def paired_bootstrap(df: DataFrame, id_col: str, pairs: Mapping[str, tuple[str, str]], by: Sequence[str],
                     replicates: int = REPLICATES, many_groups: bool = False) -> DataFrame:
    """Per group and pair ``name -> (base_se, candidate_se)``: how often and by how much RMSE falls.

    Gives ``win_<name>``, ``low_<name>`` and ``high_<name>`` (5th and 95th percentile of the
    RMSE change) from one set of draws for all pairs.
    """
    values = sorted({c for pair in pairs.values() for c in pair})
    sums = replicate_sums(df, id_col, values, replicates, by, many_groups)
    aggs = []
    for n, (b, c) in pairs.items():
        d = f"(sqrt({b} / drawn) - sqrt({c} / drawn))"
        aggs += [F.expr(f"avg(if({d} > 0, 1D, 0D)) as win_{n}"), F.expr(f"percentile({d}, 0.05D) as low_{n}"),
                 F.expr(f"percentile({d}, 0.95D) as high_{n}")]
    return sums.groupBy(*by).agg(*aggs)
