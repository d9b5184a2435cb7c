"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from the weights, stopped at ``repeats`` times a source's size, the excess reshared (in closed form: one level
such that target = least(cap, level * weight)). The mix is cut into blocks of ``block_words``; blocks go to sources, and a
source's blocks to its shards, by highest quotients weight / (2 k - 1). A shard lines its documents up in a seeded order and
takes its quota of blocks from the start of that line, going round once more where the quota exceeds it.

Shards hold about ``shard_words`` words each, so the only window over documents is bounded, whatever share a source holds;
windows over sources and over a source's shards see one row per source or shard.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: str) -> Column:
    """The source as a text that is never null; sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds weight and target to (source_key, source_size). Weights repeat along the sources' order."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("n", F.row_number().over(everything.orderBy("source_key"))).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(repeats)), "total": F.sum("source_size").over(everything) * F.lit(share)})
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = everything.orderBy("full_at", "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_key", "level"))).over(everything)["level"])
    return ranked.select("source_key", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def apportion(claims: DataFrame, within: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: adds ``out``, the seats of each key among the ``seats`` of its group ``within``.

    With n keys, the final divisor lies between those that give seats - n/2 and seats + n/2 before rounding; seats below that
    band are sure, and only quotients inside it (about one and a half per key) are ranked. Ties go to the smaller key.
    """
    group = Window.partitionBy(*(within or [F.lit(0)]))
    banded = claims.withColumns({"_n": F.count(F.lit(1)).over(group), "_sum": F.sum(weight).over(group)})
    share = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    low = F.floor(share * F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0)) + 0.5)
    high = F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1
    banded = banded.withColumns({"_low": F.greatest(low - 1, F.lit(0)), "_high": F.when(F.col(weight) > 0, F.least(high, F.col(seats))).otherwise(F.lit(0))})
    sure = F.sum("_low").over(group)
    banded = banded.withColumn("_left", F.col(seats) - sure)
    asked = banded.filter(F.col("_high") > F.col("_low")).select(
        *within, key, weight, "_left", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    order = group.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") - 1)), key, "_k")
    won = asked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_left")).groupBy(*within, key).agg(F.count(F.lit(1)).alias("_won"))
    return banded.join(won, [*within, key], "left").select(
        *claims.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias(out))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep`` columns, then size, source_size, target and taken (words that the mix takes of the document).

    Null texts have size 0 and are taken 0 times; null sources are a source of their own; repeated rows of an id are rows of
    their own; an empty table gives an empty one. Columns named like the results are only in the way if kept. For options see
    ``_mixed``.
    """
    return _mixed(docs, keep, **options).select(*keep, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                                F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def _mixed(docs: DataFrame, keep: tuple[str, ...], text: str = "text", source: str = "source", doc_id: str = "doc_id",
           weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, block_words: int = 50, shard_words: int = 200_000,
           seed: int = 7) -> DataFrame:
    """``keep`` columns and those of the result, each with a leading underscore so that none clashes."""
    places = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = docs.select(F.struct(*keep).alias("_row"), word_count(blank_text(text)).alias("_size"), source_key(source).alias("source_key"), places.alias("_place"))
    number = F.conv(F.substring("_place", 1, 8), 16, 10).cast("long")
    sizes = settle(rows.groupBy("source_key").agg(F.sum("_size").alias("source_size")), "sources")
    plan = targets(sizes, weights, share, repeats).withColumns({
        "shards": F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"),
        "seats": F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")})
    plan = settle(apportion(plan, [], "source_key", "target", "seats", "quota").drop("seats", "weight"), "plan")
    rows = rows.join(plan, "source_key").withColumn("shard", F.pmod(number, F.col("shards")))
    shards = rows.groupBy("source_key", "shard").agg(F.sum("_size").cast("double").alias("shard_size"), F.max("quota").alias("quota"))
    quotas = settle(apportion(shards, ["source_key"], "shard", "shard_size", "quota", "shard_quota").drop("quota"), "quotas")
    line = Window.partitionBy("source_key", "shard").orderBy("_place", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(quotas, ["source_key", "shard"]).withColumn("_start", F.coalesce(F.sum("_size").over(line), F.lit(0)))
    words = F.col("shard_quota") * block_words - F.col("_start")
    taken = sum((F.greatest(F.least(F.col("_size"), words - (F.col("shard_size") * k).cast("long")), F.lit(0)) for k in range(1, repeats)),
                F.greatest(F.least(F.col("_size"), words), F.lit(0)))
    return rows.select("_row.*", "_size", F.col("source_size").cast("long").alias("_source_size"), F.col("target").alias("_target"), taken.cast("long").alias("_taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix has them: whole documents, each as many times as its taken words come to (rounded)."""
    columns = docs.columns
    out = _mixed(docs, tuple(columns), **options)
    copies = F.when(F.col("_size") > 0, F.floor((2 * F.col("_taken") + F.col("_size")) / (2 * F.col("_size")))).otherwise(F.lit(0))
    return out.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*columns)
