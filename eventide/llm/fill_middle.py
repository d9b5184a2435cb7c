"""Fill-in-the-middle transformation by one repeated-capture match per text.

A text is cut into units: a word with the white space before it, or the white space that ends the text. The ``regex`` library
keeps every repetition of a captured group, so one full match of ``(unit)*`` gives all ends: their number is the number of
units, and two of them are the cuts. Nothing is searched twice and no loop runs over units.

Only texts and two draws go to Python, and a count and two offsets come back; slices, sentinels and digests are built by Spark.
Rows stay in their scan partition. A match holds about 300 bytes a unit of the one text at hand.
"""
from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from eventide.llm.common import blank_text, ship

UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle), ends in code points, from two draws."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


# types are spelled out because executors import this module too, and only the driver can parse a type's text
CUTS = StructType([StructField("units", LongType()), StructField("prefix", IntegerType()), StructField("middle", IntegerType())])


@F.pandas_udf(CUTS)
def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cuts(*row) for row in zip(texts, first, second)], columns=["units", "prefix", "middle"])


def draws(doc_id: str | Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:id``, as numbers. A null id counts as an empty one."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", seed: int = 42,
                rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``keep`` columns, then n, form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are rearranged, ``suffix_first`` percent of these suffix first (spm), the others prefix first
    (psm); empty and null texts and such that contain a sentinel stay plain, with null lengths. Rows are independent: repeated
    ids and texts are transformed alike, an empty table gives an empty one, and columns not in ``keep`` do not matter.
    """
    ship(docs.sparkSession)
    h = draws(doc_id, seed)
    rows = docs.select(F.struct(*keep).alias("_row"), blank_text(text).alias("_text"), *(x.alias(f"_h{k}") for k, x in enumerate(h)))
    rows = rows.withColumn("_cut", _cuts("_text", "_h0", "_h1"))
    t = F.col("_text")
    plain = (t == "") | (F.col("_h2") % 100 >= rate)
    for s in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(t, F.lit(s))
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("_row", t, form.alias("_form"), F.col("_cut.units").alias("_n"), F.col("_cut.prefix").alias("_a"), F.col("_cut.middle").alias("_b"))
    prefix, middle = F.substring(t, F.lit(1), F.col("_a")), F.substring(t, F.col("_a") + 1, F.col("_b") - F.col("_a"))
    suffix = F.substring(t, F.col("_b") + 1, F.char_length(t))
    output = (F.when(F.col("_form") == "plain", t)
              .when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    moved = F.col("_form") != "plain"
    return rows.select("_row.*", F.col("_n").alias("n"), F.col("_form").alias("form"), F.when(moved, F.col("_a").cast("long")).alias("prefix_chars"),
                       F.when(moved, (F.col("_b") - F.col("_a")).cast("long")).alias("middle_chars"), output.alias("output"))


def restore(output: str, form: str) -> Column:
    """The text that ``output`` was made from. Sentinels occur once each in a moved text, as its own text has none."""
    o, f = F.col(output), F.col(form)
    p, s, m = (F.instr(o, x) for x in (PREFIX, SUFFIX, MIDDLE))
    rest = F.char_length(o)
    middle = F.substring(o, m + 3, rest)
    psm = F.concat(F.substring(o, F.lit(4), s - 4), middle, F.substring(o, s + 3, m - s - 3))
    spm = F.concat(F.substring(o, p + 3, m - p - 3), middle, F.substring(o, F.lit(4), p - 4))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)
