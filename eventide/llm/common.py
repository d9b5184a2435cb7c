"""Helpers that several operators share."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.plans.settle import settle

__all__ = ["ship", "settle", "table", "blank_text", "fold_of", "parts_of"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "eventide_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "eventide")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_text(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """Remainder of crc32 of the id written as text."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)).cast("int")



def parts_of(batch: pa.RecordBatch, text: int, most_characters: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_characters`` of its column ``text``; a longer text is a slice of its own."""
    start, size = 0, 0
    for at, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
        if at > start and size + length > most_characters:
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)
