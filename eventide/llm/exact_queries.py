"""op12: exact copies among all documents, with the same in DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import table
from eventide.llm.exact_dedup import exact_groups

SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from t
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
ORACLES = {"op12_exact_dedup": SQL}
