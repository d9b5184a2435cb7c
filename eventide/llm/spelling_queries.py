"""op13: spelling variants among all words of all documents, with the same in DuckDB SQL (deletion neighbours instead of chunks)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import table
from eventide.llm.spelling import LOWER, RUN, UPPER, spelling_variants

SQL = rf"""
with recursive
steps as (select i, 0 as k, i::ubigint as c from range(256) r(i)
  union all select i, k + 1, xor(c >> 1, case when c % 2 = 1 then 3988292384::ubigint else 0::ubigint end) from steps where k < 8),
crc as materialized (select list(c order by i) as tab from steps where k = 8),
runs as (select doc_id, run, count(*) as times from (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')), '{UPPER}', '{LOWER}') as run from documents)
  where length(run) >= 5 group by all),
bytes as (select *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end)) as b from runs),
hashed as (select run, times, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(b, lambda x: x::ubigint)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)::bigint]))) as h from bytes, crc),
words as materialized (select word, sum(times)::bigint as n from (
    select times, case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from hashed)
  where length(word) >= 5 group by word having sum(times) >= 3),
cut as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
near as (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, min((-other_n, other)) as best from near group by word),
formed as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -best[1] >= 2 * w.n then best[2] end as form,
    case when -best[1] >= 2 * w.n then (-best[1])::bigint end as form_n from words w left join best using (word)),
chain as (select word, word as root, form as next from formed union all select c.word, f.word, f.form from chain c join formed f on c.next = f.word)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chain c on f.word = c.word where c.next is null
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": SQL}
