"""op6: all documents mixed, with the same computation in DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import table
from eventide.llm.mixing import mix


def mix_sql(docs: str = "documents", block_words: int = 50, shard_words: int = 200_000, seed: int = 7) -> str:
    """WITH clauses up to ``mixed`` (all columns of ``docs``, then size, source_size, target, taken)."""
    def apportion(name: str, claims: str, within: str, key: str, weight: str, seats: str) -> str:
        by = f"partition by {within}" if within else ""
        same = f"and a.{within} is not distinct from b.{within}" if within else ""
        cols = f"{within}, {key}" if within else key
        return rf"""
{name}_band as (select *, greatest(low - 1, 0) as lo, case when {weight} > 0 then least(high, {seats}) else 0 end as hi from (
  select *, cast(floor(portion * greatest({seats} - n / 2.0::double, 0.0) + 0.5) as bigint) as low,
            cast(floor(portion * ({seats} + n / 2.0::double) + 0.5) as bigint) + 1 as high
  from (select *, count(*) over ({by}) as n, case when sum({weight}) over ({by}) > 0 then {weight} / sum({weight}) over ({by}) else 0.0 end as portion from {claims}))),
{name}_left as (select *, {seats} - sum(lo) over ({by}) as remaining from {name}_band),
{name}_won as (select {cols}, count(*) as won from (
  select *, row_number() over ({by} order by {weight} / (2 * k - 1) desc, {key}, k) as r
  from (select {cols}, {weight}, remaining, unnest(range(lo + 1, hi + 1)) as k from {name}_left)) where r <= remaining group by all),
{name} as (select a.*, cast(a.lo + coalesce(b.won, 0) as bigint) as won_seats from {name}_left a left join {name}_won b on a.{key} = b.{key} {same})"""

    return rf"""
rows_ as (select d.*, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size_, coalesce('0' || source, '1') as skey,
  md5(coalesce(doc_id::varchar, '') || ':{seed}') as place from {docs} d),
sizes as (select skey, sum(size_)::bigint as source_size from rows_ group by skey),
weighed as (select *, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total,
  [5.0::double, 2.0::double, 1.0::double][1 + cast((row_number() over (order by skey) - 1) % 3 as int)] as weight from sizes),
levels as (select *, cap / weight as full_at,
  (total - coalesce(sum(cap) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, skey rows between current row and unbounded following) as lev from weighed),
target_ as (select skey, source_size, least(cap, (select arg_min(lev, (full_at, skey)) from levels where lev <= full_at) * weight) as target from levels),
plan_ as (select *, greatest(cast(ceil(source_size / {shard_words}.0::double) as bigint), 1) as shards, cast(round(sum(target) over () / {block_words}) as bigint) as seats from target_),
{apportion("plan_q", "plan_", "", "skey", "target", "seats")},
placed as (select r.*, p.source_size, p.target, p.won_seats as quota, ('0x' || substr(place, 1, 8))::bigint % p.shards as shard from rows_ r join plan_q p on r.skey = p.skey),
shard_ as (select skey, shard, sum(size_)::double as shard_size, max(quota) as quota from placed group by all),
{apportion("shard_q", "shard_", "skey", "shard", "shard_size", "quota")},
lined as (select p.*, q.won_seats * {block_words} - coalesce(sum(size_) over (partition by p.skey, p.shard order by place, size_ rows between unbounded preceding and 1 preceding), 0) as words,
  q.shard_size from placed p join shard_q q on p.skey = q.skey and p.shard = q.shard),
mixed as (select *, size_ as size, greatest(least(size_, words), 0)::bigint + greatest(least(size_, words - shard_size::bigint), 0)::bigint as taken from lined)"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_source_mixing": op6_source_mixing}
ORACLES = {"op6_source_mixing": "with " + mix_sql() + "\nselect doc_id, size, source_size, target, taken from mixed"}
