"""Queries of the general data operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.coverage import periods_and_gaps
from ..session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods_and_gaps(table(spark, sf_dir, "hmmer_dom_hits"), "qid", "ali_from", "ali_to")
    return found.withColumnsRenamed({"ali_from": "aa_from", "ali_to": "aa_to"})


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": """
with h as (
  select trim(qid, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as qid,
         least(ali_from, ali_to)::bigint as lo, greatest(ali_from, ali_to)::bigint as hi
  from hmmer_dom_hits where qid is not null and ali_from is not null and ali_to is not null),
r as (select *, max(hi) over (partition by qid order by lo, hi rows between unbounded preceding and 1 preceding) as top from h),
g as (select *, sum(case when top is null or lo > top + 1 then 1 else 0 end) over (partition by qid order by lo, hi rows unbounded preceding) as run from r),
p as (select qid, run, min(lo) as lo, max(hi) as hi from g group by qid, run),
n as (select *, lead(lo) over (partition by qid order by lo) as nxt from p)
select qid, 'period' as kind, lo as aa_from, hi as aa_to from p
union all
select qid, 'gap', hi + 1, nxt - 1 from n where nxt is not null
""",
}
