"""Queries of problem 4 (what changed between full snapshots) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import table
from lodestack.operators.snapshot_diff import ENTRY_FIELDS, snapshot_changes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "entry_snapshots"))


def p4_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed paths of each snapshot, and how often each field changed."""
    return p4_found(spark, sf_dir).groupBy("repo_id", "snapshot_no", "change_kind", "field_name").agg(F.count("*").alias("n_paths"))


_DIFFS = "\n  union all ".join(f"select repo_id, at_no, path, 'changed', '{f}' from pairs where a_there and b_there and a.{f} is distinct from b.{f}" for f in ENTRY_FIELDS)
FOUND_SQL = f"""
with clean as (
  select * replace (regexp_replace(regexp_replace(replace(path, '\\', '/'), '/(\\./)*/*(\\./)*', '/', 'g'), '^(\\./|/)+', '') as path) from entry_snapshots
  where repo_id is not null and snapshot_no is not null and path is not null),
latest as (select * from clean qualify row_number() over (partition by repo_id, snapshot_no, path order by delivered_at desc nulls last) = 1),
steps as (select repo_id, snapshot_no as at_no, lag(snapshot_no) over (partition by repo_id order by snapshot_no) as before from (select distinct repo_id, snapshot_no from clean)),
news as (select l as b, s.repo_id, s.at_no, l.path from latest l join steps s on l.repo_id = s.repo_id and l.snapshot_no = s.at_no where s.before is not null),
olds as (select l as a, s.repo_id, s.at_no, l.path from latest l join steps s on l.repo_id = s.repo_id and l.snapshot_no = s.before),
pairs as (select coalesce(n.repo_id, o.repo_id) as repo_id, coalesce(n.at_no, o.at_no) as at_no, coalesce(n.path, o.path) as path, a, b, o.path is not null as a_there, n.path is not null as b_there
  from news n full join olds o on n.repo_id = o.repo_id and n.at_no = o.at_no and n.path = o.path),
cases(repo_id, snapshot_no, path, change_kind, field_name) as (
  select repo_id, at_no, path, case when a_there then 'removed' else 'added' end, '' from pairs where not (a_there and b_there)
  union all {_DIFFS})
"""

QUERIES = {"p4_found": p4_found, "p4_change_counts": p4_change_counts}
SQL = {
    "p4_found": FOUND_SQL + "select * from cases",
    "p4_change_counts": FOUND_SQL + "select repo_id, snapshot_no, change_kind, field_name, count(*) as n_paths from cases group by all",
}
