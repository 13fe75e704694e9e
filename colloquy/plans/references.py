"""Queries on orphan references, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.orphans import orphan_references, orphan_report, parents, references
from colloquy.runtime import read_table


def _orphans(spark: SparkSession, d: str) -> list[DataFrame]:
    chunks = read_table(spark, d, "transcript_chunks")
    calls = read_table(spark, d, "labels")
    weak = read_table(spark, d, "weak_labels")
    joined = read_table(spark, d, "joined_qa_audio_review")
    return [
        orphan_references(
            references(weak, "weak_labels", F.col("chunk_id"), F.col("created_at")),
            parents(chunks, F.col("chunk_id"), F.col("created_at"), F.col("deleted_at")),
        ),
        orphan_references(
            references(joined, "joined_qa_audio_review", F.col("case_id"), F.col("created_at")),
            parents(calls, F.col("call_id"), F.col("created_at"), F.col("deleted_at")),
        ),
    ]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _orphans(spark, d)).drop("n_refs")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


_FAILING = r"""
refs as (
  select 'weak_labels' t, lower(trim(chunk_id)) k, created_at c from weak_labels
  union all
  select 'joined_qa_audio_review', lower(trim(case_id)), created_at from joined_qa_audio_review
), par as (
  select 'weak_labels' t, lower(trim(chunk_id)) k, min(created_at) c, bool_and(deleted_at is not null) gone
  from transcript_chunks where chunk_id is not null group by 2
  union all
  select 'joined_qa_audio_review', lower(trim(call_id)), min(created_at), bool_and(deleted_at is not null)
  from labels where call_id is not null group by 2
), months as (
  select t, k, strftime(c, '%Y-%m') m, min(c) first_ref, count(*) n from refs where k is not null and k <> '' group by 1, 2, 3
), failing as (
  select months.t from_table, months.k ref_key, m ref_month, n,
    case when par.k is null then 'missing' when gone then 'deleted' when par.c > first_ref then 'late' end orphan_kind
  from months left join par on months.t = par.t and months.k = par.k
)"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": f"with {_FAILING} select from_table, ref_key, ref_month, orphan_kind from failing where orphan_kind is not null",
    "p7_report": f"""with {_FAILING} select from_table, ref_month, orphan_kind, count(*) n_keys, cast(sum(n) as bigint) n_refs
      from failing where orphan_kind is not null group by 1, 2, 3""",
}
