"""Inputs that several plans share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions.scoring import signed_score
from colloquy.functions.text import normalize_role
from colloquy.operators.signals import lexicon_sentiment
from colloquy.plans.sqltext import sql_list
from colloquy.runtime import norm_key, read_spread


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv, turn, role, text, start_s, end_s) of transcript_segments, each message once (the smallest segment_id).

    The smallest id is found on the keys alone, so that no text is sorted."""
    s = read_spread(spark, d, "transcript_segments").select(
        norm_key(F.col("case_id")).alias("conv"), F.col("message_index").alias("turn"), "segment_id", "role", "text", "start_s", "end_s"
    )
    first = F.min("segment_id").over(Window.partitionBy("conv", "turn"))
    s = s.withColumn("first", first).where("segment_id <=> first")
    return s.select("conv", "turn", normalize_role(F.col("role"), L.ROLES).alias("role"), "text", "start_s", "end_s", "segment_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """turns with the default scorer's sentiment: label, score, signed."""
    t = turns(spark, d).withColumn("x", lexicon_sentiment(F.col("text")))
    t = t.withColumns({"label": F.col("x.label"), "score": F.col("x.score")}).drop("x")
    return t.withColumn("signed", signed_score(F.col("label"), F.col("score")))


_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in L.ROLES.items())
TURNS = rf"""
raw_turns as (
  select *, row_number() over (partition by lower(trim(case_id)), message_index order by segment_id) k from transcript_segments
), turns as (
  select lower(trim(case_id)) conv, message_index turn,
    case regexp_replace(lower(trim(coalesce(role, ''))), '[\s-]+', '_', 'g') {_CASES} when '' then 'unknown' else regexp_replace(lower(trim(role)), '[\s-]+', '_', 'g') end as role,
    text, start_s, end_s, segment_id from raw_turns where k = 1
), spoken as (
  select * replace (trim(regexp_replace(text, '\s+', ' ', 'g')) as text) from turns
  where trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''
)"""
#: Merged turns of the given roles, in SQL.
MERGED = """
isl as (
  select *, case when role is not distinct from lag(role) over w then 0 else 1 end nw from spoken where {roles} window w as (partition by conv order by turn)
), isl2 as (select *, sum(nw) over (partition by conv order by turn) island from isl),
merged as (
  select conv, island, any_value(role) as role, min(turn) turn, count(*) n_turns, string_agg(text, ' ' order by turn) as text from isl2 group by conv, island
)"""
_TOKS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z'']+')"
_HITS = lambda ws: f"len(list_filter({_TOKS}, lambda t: list_contains({sql_list(ws)}, t)))"
#: turns with sentiment, in SQL; after TURNS.
SCORED = f"""
sent as (select *, {_HITS(L.SENTIMENT_UP)} up, {_HITS(L.SENTIMENT_DOWN)} dn from turns),
scored as (select * exclude (up, dn), case when up > dn then 'POSITIVE' when up < dn then 'NEGATIVE' else 'NEUTRAL' end as label, round(0.5e0 + 0.5e0 * abs(up - dn) / (up + dn + 1), 4) score,
  case when up > dn then 1 when up < dn then -1 else 0 end * round(0.5e0 + 0.5e0 * abs(up - dn) / (up + dn + 1), 4) signed from sent)"""
