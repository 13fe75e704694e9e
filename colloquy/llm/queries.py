"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.broken_pairs import broken_pairs
from colloquy.llm.consensus import consensus, habit_consensus, latest_votes
from colloquy.llm.grouped_splits import assign_splits, entity_groups, norm_ticker, split_shares
from colloquy.llm.leakage import leaked_passages
from colloquy.llm.nearest_time import nearest_time
from colloquy.llm.pieces import split_oversized
from colloquy.llm.speaker_turns import label_speakers, speaker_turns, turn_starts
from colloquy.llm.survivorship import survivors
from colloquy.llm.tokenizer import encode_texts
from colloquy.runtime import checkpoint, norm_key, read_spread, read_table, salted_join

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 3. Nearest time

#: Seconds within which a segment may be paired with an audio row.
TOLERANCE_S = 2.5


@query
def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    audio = read_table(spark, d, "audio_behavior_segments").where("end_time_s >= start_time_s and not isnan(end_time_s)")
    segments = read_table(spark, d, "transcript_segments")
    return nearest_time(
        audio,
        segments,
        left_id="audio_id",
        left_entity="case_id",
        left_time="start_time_s",
        right_id="segment_id",
        right_entity="case_id",
        right_time="start_s",
        tolerance_s=TOLERANCE_S,
    )


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("audio_id", "segment_id")


_NEAREST = """
with a as (
  select distinct audio_id, lower(trim(case_id)) e, cast(round(start_time_s * 1e6) as bigint) t from audio_behavior_segments
  where start_time_s is not null and end_time_s >= start_time_s and not isnan(end_time_s) and not isnan(start_time_s)
), s as (
  select segment_id, lower(trim(case_id)) e, cast(round(start_s * 1e6) as bigint) t from transcript_segments
  where start_s is not null and not isnan(start_s)
), r as (
  select audio_id, segment_id, abs(a.t - s.t) gap,
    row_number() over (partition by audio_id, a.e, a.t order by abs(a.t - s.t), segment_id) k
  from a join s on a.e = s.e and abs(a.t - s.t) <= 2500000
)"""
SQL["p3_found"] = f"{_NEAREST} select distinct audio_id, segment_id from r where k = 1"
SQL["p3_pairs"] = f"{_NEAREST} select distinct audio_id, segment_id, gap / 1e6 gap_s from r where k = 1"


# 4. Splits of related records


def _label_edges(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "labels")
    return labels.select(norm_key(F.col("call_id")).alias("record"), norm_ticker(F.col("ticker")).alias("entity"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = entity_groups(_label_edges(spark, d))
    return groups.select(F.col("record").alias("case_id"), F.col("group").alias("group_case_id"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    gold, labels = read_table(spark, d, "gold_labels"), read_table(spark, d, "labels")
    tidy = lambda c: F.lower(F.regexp_replace(F.trim(c), r"[\s\-_]+", "_"))
    rows = gold.select(
        F.lit("gold_labels").alias("from_table"),
        F.col("gold_label_id").alias("row_id"),
        norm_key(F.col("case_id")).alias("case_id"),
        tidy(F.get(F.filter("labels", lambda x: F.trim(x) != ""), 0)).alias("label"),
    ).unionByName(
        labels.select(
            F.lit("labels").alias("from_table"),
            F.col("label_row_id").alias("row_id"),
            norm_key(F.col("call_id")).alias("case_id"),
            tidy(F.col("guidance_change_label")).alias("label"),
        )
    ).distinct()
    edges = _label_edges(spark, d).unionByName(
        gold.select(norm_key(F.col("case_id")).alias("record"), F.lit(None).cast("string").alias("entity"))
    )
    groups = entity_groups(edges)
    rows = salted_join(rows, groups.withColumnRenamed("record", "case_id"), ["case_id"], how="left")
    rows = rows.withColumn("group", F.coalesce("group", F.concat_ws(":", "from_table", F.col("row_id").cast("string"))))
    return assign_splits(rows, ["train", "validation", "test"], [0.8, 0.1, 0.1])


@query
def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row of gold_labels and labels with its group and split."""
    return _splits(spark, d).select("from_table", "row_id", "case_id", F.col("group").alias("group_case_id"), "split")


@query
def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of rows and labels that the splits reach."""
    return split_shares(_splits(spark, d))


SQL["p4_found"] = r"""
with recursive e as (
  select distinct lower(trim(call_id)) c,
    nullif(regexp_replace(regexp_replace(upper(trim(ticker)), '^[^:]*:\s*', ''), '^\$+\s*', ''), '') t
  from labels where trim(call_id) <> ''
), links as (
  select distinct a.t a, b.t b from e a join e b on a.c = b.c and a.t is not null and b.t is not null
), reach(a, b) as (
  select a, b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), low as (select a t, min(c) g from reach join e on e.t = reach.b group by 1)
select c case_id, coalesce(min(g), c) group_case_id from e left join low using (t) group by c"""


# 5. Survivors of duplicate groups

SURVIVOR_FIELDS = [
    "source_id", "source_name", "source_type", "license_or_terms_summary", "allowed_storage", "commit_allowed",
    "training_allowed", "eval_allowed", "metadata_only", "acquisition_method", "paywall_or_login_status",
    "provenance_hash", "retrieval_timestamp", "reviewer_or_operator", "blocked_reason", "notes",
]


@query
def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors(
        read_table(spark, d, "provenance_records"),
        source="source_url_or_path",
        record_id="record_id",
        checked="last_checked_at",
        tier="rights_tier",
        trust="source_type",
        fields=SURVIVOR_FIELDS,
    )


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivors(spark, d).where("n_records >= 2").select("record_id", "rights_tier", "last_checked_at")


SQL["p5_found"] = r"""
with s as (select *, regexp_replace(source_url_or_path, '^\s+|\s+$', '', 'g') u, regexp_replace(last_checked_at, '^\s+|\s+$', '', 'g') w from provenance_records),
b as (
  select *, regexp_extract(u, '^([A-Za-z]+)://([^/?#]*)([^?#]*)\??([^#]*)', ['scheme', 'host', 'path', 'query']) p from s
), c as (
  select record_id, w, lower(regexp_replace(trim(rights_tier), '[\s_-]+', '_', 'g')) tier,
    case when lower(p.scheme) in ('http', 'https') then
      regexp_replace(regexp_replace(lower(p.host), case when lower(p.scheme) = 'http' then ':80$' else ':443$' end, ''), '^www\.', '')
      || rtrim(url_decode(p.path), '/') || '?' ||
      array_to_string(list_sort(list_transform(list_filter(string_split(p.query, '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_')), lambda x: url_decode(x))), '&')
    else (case when starts_with(u, '/') then '/' else '' end) || array_to_string(list_filter(string_split(replace(u, '\', '/'), '/'), lambda x: x not in ('', '.')), '/')
    end k
  from b where u <> ''
), d as (
  select *, case
    when regexp_full_match(w, '\d{10}') then make_timestamp(cast(w as bigint) * 1000000)
    when regexp_full_match(w, '\d{8}T\d{6}Z') then strptime(w, '%Y%m%dT%H%M%SZ')
    when regexp_full_match(w, '\d{4}-\d\d-\d\d') then try_strptime(w, '%Y-%m-%d')
    when regexp_full_match(w, '\d\d [A-Z][a-z]{2} \d{4}') then strptime(w, '%d %b %Y')
    when regexp_full_match(w, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?Z?') then strptime(replace(left(w, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')
    when regexp_full_match(w, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[+-]\d\d:\d\d') then strptime(replace(left(w, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')
      - to_minutes((case when w[20] = '-' then -1 else 1 end) * (cast(w[21:22] as int) * 60 + cast(w[24:25] as int)))
    end t0
  from c
), f as (
  select *, case when year(t0) between 1971 and 2100 then t0 end t, case when tier not in ('', 'unknown', 'n/a', 'na', 'none', 'null') then tier end kt from d
)
select min(record_id) record_id, arg_max(kt, (epoch_us(t), -record_id)) filter (where t is not null and kt is not null) rights_tier,
  strftime(max(t), '%Y-%m-%dT%H:%M:%SZ') last_checked_at
from f group by k having count(*) >= 2"""


# 8. Token ids


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(read_spread(spark, d, "documents"), "doc_id", "text")


# 9. Leaked evaluation passages


@query
def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(
        read_spread(spark, d, "documents"),
        read_table(spark, d, "eval_passages"),
        doc_id="doc_id",
        doc_text="text",
        item_id="item_id",
        item_text="text",
    )


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_runs(spark, d).select("doc_id", "item_id")


# 10. Pieces of oversized texts


@query
def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read_spread(spark, d, "documents"), "doc_id", "text")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(read_spread(spark, d, "documents"), "doc_id", "text", with_text=False)
    return pieces.where("piece_no = 2").select("doc_id").distinct()


# 2. Consensus of reviewers


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return latest_votes(
        read_table(spark, d, "gold_labels"),
        item="chunk_id",
        annotator="reviewer",
        labels="labels",
        time="review_timestamp",
        row_id="gold_label_id",
    )


@query
def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    """By the spectral weights alone."""
    return consensus(_votes(spark, d))[0].withColumnRenamed("item", "chunk_id")


@query
def p2_reviewers(spark: SparkSession, d: str) -> DataFrame:
    return consensus(_votes(spark, d))[1].withColumnRenamed("annotator", "reviewer")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """By label habits, which start from the spectral weights."""
    votes = checkpoint(_votes(spark, d))
    return habit_consensus(votes, consensus(votes)[1]).select(F.col("item").alias("chunk_id"), "label")


# 1. Broken prompt and response pairs


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(
        read_spread(spark, d, "joined_qa_audio_review"),
        pair_id="row_id",
        prompt="analyst_question_excerpt",
        response="management_answer_excerpt",
    )


# 6. Speaker turns


@query
def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(read_spread(spark, d, "transcript_segments"), read_table(spark, d, "participants"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turn_starts(read_spread(spark, d, "transcript_segments"), read_table(spark, d, "participants"))


@query
def p6_chunk_speakers(spark: SparkSession, d: str) -> DataFrame:
    """The participant of each speaker label of transcript_chunks."""
    return label_speakers(
        read_table(spark, d, "transcript_chunks"), read_table(spark, d, "participants"), case="case_id", label="speaker", row_id="chunk_id"
    )
