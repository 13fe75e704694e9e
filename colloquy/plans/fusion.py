"""Queries on segments scored by text and audio, fused, voted on and queued for review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.operators import fusion as U
from colloquy.operators import signals as S
from colloquy.plans import signals as SG
from colloquy.plans import sqltext as X
from colloquy.plans.common import TURNS, turns
from colloquy.plans.registry import Registry
from colloquy.plans.series import _AUDIO_ROWS, audio_context
from colloquy.runtime import read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def text_rows(spark, d):
    t = S.with_emotion(SG.with_family(turns(spark, d).select("segment_id", "text")), "text")
    return U.text_scores(t, "w", "emotion")


_TEXT = f"""{TURNS}, {SG.weak_sql('turns', 'segment_id')},
em0 as (select segment_id, {X.compact("coalesce(text, '')")} t from turns), em1 as (select *, ' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ' pad from em0),
em2 as (select segment_id, t, {" + ".join(SG._ES(e) for e in L.EMOTIONS)} total, list_reverse_sort([{", ".join(f"{{'s': {SG._ES(e)}, 'n': {SG._EN(e)}, 'o': {-i}, 'e': '{e}'}}" for i, e in enumerate(SG._EO))}])[1] b from em1),
em as (select segment_id, case when b.s > 0 then b.e else 'neutral' end mood, case when t = '' then 0.35 when b.s > 0 then round(greatest(0.55e0, least(0.95e0, b.s / total + 0.03e0 * b.n)), 4) else 0.42 end mood_p from em2),
tx0 as (select segment_id, label as rule_signal, case when len(evidence) > 0 then 0.72e0 else 0.44e0 end signal_confidence, mood, mood_p from weak join em using (segment_id)),
tx as (select segment_id, rule_signal, signal_confidence, {", ".join(f"round(case when rule_signal = '{f}' then signal_confidence else (1 - signal_confidence) / 3 end, 4) p_{f}" for f in L.FAMILIES)},
  case when mood = 'satisfaction' then 'positive' when mood in ('anger', 'frustration', 'concern', 'urgency') then 'negative' else 'neutral' end sentiment, mood_p sentiment_confidence from tx0)"""


@query(f"with {_TEXT} select * from tx")
def segment_text_scores(spark, d):
    return text_rows(spark, d).select("segment_id", "rule_signal", "signal_confidence", *(f"p_{f}" for f in L.FAMILIES), "sentiment", "sentiment_confidence")


def audio_rows(spark, d):
    """Audio features of the segment that an audio row overlaps most; of several rows the last."""
    a = read_table(spark, d, "audio_behavior_segments").dropDuplicates(["audio_id"])
    part = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0))
    a = a.select("audio_id", (F.coalesce("hesitation_score", F.lit(0)) / 10.0).alias("hesitation_score"), (1 - part("silence_ratio")).alias("confidence_score"), F.greatest(F.lit(0.0), (part("mean_rms_db") + 60) / 60).alias("intensity_score"))
    c = audio_context(spark, d).join(a, "audio_id")
    w = Window.partitionBy("segment_id").orderBy(F.desc("audio_id"))
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("segment_id", "hesitation_score", "confidence_score", "intensity_score")


def fused_rows(spark, d):
    none = spark.createDataFrame([], "segment_id long, motion_intensity double, stress_indicator double")
    return U.fuse(text_rows(spark, d), audio_rows(spark, d), none, key="segment_id")


_FUSED = f"""{_TEXT}, {_AUDIO_ROWS}, au as (select audio_id, any_value(coalesce(hesitation_score, 0) / 10e0) h, any_value(1 - coalesce(nullif(silence_ratio, 'nan'::double), 0)) c, any_value(greatest(0, (coalesce(nullif(mean_rms_db, 'nan'::double), 0) + 60) / 60)) i from audio_behavior_segments group by 1),
ak as (select segment_id, h, c, i, row_number() over (partition by segment_id order by audio_id desc) k from context join au using (audio_id)),
fz as (select tx.*, ak.k is not null has_audio, greatest(0, p_risk_friction + least(0.12e0, coalesce(i, 0) * 0.08e0)) a, greatest(0, p_opportunity_commitment + least(0.1e0, coalesce(c, 0) * 0.08e0)) b,
  greatest(0, p_uncertainty_hedging + least(0.14e0, coalesce(h, 0) * 0.1e0)) u, greatest(0, p_neutral) n from tx left join ak on ak.segment_id = tx.segment_id and ak.k = 1),
fr as (select *, round(a / (a + b + u + n), 4) f_risk_friction, round(b / (a + b + u + n), 4) f_opportunity_commitment, round(u / (a + b + u + n), 4) f_uncertainty_hedging, round(n / (a + b + u + n), 4) f_neutral from fz),
fb as (select *, list_reverse_sort([{", ".join(f"{{'p': f_{f}, 'o': {-i}, 'f': '{f}'}}" for i, f in enumerate(L.FAMILIES))}])[1] b1 from fr),
fused as (select *, b1.f fused_signal, b1.p confidence from fb)"""


@query(f"with {_FUSED} select segment_id, has_audio, {', '.join(f'f_{f}' for f in L.FAMILIES)}, fused_signal, confidence from fused")
def fusion_scores(spark, d):
    """Text probabilities adjusted by audio within bounds and renormalised."""
    return fused_rows(spark, d).select("segment_id", "has_audio", *(f"f_{f}" for f in L.FAMILIES), "fused_signal", "confidence")


def ensemble_rows(spark, d):
    f = fused_rows(spark, d).withColumns({"rule": F.col("rule_signal"), "snorkel": F.col("rule_signal"), "mood": F.when(F.col("sentiment") == "negative", "risk_friction")})
    return U.ensemble(f, ["rule", "mood", "fused_signal"], fallback="rule_signal", confidence="confidence")


_ENS = f"""{_FUSED}, vt as (select *, list_filter([rule_signal, case when sentiment = 'negative' then 'risk_friction' end, fused_signal], lambda x: x is not null) v from fused),
en as (select segment_id, rule_signal, confidence, case when len(v) = 3 and v[2] = v[3] then v[2] else v[1] end final_signal, len(list_distinct(v)) > 1 differs from vt),
ens as (select *, list_filter([case when differs then 'model_vote_disagreement' end, case when confidence < 0.55 then 'low_confidence' end], lambda x: x is not null) flags from en)"""


@query(f"with {_ENS} select segment_id, final_signal, confidence, array_to_string(flags, ',') flags from ens")
def ensemble_outputs(spark, d):
    """The majority of rule, tone and fusion for each segment, with its flags."""
    return ensemble_rows(spark, d).select("segment_id", "final_signal", "confidence", F.array_join("flags", ",").alias("flags"))


@query(f"""with {_ENS}, n as (select *, count(*) over (partition by final_signal) freq from ens),
p as (select segment_id, final_signal, case when confidence < 0.55 then 3 else 0 end + case when len(flags) > 0 then 3 else 0 end + case when freq <= 2 then 2 else 0 end + case when final_signal in ('risk_friction', 'uncertainty_hedging') then 1 else 0 end review_priority,
  array_to_string(list_filter([case when confidence < 0.55 then 'low_confidence' end, case when len(flags) > 0 then 'model_disagreement' end, case when freq <= 2 then 'rare_label' end, case when final_signal in ('risk_friction', 'uncertainty_hedging') then 'high_value_signal' end], lambda x: x is not null), ';') review_reason from n)
select *, cast(row_number() over (order by review_priority desc, cast(segment_id as varchar)) as int) rank from p where review_priority > 0 order by rank limit 50""")
def active_learning(spark, d):
    """The 50 segments with most points for review (a top-k report)."""
    return U.review_batch(ensemble_rows(spark, d), key="segment_id")
