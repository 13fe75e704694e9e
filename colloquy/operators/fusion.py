"""Scores of segments from text, audio and video: probabilities, bounded adjustments, votes, and what to review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L

#: Which emotions are a negative tone.
NEGATIVE_EMOTIONS = ["anger", "frustration", "concern", "urgency"]
#: Families of which every segment is worth a look.
HIGH_VALUE = ["risk_friction", "uncertainty_hedging"]
#: Review buckets of the signals of each modality.
BUCKETS = {
    "uncertainty": "uncertainty_review", "hedging": "uncertainty_review", "pressure": "friction_review", "escalation_risk": "friction_review",
    "contradiction": "contradiction_review", "reassurance": "reassurance_review", "pause_length": "uncertainty_review",
    "volume_intensity_change": "friction_review", "motion_change_proxy": "friction_review",
}


def text_scores(df: DataFrame, family: str, emotion: str) -> DataFrame:
    """Adds rule_signal, signal_confidence, the probabilities p_<family>, sentiment and sentiment_confidence.

    family: struct of signals.weak_family; emotion: struct of signals.emotion."""
    label, sure = F.col(family)["label"], F.when(F.size(F.col(family)["evidence"]) > 0, 0.72).otherwise(0.44)
    rest = (1 - F.col("signal_confidence")) / (len(L.FAMILIES) - 1)
    mood = F.col(emotion)["label"]
    t = df.withColumns({"rule_signal": label, "signal_confidence": sure})
    t = t.withColumns({f"p_{f}": F.round(F.when(F.col("rule_signal") == f, F.col("signal_confidence")).otherwise(rest), 4) for f in L.FAMILIES})
    tone = F.when(mood == "satisfaction", "positive").when(mood.isin(NEGATIVE_EMOTIONS), "negative").otherwise("neutral")
    return t.withColumns({"sentiment": tone, "sentiment_confidence": F.round(F.col(emotion)["confidence"], 4)})


def fuse(text: DataFrame, audio: DataFrame, video: DataFrame, *, key: str) -> DataFrame:
    """Text probabilities p_<family> with the bounded adjustments of audio and video, renormalised: adds f_<family>,
    fused_signal and confidence.

    audio: (key, hesitation_score, confidence_score, intensity_score); video: (key, motion_intensity,
    stress_indicator); one row for each key. Segments without them are as their text; nothing left is uniform.
    Equal families go to the first in order."""
    part = lambda c, w, top: F.least(F.lit(top), F.coalesce(F.col(c), F.lit(0.0)) * w)
    j = text.join(audio.withColumn("_a", F.lit(True)), key, "left").join(video.withColumn("_v", F.lit(True)), key, "left")
    stress = F.coalesce(F.col("stress_indicator"), F.lit(0.0))
    add = {
        "risk_friction": part("intensity_score", 0.08, 0.12) + F.least(F.lit(0.10), F.coalesce(F.col("motion_intensity"), F.lit(0.0)) / 100 + stress * 0.05),
        "opportunity_commitment": part("confidence_score", 0.08, 0.10),
        "uncertainty_hedging": part("hesitation_score", 0.10, 0.14) + F.least(F.lit(0.08), stress * 0.08),
        "neutral": F.lit(0.0),
    }
    j = j.withColumns({f"f_{f}": F.greatest(F.lit(0.0), F.col(f"p_{f}") + add[f]) for f in L.FAMILIES})
    total = reduce(lambda a, b: a + b, (F.col(f"f_{f}") for f in L.FAMILIES))
    j = j.withColumn("_t", total)
    j = j.withColumns({f"f_{f}": F.round(F.when(F.col("_t") > 0, F.col(f"f_{f}") / F.col("_t")).otherwise(1 / len(L.FAMILIES)), 4) for f in L.FAMILIES})
    best = F.array_max(F.array(*(F.struct(F.col(f"f_{f}").alias("p"), F.lit(-i).alias("o"), F.lit(f).alias("f")) for i, f in enumerate(L.FAMILIES))))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.withColumns({"fused_signal": best["f"], "confidence": F.round(best["p"], 4), "has_audio": has("_a"), "has_video": has("_v")}).drop("_t", "_a", "_v")


def ensemble(df: DataFrame, votes: list[str], *, fallback: str, confidence: str, threshold: float = 0.55) -> DataFrame:
    """Adds final_signal (the most frequent vote, of equal ones the first cast, without votes the fallback) and
    the flags model_vote_disagreement and low_confidence."""
    from colloquy.operators.labels import majority

    cast = F.array_compact(F.array(*(F.nullif(F.col(v), F.lit("")) for v in votes)))
    t = df.withColumns({"final_signal": F.coalesce(majority(cast), F.col(fallback), F.lit("neutral")), "_n": F.size(F.array_distinct(cast))})
    flags = F.array_compact(F.array(F.when(F.col("_n") > 1, "model_vote_disagreement"), F.when(F.coalesce(F.col(confidence), F.lit(0.0)) < threshold, "low_confidence")))
    return t.withColumn("flags", flags).drop("_n")


def review_batch(df: DataFrame, *, key: str, limit: int = 50) -> DataFrame:
    """(key, final_signal, review_priority, review_reason, rank): the ``limit`` segments with most points for low
    confidence, disagreement, rare labels and families of high value; without points a segment is left out.

    df: (key, final_signal, confidence, flags). Labels are counted over all rows; a label of at most two is rare."""
    rare = df.groupBy("final_signal").agg(F.count(F.lit(1)).alias("_n")).where("_n <= 2").withColumn("_rare", F.lit(True)).drop("_n")
    j = df.join(rare, "final_signal", "left")
    reasons = [
        ("low_confidence", 3, F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.55), ("model_disagreement", 3, F.size("flags") > 0),
        ("rare_label", 2, F.coalesce(F.col("_rare"), F.lit(False))), ("high_value_signal", 1, F.col("final_signal").isin(HIGH_VALUE)),
    ]
    points = reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for _, p, c in reasons))
    why = F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, _, c in reasons))), ";")
    t = j.select(key, "final_signal", points.alias("review_priority"), why.alias("review_reason")).where("review_priority > 0")
    order = [F.desc("review_priority"), F.col(key).cast("string")]
    top = t.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse_buckets(signals: DataFrame, *, key: str) -> DataFrame:
    """signals: (key, modality, signal, strength, confidence). (key, bucket, modalities, strength, confidence, n):
    signals of all modalities by review bucket; without a transcript's signal confidence is at most 0.42, two
    signals of 0.45 or more raise it by 0.05. Signals without a bucket are left out."""
    known = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))
    t = signals.withColumn("bucket", F.try_element_at(known, F.col("signal"))).where("bucket is not null")
    g = t.groupBy(key, "bucket").agg(
        F.array_sort(F.collect_set("modality")).alias("modalities"), F.max("confidence").alias("base"), F.count_if(F.col("confidence") >= 0.45).alias("strong"),
        F.bool_or(F.col("strength") == "high").alias("high"), F.bool_or(F.col("strength") == "medium").alias("medium"), F.count(F.lit(1)).alias("n"),
    )
    anchor = F.array_contains("modalities", "transcript")
    strength = F.when(anchor & F.col("high") & (F.col("n") >= 2), "high").when(F.col("high") | F.col("medium"), "medium").otherwise("low")
    sure = F.when(~anchor, F.least(F.col("base"), F.lit(0.42))).when(F.col("strong") >= 2, F.least(F.lit(0.82), F.col("base") + 0.05)).otherwise(F.least(F.lit(0.78), F.col("base")))
    return g.select(key, "bucket", F.array_join("modalities", ",").alias("modalities"), strength.alias("strength"), F.round(sure, 4).alias("confidence"), "n")
