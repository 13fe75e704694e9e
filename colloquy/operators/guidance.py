"""Guidance figures: similarity, revisions, and greedy matching with the period before."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.functions.text import round_significant

#: Two midpoints closer than this are the same.
EPSILON = 0.05


def statements(df: DataFrame, text: str, signed: str) -> DataFrame:
    """Rows whose text has a guidance cue, with topic, period, numbers, midpoint and the strength of the statement.

    signed: the signed score of the text's tone. Empty texts are no statements."""
    c, low = F.col(text), F.lower(F.col(text))
    g = df.where(T.strip(c) != "").withColumn("n_cues", T.phrase_count(c, L.GUIDANCE_CUES)).where("n_cues > 0")
    g = g.withColumns({
        "topic": T.argmax_topic(c, L.TOPICS, "other"), "period": T.period_tag(c), "numbers": T.numbers(c), "midpoint": T.midpoint(c), "count_numbers": F.size(T.numbers(c)),
        "has_percent": low.rlike(r"%|percent|bps|basis points"), "has_range": T.number_range(c).isNotNull(), "has_currency": low.rlike(r"\$|€|£|million|billion|bn\b|mm\b"),
    })
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    s = 0.4 * F.least(F.lit(1.0), F.col("count_numbers") / 4.0) + part(F.col("has_percent"), 0.15) + part(F.col("has_range"), 0.15) + part(F.col("has_currency"), 0.1)
    s = s + 0.2 * F.greatest(F.lit(0.0), F.col(signed)) + F.least(F.lit(0.1), 0.02 * F.col("n_cues"))
    return g.withColumn("guidance_strength", F.round(F.least(F.lit(1.0), s), 4))


def signature(numbers: Column) -> Column:
    """Sorted distinct numbers to three significant digits."""
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda x: F.round(round_significant(x), 6))))


def number_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two signatures, 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def revision(prior: Column, current: Column, prior_mid: Column, current_mid: Column, epsilon: float = EPSILON) -> Column:
    """unclear without both midpoints, mixed where aligned numbers move both ways, else raised, lowered or reaffirmed by the midpoint.
    A move of ``epsilon`` counts."""
    moves = F.transform(F.arrays_zip(prior.alias("a"), current.alias("b")), lambda x: x["b"] - x["a"])
    up, down = F.exists(moves, lambda m: m >= epsilon), F.exists(moves, lambda m: m <= -epsilon)
    diff = current_mid - prior_mid
    return (
        F.when(diff.isNull(), "unclear").when(up & down, "mixed").when(diff >= epsilon, "raised").when(diff <= -epsilon, "lowered").otherwise("reaffirmed")
    )


def match_prior(rows: DataFrame, *, key: str, threshold: float = 0.75) -> DataFrame:
    """Greedy 1:1 match of each statement with one of the period before, per key.

    rows: (key, period_no, rid, topic, period, sig). In order of rid each current row takes the
    unused prior row with the best number overlap plus bonuses for topic (.35, .175 for other)
    and period (.2, .1 for Unknown); the first of equal ones; matched from ``threshold`` on, which
    must be above what topic and period give together. Sequential by nature: each (key, period)
    with its prior rows goes through Python, where numbers are looked up, so that only rows
    which share one are compared; it holds the statements of one entity in two periods.
    """
    if threshold <= 0.55:
        raise ValueError("the threshold must need a shared number")
    cur = rows.withColumn("grp", F.col("period_no")).withColumn("side", F.lit("current"))
    pri = rows.withColumn("grp", F.col("period_no") + 1).withColumn("side", F.lit("prior"))
    types = dict(rows.dtypes)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        prior = pdf[pdf.side == "prior"].sort_values("rid").to_dict("records")
        sigs = [frozenset(p["sig"] if p["sig"] is not None else []) for p in prior]
        having: dict[float, list[int]] = {}  # a match needs a shared number
        for i, g in enumerate(sigs):
            for x in g:
                having.setdefault(x, []).append(i)
        free = Counter((p["topic"], p["period"]) for p in prior)
        topics, periods = Counter(p["topic"] for p in prior), Counter(p["period"] for p in prior)
        used: set[int] = set()
        out = []
        for c in pdf[pdf.side == "current"].sort_values("rid").to_dict("records"):
            a = frozenset(c["sig"] if c["sig"] is not None else [])
            by_topic, by_period = (0.175 if c["topic"] == "other" else 0.35), (0.1 if c["period"] == "Unknown" else 0.2)
            best, at = 0.0, None
            for i in sorted({i for x in a for i in having.get(x, ()) if i not in used}):
                p, b = prior[i], sigs[i]
                s = len(a & b) / len(a | b) + (by_topic if c["topic"] == p["topic"] else 0.0) + (by_period if c["period"] == p["period"] else 0.0)
                if s > best:
                    best, at = s, i
            # what those without a shared number reach
            if free[c["topic"], c["period"]]:
                rest = by_topic + by_period
            else:
                rest = max(by_topic if topics[c["topic"]] else 0.0, by_period if periods[c["period"]] else 0.0)
            hit = at is not None and best >= threshold and best >= rest
            if hit:
                used.add(at)
                p = prior[at]
                free[p["topic"], p["period"]] -= 1
                topics[p["topic"]] -= 1
                periods[p["period"]] -= 1
            out.append((c[key], c["rid"], prior[at]["rid"] if hit else None, round(max(best, rest), 6), hit))
        return pd.DataFrame(out, columns=[key, "rid", "prior_rid", "score", "matched"]).astype({"prior_rid": "Int64"})

    return cur.unionByName(pri).groupBy(key, "grp").applyInPandas(greedy, f"`{key}` {types[key]}, rid long, prior_rid long, score double, matched boolean")
