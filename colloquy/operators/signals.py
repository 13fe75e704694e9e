"""Rule classifiers as column expressions: signal families, emotions, candidates, suppression, sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T

NONE = "array<string>"


def guidance_override(low: Column) -> Column:
    """Struct of family and evidence where guidance language of a lower text decides by itself, else null."""
    out = F.lit(None)
    for family, term, patterns in reversed(L.GUIDANCE_OVERRIDES):
        out = F.when(T.any_pattern(low, patterns), F.struct(F.lit(family).alias("label"), F.lit(term).alias("term"))).otherwise(out)
    return out


def lexicon_terms(t: Column, lexicon: dict[str, list[str]], limit: int = 8) -> dict[str, Column]:
    """Terms found in a plain text of each category of a lexicon, in order, at most ``limit``. Categories without terms find nothing."""
    return {k: T.terms_in(t, sorted({w.lower() for w in v if w.strip()}), limit) if v else F.array().cast(NONE) for k, v in lexicon.items()}


def _minus(found: Column, generic: list[str]) -> Column:
    return F.filter(found, lambda t: ~t.isin(generic))


def with_weak_family(df: DataFrame, text: str, lexicon: dict[str, list[str]] | None = None, to: str = "w") -> DataFrame:
    """Adds ``to``, a struct (label, confidence, risk, opportunity, uncertainty, evidence) of the text's signal family.

    Guidance language decides first, with a score of 3 and a confidence of 0.75. Else the score of a
    family is twice its terms plus those of the finance lexicon (negative, positive, uncertainty,
    litigious, modal and constraining words, none by default); generic terms count only in their
    contexts; risk wins ties, then opportunity; nothing found is neutral with confidence 0. Null is
    empty text. Built in steps, so that no step repeats another's work."""
    keep = df.columns
    low, t, none = F.col("_low"), F.col("_t"), F.array().cast(NONE)
    s = df.withColumns({"_low": F.lower(F.coalesce(F.col(text), F.lit(""))), "_t": T.plain(F.col(text))})
    fin = lexicon_terms(t, lexicon or {})
    pick = lambda *ks: F.slice(F.array_distinct(F.concat(none, *(fin[k] for k in ks if k in fin))), 1, 8)
    any_in = lambda words: reduce(lambda a, b: a | b, (T.term_in(t, w) for w in words))
    s = s.withColumns({
        "_r": T.terms_in(t, L.RISK_TERMS), "_o": T.terms_in(t, L.OPPORTUNITY_TERMS), "_u": T.terms_in(t, L.UNCERTAINTY_TERMS), "_fr": pick("negative", "litigious", "constraining"),
        "_fo": pick("positive"), "_fu": pick("uncertainty", "modal"), "_so": any_in(L.STRONG_OPPORTUNITY), "_sr": any_in(L.STRONG_RISK), "_cond": T.any_pattern(low, L.CONDITIONAL),
        "_neutral": T.any_pattern(low, L.NEUTRAL_STATUS), "_def": low.contains("please check the help center") | low.contains("please refer"), "_over": guidance_override(low),
    })
    s = s.withColumns({"_cond": F.col("_cond") & ~F.col("_so"), "_status": F.col("_neutral") & ~F.col("_sr"), **{f"_{k}": F.array_distinct(F.concat(f"_{k}", f"_f{k}")) for k in "rou"}})
    drop = lambda c, words: F.filter(c, lambda x: ~x.isin(words))
    s = s.withColumns({
        "_r": F.when(F.col("_status"), drop("_r", L.GENERIC_RISK)).otherwise(F.col("_r")),
        "_o": F.when(F.col("_cond") | (F.col("_status") & ~F.col("_so")), drop("_o", L.GENERIC_OPPORTUNITY)).otherwise(F.col("_o")),
        "_u": F.when(F.col("_cond"), F.array_distinct(F.concat("_u", T.lits(["conditional_language"])))).otherwise(F.col("_u")),
    })
    s = s.withColumns({
        "_r": F.when(F.col("_def"), F.array_distinct(F.concat("_r", T.lits(["support_deflection"])))).otherwise(F.col("_r")),
        "_u": F.when(F.col("_def"), drop("_u", ["for now"])).otherwise(F.col("_u")),
    })
    s = s.withColumns({f"_p{k}": 2 * F.size(f"_{k}") + F.size(f"_f{k}") for k in "rou"}).withColumn("_best", F.greatest("_pr", "_po", "_pu"))
    best, over = F.col("_best"), F.col("_over")
    s = s.withColumn("_i", F.when(best == 0, 4).when(F.col("_pr") == best, 1).when(F.col("_po") == best, 2).otherwise(3))
    given = over.isNotNull()
    score = lambda k, f: F.when(given, F.when(over["label"] == f, 3).otherwise(0)).otherwise(F.col(f"_p{k}"))
    out = F.struct(
        F.when(given, over["label"]).otherwise(F.element_at(T.lits(L.FAMILIES), F.col("_i"))).alias("label"),
        F.when(given, 0.75).otherwise(F.round(F.least(F.lit(0.95), best / 6), 4)).alias("confidence"),
        score("r", L.FAMILIES[0]).alias("risk"), score("o", L.FAMILIES[1]).alias("opportunity"), score("u", L.FAMILIES[2]).alias("uncertainty"),
        F.when(given, F.array(over["term"])).otherwise(F.element_at(F.array("_r", "_o", "_u", none), F.col("_i"))).alias("evidence"),
    )
    return s.select(*keep, out.alias(to))


def with_emotion(df: DataFrame, text: str, labels: list[str] | None = None, to: str = "emotion") -> DataFrame:
    """Adds ``to``, a struct (label, confidence) by weighted keywords: the highest score, then the most keywords, then
    neutral and the order of emotions. ``labels`` restricts the emotions; null is empty text."""
    allowed = [e for e in L.EMOTIONS if labels is None or e in labels]
    if not allowed:
        raise ValueError("no known emotion among the labels")
    keep = df.columns
    s = df.withColumn("_t", T.compact(F.coalesce(F.col(text), F.lit(""))))
    s = s.withColumn("_pad", F.concat(F.lit(" "), F.regexp_replace("_t", "[^a-z0-9]+", " "), F.lit(" ")))
    has = lambda k: F.col("_t").contains(k) if " " in k else F.col("_pad").contains(f" {k} ")
    add = lambda cells: reduce(lambda a, b: a + b, cells)
    first = "neutral" if "neutral" in allowed else allowed[0]
    order = [first, *(e for e in L.EMOTION_ORDER if e in allowed and e != first)]
    cell = lambda e: F.struct(add(F.when(has(k), w).otherwise(0.0) for k, w in L.EMOTIONS[e]).alias("s"), add(has(k).cast("int") for k, _ in L.EMOTIONS[e]).alias("n"), F.lit(-order.index(e)).alias("o"), F.lit(e).alias("e"))
    s = s.withColumn("_c", F.array(*(cell(e) for e in allowed)))
    s = s.withColumns({"_b": F.array_max("_c"), "_total": F.aggregate("_c", F.lit(0.0), lambda x, y: x + y["s"])})
    b = F.col("_b")
    sure = F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.95), b["s"] / F.col("_total") + 0.03 * b["n"])), 4)
    none = F.when(F.col("_t") == "", 0.35).otherwise(0.42 if first == "neutral" else 0.34)
    return s.select(*keep, F.struct(F.when(b["s"] > 0, b["e"]).otherwise(first).alias("label"), F.when(b["s"] > 0, sure).otherwise(none).alias("confidence")).alias(to))


def candidate(c: Column, section: Column, topic: Column, object_type: Column) -> Column:
    """Struct (label, confidence) by the first candidate rule whose phrase is in the text or topic; analysts'
    pressure only counts in questions and answers or evidence objects."""
    low, top = F.lower(F.coalesce(c, F.lit(""))), F.lower(F.coalesce(topic, F.lit("")))
    sec, kind = F.lower(F.coalesce(section, F.lit(""))), F.lower(F.coalesce(object_type, F.lit("")))
    cell = lambda label, p: F.struct(F.lit(label).alias("label"), F.lit(p).alias("confidence"))
    out = F.when(top == "guidance_revision_candidate", cell("guidance_revision", 0.78)).when(top == "guidance_statement", cell("guidance_statement", 0.74)).otherwise(cell("neutral/no_signal", 0.2))
    for label, phrases, p in reversed(L.CANDIDATE_RULES):
        hit = T.any_phrase(low, phrases) | T.any_phrase(top, phrases)
        if label == "analyst_pressure":
            hit = hit & (sec.contains("qa") | (kind == "evidence_object"))
        out = F.when(hit, cell(label, p)).otherwise(out)
    return out


def candidate_suppression(c: Column, section: Column, topic: Column) -> Column:
    """Why a candidate is suppressed, or empty: section or topic, then markers in order, then optimism and history."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(low.contains("great quarter") & ~T.any_phrase(low, ["guidance", "outlook", "expect", "pressure", "uncertain"]), "generic_optimism")
    out = out.when(low.contains("last year") & ~T.any_phrase(low, ["guidance", "outlook", "expect", "revis"]), "historical_only_results").otherwise("")
    for marker, reason in reversed(L.SUPPRESSION_MARKERS.items()):
        out = F.when(low.contains(marker), reason).otherwise(out)
    for c in (topic, section):
        v = F.lower(F.coalesce(c, F.lit("")))
        out = F.when(v.isin("safe_harbor", "operator"), v).otherwise(out)
    return out


def event_suppression(c: Column) -> Column:
    """Why a span of a transcript is suppressed, or empty; the first of six rules."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *p: T.any_phrase(low, list(p))
    return (
        F.when(has("safe harbor", "forward-looking"), "safe_harbor").when(has("non-gaap", "non gaap"), "non_gaap")
        .when(has("operator") & has("instructions", "queue"), "operator_instructions").when(has("excited", "pleased"), "generic_optimism")
        .when(has("last year") & ~has("guidance"), "historical_only_results").when(has("factset", "refinitiv", "callstreet"), "vendor_disclaimer").otherwise("")
    )


def historical_only(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return T.any_phrase(low, L.HISTORICAL) & ~T.any_phrase(low, L.CURRENT)


def period_present(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike(r"\b(20\d{2}|fy\s?\d{2,4}|q[1-4]|quarter|year|annual|full year)\b")


def likely_boilerplate(c: Column) -> Column:
    """Boilerplate that isn't about the business, or a greeting of fewer than seven words."""
    t = T.compact(F.coalesce(c, F.lit("")))
    short = (F.size(F.split(t, " ")) < 7) & t.rlike(L.REVIEW_GREETING)
    return (t != "") & ((t.rlike(L.REVIEW_BOILERPLATE) & ~t.rlike(L.REVIEW_BUSINESS)) | short)


def triggers(c: Column) -> Column:
    """Names of the risk triggers in a text, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in L.RISK_TRIGGERS)))


def lexicon_sentiment(c: Column) -> Column:
    """Struct (label, score): the default scorer of sentiment, by words; a model's columns may stand in for it."""
    ts = T.tokens(c)
    up, down = (F.size(F.filter(ts, lambda t: t.isin(words))) for words in (L.SENTIMENT_UP, L.SENTIMENT_DOWN))
    label = F.when(up > down, "POSITIVE").when(up < down, "NEGATIVE").otherwise("NEUTRAL")
    return F.struct(label.alias("label"), F.round(0.5 + 0.5 * F.abs(up - down) / (up + down + 1), 4).alias("score"))
