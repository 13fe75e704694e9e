"""Cleaning and evidence of a corpus of transcripts: lines, sections, headed turns, guidance and signals of sentences,
labels from them, and their match with gold spans. Offsets count characters from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators.transcripts import with_offsets

#: Lines that are dropped, what opens questions and answers, and markers of calls.
DROPPED_LINES = [r"^\s*advertisement\s*$", r"^\s*related articles\s*$", r"^\s*recommended stories\s*$", r"^\s*read more\s*$", r"^\s*copyright .* rights reserved\s*$"]
QA_LINE = r"^\s*(question-and-answer|questions and answers|questions & answers|q&a|q and a|question and answer|question & answer)\b"
QA_TRANSITION = (
    r"(open (?:the )?(?:call )?(?:up )?(?:for|to) questions|open for questions|operator,? (?:please )?(?:poll for|open|may we have|get|could we get) (?:the )?(?:first |next )?question"
    r"|(?:head over|move on) to (?:investor|analyst) questions|(?:first|next) (?:analyst )?question (?:is|comes|will be|from)|we will now (?:be )?(?:taking|take) (?:a )?question)"
)
OPERATOR_LINE = r"^\s*operator\s*$"
CALL_MARKERS = ["operator", "question-and-answer", "questions and answers", "q&a", "analyst", "prepared remarks", "conference call", "earnings call"]
#: Headings of turns, and headings that name nobody.
HEADING = r"[A-Z][A-Za-z .,'&/-]{1,80}"
NO_SPEAKERS = ["prepared remarks", "question-and-answer session", "question and answer session", "questions and answers", "corporate participants", "conference call participants", "presentation"]
ANALYST_NAMES = ["analyst", "securities", "capital", "bank", "morgan", "goldman", "ubs", "j.p.", "rbc", "barclays"]
EXECUTIVE_NAMES = ["ceo", "cfo", "president", "chief", "officer", "founder", "chair"]
#: Guidance of a sentence (direction, rule, pattern), in order; metrics in order.
GUIDANCE = [
    ("up", "raised_guidance", r"\b(raise|raises|raised|raising|increase|increased|increasing)\b.{0,80}\b(guidance|outlook|forecast|revenue|eps)\b"),
    ("up", "guidance_raised_reverse", r"\b(guidance|outlook|forecast|revenue|eps)\b.{0,80}\b(raise|raised|higher|above|up from|increase|increased)\b"),
    ("down", "lowered_guidance", r"\b(lower|lowered|lowering|reduce|reduced|cut|down)\b.{0,80}\b(guidance|outlook|forecast|revenue|eps)\b"),
    ("down", "guidance_lowered_reverse", r"\b(guidance|outlook|forecast|revenue|eps)\b.{0,80}\b(lower|lowered|reduced|cut|down)\b"),
    ("unchanged", "reaffirmed_guidance", r"\b(reaffirm|reaffirmed|maintain|maintained|reiterate|reiterated)\b.{0,80}\b(guidance|outlook|forecast)\b"),
]
METRICS = ["revenue", "eps", "margin", "operating income", "capex", "free cash flow", "guidance", "outlook"]
COMMITMENT = [r"\bcommitted to\b", r"\bwe will continue\b", r"\bwe remain confident\b", r"\bwell positioned\b", r"\bon track\b"]
RISK = [r"\bmargin pressure\b", r"\bdemand softness\b", r"\bweakness\b", r"\brisk\b", r"\bheadwind\b"]
#: Features of the reference: at most so many guidance sentences and signals of a text.
MAX_GUIDANCE, GUIDANCE_SIGNALS, SCAN_SIGNALS, MAX_SIGNALS = 20, 8, 80, 50


def clean_transcripts(df: DataFrame, *, row: str, text: str) -> DataFrame:
    """(row, clean, n_encoding, n_repeated, n_boilerplate): texts without boilerplate lines, the fifth and later
    occurrences of a short line, repeats of the line before, and more than one blank line in a row.

    Null texts have no row; an empty one becomes a line end."""
    t = df.where(F.col(text).isNotNull()).select(row, F.regexp_replace(F.replace(F.col(text), F.lit("﻿"), F.lit("")), r"\r\n|\r", "\n").alias("t"))
    t = t.withColumn("n_encoding", F.length("t") - F.length(F.replace("t", F.lit("�"), F.lit(""))))
    lines = t.select(row, "n_encoding", F.posexplode(F.split(F.replace("t", F.lit("�"), F.lit("")), "\n")).alias("i", "x"))
    lines = lines.withColumn("line", T.strip(F.regexp_replace("x", r"[ \t]+", " "))).drop("x")
    by = Window.partitionBy(row).orderBy("i")
    blank, low = F.col("line") == "", F.lower("line")
    lines = lines.withColumns({"blank": blank, "low": low, "blanks": F.sum(blank.cast("int")).over(by), "boiler": ~blank & T.any_pattern(low, DROPPED_LINES)})
    seen = F.row_number().over(Window.partitionBy(row, "low", "blank", "boiler").orderBy("i"))
    lines = lines.withColumn("nav", ~F.col("blank") & ~F.col("boiler") & (seen > 4) & (F.length("line") < 120))
    live = lines.withColumn("live", ~F.col("blank") & ~F.col("boiler") & ~F.col("nav"))
    alive = Window.partitionBy(row, "live").orderBy("i")
    live = live.withColumn("again", F.col("live") & F.coalesce(F.lag("line").over(alive) == F.col("line"), F.lit(False)))
    live = live.withColumn("keep", F.col("live") & ~F.col("again"))
    before = F.lag("blanks").over(Window.partitionBy(row, "keep").orderBy("i"))
    gap = F.when(before.isNull(), "").when(F.col("blanks") > before, "\n\n").otherwise("\n")
    live = live.withColumn("piece", F.when(F.col("keep"), F.concat(gap, "line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("i", "piece")))), lambda x: x["piece"]), "")
    g = live.groupBy(row).agg(body.alias("b"), F.first("n_encoding").alias("n_encoding"), F.count_if("again").alias("n_repeated"), F.count_if(F.col("boiler") | F.col("nav")).alias("n_boilerplate"))
    return g.select(row, F.concat("b", F.lit("\n")).alias("clean"), "n_encoding", "n_repeated", "n_boilerplate")


def qa_start(c: Column) -> Column:
    """Offset of questions and answers: a line that says so, else a phrase of transition, else the second line of the operator; null without."""
    at = lambda p, flags: F.when(c.rlike(f"({flags}){p}"), F.length(F.regexp_extract(c, rf"({flags}s)\A(.*?){p}", 1)))
    twice = rf"(?imds)\A(.*?{OPERATOR_LINE}.*?){OPERATOR_LINE}"
    return F.coalesce(at(QA_LINE, "?imd"), at(QA_TRANSITION, "?id"), F.when(c.rlike(twice), F.length(F.regexp_extract(c, twice, 1))))


def qa_sections(c: Column) -> Column:
    """Struct of prepared_remarks, q_and_a and unknown, stripped; unknown where nothing opens questions."""
    at = qa_start(c)
    has = at.isNotNull()
    return F.struct(
        F.when(has, T.strip(F.substring(c, F.lit(1), at))).otherwise("").alias("prepared_remarks"), F.when(has, T.strip(F.substring(c, at + 1, F.length(c)))).otherwise("").alias("q_and_a"),
        F.when(has, "").otherwise(T.strip(c)).alias("unknown"),
    )


def marker_flags(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.struct(
        low.contains("operator").alias("operator"), T.any_phrase(low, ["question-and-answer", "questions and answers", "q&a", "question and answer"]).alias("q_and_a"),
        T.any_phrase(low, ["safe harbor", "forward-looking", "actual results may differ"]).alias("safe_harbor"), T.any_phrase(low, CALL_MARKERS).alias("any_marker"),
    )


def classify_role(speaker: Column, raw_role: Column, body: Column, section: Column) -> Column:
    """operator, analyst, executive or unknown, by the name, a question at the start of an answer, and the section."""
    who = F.lower(F.concat_ws(" ", speaker, F.coalesce(raw_role, F.lit(""))))
    return (
        F.when(who.contains("operator"), "operator").when(T.any_phrase(who, ANALYST_NAMES), "analyst").when((section == "q_and_a") & F.substring(body, 1, 500).contains("?"), "analyst")
        .when(T.any_phrase(who, EXECUTIVE_NAMES), "executive").when(section == "prepared_remarks", "executive").otherwise("unknown")
    )


def headed_turns(df: DataFrame, *, row: str, text: str, least: int = 20) -> DataFrame:
    """(row, turn_no, speaker, role, section, start, end, body): turns under a heading line with a name, of at least
    ``least`` characters; a text without any is one turn of an unknown speaker."""
    head = rf"{HEADING}(?:\s+-\s*[^:\n]{{1,80}})?\s*$"
    docs = df.where(F.col(text).isNotNull()).select(row, F.col(text).alias("text"), qa_start(F.col(text)).alias("qa"))
    t = docs.select(row, "qa", F.length("text").alias("n"), F.posexplode(with_offsets(F.split("text", rf"(?md)(?=^{head})"))).alias("i", "x"))
    p = F.col("x.piece")
    lead = F.regexp_extract(p, rf"(?md)\A({head})", 1)
    name = F.regexp_extract(p, rf"(?md)\A({HEADING})(?:\s+-\s*([^:\n]{{1,80}}))?\s*$", 1)
    raw = F.regexp_extract(p, rf"(?md)\A({HEADING})(?:\s+-\s*([^:\n]{{1,80}}))?\s*$", 2)
    t = t.select(row, "qa", "n", "i", p.alias("piece"), F.col("x.pos").alias("pos"), lead.alias("lead"), name.alias("name"), F.lower(raw).alias("raw"))
    real = (F.col("lead") != "") & ~F.lower(T.strip(F.col("name"))).isin(NO_SPEAKERS)
    # headings that name nobody, and what comes before the first one, belong to the turn before
    w = Window.partitionBy(row).orderBy("i")
    t = t.withColumn("g", F.sum(real.cast("int")).over(w)).where("g > 0")
    order = F.array_sort(F.collect_list(F.struct("i", "piece", "lead", "name", "raw", "pos")))
    g = t.groupBy(row, "g", "qa").agg(order.alias("a"))
    first = F.get("a", 0)
    whole = F.array_join(F.transform("a", lambda x: x["piece"]), "")
    g = g.select(row, "g", "qa", (first["pos"] + F.length(first["lead"])).alias("start"), (first["pos"] + F.length(whole)).alias("end"), T.strip(F.expr("substring(array_join(transform(a, x -> x.piece), ''), length(a[0].lead) + 1)")).alias("body"), T.strip(F.regexp_replace(first["name"], r"\s+", " ")).alias("speaker"), first["raw"].alias("raw"))
    g = g.where(F.length("body") >= least)
    section = F.when(F.col("qa").isNull(), "unknown").when(F.col("start") < F.col("qa"), "prepared_remarks").otherwise("q_and_a")
    g = g.withColumn("section", section)
    out = g.select(row, (F.row_number().over(Window.partitionBy(row).orderBy("g")) - 1).alias("turn_no"), "speaker", classify_role(F.col("speaker"), F.col("raw"), F.col("body"), F.col("section")).alias("role"), "section", "start", "end", "body")
    rest = docs.join(out.select(row).distinct(), row, "left_anti")
    return out.unionByName(rest.select(row, F.lit(0).alias("turn_no"), F.lit("Unknown").alias("speaker"), F.lit("unknown").alias("role"), F.lit("unknown").alias("section"), F.lit(0).alias("start"), F.length("text").alias("end"), T.strip(F.col("text")).alias("body")))


_SENTENCE = r"[^.!?\n]+(?:[.!?]+|\n?\z)"


def sentence_spans(c: Column, least: int = 20) -> Column:
    """Array of (start, end, sentence): sentences within a line, trimmed, of at least ``least`` characters."""
    pre, sen = (F.regexp_extract_all(c, F.lit(rf"(?s)(.*?)({_SENTENCE})"), i) for i in (1, 2))
    step = lambda s, x: F.struct((s["pos"] + F.length(x["p"]) + F.length(x["s"])).alias("pos"), F.concat(s["out"], F.array(F.struct((s["pos"] + F.length(x["p"])).alias("at"), x["s"].alias("s")))).alias("out"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,s:string>>").alias("out"))
    spans = F.aggregate(F.arrays_zip(pre.alias("p"), sen.alias("s")), zero, step)["out"]
    cut = F.transform(spans, lambda x: F.struct((x["at"] + F.length(x["s"]) - F.length(F.ltrim(x["s"], F.lit(T.WHITE)))).alias("start"), T.strip(x["s"]).alias("s")))
    return F.transform(F.filter(cut, lambda x: F.length(x["s"]) >= least), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["s"])).alias("end"), x["s"].alias("sentence")))


def infer_metric(c: Column) -> Column:
    low, out = F.lower(c), F.lit("guidance")
    for m in reversed(METRICS):
        out = F.when(low.contains(m), m).otherwise(out)
    return out


def guidance_sentences(df: DataFrame, *, row: str, text: str) -> DataFrame:
    """(row, k, metric, direction, rule, confidence, start, end, sentence): sentences with guidance, the first rule of each, the first 20 of a text."""
    s = df.where(F.col(text).isNotNull()).select(row, F.inline(sentence_spans(F.col(text))))
    low, hit = F.lower("sentence"), F.lit(None)
    for direction, name, p in reversed(GUIDANCE):
        hit = F.when(low.rlike(p), F.struct(F.lit(direction).alias("direction"), F.lit(name).alias("rule"))).otherwise(hit)
    g = s.withColumn("h", hit).where("h is not null").withColumn("k", F.row_number().over(Window.partitionBy(row).orderBy("start"))).where(F.col("k") <= MAX_GUIDANCE)
    return g.select(row, "k", infer_metric(F.col("sentence")).alias("metric"), "h.direction", "h.rule", F.lit(0.72).alias("confidence"), "start", "end", "sentence")


def at_span(df: DataFrame, turns: DataFrame, *, row: str, pos: str) -> DataFrame:
    """df with speaker and section of the first turn that holds ``pos``, both ends inclusive; Unknown and unknown without one."""
    t = turns.select(row, F.struct("turn_no", "speaker", "section").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    keys = df.columns
    j = df.join(t, row, "left").withColumn("_t", F.when(F.col(pos).between(F.col("_s"), F.col("_e")), F.col("_t")))
    g = j.groupBy(*keys).agg(F.min("_t").alias("_t"))
    return g.select(*keys, F.coalesce("_t.speaker", F.lit("Unknown")).alias("speaker"), F.coalesce("_t.section", F.lit("unknown")).alias("section"))


def signals(df: DataFrame, turns: DataFrame, *, row: str, text: str) -> DataFrame:
    """(row, k, signal, confidence, direction, start, end, section, speaker): signals of each text, the most confident first.

    The first guidance sentences, then those of turns by their role: analysts' doubts; caution, and one of
    commitment, risk and reassurance, of executives and unknowns. Turns are scanned up to the one that brings
    the signals to 80; equal spans of a signal count once; at most 50 are kept. A text without any is neutral."""
    guide = guidance_sentences(df, row=row, text=text).where(F.col("k") <= GUIDANCE_SIGNALS)
    way = F.when(F.col("direction") == "up", "positive").when(F.col("direction") == "down", "negative").otherwise("neutral")
    guide = at_span(guide.select(row, F.col("k").alias("n"), "confidence", way.alias("direction"), "start", "end"), turns, row=row, pos="start")
    s = turns.select(row, "turn_no", "role", "section", "speaker", F.col("start").alias("t0"), F.posexplode(sentence_spans(F.col("body"))).alias("i", "x"))
    low = F.lower("x.sentence")

    def by_rules(rules, base: float, top: float) -> Column:
        out = F.lit(None).cast("double")
        for *_, p, strength in reversed(rules):
            out = F.when(low.rlike(p), min(top, base + strength / 10)).otherwise(out)
        return out

    speaks = F.col("role").isin("executive", "unknown")
    sure = {"doubt": by_rules(L.SKEPTICISM_RULES, 0.45, 0.85), "caution": by_rules(L.UNCERTAINTY_RULES, 0.40, 0.85), "calm": by_rules(L.REASSURANCE_RULES, 0.45, 0.82)}
    s = s.withColumns({**sure, "commit": T.any_pattern(low, COMMITMENT), "risk": T.any_pattern(low, RISK)})
    cell = lambda name, c, d: F.struct(F.lit(name).alias("signal"), c.alias("confidence"), F.lit(d).alias("direction"))
    found = F.array_compact(F.array(
        F.when((F.col("role") == "analyst") & F.col("doubt").isNotNull(), cell("analyst_pressure", F.col("doubt"), "negative")),
        F.when(speaks & F.col("caution").isNotNull(), cell("uncertainty", F.col("caution"), "negative")),
        F.when(speaks & F.col("commit"), cell("commitment", F.lit(0.66), "positive")).when(speaks & F.col("risk"), cell("risk_friction", F.lit(0.58), "negative"))
        .when(speaks & F.col("calm").isNotNull(), cell("opportunity_commitment", F.col("calm"), "positive")),
    ))
    s = s.select(row, "turn_no", "i", "section", "speaker", (F.col("t0") + F.col("x.start")).alias("start"), (F.col("t0") + F.col("x.end")).alias("end"), F.posexplode(found).alias("j", "f"))
    per = s.groupBy(row, "turn_no").agg(F.count(F.lit(1)).alias("c"))
    head = guide.groupBy(row).agg(F.count(F.lit(1)).alias("g"))
    w = Window.partitionBy(row).orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(head, row, "left").withColumn("before", F.coalesce("g", F.lit(0)) + F.coalesce(F.sum("c").over(w), F.lit(0)))
    s = s.join(per.where(F.col("before") < SCAN_SIGNALS).select(row, "turn_no"), [row, "turn_no"])
    s = s.select(row, F.col("f.signal").alias("signal"), F.round("f.confidence", 3).alias("confidence"), F.col("f.direction").alias("direction"), "start", "end", "section", "speaker", F.struct(F.lit(1).alias("p"), "turn_no", "i", "j").alias("o"))
    zero = F.lit(0)
    guide = guide.select(row, F.lit("guidance_revision").alias("signal"), F.round("confidence", 3).alias("confidence"), "direction", "start", "end", "section", "speaker", F.struct(zero.alias("p"), F.col("n").alias("turn_no"), zero.alias("i"), zero.alias("j")).alias("o"))
    every = guide.unionByName(s)
    best = F.row_number().over(Window.partitionBy(row, "signal", "start", "end").orderBy(F.desc("confidence"), "o"))
    every = every.withColumn("d", best).where("d = 1").withColumn("k", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("confidence"), "start", "o")))
    every = every.where(F.col("k") <= MAX_SIGNALS).drop("d", "o")
    none = df.where(F.col(text).isNotNull()).join(every.select(row).distinct(), row, "left_anti")
    first = F.get(sentence_spans(F.col(text)), 0)
    none = none.select(row, F.lit(1).alias("k"), F.lit("neutral").alias("signal"), F.lit(0.25).alias("confidence"), F.lit("neutral").alias("direction"), F.coalesce(first["start"], F.lit(0)).alias("start"), F.coalesce(first["end"], F.least(F.length(text), F.lit(250))).alias("end"), F.lit("unknown").alias("section"), F.lit("Unknown").alias("speaker"))
    return every.unionByName(none)


def labels_of_signals(signal: DataFrame) -> DataFrame:
    """Signals as weak labels: other kinds become commitment or uncertainty, confidence is at most 0.75."""
    known = F.col("signal").isin("guidance_revision", "uncertainty", "analyst_pressure", "commitment", "neutral")
    kind = F.when(known, F.col("signal")).when(F.col("signal") == "opportunity_commitment", "commitment").otherwise("uncertainty")
    return signal.withColumns({"label": kind, "confidence": F.least("confidence", F.lit(0.75))})


def match_spans(gold: DataFrame, weak: DataFrame, *, key: str) -> DataFrame:
    """(key, gold_no, weak_no, overlap): each gold span, in order, with the unused weak span of its key that overlaps it most,
    the first of equal ones; null without.

    gold and weak: (key, no, start, end). Candidates come from a bucketed overlap join, so that only
    overlapping spans are compared; taking them in order goes through Python, key by key, as candidates only."""
    from colloquy.operators.series import overlaps, ordered_scan

    g = gold.select(key, F.col("no").alias("lid"), F.col("start").cast("double").alias("ls"), F.col("end").cast("double").alias("le"))
    r = weak.select(key, F.col("no").alias("rid"), F.col("start").cast("double").alias("rs"), F.col("end").cast("double").alias("re"))
    c = gold.select(key, F.col("no").alias("gold_no")).join(overlaps(g, r, key=key, width=512.0).withColumnRenamed("lid", "gold_no"), [key, "gold_no"], "left")
    types = dict(gold.dtypes)

    def step(state, row):
        used, best = state if state else (set(), None)
        out = []
        if best is not None and (row is None or row[1] != best[1]):
            out.append(tuple(best))
            if best[2] is not None:
                used.add(best[2])
            best = None
        if row is not None:
            k, no, rid, o = row
            if best is None:
                best = [k, no, None, 0.0]
            if rid is not None and rid not in used and o > best[3]:
                best[2], best[3] = rid, o
        return (used, best), out

    rows = c.select(key, "gold_no", F.col("rid").cast("long").alias("rid"), F.coalesce("overlap", F.lit(0.0)).alias("o"))
    rows = rows.withColumn("gold_no", F.col("gold_no").cast("long"))
    return ordered_scan(rows, [key], ["gold_no", "rid"], step, f"`{key}` {types[key]}, gold_no long, weak_no long, overlap double")


def span_scores(gold: DataFrame, weak: DataFrame, *, key: str, slack: int = 5) -> DataFrame:
    """(key, n_gold, n_weak, matched, missed, extra, type_match, type_mismatch, exact, overlap_only) of the spans of each key that has gold ones.

    gold and weak: (key, no, start, end, label). exact: same label and both ends within ``slack``."""
    m = match_spans(gold, weak, key=key)
    g = gold.select(key, F.col("no").alias("gold_no"), F.col("label").alias("gl"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    w = weak.select(key, F.col("no").alias("weak_no"), F.col("label").alias("wl"), F.col("start").alias("ws"), F.col("end").alias("we"))
    j = m.join(g, [key, "gold_no"]).join(w, [key, "weak_no"], "left")
    hit, same = F.col("weak_no").isNotNull(), F.col("gl").eqNullSafe(F.col("wl")) & F.col("weak_no").isNotNull()
    exact = same & (F.abs(F.col("ws") - F.col("gs")) <= slack) & (F.abs(F.col("we") - F.col("ge")) <= slack)
    s = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_gold"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("missed"), F.count_if(same).alias("type_match"), F.count_if(hit & ~same).alias("type_mismatch"),
        F.count_if(exact).alias("exact"), F.count_if(same & ~exact).alias("overlap_only"),
    )
    n = weak.groupBy(key).agg(F.count(F.lit(1)).alias("n_weak"))
    return s.join(n, key, "left").fillna(0, ["n_weak"]).withColumn("extra", F.col("n_weak") - F.col("matched"))
