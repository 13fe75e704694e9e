"""Sections, speaker turns, typed chunks and rule candidates of transcript texts. Offsets count characters from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import signals as S

#: What begins a section, in order; letter case doesn't matter.
SECTION_MARKERS = [
    ("safe_harbor", r"\b(safe harbor|forward[- ]looking statements?|non[- ]gaap)\b"),
    ("operator", r"\b(operator instructions|conference operator|call operator)\b"),
    ("prepared_remarks", r"\b(prepared remarks|presentation|management remarks|business update)\b"),
    ("qna", r"\b(question[- ]and[- ]answer|questions and answers|q&a)\b"),
    ("closing", r"\b(closing remarks|this concludes|thank you for joining)\b"),
]
#: A speaker's line, and hints on roles, in order.
SPEAKER = r"[A-Z][A-Za-z0-9 .,&'/-]{1,80}"
ROLE_HINTS = [
    ("operator", r"\b(operator|conference coordinator)\b"), ("investor_relations", r"\b(investor relations|ir)\b"),
    ("analyst", r"\b(analyst|questioner|research|securities|capital markets|bank|j\.?p\.? morgan|goldman|morgan stanley)\b"),
    ("management", r"\b(ceo|cfo|president|chief|management|officer|chair|treasurer|controller|executive)\b"),
]
#: Chunk types that are evidence.
EVIDENCE_TYPES = ["qa_pair", "prepared_remarks", "guidance_statement", "guidance_revision_candidate"]


def stable_object_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts joined by pipes."""
    body = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(body, 256), 1, 16))


def stable_chunk_id(case: Column, kind: Column, start: Column, end: Column) -> Column:
    return stable_object_id("chunk", T.slug(case), kind, start, end)


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def section_spans(c: Column) -> Column:
    """Array of (start, section, end): from the first hit of each marker to the next marker, and what comes before;
    without a marker one unknown section."""
    n = F.length(c)
    prefix = lambda p: F.regexp_extract(c, rf"(?is)\A(.*?){p}", 1)
    hit = [F.when(c.rlike(f"(?i){p}"), F.struct(F.length(prefix(p)).alias("start"), F.lit(name).alias("section"))) for name, p in SECTION_MARKERS]
    hits = F.array_sort(F.array_compact(F.array(*hit)))
    first = F.coalesce(F.get(hits, 0)["start"], n)
    head = F.array(F.struct(F.lit(0).alias("start"), F.lit("unknown").alias("section")))
    hits = F.when((F.size(hits) == 0) | (first > 0), F.concat(head, hits)).otherwise(hits)
    return F.transform(hits, lambda h, i: F.struct(h["start"].alias("start"), h["section"].alias("section"), F.coalesce(F.get(hits, i + 1)["start"], n).alias("end")))


def role_of_name(c: Column) -> Column:
    out = F.lit("unknown")
    for role, p in reversed(ROLE_HINTS):
        out = F.when(c.rlike(f"(?i){p}"), role).otherwise(out)
    return out


def with_offsets(pieces: Column) -> Column:
    """Array of (pos, piece) of pieces that lie end to end."""
    step = lambda s, p: F.struct((s["pos"] + F.length(p)).alias("pos"), F.concat(s["out"], F.array(F.struct(s["pos"].alias("pos"), p.alias("piece")))).alias("out"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<pos:int,piece:string>>").alias("out"))
    return F.aggregate(pieces, zero, step)["out"]


def speaker_turns(df: DataFrame, row: list[str], text: str) -> DataFrame:
    """(row..., turn_no from 1, speaker, role, start, end) of lines that begin with a name and a colon, each up to the next."""
    t = df.select(*row, F.posexplode(with_offsets(F.split(text, rf"(?md)(?=^{SPEAKER}:\s)"))).alias("i", "x"))
    p = F.col("x.piece")
    t = t.where(p.rlike(rf"\A{SPEAKER}:\s"))
    name = F.regexp_replace(F.trim(F.regexp_extract(p, rf"\A({SPEAKER}):\s", 1)), r"\s+", " ")
    head = F.length(F.regexp_extract(p, rf"\A({SPEAKER}:\s+)", 1))
    w = Window.partitionBy(*row).orderBy("i")
    return t.select(*row, F.row_number().over(w).alias("turn_no"), name.alias("speaker"), role_of_name(name).alias("role"), (F.col("x.pos") + head).alias("start"), (F.col("x.pos") + F.length(p)).alias("end"))


def turn_pairs(turns: DataFrame, row: list[str]) -> DataFrame:
    """(row..., pair_no, question_no, answer_no, start, end): the last question before each answer by management or an unknown."""
    t = turns.where(F.col("role").isin("questioner", "analyst", "management", "unknown"))
    w = Window.partitionBy(*row).orderBy("turn_no")
    t = t.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("role", "turn_no", "start")))
    hit = t.where(F.col("role").isin("management", "unknown") & F.col("p_role").isin("questioner", "analyst"))
    return hit.select(*row, F.row_number().over(w).alias("pair_no"), F.col("p_turn_no").alias("question_no"), F.col("turn_no").alias("answer_no"), F.col("p_start").alias("start"), "end")


def ranges(start: Column, end: Column, width: int) -> Column:
    """Array of (start, end) that cover [start, end) in pieces of ``width``; nothing of an empty span."""
    starts = F.when(end > start, F.sequence(start, end - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, end).alias("end")))


def event_chunks(df: DataFrame, *, case: str, text: str, chunk_chars: int = 2500) -> DataFrame:
    """(case, chunk_id, chunk_type, section, speaker_role, start, end, pairing, suppression, text_sha): typed chunks of each text.

    Safe harbour, operator and vendor sections are suppressed (long ones in part), prepared remarks are cut
    into ranges, turns of analysts and management and pairs of them are chunks of their own; a text
    without any is cut as it is. Null texts have no chunks, empty ones neither."""
    docs = df.where(F.col(text).isNotNull()).select(F.col(case).alias("case"), F.col(text).alias("text"))
    c = F.col("text")
    sec = docs.select("case", "text", F.inline(section_spans(c)))
    size, body = F.col("end") - F.col("start"), piece(c, F.col("start"), F.col("end"))
    sec = sec.withColumn("why", S.event_suppression(body))
    quiet = F.col("section").isin("safe_harbor", "operator")
    whole = (quiet | F.col("why").isin("safe_harbor", "operator_instructions", "vendor_disclaimer")) & (size <= chunk_chars)
    part = quiet & (size > chunk_chars)
    silent = sec.where(whole | part).select("case", F.col("start").alias("s0"), F.least("end", F.col("start") + chunk_chars).alias("s1"))
    empty = F.lit("")
    cut = lambda t, s, e: t.select("case", "text", "section", F.inline(ranges(s, e, chunk_chars)))
    rest = cut(sec.where(part), F.col("start") + chunk_chars, F.col("end")).select("case", F.lit("semantic_fallback").alias("chunk_type"), F.lit("unknown").alias("section"), F.lit("unknown").alias("speaker_role"), "start", "end", empty.alias("pairing"), empty.alias("suppression"), piece(c, F.col("start"), F.col("end")).alias("body"))
    prep = cut(sec.where(~whole & ~part & (F.col("section") == "prepared_remarks")), F.col("start"), F.col("end")).withColumn("body", piece(c, F.col("start"), F.col("end")))
    low = F.lower("body")
    kind = F.when(low.contains("guidance") & T.any_phrase(low, ["raise", "lower", "narrow", "revise", "update"]), "guidance_revision_candidate").when(low.contains("guidance"), "guidance_statement").otherwise("prepared_remarks")
    prep = prep.select("case", kind.alias("chunk_type"), "section", F.lit("management").alias("speaker_role"), "start", "end", empty.alias("pairing"), S.event_suppression(F.col("body")).alias("suppression"), "body")
    turns = speaker_turns(docs, ["case"], "text")
    inside = turns.join(silent, "case").where("start >= s0 and `end` <= s1").select("case", "turn_no").distinct()
    said = turns.where(F.col("role").isin("questioner", "analyst", "management")).join(inside, ["case", "turn_no"], "left_anti").join(docs, "case")
    asks = F.col("role") != "management"
    said = said.select("case", F.when(asks, "qa_question").otherwise("qa_answer").alias("chunk_type"), F.lit("qna").alias("section"), F.col("role").alias("speaker_role"), "start", "end", F.when(asks, "unpaired_question").otherwise("answer_without_question").alias("pairing"), empty.alias("suppression"), piece(c, F.col("start"), F.col("end")).alias("body"))
    pairs = turn_pairs(turns, ["case"]).join(docs, "case").select("case", F.lit("qa_pair").alias("chunk_type"), F.lit("qna").alias("section"), F.lit("mixed").alias("speaker_role"), "start", "end", F.lit("paired").alias("pairing"), empty.alias("suppression"), piece(c, F.col("start"), F.col("end")).alias("body"))
    some = reduce(DataFrame.unionByName, (rest, prep, said, pairs))
    none = docs.join(some.select("case").distinct(), "case", "left_anti").select("case", "text", F.inline(ranges(F.lit(0), F.length("text"), chunk_chars)))
    none = none.select("case", F.lit("semantic_fallback").alias("chunk_type"), F.lit("unknown").alias("section"), F.lit("unknown").alias("speaker_role"), "start", "end", F.lit("no_qa_pairs_detected").alias("pairing"), empty.alias("suppression"), piece(c, F.col("start"), F.col("end")).alias("body"))
    out = some.unionByName(none)
    return out.select(
        F.col("case").alias(case), stable_chunk_id(F.col("case"), F.col("chunk_type"), F.col("start"), F.col("end")).alias("chunk_id"), "chunk_type", "section", "speaker_role", "start", "end", "pairing", "suppression",
        F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("text_sha"),
    )


def evidence_objects(chunks: DataFrame) -> DataFrame:
    """Chunks that are evidence, with an id of chunk and text."""
    return chunks.where(F.col("chunk_type").isin(EVIDENCE_TYPES)).withColumn("evidence_id", stable_object_id("evidence", F.col("chunk_id"), F.col("text_sha")))


def chunk_quality(chunks: DataFrame, case: str) -> DataFrame:
    """Per text: chunks, evidence, share of fallbacks and the longest chunk."""
    return chunks.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_type").isin(EVIDENCE_TYPES)).alias("n_evidence"), F.round(F.avg((F.col("chunk_type") == "semantic_fallback").cast("int")), 4).alias("fallback_ratio"),
        F.max(F.col("end") - F.col("start")).alias("max_chars"), F.count_if(F.col("suppression") != "").alias("n_suppressed"),
    )


# Turns by line, and candidates by rules


def first_of(low: Column, markers: list[str]) -> Column:
    """Offset of the first of several markers in a lower text; null without any."""
    return F.least(*(F.nullif(F.locate(m, low), F.lit(0)) for m in markers)) - 1


def line_turns(df: DataFrame, row: list[str], text: str) -> DataFrame:
    """(row..., turn_no from 0, speaker, role, section, start, end, body): each line with text is a turn; what stands
    before its first colon is the speaker. Sections by where questions and answers begin."""
    low = F.lower(F.col(text))
    qa = first_of(low, ["question-and-answer", "question and answer", "q&a"])
    t = df.where(F.col(text).isNotNull()).select(*row, qa.alias("qa"), F.posexplode(with_offsets(F.split(text, r"(?<=\n)"))).alias("i", "x"))
    line = F.regexp_replace(F.col("x.piece"), r"\n\z", "")
    t = t.withColumn("line", line).withColumn("flat", T.strip(F.col("line"))).where("flat <> ''")
    named = F.col("flat").contains(":")
    name = F.when(named, F.coalesce(F.nullif(T.strip(F.substring_index("flat", ":", 1)), F.lit("")), F.lit("unknown"))).otherwise("unknown")
    body = F.when(named, T.strip(F.expr("substring(flat, locate(':', flat) + 1)"))).otherwise(F.col("flat"))
    t = t.withColumns({"speaker": name, "body": body})
    n = F.lower("speaker")
    role = F.when(n.contains("operator"), "operator").when(n.contains("investor relations") | (n == "ir"), "investor_relations").when(n.contains("analyst") | n.contains("question"), "analyst").when(n != "unknown", "management").otherwise("unknown")
    section = F.when(F.col("qa").isNull(), "unknown").when(F.col("x.pos") >= F.col("qa"), "qa").otherwise("prepared_remarks")
    w = Window.partitionBy(*row).orderBy("i")
    return t.select(*row, (F.row_number().over(w) - 1).alias("turn_no"), "speaker", role.alias("role"), section.alias("section"), F.col("x.pos").alias("start"), (F.col("x.pos") + F.length("line")).alias("end"), "body")


def answer_shift(c: Column) -> Column:
    low, out = F.lower(c), F.lit("direct_answer")
    for kind, phrases in reversed(L.ANSWER_SHIFTS):
        out = F.when(T.any_phrase(low, phrases), kind).otherwise(out)
    return out


def turn_candidates(turns: DataFrame, row: list[str]) -> DataFrame:
    """(row..., turn_no, signal, direction, confidence, bucket, rule, start, end): what the rules propose for each turn.

    turns: as by line_turns(). The answer of an analyst's turn in questions and answers is the first management
    turn among the next three, unless another analyst speaks before it. One row for each span and rule."""
    w = Window.partitionBy(*row).orderBy("turn_no")
    ahead = F.array(*(F.struct(*(F.lead(c, k).over(w).alias(c) for c in ("role", "body", "end"))) for k in (1, 2, 3)))
    t = turns.withColumn("_next", ahead)
    t = t.withColumn("_first", F.get(F.filter("_next", lambda x: x["role"].isin("management", "analyst")), 0))
    t = t.withColumn("_ans", F.when(F.col("_first")["role"] == "management", F.col("_first"))).drop("_next", "_first")
    low = F.lower("body")
    has = lambda words: T.any_phrase(low, words)
    mgmt, ask = F.col("role") == "management", (F.col("role") == "analyst") & (F.col("section") == "qa")
    boiler = (F.col("role") == "operator") | has(L.SAFE_HARBOR)
    biz = has(L.BUSINESS_TOPICS)
    direction = F.lit("prior_missing")
    for name, words in reversed(L.TURN_DIRECTIONS.items()):
        direction = F.when(has(words), name).otherwise(direction)
    past = T.any_phrase(low, L.HISTORICAL) & ~T.any_phrase(low, L.CURRENT)
    cell = lambda signal, way, sure, bucket, rule, end=None: F.struct(
        F.lit(signal).alias("signal"), (way if isinstance(way, Column) else F.lit(way)).alias("direction"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"),
        (bucket if isinstance(bucket, Column) else F.lit(bucket)).alias("bucket"), F.lit(rule).alias("rule"), (F.col("end") if end is None else end).alias("stop"),
    )
    guides = ~boiler & mgmt & has(L.TURN_GUIDANCE_CUES) & biz & S.period_present(F.col("body"))
    lost = direction == "prior_missing"
    answered = F.col("_ans").isNotNull()
    calm = ~boiler & mgmt & has(L.TURN_REASSURANCE)
    rules = [
        F.when(boiler, cell("neutral/no_signal", "neutral", "high", "boilerplate_safe_harbor", "neutral_boilerplate_v1")),
        F.when(guides & past, cell("neutral/no_signal", "neutral", "medium", "historical_only", "neutral_historical_only_v1")),
        F.when(guides & ~past, cell("guidance_revision", direction, F.when(lost, "low").otherwise("medium"), F.when(lost, "prior_missing").otherwise(""), "guidance_revision_v1")),
        F.when(~boiler & ask & has(L.TURN_PRESSURE) & biz, cell("analyst_pressure", "pressure", F.when(answered, "medium").otherwise("low"), F.when(answered, "").otherwise("analyst_only_unpaired"), "analyst_pressure_v1")),
        F.when(~boiler & mgmt & has(L.TURN_HEDGES) & biz, cell("management_hedging", "hedged", "medium", "", "management_hedging_v1")),
        F.when(~boiler & has(L.TURN_UNCERTAINTY) & biz, cell("uncertainty", "uncertain", "medium", "", "uncertainty_v1")),
        F.when(calm & biz, cell("reassurance", "reassuring", "medium", "", "reassurance_v1")),
        F.when(calm & ~biz, cell("neutral/no_signal", "neutral", "medium", "generic_optimism", "neutral_generic_optimism_v1")),
        F.when(~boiler & ask & answered, cell("answer_shift", answer_shift(F.col("_ans")["body"]), "medium", "", "answer_shift_v1", F.col("_ans")["end"])),
    ]
    out = t.select(*row, "turn_no", "start", F.inline(F.array_compact(F.array(*rules)))).withColumnRenamed("stop", "end")
    k = F.row_number().over(Window.partitionBy(*row, "start", "end", "rule").orderBy("turn_no"))
    return out.withColumn("_k", k).where("_k = 1").drop("_k")


def guidance_comparison(current: DataFrame, prior: DataFrame, *, key: str, fields: list[str], value: str) -> DataFrame:
    """(key, comparison): raised, lowered or maintained against the prior row of the key; unclear where a field (trimmed,
    without letter case) or a readable value differs or lacks; prior_missing without one."""
    tidy = lambda c: F.lower(T.strip(F.coalesce(c.cast("string"), F.lit(""))))
    num = lambda c: F.regexp_replace(c.cast("string"), r"[,$%]", "").try_cast("double")
    p = prior.select(F.col(key), F.lit(True).alias("_has"), *(tidy(F.col(f)).alias(f"_p{i}") for i, f in enumerate(fields)), num(F.col(value)).alias("_pv"))
    j = current.join(p, key, "left")
    same = reduce(lambda a, b: a & b, (tidy(F.col(f)) == F.col(f"_p{i}") for i, f in enumerate(fields)))
    v, pv = num(F.col(value)), F.col("_pv")
    out = F.when(F.col("_has").isNull(), "prior_missing").when(~same | v.isNull() | pv.isNull(), "unclear").when(v > pv, "raised").when(v < pv, "lowered").otherwise("maintained")
    return j.select(key, out.alias("comparison"))
