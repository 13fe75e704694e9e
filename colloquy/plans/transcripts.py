"""Queries on sections, turns, chunks and candidates of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.operators import transcripts as R
from colloquy.plans import sqltext as X
from colloquy.plans.registry import Registry
from colloquy.plans.signals import _EV
from colloquy.runtime import norm_key, read_spread, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def docs(spark, d):
    return read_spread(spark, d, "documents").where("text is not null").select("doc_id", "text")


_HITS = ", ".join(f"case when regexp_matches(text, {X.q(p)}, 'i') then {{'st': length(regexp_extract(text, {X.q(f'(?is)^(.*?){p}')}, 1)), 'section': '{n}'}} end" for n, p in R.SECTION_MARKERS)
_SECTIONS = f"""sk as (select doc_id, text, length(text) n, list_sort(list_filter([{_HITS}], lambda x: x is not null)) h from documents where text is not null),
sh as (select *, case when len(h) = 0 or h[1].st > 0 then [{{'st': 0, 'section': 'unknown'}}] || h else h end h2 from sk),
si as (select doc_id, text, n, h2, unnest(range(1, len(h2) + 1)) i from sh),
sections as (select doc_id, text, h2[i].section section, h2[i].st st, coalesce(h2[i + 1].st, n) en from si)"""


@query(f"with {_SECTIONS} select doc_id, section, cast(st as int) start_char, cast(en as int) end_char from sections")
def doc_sections(spark, d):
    t = docs(spark, d).select("doc_id", F.inline(R.section_spans(F.col("text"))))
    return t.select("doc_id", "section", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


_NAME = r"[A-Z][A-Za-z0-9 .,&''/-]{1,80}"
_ROLE = X.first_of([(f"regexp_matches(name, {X.q(p)}, 'i')", X.q(r)) for r, p in R.ROLE_HINTS], "'unknown'")
_TURNS = rf"""tl as (select doc_id, text, string_split(text, chr(10)) ls from documents where text is not null), tm as (select doc_id, text, len(ls) n, ls, unnest(range(len(ls))) i from tl),
tn as (select doc_id, text, n, i, ls[i + 1] line, coalesce(sum(length(ls[i + 1]) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) pos from tm),
tp as (select *, regexp_extract(line, '^({_NAME}):', 1) raw from tn where regexp_matches(line || case when i < n - 1 then chr(10) else '' end, '^{_NAME}:\s')),
tq as (select *, trim(regexp_replace(raw, '\s+', ' ', 'g')) name, pos + length(raw) + 1 + length(regexp_extract(substring(text, cast(pos + length(raw) + 2 as bigint)), '^\s+')) st, lead(pos, 1, length(text)) over (partition by doc_id order by i) en from tp),
spk as (select doc_id, text, row_number() over (partition by doc_id order by i) turn_no, name speaker, {_ROLE} as role, cast(st as int) st, cast(en as int) en from tq)"""


@query(f"with {_TURNS} select doc_id, cast(turn_no as int) turn_no, speaker, role, st start_char, en end_char from spk")
def doc_speaker_turns(spark, d):
    t = R.speaker_turns(docs(spark, d), ["doc_id"], "text")
    return t.select("doc_id", "turn_no", "speaker", "role", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


_PAIRS = """pf as (select *, lag(role) over w pr, lag(turn_no) over w pn, lag(st) over w ps from spk where role in ('questioner', 'analyst', 'management', 'unknown') window w as (partition by doc_id order by turn_no)),
tpairs as (select doc_id, text, pn question_no, turn_no answer_no, ps st, en from pf where role in ('management', 'unknown') and pr in ('questioner', 'analyst'))"""


_ASKING = "spk2 as (select * replace (case when role = 'unknown' and contains(substring(text, st + 1, en - st), '?') then 'analyst' else role end as role) from spk)"


@query(f"with {_TURNS}, {_ASKING}, {_PAIRS.replace('from spk ', 'from spk2 ')} select doc_id, cast(row_number() over (partition by doc_id order by answer_no) as int) pair_no, cast(question_no as int) question_no, cast(answer_no as int) answer_no, st start_char, en end_char from tpairs")
def doc_turn_pairs(spark, d):
    """Pairs of turns; an unknown speaker who asks counts as an analyst here."""
    t = R.speaker_turns(docs(spark, d), ["doc_id"], "text").join(docs(spark, d), "doc_id")
    asks = (F.col("role") == "unknown") & R.piece(F.col("text"), F.col("start"), F.col("end")).contains("?")
    p = R.turn_pairs(t.withColumn("role", F.when(asks, "analyst").otherwise(F.col("role"))).drop("text"), ["doc_id"])
    return p.select("doc_id", "pair_no", "question_no", "answer_no", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


_WHY = _EV.replace("coalesce(text, '')", "body")
_CUT = lambda a, b: f"unnest(list_transform(range({a}, {b}, 2500), lambda s: {{'s': s, 'e': least(s + 2500, {b})}}))"
_CHUNKS = f"""{_SECTIONS}, {_TURNS}, {_PAIRS}, s1 as (select *, substring(text, st + 1, en - st) body from sections), s2 as (select *, {_WHY} why, section in ('safe_harbor', 'operator') quiet from s1),
s3 as (select *, (quiet or why in ('safe_harbor', 'operator_instructions', 'vendor_disclaimer')) and en - st <= 2500 whole, quiet and en - st > 2500 part from s2),
silent as (select doc_id, st s0, least(en, st + 2500) s1 from s3 where whole or part),
c1 as (select doc_id, text, {_CUT('st + 2500', 'en')} r from s3 where part), c2 as (select doc_id, text, section, {_CUT('st', 'en')} r from s3 where not whole and not part and section = 'prepared_remarks'),
c3 as (select *, substring(text, r.s + 1, r.e - r.s) body from c2),
mine as (select doc_id, 'semantic_fallback' chunk_type, 'unknown' section, 'unknown' speaker_role, r.s st, r.e en, '' pairing, '' suppression, substring(text, r.s + 1, r.e - r.s) body from c1
  union all select doc_id, case when contains(lower(body), 'guidance') and {X.any_phrase('lower(body)', ['raise', 'lower', 'narrow', 'revise', 'update'])} then 'guidance_revision_candidate' when contains(lower(body), 'guidance') then 'guidance_statement' else 'prepared_remarks' end, section, 'management', r.s, r.e, '', {_WHY}, body from c3
  union all select doc_id, case when role = 'management' then 'qa_answer' else 'qa_question' end, 'qna', role, st, en, case when role = 'management' then 'answer_without_question' else 'unpaired_question' end, '', substring(text, st + 1, en - st) from spk
    where role in ('questioner', 'analyst', 'management') and not exists (select 1 from silent where silent.doc_id = spk.doc_id and spk.st >= s0 and spk.en <= s1)
  union all select doc_id, 'qa_pair', 'qna', 'mixed', st, en, 'paired', '', substring(text, st + 1, en - st) from tpairs),
left_ as (select doc_id, text, {_CUT('0', 'length(text)')} r from documents where text is not null and doc_id not in (select doc_id from mine)),
every as (select * from mine union all select doc_id, 'semantic_fallback', 'unknown', 'unknown', r.s, r.e, 'no_qa_pairs_detected', '', substring(text, r.s + 1, r.e - r.s) from left_),
chunks as (select doc_id, 'chunk_' || left(sha256(concat_ws('|', cast(doc_id as varchar), chunk_type, cast(st as varchar), cast(en as varchar))), 16) chunk_id, chunk_type, section, speaker_role, cast(st as int) start_char, cast(en as int) end_char, pairing, suppression, 'sha256:' || sha256(body) text_sha from every)"""


def _chunks(spark, d):
    c = R.event_chunks(docs(spark, d), case="doc_id", text="text")
    return c.withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query(f"with {_CHUNKS} select * from chunks")
def doc_event_chunks(spark, d):
    return _chunks(spark, d)


@query(f"with {_CHUNKS} select 'evidence_' || left(sha256(chunk_id || '|' || text_sha), 16) evidence_id, chunk_id, doc_id, chunk_type, start_char, end_char from chunks where chunk_type in {tuple(R.EVIDENCE_TYPES)}")
def doc_evidence_objects(spark, d):
    return R.evidence_objects(_chunks(spark, d)).select("evidence_id", "chunk_id", "doc_id", "chunk_type", "start_char", "end_char")


@query(f"""with {_CHUNKS} select doc_id, count(*) n_chunks, count(*) filter (where chunk_type in {tuple(R.EVIDENCE_TYPES)}) n_evidence, round(avg((chunk_type = 'semantic_fallback')::int), 4) fallback_ratio,
  max(end_char - start_char) max_chars, count(*) filter (where suppression <> '') n_suppressed from chunks group by 1""")
def doc_chunk_quality(spark, d):
    return R.chunk_quality(_chunks(spark, d).withColumnsRenamed({"start_char": "start", "end_char": "end"}), "doc_id")


_FLAT = X.strip("line")
_LINES = f"""lq as (select doc_id, list_min(list_filter([nullif(instr(lower(text), 'question-and-answer'), 0), nullif(instr(lower(text), 'question and answer'), 0), nullif(instr(lower(text), 'q&a'), 0)], lambda x: x is not null)) - 1 qa from documents),
ll as (select *, {_FLAT} flat from ({{src}}) where {_FLAT} <> ''),
lm as (select ll.*, qa, case when contains(flat, ':') then coalesce(nullif({X.strip("split_part(flat, ':', 1)")}, ''), 'unknown') else 'unknown' end speaker, case when contains(flat, ':') then {X.strip("substring(flat, instr(flat, ':') + 1)")} else flat end body from ll join lq using (doc_id)),
lr as (select *, case when contains(lower(speaker), 'operator') then 'operator' when contains(lower(speaker), 'investor relations') or lower(speaker) = 'ir' then 'investor_relations' when contains(lower(speaker), 'analyst') or contains(lower(speaker), 'question') then 'analyst'
  when lower(speaker) <> 'unknown' then 'management' else 'unknown' end as role, case when qa is null then 'unknown' when pos >= qa then 'qa' else 'prepared_remarks' end section from lm),
lturns as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) turn_no, speaker, role, section, cast(pos as int) st, cast(pos + length(line) as int) en, body from lr)"""
_TN = _TURNS[: _TURNS.index("\ntp as")].rstrip(",")
_LT = f"{_TN}, {_LINES.format(src='select * from tn')}"


@query(f"with {_LT} select doc_id, turn_no, speaker, role, section, st start_char, en end_char, sha256(body) body_sha from lturns")
def doc_line_turns(spark, d):
    t = R.line_turns(docs(spark, d), ["doc_id"], "text")
    return t.select("doc_id", "turn_no", "speaker", "role", "section", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.sha2("body", 256).alias("body_sha"))


_A = lambda ws: X.any_phrase("lower(body)", ws)
_DIR = X.first_of([(_A(ws), X.q(n)) for n, ws in L.TURN_DIRECTIONS.items()], "'prior_missing'")
_SHIFT = X.first_of([(X.any_phrase("lower(ans.body)", ws), X.q(n)) for n, ws in L.ANSWER_SHIFTS], "'direct_answer'")
_CANDS = rf"""ca as (select *, [lead({{'role': role, 'body': body, 'en': en}}, 1) over w, lead({{'role': role, 'body': body, 'en': en}}, 2) over w, lead({{'role': role, 'body': body, 'en': en}}, 3) over w] nx from lturns window w as (partition by doc_id order by turn_no)),
cb as (select *, list_filter(nx, lambda x: x.role in ('management', 'analyst'))[1] f1 from ca),
cc as (select * exclude (nx, f1), case when f1.role = 'management' then f1 end ans, role = 'operator' or {_A(L.SAFE_HARBOR)} boiler, {_A(L.BUSINESS_TOPICS)} biz, role = 'management' mg, role = 'analyst' and section = 'qa' ask,
  {_A(L.HISTORICAL)} and not {_A(L.CURRENT)} past, {_DIR} dir from cb),
cd as (select *, not boiler and mg and {_A(L.TURN_GUIDANCE_CUES)} and biz and regexp_matches(lower(body), '\b(?:20[0-9]{{2}}|fy\s?[0-9]{{2,4}}|q[1-4]|quarter|year|annual|full year)\b') guides, not boiler and mg and {_A(L.TURN_REASSURANCE)} calm from cc),
ce as (select doc_id, turn_no, st, unnest(list_filter([
  case when boiler then {{'signal': 'neutral/no_signal', 'direction': 'neutral', 'confidence': 'high', 'bucket': 'boilerplate_safe_harbor', 'rule': 'neutral_boilerplate_v1', 'en': en}} end,
  case when guides and past then {{'signal': 'neutral/no_signal', 'direction': 'neutral', 'confidence': 'medium', 'bucket': 'historical_only', 'rule': 'neutral_historical_only_v1', 'en': en}} end,
  case when guides and not past then {{'signal': 'guidance_revision', 'direction': dir, 'confidence': case when dir = 'prior_missing' then 'low' else 'medium' end, 'bucket': case when dir = 'prior_missing' then 'prior_missing' else '' end, 'rule': 'guidance_revision_v1', 'en': en}} end,
  case when not boiler and ask and {_A(L.TURN_PRESSURE)} and biz then {{'signal': 'analyst_pressure', 'direction': 'pressure', 'confidence': case when ans is null then 'low' else 'medium' end, 'bucket': case when ans is null then 'analyst_only_unpaired' else '' end, 'rule': 'analyst_pressure_v1', 'en': en}} end,
  case when not boiler and mg and {_A(L.TURN_HEDGES)} and biz then {{'signal': 'management_hedging', 'direction': 'hedged', 'confidence': 'medium', 'bucket': '', 'rule': 'management_hedging_v1', 'en': en}} end,
  case when not boiler and {_A(L.TURN_UNCERTAINTY)} and biz then {{'signal': 'uncertainty', 'direction': 'uncertain', 'confidence': 'medium', 'bucket': '', 'rule': 'uncertainty_v1', 'en': en}} end,
  case when calm and biz then {{'signal': 'reassurance', 'direction': 'reassuring', 'confidence': 'medium', 'bucket': '', 'rule': 'reassurance_v1', 'en': en}} end,
  case when calm and not biz then {{'signal': 'neutral/no_signal', 'direction': 'neutral', 'confidence': 'medium', 'bucket': 'generic_optimism', 'rule': 'neutral_generic_optimism_v1', 'en': en}} end,
  case when not boiler and ask and ans is not null then {{'signal': 'answer_shift', 'direction': {_SHIFT}, 'confidence': 'medium', 'bucket': '', 'rule': 'answer_shift_v1', 'en': ans.en}} end], lambda x: x is not null)) x from cd),
cands as (select doc_id, min(turn_no) turn_no, arg_min(x.signal, turn_no) signal, arg_min(x.direction, turn_no) direction, arg_min(x.confidence, turn_no) confidence, arg_min(x.bucket, turn_no) bucket, x.rule as rule, st start_char, x.en end_char from ce group by doc_id, st, x.en, x.rule)"""


@query(f"with {_LT}, {_CANDS} select * from cands")
def doc_turn_candidates(spark, d):
    c = R.turn_candidates(R.line_turns(docs(spark, d), ["doc_id"], "text"), ["doc_id"])
    return c.withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query(f"with {_LT}, {_CANDS} select signal, bucket, count(*) n from cands group by all")
def doc_candidate_counts(spark, d):
    return doc_turn_candidates(spark, d).groupBy("signal", "bucket").agg(F.count(F.lit(1)).alias("n"))


_NUMS = r"regexp_extract(evidence_text, '([$]?[0-9][0-9,.]*[0-9]%?)', 1)"


@query(rf"""with l as (select label_row_id, lower(trim(call_id)) c, regexp_extract(lower(trim(call_id)), '^([^_]+)_', 1) e, coalesce(source_type, '') basis, {_NUMS} v, row_number() over (partition by regexp_extract(lower(trim(call_id)), '^([^_]+)_', 1) order by label_row_id) k
  from (select distinct * from labels) where evidence_text is not null and call_id is not null), j as (select a.label_row_id, lower({X.strip('a.basis')}) ab, lower({X.strip('b.basis')}) bb, try_cast(regexp_replace(a.v, '[,$%]', '', 'g') as double) av, try_cast(regexp_replace(b.v, '[,$%]', '', 'g') as double) bv, b.k is not null has from l a left join l b on a.e = b.e and a.k = b.k + 1)
select label_row_id, case when not has then 'prior_missing' when ab <> bb or av is null or bv is null then 'unclear' when av > bv then 'raised' when av < bv then 'lowered' else 'maintained' end comparison from j""")
def guidance_comparison(spark, d):
    """The first figure of each label row against that of the row before it of the entity, on the same basis."""
    from pyspark.sql import Window

    t = read_table(spark, d, "labels").distinct().where("evidence_text is not null and call_id is not null")
    t = t.select("label_row_id", F.regexp_extract(norm_key(F.col("call_id")), "^([^_]+)_", 1).alias("e"), F.coalesce("source_type", F.lit("")).alias("basis"), F.regexp_extract("evidence_text", r"([$]?[0-9][0-9,.]*[0-9]%?)", 1).alias("v"))
    w = Window.partitionBy("e").orderBy("label_row_id")
    prior = t.select(F.lead("label_row_id").over(w).alias("label_row_id"), "basis", "v").where("label_row_id is not null")
    return R.guidance_comparison(t, prior, key="label_row_id", fields=["basis"], value="v")
