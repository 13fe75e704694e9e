"""Queries of the corpus path: cleaning, sections, headed turns, guidance, signals, span scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import corpus as C
from colloquy.plans import sqltext as X
from colloquy.plans.registry import Registry
from colloquy.runtime import norm_key, read_spread, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def docs(spark, d):
    return read_spread(spark, d, "documents").where("text is not null").select("doc_id", "text")


@query(rf"""with t as (select doc_id, regexp_replace(replace(text, chr(65279), ''), '\r\n|\r', chr(10), 'g') t from documents where text is not null), u as (select doc_id, length(t) - length(replace(t, chr(65533), '')) n_encoding, string_split(replace(t, chr(65533), ''), chr(10)) ls from t),
v as (select doc_id, n_encoding, unnest(range(len(ls))) i, ls from u), l as (select doc_id, n_encoding, i, {X.strip("regexp_replace(ls[i + 1], '[ \t]+', ' ', 'g')")} line from v),
m as (select *, line = '' blank, sum((line = '')::int) over (partition by doc_id order by i) blanks, line <> '' and {X.any_pattern('lower(line)', C.DROPPED_LINES)} boiler from l),
n as (select *, not blank and not boiler and length(line) < 120 and row_number() over (partition by doc_id, lower(line), blank, boiler order by i) > 4 nav from m), o as (select *, not blank and not boiler and not nav live from n),
p as (select *, live and coalesce(lag(line) over (partition by doc_id, live order by i) = line, false) again from o), q as (select *, live and not again keep from p),
r as (select *, lag(blanks) over (partition by doc_id, keep order by i) b0 from q)
select doc_id, sha256(coalesce(string_agg(case when b0 is null then '' when blanks > b0 then chr(10) || chr(10) else chr(10) end || line, '' order by i) filter (where keep), '') || chr(10)) clean_sha,
  any_value(n_encoding) n_encoding, count(*) filter (where again) n_repeated, count(*) filter (where boiler or nav) n_boilerplate from r group by doc_id""")
def doc_clean_lines(spark, d):
    c = C.clean_transcripts(docs(spark, d), row="doc_id", text="text")
    return c.select("doc_id", F.sha2("clean", 256).alias("clean_sha"), "n_encoding", "n_repeated", "n_boilerplate")


_AT = lambda p, f: f"case when regexp_matches(text, {X.q(f'(?{f}){p}')}) then length(regexp_extract(text, {X.q(f'(?{f}s)' + chr(92) + f'A(.*?){p}')}, 1)) end"
_TWICE = X.q(rf"(?ims)\A(.*?{C.OPERATOR_LINE}.*?){C.OPERATOR_LINE}")
_QA = f"coalesce({_AT(C.QA_LINE, 'im')}, {_AT(C.QA_TRANSITION, 'i')}, case when regexp_matches(text, {_TWICE}) then length(regexp_extract(text, {_TWICE}, 1)) end)"
_LOWT = "lower(text)"


@query(f"""with t as (select doc_id, text, {_QA} qa from documents where text is not null)
select doc_id, case when qa is null then 0 else length({X.strip('substring(text, 1, qa)')}) end prepared_chars, case when qa is null then 0 else length({X.strip('substring(text, qa + 1)')}) end qa_chars, case when qa is null then length({X.strip('text')}) else 0 end unknown_chars,
  contains({_LOWT}, 'operator') has_operator, {X.any_phrase(_LOWT, ['question-and-answer', 'questions and answers', 'q&a', 'question and answer'])} has_q_and_a, {X.any_phrase(_LOWT, ['safe harbor', 'forward-looking', 'actual results may differ'])} has_safe_harbor, {X.any_phrase(_LOWT, C.CALL_MARKERS)} any_marker from t""")
def doc_qa_sections(spark, d):
    t = docs(spark, d).select("doc_id", C.qa_sections(F.col("text")).alias("s"), C.marker_flags(F.col("text")).alias("m"))
    return t.select(
        "doc_id", F.length("s.prepared_remarks").alias("prepared_chars"), F.length("s.q_and_a").alias("qa_chars"), F.length("s.unknown").alias("unknown_chars"),
        F.col("m.operator").alias("has_operator"), F.col("m.q_and_a").alias("has_q_and_a"), F.col("m.safe_harbor").alias("has_safe_harbor"), F.col("m.any_marker").alias("any_marker"),
    )


_SPANS = rf"""ss0 as (select doc_id, regexp_extract_all({{text}}, '(?s)(.*?)([^.!?\n]+(?:[.!?]+|\n?\z))', 1) p, regexp_extract_all({{text}}, '(?s)(.*?)([^.!?\n]+(?:[.!?]+|\n?\z))', 2) s from {{source}}),
ss1 as (select doc_id, unnest(range(1, len(s) + 1)) i, p, s from ss0), ss2 as (select doc_id, i, s[i] s, sum(length(p[i]) + length(s[i])) over (partition by doc_id order by i) - length(s[i]) pos0 from ss1),
spans as (select doc_id, i, pos0 + length(s) - length(ltrim(s, {X.BLANKS})) st, {X.strip('s')} sentence from ss2 where length({X.strip('s')}) >= 20)"""
_DOC_SPANS = _SPANS.format(text="text", source="documents where text is not null")


@query(f"with {_DOC_SPANS} select doc_id, count(*) n_sentences, cast(sum(st) as bigint) starts, cast(sum(st + length(sentence)) as bigint) ends from spans group by doc_id")
def doc_sentence_spans(spark, d):
    s = docs(spark, d).select("doc_id", F.inline(C.sentence_spans(F.col("text"))))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


_GUIDE = X.first_of([(f"regexp_matches(lower(sentence), {X.q(p)})", f"{{'direction': '{w}', 'rule': '{n}'}}") for w, n, p in C.GUIDANCE], "null")
_METRIC = X.first_of([(f"contains(lower(sentence), '{m}')", f"'{m}'") for m in C.METRICS], "'guidance'")


@query(f"""with {_DOC_SPANS}, h as (select *, {_GUIDE} h from spans), k as (select *, row_number() over (partition by doc_id order by st) k from h where h is not null)
select doc_id, cast(k as int) k, {_METRIC} metric, h.direction direction, h.rule as rule, 0.72e0 confidence, cast(st as int) start_char, cast(st + length(sentence) as int) end_char from k where k <= 20""")
def doc_guidance_sentences(spark, d):
    g = C.guidance_sentences(docs(spark, d), row="doc_id", text="text")
    return g.select("doc_id", "k", "metric", "direction", "rule", "confidence", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


@query()
def doc_headed_turns(spark, d):
    t = C.headed_turns(docs(spark, d), row="doc_id", text="text")
    return t.select("doc_id", "turn_no", "speaker", "role", "section", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def _signals(spark, d):
    t = docs(spark, d)
    return C.signals(t, C.headed_turns(t, row="doc_id", text="text"), row="doc_id", text="text")


@query()
def doc_signals(spark, d):
    return _signals(spark, d).withColumnsRenamed({"start": "start_char", "end": "end_char"})


@query()
def doc_signal_labels(spark, d):
    """Weak labels from the signals of each document."""
    return C.labels_of_signals(_signals(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


_G0 = """lb as (select distinct label_row_id, lower(trim(call_id)) call_id, evidence_start s, evidence_end e, lower(trim(guidance_change_label)) label from labels where trim(call_id) <> '' and evidence_start >= 0 and evidence_end > evidence_start and label_row_id is not null),
gold as (select * from lb where label_row_id % 2 = 0), weak as (select * from lb where label_row_id % 2 = 1)"""
_MATCH = """cand as (select g.call_id, g.label_row_id gid, list({'o': least(g.e, w.e) - greatest(g.s, w.s), 'k': -w.label_row_id, 'w': w.label_row_id} order by w.label_row_id) filter (where w.label_row_id is not null and w.s < g.e and g.s < w.e) c
  from gold g left join weak w on w.call_id = g.call_id group by 1, 2), ordered as (select *, row_number() over (partition by call_id order by gid) r from cand),
walk as (select call_id, gid, r, list_reverse_sort(coalesce(c, []))[1] b, case when len(c) > 0 then [list_reverse_sort(c)[1].w] else []::bigint[] end used from ordered where r = 1 union all
  select z.call_id, z.gid, z.r, z.b, case when z.b is not null then z.used || [z.b.w] else z.used end from (select o.call_id, o.gid, o.r, list_reverse_sort(list_filter(coalesce(o.c, []), lambda x: not list_contains(walk.used, x.w)))[1] b, walk.used from walk join ordered o on o.call_id = walk.call_id and o.r = walk.r + 1) z)"""


@query(f"""with recursive {_G0}, {_MATCH}, j as (select walk.call_id, walk.b is not null hit, coalesce(g.label is not distinct from w.label and walk.b is not null, false) same, coalesce(abs(w.s - g.s) <= 5 and abs(w.e - g.e) <= 5, false) near
  from walk join gold g on g.label_row_id = walk.gid and g.call_id = walk.call_id left join weak w on w.label_row_id = walk.b.w and w.call_id = walk.call_id),
n as (select call_id, count(*) n_weak from weak group by 1)
select call_id, count(*) n_gold, count(*) filter (where hit) matched, count(*) filter (where not hit) missed, count(*) filter (where same) type_match, count(*) filter (where hit and not same) type_mismatch, count(*) filter (where same and near) exact,
  count(*) filter (where same and not near) overlap_only, coalesce(any_value(n_weak), 0) n_weak, coalesce(any_value(n_weak), 0) - count(*) filter (where hit) extra from j left join n using (call_id) group by call_id""")
def span_scores(spark, d):
    """Even label rows as gold, odd ones as weak spans of each call: how they match."""
    t = read_table(spark, d, "labels").where("evidence_start >= 0 and evidence_end > evidence_start and label_row_id is not null")
    t = t.select(norm_key(F.col("call_id")).alias("call_id"), F.col("label_row_id").alias("no"), F.col("evidence_start").alias("start"), F.col("evidence_end").alias("end"), F.lower(F.trim("guidance_change_label")).alias("label")).where("call_id is not null").distinct()
    return C.span_scores(t.where("no % 2 = 0"), t.where("no % 2 = 1"), key="call_id")
