"""Queries on guidance revisions, validation, packing, frames and score maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import chunking as K
from colloquy.operators import evidence as E
from colloquy.operators import guidance as G
from colloquy.operators import privacy as P
from colloquy.operators import validate as V
from colloquy.operators.quantiles import exact_quantiles, wide
from colloquy.plans.common import TURNS, turns
from colloquy.plans import sqltext as X
from colloquy.plans.documents import docs
from colloquy.plans.signals import _PERIOD
from colloquy.plans.registry import Registry
from colloquy.runtime import norm_key, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_NUM = r"list_transform(regexp_extract_all({}, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: try_cast(replace(x, ',', '') as double))"


def _statements(spark, d):
    """(call, period_no, rid, topic, period, numbers, mid) of the label evidence."""
    t = read_table(spark, d, "labels").distinct().where("evidence_text is not null and call_id is not null")
    c, e = norm_key(F.col("call_id")), F.col("evidence_text")
    p = r"^([^_]+)_([0-9]{4})q([1-4])_"
    t = t.select(c.alias("call"), "label_row_id", e.alias("e"))
    return t.select(
        F.regexp_extract("call", p, 1).alias("entity"), (F.regexp_extract("call", p, 2).try_cast("int") * 4 + F.regexp_extract("call", p, 3).try_cast("int")).alias("period_no"),
        F.col("label_row_id").alias("rid"), T.argmax_topic(F.col("e"), L.TOPICS, "other").alias("topic"), T.period_tag(F.col("e")).alias("period"),
        T.numbers(F.col("e")).alias("numbers"), T.midpoint(F.col("e")).alias("mid"),
    ).where("period_no is not null and rid is not null")


_SIG = "list_sort(list_distinct(list_transform(n, lambda v: case when v = 0 then 0 else round(v / pow(10e0, floor(log10(abs(v))) - 2)) * pow(10e0, floor(log10(abs(v))) - 2) end)))"
_MATCHES = rf"""t0 as (select distinct label_row_id rid, evidence_text as text, regexp_extract(lower(trim(call_id)), '^([^_]+)_([0-9]{{4}})q([1-4])_', ['e', 'y', 'q']) x from labels where evidence_text is not null and label_row_id is not null and regexp_matches(lower(trim(call_id)), '^[^_]+_[0-9]{{4}}q[1-4]_')),
t1 as (select rid, x.e entity, x.y::int * 4 + x.q::int no, {X.topic('lower(text)', L.TOPICS, 'other')} topic, {_PERIOD} period, {_NUM.format('text')} n,
  regexp_extract(lower(text), '(-?[0-9]+(?:\.[0-9]+)?)\s*(?:to|–|-)\s*(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) ran, regexp_extract(lower(text), 'between\s+(-?[0-9]+(?:\.[0-9]+)?)\s+and\s+(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) btw from t0),
t2 as (select *, list_transform({_SIG}, lambda v: round(v, 6)) sig, round(coalesce((try_cast(btw.a as double) + try_cast(btw.b as double)) / 2, (try_cast(ran.a as double) + try_cast(ran.b as double)) / 2, n[1]), 6) mid,
  row_number() over (partition by entity, no order by rid) r from t1),
pr as (select c.rid, list({{'s': case when len(c.sig) > 0 and len(p.sig) > 0 then len(list_intersect(c.sig, p.sig)) / len(list_distinct(c.sig || p.sig)) else 0e0 end
  + case when c.topic <> p.topic then 0e0 when c.topic = 'other' then 0.175e0 else 0.35e0 end + case when c.period <> p.period then 0e0 when c.period = 'Unknown' then 0.1e0 else 0.2e0 end, 'o': -p.r, 'rid': p.rid}}) cands
  from t2 c join t2 p on p.entity = c.entity and p.no = c.no - 1 group by c.rid),
cu as (select t2.entity, t2.no, t2.r, t2.rid, coalesce(cands, []) cands from t2 left join pr using (rid)),
wk as (select entity, no, r, rid, list_reverse_sort(cands)[1] b, case when list_reverse_sort(cands)[1].s >= 0.75 then [list_reverse_sort(cands)[1].rid] else []::bigint[] end used from cu where r = 1 union all
  select z.entity, z.no, z.r, z.rid, z.b, case when z.b.s >= 0.75 then z.used || [z.b.rid] else z.used end from (
    select cu.entity, cu.no, cu.r, cu.rid, list_reverse_sort(list_filter(cu.cands, lambda k: not list_contains(wk.used, k.rid)))[1] b, wk.used from wk join cu on cu.entity = wk.entity and cu.no = wk.no and cu.r = wk.r + 1) z),
matches as (select entity, rid, case when b.s >= 0.75 then b.rid end prior_rid, coalesce(round(b.s, 6), 0) score, coalesce(b.s >= 0.75, false) matched from wk)"""


@query(f"with recursive {_MATCHES} select * from matches")
def guidance_match(spark, d):
    s = _statements(spark, d)
    return G.match_prior(s.select("entity", "period_no", "rid", "topic", "period", G.signature(F.col("numbers")).alias("sig")), key="entity")


@query(f"""with recursive {_MATCHES}, z as (select m.rid, c.mid - p.mid df, list_filter(list_transform(range(1, greatest(len(c.n), len(p.n)) + 1), lambda i: c.n[i] - p.n[i]), lambda v: v is not null) mv
  from matches m join t2 c on c.rid = m.rid left join t2 p on p.rid = m.prior_rid)
select rid, case when df is null then 'unclear' when len(list_filter(mv, lambda v: v >= 0.05)) > 0 and len(list_filter(mv, lambda v: v <= -0.05)) > 0 then 'mixed' when df >= 0.05 then 'raised' when df <= -0.05 then 'lowered' else 'reaffirmed' end revision from z""")
def guidance_revision(spark, d):
    """Each statement against the one of the period before that it is matched with; unclear without one."""
    s = _statements(spark, d)
    m = G.match_prior(s.select("entity", "period_no", "rid", "topic", "period", G.signature(F.col("numbers")).alias("sig")), key="entity").select("rid", "prior_rid")
    m = m.join(s.select("rid", "numbers", "mid"), "rid")
    m = m.join(s.select(F.col("rid").alias("prior_rid"), F.col("numbers").alias("pn"), F.col("mid").alias("pm")), "prior_rid", "left")
    return m.select("rid", G.revision(F.col("pn"), F.col("numbers"), F.col("pm"), F.col("mid")).alias("revision"))


def _rules():
    return {
        "missing_call": F.trim("call_id") != "", "missing_text": F.trim("evidence_text") != "", "bad_span": F.col("evidence_end") > F.col("evidence_start"),
        "bad_confidence": F.lower(F.trim("label_confidence")).isin("high", "medium", "low") | F.col("label_confidence").try_cast("double").between(0, 1),
    }


_R = """case when coalesce(trim(call_id) <> '', false) then null else 'missing_call' end, case when coalesce(trim(evidence_text) <> '', false) then null else 'missing_text' end,
  case when coalesce(evidence_end > evidence_start, false) then null else 'bad_span' end,
  case when coalesce(lower(trim(label_confidence)) in ('high', 'medium', 'low') or try_cast(label_confidence as double) between 0 and 1, false) then null else 'bad_confidence' end"""


@query(f"select distinct label_row_id, array_to_string(list_filter([{_R}], lambda x: x is not null), ',') errors from labels where label_row_id is not null")
def label_errors(spark, d):
    t = V.validate(read_table(spark, d, "labels").where("label_row_id is not null"), _rules())
    return t.select("label_row_id", F.array_join("errors", ",").alias("errors")).distinct()


@query(f"with e as (select unnest([{_R}]) code from labels) select c.code, count(e.code) n from (values ('missing_call'), ('missing_text'), ('bad_span'), ('bad_confidence')) c(code) left join e using (code) group by 1")
def label_error_summary(spark, d):
    return V.summary(read_table(spark, d, "labels"), _rules())


@query()
def doc_sentence_chunks(spark, d):
    """Runs of sentences of up to 1,800 characters of the normalised text, 200 shared."""
    t = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(K.packed(T.normalize_lines(F.col("text")))).alias("chunk_no", "x"))
    return t.select("doc_id", "chunk_no", "x.start", "x.end")


@query()
def doc_review_chunks(spark, d):
    """Pieces of up to 900 characters for review, on a made-up timeline."""
    t = docs(spark, d).where("text is not null").select("doc_id", K.review_chunks(F.col("text")).alias("p"))
    t = t.select("doc_id", F.posexplode(K.timeline(F.col("p"))).alias("chunk_no", "x"))
    return t.select("doc_id", "chunk_no", "x.start", "x.end", F.sha2("x.text", 256).alias("text_sha"))


@query()
def doc_redactions(spark, d):
    """Personal data of documents by kind."""
    t = docs(spark, d).where("text is not null").select("doc_id", P.redacted(F.col("text")).alias("r"))
    return P.redaction_summary(t.select("doc_id", F.inline("r.found")))


@query()
def doc_redacted(spark, d):
    t = docs(spark, d).where("text is not null").select("doc_id", P.redacted(F.col("text")).alias("r"))
    return t.select("doc_id", F.size("r.found").alias("n"), F.sha2("r.text", 256).alias("redacted_sha"))


@query()
def evidence_spans(spark, d):
    """Where the first sentence of each label's evidence stands in the documents of its ticker."""
    lab = read_table(spark, d, "labels").distinct().where("evidence_text is not null and ticker is not null")
    lab = lab.select("label_row_id", F.upper(F.trim("ticker")).alias("ticker"), F.regexp_extract("evidence_text", r"^([^.!?]+[.!?])", 1).alias("q"), F.col("event_date").alias("day"))
    doc = docs(spark, d).where("text is not null and ticker is not null").select("doc_id", F.upper(F.trim("ticker")).alias("ticker"), "text", F.col("fiscal_year").cast("string").alias("year"))
    # the years that a day names, found once for each day of a ticker
    years = lab.select("ticker", "day").distinct().join(doc.select("ticker", "year").distinct(), "ticker").where(F.col("day").contains(F.col("year")))
    key = F.struct("ticker", "year").alias("key")
    quotes = lab.join(years, ["ticker", "day"]).select(key, F.col("label_row_id").alias("quote_id"), F.col("q").alias("quote"))
    j = E.quote_spans(quotes, doc.select(key, F.col("doc_id").alias("text_id"), "text"))
    return j.select(F.col("quote_id").alias("label_row_id"), F.col("text_id").alias("doc_id"), "status", "start", "end")


@query(f"""with recursive {TURNS.lstrip()}, o as (select conv, start_s s, end_s e, row_number() over (partition by conv order by turn) r from turns where start_s is not null and end_s is not null),
w as (select conv, r, 0 no, s first, e last from o where r = 1 union all
  select o.conv, o.r, case when o.e - w.first > 30 then w.no + 1 else w.no end, case when o.e - w.first > 30 then o.s else w.first end, o.e from w join o on o.conv = w.conv and o.r = w.r + 1)
select conv, no chunk_no, first start, arg_max(last, r) "end", cast(count(*) as int) n from w group by conv, no, first""")
def time_packed_chunks(spark, d):
    t = turns(spark, d).select("conv", F.col("turn").alias("ord"), F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    return K.pack_time(t, key="conv")


@query(f"""with {TURNS}, a as (select distinct * from audio_behavior_segments where start_time_s <= end_time_s), f as (select lower(trim(case_id)) conv, audio_id, any_value(start_time_s) s, any_value(end_time_s) e from a group by 1, 2)
select audio_id, count(turns.turn) n_points, round(coalesce(avg(length(turns.text)), 0), 4) mean_chars from f left join turns on f.conv = turns.conv and turns.start_s between f.s and f.e group by audio_id""")
def points_in_intervals(spark, d):
    """Segment starts within each audio interval, both ends inclusive; 0 where there is none."""
    a = read_table(spark, d, "audio_behavior_segments").distinct().where("start_time_s <= end_time_s")
    a = a.select(norm_key(F.col("case_id")).alias("conv"), "audio_id", F.col("start_time_s").alias("s"), F.col("end_time_s").alias("e"))
    width = 60.0
    b = a.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    p = turns(spark, d).where("start_s is not null").select("conv", "start_s", F.length("text").alias("n"), F.floor(F.col("start_s") / width).alias("bucket"))
    hit = b.join(p, ["conv", "bucket"]).where("start_s between s and e").groupBy("audio_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("n").alias("m"))
    return a.select("audio_id").distinct().join(hit, "audio_id", "left").select("audio_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.round(F.coalesce("m", F.lit(0.0)), 4).alias("mean_chars"))


@query("""with v as (select lower(trim(chunk_id)) c, regexp_replace(lower(trim(label)), '[\\s_-]+', '_', 'g') l, count(*) n from (select distinct * from weak_labels) where trim(chunk_id) <> '' and trim(label) <> '' group by 1, 2),
r as (select c, l, n / sum(n) over (partition by c) p, row_number() over (partition by c order by n desc, l) k from v)
select c chunk_id, max(case when k = 1 then l end) first_label, max(case when k = 2 then l end) second_label, round(max(case when k = 1 then p end) - max(case when k = 2 then p end), 4) margin from r group by c""".replace("\\\\", "\\"))
def label_margins(spark, d):
    """The two best labels of each chunk's vote shares and the margin between them."""
    w = read_table(spark, d, "weak_labels").distinct().where("trim(label) <> ''")
    v = w.select(norm_key(F.col("chunk_id")).alias("chunk_id"), F.regexp_replace(F.lower(F.trim("label")), r"[\s_-]+", "_").alias("l")).where("chunk_id is not null")
    v = v.groupBy("chunk_id", "l").agg(F.count(F.lit(1)).alias("n"))
    g = v.groupBy("chunk_id").agg(F.sum("n").alias("t"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "l"))).alias("x"))
    a, b = F.get("x", 0), F.get("x", 1)
    return g.select("chunk_id", a["l"].alias("first_label"), b["l"].alias("second_label"), F.round(-a["n"] / F.col("t") + b["n"] / F.col("t"), 4).alias("margin"))


@query("""with j as (select distinct row_id, analyst_question_excerpt q, management_answer_excerpt a from joined_qa_audio_review),
t as (select row_id, list_distinct(regexp_extract_all(lower(coalesce(q, '')), '[a-z0-9]+')) x, list_distinct(regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9]+')) y from j)
select row_id, round(case when len(list_distinct(list_concat(x, y))) > 0 then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) else 0 end, 4) jaccard from t""")
def qa_jaccard(spark, d):
    j = read_table(spark, d, "joined_qa_audio_review").select("row_id", "analyst_question_excerpt", "management_answer_excerpt").distinct()
    x, y = (T.tokens(F.col(c), "[a-z0-9]+") for c in ("analyst_question_excerpt", "management_answer_excerpt"))
    return j.select("row_id", F.round(T.jaccard(x, y), 4).alias("jaccard"))


@query()
def qa_similarity(spark, d):
    """Sequence ratio of question and answer."""
    j = read_table(spark, d, "joined_qa_audio_review").select("row_id", "analyst_question_excerpt", "management_answer_excerpt").distinct()
    return j.select("row_id", F.round(K.similarity(F.col("analyst_question_excerpt"), F.col("management_answer_excerpt")), 4).alias("ratio"))


@query("select section, cast(quantile_disc(n_chars, 0.5) as bigint) p50, cast(quantile_disc(n_chars, 0.9) as bigint) p90, cast(quantile_disc(n_chars, 0.95) as bigint) p95, max(n_chars) top from documents where n_chars is not null group by section")
def nearest_rank_percentiles(spark, d):
    t = docs(spark, d)
    q = exact_quantiles(t, ["section"], "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "top": 1.0})
    return wide(q, ["section"], ["p50", "p90", "p95", "top"]).select("section", *(F.col(c).cast("long").alias(c) for c in ("p50", "p90", "p95", "top")))


@query(f"""with {TURNS}, t as (select conv, turn, start_s, end_s, role from turns where start_s < end_s), c as (select *, coalesce(lead(start_s) over (partition by conv order by start_s, turn) - end_s, 0) gap from t)
select conv, count(*) filter (where gap >= 1) n_pauses, round(coalesce(avg(gap) filter (where gap >= 1), 0), 4) mean_pause, round(coalesce(max(gap) filter (where gap >= 1), 0), 4) max_pause from c group by conv""")
def pause_statistics(spark, d):
    t = turns(spark, d).where("start_s < end_s")
    gap = F.coalesce(F.lead("start_s").over(Window.partitionBy("conv").orderBy("start_s", "turn")) - F.col("end_s"), F.lit(0.0))
    long = F.when(F.col("gap") >= 1, F.col("gap"))
    t = t.select("conv", gap.alias("gap"))
    return t.groupBy("conv").agg(F.count(long).alias("n_pauses"), F.round(F.coalesce(F.avg(long), F.lit(0.0)), 4).alias("mean_pause"), F.round(F.coalesce(F.max(long), F.lit(0.0)), 4).alias("max_pause"))


@query("""with e as (select event_id, event_type, ts, value, try_cast(json_extract_string(props, '$.k') as int) k from events)
select event_type, count(*) n, count(k) n_k, cast(sum(k) as bigint) total, max_by(event_id, (value, -event_id)) best from e group by event_type""")
def event_json_summary(spark, d):
    e = read_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("total"), F.max(F.struct("value", (-F.col("event_id")).alias("o"), "event_id"))["event_id"].alias("best"))


@query("select count(*) n, count(distinct user_id) users, count(distinct event_type) kinds from events")
def event_distinct(spark, d):
    return read_table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


