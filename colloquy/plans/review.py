"""Queries on queues, contracts, gates, searches and error analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import contracts as Q
from colloquy.operators import queues as U
from colloquy.operators import validate as V
from colloquy.plans import labels as LB
from colloquy.plans import sqltext as X
from colloquy.plans.documents import docs
from colloquy.plans.registry import Registry
from colloquy.plans.signals import _PRED, _TEXTS, signal_rules, texts
from colloquy.plans.transcripts import _CHUNKS, doc_event_chunks
from colloquy.runtime import norm_key, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_W = f"w as (select weak_label_id, lower(trim(chunk_id)) chunk_id, lower(trim(case_id)) case_id, {LB._TIDY.format('label')} as label, confidence c from (select distinct * from weak_labels) where confidence between 0 and 1 and not isnan(confidence) and trim(case_id) <> '' and trim(label) <> '')"


def _weak(spark, d):
    w = read_table(spark, d, "weak_labels").distinct().where("confidence between 0 and 1 and not isnan(confidence) and trim(case_id) <> '' and trim(label) <> ''")
    return w.select("weak_label_id", norm_key(F.col("chunk_id")).alias("chunk_id"), norm_key(F.col("case_id")).alias("case_id"), LB.tidy(F.col("label")).alias("label"), F.col("confidence").alias("c"))


# Queues

_QUEUE = f"""{_W}, n as (select label, count(*) n from w group by 1),
q as (select chunk_id, min(case_id) case_id, array_to_string(list_sort(list(distinct label)), ';') suggested, count(*) n_suggestions, case when min(c) < 0.7 then 3 else 0 end + case when count(distinct label) >= 2 then 3 else 0 end + count(distinct label) filter (where n.n <= 2) points
  from w join n using (label) where chunk_id is not null and chunk_id <> '' group by chunk_id)"""


def _queue(spark, d):
    """One row for each chunk with its suggestions and points for low confidence, conflict and rare labels."""
    w = _weak(spark, d).where("chunk_id is not null")
    n = _weak(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    g = w.join(n, "label").groupBy("chunk_id").agg(
        F.min("case_id").alias("case_id"), F.array_sort(F.collect_set("label")).alias("l"), F.count(F.lit(1)).alias("n_suggestions"), F.min("c").alias("low"), F.count_distinct(F.when(F.col("n") <= 2, F.col("label"))).alias("rare")
    )
    points = F.when(F.col("low") < 0.7, 3).otherwise(0) + F.when(F.size("l") >= 2, 3).otherwise(0) + F.col("rare")
    return g.select("chunk_id", "case_id", F.array_join("l", ";").alias("suggested"), "n_suggestions", points.alias("points"))


@query(f"with {_QUEUE} select *, cast(row_number() over (order by points desc, case_id, chunk_id) as int) rank from q")
def review_queue(spark, d):
    """All chunks with suggestions, those with most points first."""
    return U.ranked(_queue(spark, d), [F.desc("points"), F.col("case_id"), F.col("chunk_id")])


@query(f"with {_QUEUE} select chunk_id, suggested, cast(row_number() over (order by sha256('13' || chr(31) || chunk_id), chunk_id) as int) rank from q order by rank limit 60")
def review_queue_random(spark, d):
    """A seeded sample of 60 chunks (a sampling operator)."""
    return U.ranked(_queue(spark, d).select("chunk_id", "suggested"), [U.seeded(13, "chunk_id"), F.col("chunk_id")], 60)


@query(f"""with {_QUEUE}, b as (select *, split_part(suggested, ';', 1) bucket from q), t as (select chunk_id, bucket, row_number() over (partition by bucket order by points desc, chunk_id) turn from b)
select chunk_id, bucket, cast(row_number() over (order by turn, bucket) as int) rank from t order by rank limit 60""")
def review_queue_stratified(spark, d):
    """Buckets by the first suggestion take turns: the first 60."""
    t = U.round_robin(_queue(spark, d).withColumn("bucket", F.substring_index("suggested", ";", 1)), "bucket", [F.desc("points"), F.col("chunk_id")])
    return U.ranked(t.select("chunk_id", "bucket", "turn"), [F.col("turn"), F.col("bucket")], 60).drop("turn")


@query(f"with {_QUEUE}, l as (select unnest(string_split(suggested, ';')) as label from q), tot as (select count(*) n from q) select label, count(*) items, any_value(tot.n) total_items, round(any_value(tot.n) * 45 / 60, 2) as minutes from l, tot group by label")
def review_workload(spark, d):
    q = _queue(spark, d)
    n = q.agg(F.count(F.lit(1)).alias("total_items"))
    g = q.select(F.explode(F.split("suggested", ";")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("items"))
    return g.join(F.broadcast(n)).select("label", "items", "total_items", F.round(F.col("total_items") * 45 / 60, 2).alias("minutes"))


@query(f"""with {_W}, a as (select *, row_number() over (partition by case_id, label order by c desc, weak_label_id) k from w)
select weak_label_id, case_id, label from (select *, row_number() over (partition by case_id order by c desc, weak_label_id) k2 from a where k <= 3) where k2 <= 8 order by c desc, weak_label_id limit 100""")
def capped_cascade(spark, d):
    """At most three for each case and label, of these at most eight for each case, the first hundred."""
    order = [F.desc("c"), F.col("weak_label_id")]
    c = U.capped(_weak(spark, d), caps={"label": ([F.col("case_id"), F.col("label")], 3), "case": ([F.col("case_id")], 8)}, order=order, limit=100)
    return c.select("weak_label_id", "case_id", "label")


@query(f"""with {_W}, a as (select *, row_number() over (partition by case_id, label order by c desc, weak_label_id) l from w), b as (select *, row_number() over (partition by case_id order by (l <= 3)::int desc, c desc, weak_label_id) k from a)
select weak_label_id, case_id, label, case when l <= 3 then 'quota' else 'fill' end picked from b where k <= 12""")
def balanced_batch(spark, d):
    b = U.balanced_batch(_weak(spark, d), key="case_id", label="label", order=[F.desc("c"), F.col("weak_label_id")])
    return b.select("weak_label_id", "case_id", "label", "picked")


@query(f"""with {_W}, a as (select *, c >= 0.35 ok, row_number() over (partition by label, c >= 0.35 order by c desc, weak_label_id) l from w), b as (select * from a order by (ok and l <= 4)::int desc, c desc, weak_label_id limit 30)
select weak_label_id, label, cast(row_number() over (order by c desc, weak_label_id) as int) rank from b""")
def label_quota_queue(spark, d):
    """Four sure rows of each label, then the surest others: 30 rows."""
    q = U.quota_then_fill(_weak(spark, d), label="label", fits=F.col("c") >= 0.35, order=[F.desc("c"), F.col("weak_label_id")], quota=4, limit=30)
    return q.select("weak_label_id", "label", "rank")


_QUOTAS = {"guidance_revision": 10, "analyst_pressure": 8, "uncertainty": 8, "neutral": 5}


@query(f"""with {_W}, a as (select *, row_number() over (partition by label order by case_id, c desc, weak_label_id) r from w), m as (select weak_label_id, label bucket from a where r <= case label {' '.join(f"when '{k}' then {v}" for k, v in _QUOTAS.items())} else 0 end),
r as (select weak_label_id, 'unsure' bucket from w where weak_label_id not in (select weak_label_id from m) order by abs(c - 0.5), weak_label_id limit 10) select * from m union all select * from r""")
def calibration_batch(spark, d):
    """Quotas of labels, and the ten least sure others."""
    b = U.calibration_batch(_weak(spark, d), row_id="weak_label_id", label="label", quotas=_QUOTAS, order=[F.col("case_id"), F.desc("c"), F.col("weak_label_id")], unsure=F.abs(F.col("c") - 0.5), n_unsure=10)
    return b.select("weak_label_id", "bucket")


@query("""with g as (select distinct gold_label_id id, lower(trim(case_id)) case_id, text, 'gold_labels' src, 0 s from gold_labels), l as (select distinct label_row_id + 500 id, lower(trim(call_id)) case_id, evidence_text as text, 'labels' src, 1 s from labels where label_row_id is not null),
e as (select id, case_id, text from g where id % 7 = 0), a as (select *, coalesce(text <> '' and case_id <> '', false) ok, sha256(coalesce(case_id, '') || chr(31) || coalesce(text, '')) h from (select * from g where id % 7 <> 0 union all select * from l)),
b as (select *, row_number() over (partition by id, ok order by s, id) k, id in (select id from e) old, h in (select sha256(coalesce(case_id, '') || chr(31) || coalesce(text, '')) from e) oldc from a),
c as (select *, ok and not old and k = 1 fresh from b), f as (select *, row_number() over (partition by h, fresh order by s, id) cn from c)
select id, src, case when not ok then 'invalid' when not fresh then 'duplicate_id' when oldc or cn > 1 then 'duplicate_content' else 'imported' end state from f""")
def import_sources(spark, d):
    """gold_labels and labels merged into a part of gold_labels; what was imported and why not."""
    g = read_table(spark, d, "gold_labels").select(F.col("gold_label_id").alias("id"), norm_key(F.col("case_id")).alias("case_id"), "text", F.lit("gold_labels").alias("src")).distinct()
    lab = read_table(spark, d, "labels").where("label_row_id is not null").select((F.col("label_row_id") + 500).alias("id"), norm_key(F.col("call_id")).alias("case_id"), F.col("evidence_text").alias("text"), F.lit("labels").alias("src")).distinct()
    m = U.merge_sources([g.where("id % 7 <> 0"), lab], g.where("id % 7 = 0"), row_id="id", keys=["case_id", "text"], valid=F.expr("text <> '' and case_id <> ''"), order="id")
    return m.select("id", "src", "state")


@query("""with a as (select distinct record_id, source_name, rights_tier from provenance_records), b as (select record_id, case when record_id % 11 = 0 then 'other' else source_name end source_name, 'checked' rights_tier from a where record_id % 5 <> 0 union all select record_id + 1000000, source_name, rights_tier from a where record_id % 50 = 1),
j as (select coalesce(a.record_id, b.record_id) record_id, a.source_name, a.rights_tier ar, b.rights_tier br, b.record_id is null m, a.record_id is null u, a.source_name is distinct from b.source_name ch from a full join b on a.record_id = b.record_id)
select record_id, source_name, case when not m and not u and not ch then br else ar end rights_tier, case when m then 'missing' when u then 'unexpected' when ch then 'changed:source_name' end error from j""")
def review_updates(spark, d):
    """A table with updates of its rights tiers, one in five missing, some unexpected or changing a fixed field."""
    a = read_table(spark, d, "provenance_records").select("record_id", "source_name", "rights_tier").distinct()
    b = a.where("record_id % 5 <> 0").withColumns({"source_name": F.when(F.col("record_id") % 11 == 0, "other").otherwise(F.col("source_name")), "rights_tier": F.lit("checked")})
    b = b.unionByName(a.where("record_id % 50 = 1").withColumn("record_id", F.col("record_id") + 1_000_000))
    return U.update_rows(a, b, key="record_id", fixed=["source_name"], changing=["rights_tier"])


# Contracts

_M = lambda code, ok: f"case when coalesce({ok}, false) then null else '{code}' end"


@query(f"""with {_CHUNKS}, r as (select chunk_id, chunk_type, case when start_char % 3 = 0 then 'false' else 'true' end raw_text_committed, text_sha text_sha256, case when end_char % 2 = 0 then text_sha else 'sha256:' end source_sha256 from chunks)
select chunk_id, array_to_string(list_filter([{_M('bad_chunk_type', f"chunk_type in {tuple(Q.CHUNK_TYPES)}")}, {_M('raw_text_committed', "raw_text_committed = 'false'")}, {_M('bad_source_sha256', f"regexp_matches(source_sha256, '{Q.SHA}')")}, {_M('bad_text_sha256', f"regexp_matches(text_sha256, '{Q.SHA}')")}], lambda x: x is not null), ',') errors from r""")
def chunk_manifest_errors(spark, d):
    """The chunk contract on event chunks of which some are made to break it."""
    c = doc_event_chunks(spark, d).select(
        "chunk_id", "chunk_type", F.when(F.col("start_char") % 3 == 0, "false").otherwise("true").alias("raw_text_committed"), F.col("text_sha").alias("text_sha256"), F.when(F.col("end_char") % 2 == 0, F.col("text_sha")).otherwise("sha256:").alias("source_sha256")
    )
    return V.validate(c, Q.chunk_manifest(c)).select("chunk_id", F.array_join("errors", ",").alias("errors"))


_ST = lambda c: f"coalesce({X.strip(c)}, '')"


@query(f"""with g as (select distinct gold_label_id, case_id, chunk_id, text, reviewer, {LB._TIDY.format("list_filter(labels, lambda x: trim(x) <> '')[1]")} lb, case when gold_label_id % 4 = 0 then 'draft' else 'Reviewed' end review_state from gold_labels)
select gold_label_id, array_to_string(list_filter([{_M('not_reviewed', "lower(review_state) in ('reviewed', 'approved')")}, {_M('no_label', f'lb in {LB._NAMES}')}, {', '.join(_M(f'missing_{f}', f"{_ST(f)} <> ''") for f in ('case_id', 'chunk_id', 'text', 'reviewer'))}], lambda x: x is not null), ',') errors from g""")
def reviewed_row_errors(spark, d):
    """The contract of reviewed rows on gold votes, of which every fourth is a draft."""
    g = read_table(spark, d, "gold_labels").select("gold_label_id", "case_id", "chunk_id", "text", "reviewer", LB.tidy(F.get(F.filter("labels", lambda x: F.trim(x) != ""), 0)).alias("labels"), F.when(F.col("gold_label_id") % 4 == 0, "draft").otherwise("Reviewed").alias("review_state")).distinct()
    return V.validate(g, Q.reviewed_row(g, LB.NAMES)).select("gold_label_id", F.array_join("errors", ",").alias("errors"))


@query(f"""with g as (select cast(gold_label_id as varchar) label_id, case_id, reviewer, review_timestamp reviewed_at, text evidence_text, {LB._TIDY.format("list_filter(labels, lambda x: trim(x) <> '')[1]")} final_label, 'sha256:' || json_extract_string(provenance, '$.source_id') provenance_hash from gold_labels)
select label_id, array_to_string(list_filter([{', '.join(_M(f'missing_{f}', f"{_ST(f)} <> ''") for f in ('label_id', 'case_id', 'final_label'))}, {', '.join(_M(f'missing_{f}', 'true') for f in ('review_status', 'gold_status'))},
  {', '.join(_M(f'missing_{f}', f"{_ST(f)} <> ''") for f in ('reviewer', 'reviewed_at', 'evidence_text'))}, {', '.join(_M(f'missing_{f}', 'false') for f in ('source_file',))}, {_M('missing_provenance_hash', "coalesce(provenance_hash, '') <> ''")}, {', '.join(_M(f'missing_{f}', 'false') for f in ('adjudicator', 'adjudicated_at'))},
  {_M('no_rationale', f"{_ST('final_label')} <> ''")}, {_M('duplicate_label_id', 'count(*) over (partition by label_id) = 1')}, {_M('duplicate_provenance_hash', "coalesce(provenance_hash, '') = '' or count(*) over (partition by coalesce(provenance_hash, '')) = 1")}], lambda x: x is not null), ',') errors from g""")
def promotion_errors(spark, d):
    """The contract of promotion on all rows of gold_labels, redeliveries included."""
    g = read_table(spark, d, "gold_labels").select(
        F.col("gold_label_id").cast("string").alias("label_id"), "case_id", "reviewer", F.col("review_timestamp").alias("reviewed_at"), F.col("text").alias("evidence_text"), LB.tidy(F.get(F.filter("labels", lambda x: F.trim(x) != ""), 0)).alias("final_label"),
        F.concat(F.lit("sha256:"), F.get_json_object("provenance", "$.source_id")).alias("provenance_hash"), F.lit("adjudicated").alias("review_status"), F.lit("promotion_candidate").alias("gold_status"),
    )
    return V.validate(g, Q.promotion(g)).select("label_id", F.array_join("errors", ",").alias("errors"))


_LOWDOC = "lower(coalesce(text, ''))"
_BARE = _LOWDOC
for _d in Q.DISCLAIMERS:
    _BARE = f"replace({_BARE}, '{_d.lower()}', '')"


@query(f"""select doc_id, array_to_string(list_filter([{', '.join(f"case when regexp_matches({_LOWDOC}, {X.q(p)}) then {X.q(p)} end" for p in Q.MARKET_CLAIMS)}], lambda x: x is not null), ' ') market_claims,
  array_to_string(list_filter([{', '.join(f"case when {X.any_phrase(_BARE, ws)} then '{c}' end" for c, ws in Q.CLAIM_ERRORS.items())}], lambda x: x is not null), ',') claim_errors, {X.any_pattern(_LOWDOC, Q.TRANSCRIPT_LIKE)} transcript_like from documents""")
def doc_claims(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.array_join(Q.market_claims(c), " ").alias("market_claims"), F.array_join(Q.claim_language(c), ",").alias("claim_errors"), Q.transcript_like(c).alias("transcript_like"))


# Gates and readiness


@query(f"""with {LB._GOLD}, n as (select l.label, count(gold.label) n from (select unnest({list(LB.NAMES)}) as label) l left join gold on gold.label = l.label group by 1), t as (select cast(sum(n) as bigint) total, count(*) filter (where n < 2) short from n),
c as (select count(distinct lower(trim(call_id))) calls from labels where trim(call_id) <> '')
select total total_examples, short n_short_labels, total >= 12 and short = 0 ready, calls, case when calls >= 30 then 'PIPELINE_READY_ONLY' else 'NOT_ENOUGH_DATA' end pilot, case when total >= 100 then 'READY' else 'NOT_ENOUGH_DATA' end signal_eval,
  case when calls between 100 and 150 and total >= 100 then 'READY' else 'NOT_ENOUGH_DATA' end retrieval_benchmark, case when calls >= 500 then 'METADATA_READY_MAP_ONLY' else 'NOT_ENOUGH_DATA' end universe from t, c""")
def sample_gates(spark, d):
    """Whether there are enough labels and calls for training, evaluation and benchmarks."""
    dim = spark.createDataFrame([(n,) for n in LB.NAMES], "label string")
    n = dim.join(LB.gold(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").fillna(0, ["n"])
    t = n.agg(F.sum("n").alias("total"), F.count_if(F.col("n") < 2).alias("short"))
    c = read_table(spark, d, "labels").select(norm_key(F.col("call_id")).alias("c")).where("c is not null").agg(F.count_distinct("c").alias("calls"))
    no = "NOT_ENOUGH_DATA"
    j = t.join(F.broadcast(c))
    total, calls = F.col("total"), F.col("calls")
    return j.select(
        total.alias("total_examples"), F.col("short").alias("n_short_labels"), ((total >= 12) & (F.col("short") == 0)).alias("ready"), "calls", F.when(calls >= 30, "PIPELINE_READY_ONLY").otherwise(no).alias("pilot"),
        F.when(total >= 100, "READY").otherwise(no).alias("signal_eval"), F.when(calls.between(100, 150) & (total >= 100), "READY").otherwise(no).alias("retrieval_benchmark"), F.when(calls >= 500, "METADATA_READY_MAP_ONLY").otherwise(no).alias("universe"),
    )


@query(f"with {_TEXTS}, e as (select truth, ({_PRED}) p from texts) select count(*) n, round(avg(abs(p.confidence - (truth = p.label)::int)), 4) calibration_error from e")
def calibration_error(spark, d):
    """Mean distance of a rule's confidence from whether it is right."""
    e = signal_rules(spark, d)
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("confidence") - (F.col("truth") == F.col("predicted")).cast("int"))), 4).alias("calibration_error"))


# Errors

#: Clusters of errors by phrases.
CLUSTERS = {
    "hedge_or_conditional": ["if", "whether", "probably", "maybe", "may", "might", "could", "depends", "once"],
    "rollout_procurement_pilot": ["rollout", "procurement", "pilot", "security review", "implementation", "expansion"],
    "generic_positive_or_commitment": ["send", "follow up", "schedule", "review", "owner", "fixed", "recovery plan"],
    "weak_blocker_language": ["legal", "renewal", "still open", "discount", "pricing", "someone will reach out"],
    "guidance_outlook": ["guidance", "outlook", "expect", "expected", "revenue", "plus or minus"],
}
_NT = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"""with {_TEXTS}, e as (select gold_label_id, {_NT} t, truth, ({_PRED}).label predicted from texts), f as (select * from e where truth <> predicted),
c as (select gold_label_id, list_filter([{', '.join("case when " + ' or '.join(X.term_found('t', w) for w in ws) + f" then '{n}' end" for n, ws in CLUSTERS.items())}], lambda x: x is not null) c from f),
u as (select gold_label_id, unnest(case when len(c) = 0 then ['low_evidence_or_other'] else c end) cluster from c) select cluster, count(*) n from u group by 1""")
def error_clusters(spark, d):
    """Wrong predictions by every cluster they fit, the others by themselves."""
    e = signal_rules(spark, d).where("truth <> predicted").select("gold_label_id").join(texts(spark, d).select("gold_label_id", T.plain(F.col("text")).alias("t")), "gold_label_id")
    found = F.array_compact(F.array(*(F.when(_any_term(ws), F.lit(n)) for n, ws in CLUSTERS.items())))
    u = e.select(F.explode(F.when(F.size(found) == 0, T.lits(["low_evidence_or_other"])).otherwise(found)).alias("cluster"))
    return u.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _any_term(ws):
    out = T.term_in(F.col("t"), ws[0])
    for w in ws[1:]:
        out = out | T.term_in(F.col("t"), w)
    return out


@query(f"""{LB._BOTH}, r as (select chunk_id, truth, predicted from ev where truth <> predicted) select truth, predicted, count(*) n, min(chunk_id) example from r group by 1, 2""")
def disagreements(spark, d):
    r = LB.evaluated(spark, d).where("truth <> predicted")
    return r.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("example"))


@query(f"""with {LB._GOLD}, {LB._WEAK}, e as (select gold.chunk_id, gold.label g, weak.label w from gold left join weak using (chunk_id)), l as (select unnest({list(LB.NAMES)}) as label)
select label, count(*) filter (where g = label and w = label) tp, count(*) filter (where g <> label and coalesce(w, '') = label) fp, count(*) filter (where g = label and coalesce(w, '') <> label) fn, count(*) filter (where g <> label and coalesce(w, '') <> label) tn from l cross join e group by label""")
def label_cells(spark, d):
    """All four cells of every label of gold chunks against their suggestion, if any."""
    e = LB.gold(spark, d).withColumnRenamed("label", "g").join(LB.weak(spark, d).select("chunk_id", F.col("label").alias("w")), "chunk_id", "left").withColumn("w", F.coalesce("w", F.lit("")))
    n = e.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n"))
    cells = n.select("g", "w", "n", F.explode(T.lits(LB.NAMES)).alias("label"))
    on = lambda a, b: F.sum(F.when(a & b, F.col("n")).otherwise(0))
    g, w = F.col("g") == F.col("label"), F.col("w") == F.col("label")
    return cells.groupBy("label").agg(on(g, w).alias("tp"), on(~g, w).alias("fp"), on(g, ~w).alias("fn"), on(~g, ~w).alias("tn"))


@query(f"""with {LB._GOLD}, c as (select l.label, count(gold.chunk_id) n from (select unnest({list(LB.NAMES)}) as label) l left join gold on gold.label = l.label group by 1) select label, n, n = 0 missing from c""")
def gold_coverage(spark, d):
    dim = spark.createDataFrame([(n,) for n in LB.NAMES], "label string")
    n = LB.gold(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "label", "left").fillna(0, ["n"]).withColumn("missing", F.col("n") == 0)


@query(f"with {_W}, r as (select *, row_number() over (partition by label order by c desc, case_id, weak_label_id) k from w) select weak_label_id, label, cast(k as int) k from r where k <= 4")
def holdout_candidates(spark, d):
    """The four best of each label."""
    w = Window.partitionBy("label").orderBy(F.desc("c"), "case_id", "weak_label_id")
    return _weak(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 4").select("weak_label_id", "label", "k")


@query(f"""with {LB._GOLD}, {_W} select bucket, eligible, count(*) n from (select 'human' bucket, true eligible from gold union all select 'weak', false from w union all select 'external', false from eval_passages union all select 'retrieval', false from documents) group by all""")
def training_buckets(spark, d):
    """Candidates of all sources, tagged; only human labels may be gold."""
    tag = lambda df, b, ok: df.select(F.lit(b).alias("bucket"), F.lit(ok).alias("eligible"))
    every = tag(LB.gold(spark, d), "human", True).unionByName(tag(_weak(spark, d), "weak", False)).unionByName(tag(read_table(spark, d, "eval_passages"), "external", False)).unionByName(tag(read_table(spark, d, "documents"), "retrieval", False))
    return every.groupBy("bucket", "eligible").agg(F.count(F.lit(1)).alias("n"))


@query("with t as (select doc_id, sha256(text) sha from documents where text is not null), g as (select sha, list_sort(list(doc_id)) ids from t group by 1 having count(*) > 1) select unnest(ids) doc_id, sha text_sha, ids[1] first_doc, len(ids) n from g")
def duplicate_members(spark, d):
    """Every member of a group of equal texts, with the first and the size of its group; no member list is collected."""
    t = docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    g = t.groupBy("text_sha").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    return t.join(g, "text_sha").select("doc_id", "text_sha", "first_doc", "n")


# Searches

_WORDS = ["outlook", "margin", "inventory"]


@query(f"""with s as (select doc_id, coalesce(fiscal_year, 9999) y, {' + '.join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in _WORDS)} + 3 * ({' + '.join(f"contains(lower(coalesce(section, '') || ' ' || coalesce(source, '')), '{w}')::int" for w in _WORDS)}) score from documents where text is not null)
select doc_id, cast(score as int) score, cast(row_number() over (order by score desc, y, doc_id) as int) rank from s where score > 0 order by rank limit 20""")
def keyword_search(spark, d):
    """Documents by how often words occur, those in section or source thrice: the first 20."""
    low, title = F.lower("text"), F.lower(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("source", F.lit(""))))
    n = sum((F.regexp_count(low, F.lit(w)) for w in _WORDS[1:]), F.regexp_count(low, F.lit(_WORDS[0]))) + 3 * sum((title.contains(w).cast("int") for w in _WORDS[1:]), title.contains(_WORDS[0]).cast("int"))
    t = docs(spark, d).where("text is not null").select("doc_id", F.coalesce("fiscal_year", F.lit(9999)).alias("y"), n.alias("score")).where("score > 0")
    return U.ranked(t, [F.desc("score"), F.col("y"), F.col("doc_id")], 20).drop("y")
