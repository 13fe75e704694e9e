"""Queries on gold and weak labels: evaluation, audits, queues, votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import contracts as Q
from colloquy.operators import labels as O
from colloquy.plans.registry import Registry
from colloquy.runtime import norm_key, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql
NAMES = ["guidance_revision", "analyst_pressure", "uncertainty", "commitment", "neutral"]
_TIDY = r"regexp_replace(lower(trim({})), '[\s_-]+', '_', 'g')"
_GOLD = f"""gold as (select chunk_id, label from (
  select lower(trim(chunk_id)) chunk_id, {_TIDY.format("list_filter(labels, lambda x: trim(x) <> '')[1]")} label, row_number() over (partition by lower(trim(chunk_id)) order by gold_label_id) k
  from gold_labels where len(list_filter(labels, lambda x: trim(x) <> '')) > 0 and chunk_id is not null) where k = 1)"""
_WEAK = f"""weak as (select chunk_id, label, confidence from (
  select lower(trim(chunk_id)) chunk_id, {_TIDY.format('label')} label, confidence, row_number() over (partition by lower(trim(chunk_id)) order by weak_label_id) k
  from (select distinct * from weak_labels) where label is not null and chunk_id is not null) where k = 1)"""
_NAMES = "(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
_BOTH = f"with {_GOLD}, {_WEAK}, ev as (select chunk_id, gold.label truth, weak.label predicted, confidence from gold join weak using (chunk_id))"


def tidy(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def gold(spark, d):
    g = read_table(spark, d, "gold_labels").withColumn("l", F.filter("labels", lambda x: F.trim(x) != ""))
    g = g.where("size(l) > 0 and chunk_id is not null").select(norm_key(F.col("chunk_id")).alias("chunk_id"), tidy(F.get("l", 0)).alias("label"), "gold_label_id")
    return g.groupBy("chunk_id").agg(F.min_by("label", "gold_label_id").alias("label"))


def weak(spark, d):
    w = read_table(spark, d, "weak_labels").where("label is not null and chunk_id is not null")
    w = w.select(norm_key(F.col("chunk_id")).alias("chunk_id"), tidy(F.col("label")).alias("label"), "confidence", "weak_label_id")
    return w.groupBy("chunk_id").agg(F.min_by(F.struct("label", "confidence"), "weak_label_id").alias("x")).select("chunk_id", "x.label", "x.confidence")


def evaluated(spark, d):
    return gold(spark, d).withColumnRenamed("label", "truth").join(weak(spark, d).withColumnRenamed("label", "predicted"), "chunk_id")


@query(f"{_BOTH}, l as (select unnest({list(NAMES)}) n) select a.n truth, b.n predicted, count(ev.chunk_id) n from l a cross join l b left join ev on ev.truth = a.n and ev.predicted = b.n group by 1, 2")
def label_confusion(spark, d):
    return O.confusion(evaluated(spark, d), "truth", "predicted", NAMES)


_PRF = f"""{_BOTH}, e2 as (select * from ev where truth in {_NAMES} and predicted in {_NAMES}), l as (select unnest({list(NAMES)}) label), c as (
  select label, count(*) filter (where truth = label and predicted = label) tp, count(*) filter (where truth <> label and predicted = label) fp, count(*) filter (where truth = label and predicted <> label) fn
  from l cross join e2 group by label), m as (select *, tp + fn support, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r from c)"""


@query(f"{_PRF} select label, tp, fp, fn, support, round(p, 4) as precision, round(r, 4) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1 from m")
def label_prf(spark, d):
    return O.precision_recall(evaluated(spark, d), "truth", "predicted", NAMES)


@query(f"""{_PRF}, f as (select *, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1 from m)
select round(avg(f1), 4) macro_f1, round(sum(f1 * support) / sum(support), 4) weighted_f1, round(sum(tp) / sum(support), 4) accuracy from f""")
def label_averages(spark, d):
    m = label_prf(spark, d)
    return m.agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"))


@query(f"""{_BOTH}, t as (select truth l, count(*) n from ev group by 1), p as (select predicted l, count(*) n from ev group by 1), s as (select count(*) n, count(*) filter (where truth = predicted) same from ev),
e as (select sum(t.n * p.n) e from t join p using (l)) select n, round(same / n * 100, 4) agreement, round((same / n - e / n / n) / (1 - e / n / n), 4) kappa from s, e""")
def label_kappa(spark, d):
    return O.kappa(evaluated(spark, d), "truth", "predicted")


@query(f"""{_BOTH}, b as (select least(floor(confidence * 10), 9)::int bin, confidence, (truth = predicted)::int y from ev where confidence between 0 and 1 and not isnan(confidence))
select r.bin::int bin, count(b.y) n, round(avg(confidence), 4) avg_score, round(avg(y), 4) positive_rate from range(10) r(bin) left join b on b.bin = r.bin group by 1""")
def calibration_bins(spark, d):
    return O.calibration(evaluated(spark, d), "confidence", F.col("truth") == F.col("predicted"))


@query(f"""{_BOTH} select n.label, count(ev.chunk_id) support from (select unnest({list(NAMES)}) as label) n left join ev on ev.truth = n.label group by 1""")
def label_support(spark, d):
    dim = spark.createDataFrame([(n,) for n in NAMES], "label string")
    n = evaluated(spark, d).groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("support"))
    return dim.join(n, "label", "left").fillna(0, ["support"])


@query(f"with {_GOLD}, {_WEAK} select coalesce(gold.chunk_id, weak.chunk_id) chunk_id, case when weak.chunk_id is null then 'gold_only' when gold.chunk_id is null then 'weak_only' when gold.label = weak.label then 'same' else 'different' end status from gold full join weak using (chunk_id)")
def label_full_match(spark, d):
    g, w = gold(spark, d).withColumnRenamed("label", "g"), weak(spark, d).withColumnRenamed("label", "w")
    s = F.when(F.col("w").isNull(), "gold_only").when(F.col("g").isNull(), "weak_only").when(F.col("g") == F.col("w"), "same").otherwise("different")
    return g.join(w, "chunk_id", "full_outer").select("chunk_id", s.alias("status"))


_AUDIT = r"""gl as (select distinct * from gold_labels), ga as (select *, count(*) over (partition by trim(cast(gold_label_id as varchar))) k, regexp_replace(lower(trim(list_filter(labels, lambda x: trim(x) <> '')[1])), '[\s_-]+', '_', 'g') sig from gl),
audit as (select gold_label_id, case when k > 1 then 'BLOCKED_DUPLICATE' when source = 'external_dataset' then 'BLOCKED_EXTERNAL_SOURCE' when coalesce(json_extract_string(provenance, '$.source_id'), '') = '' then 'BLOCKED_NO_PROVENANCE'
  when coalesce(trim(text), '') = '' or coalesce(trim(reviewer), '') = '' or coalesce(trim(review_timestamp), '') = '' then 'REPAIRABLE_REVIEW_REQUIRED' when coalesce(trim(case_id), '') = '' or sig is null
    or sig not in ('guidance_revision', 'analyst_pressure', 'management_hedging', 'uncertainty', 'opportunity_commitment', 'risk_friction', 'neutral', 'neutral/no_signal', 'reassurance', 'answer_shift') then 'REPAIRABLE_SCHEMA_ONLY' else 'VALID' end status from ga)"""


def audited(spark, d):
    """gold_labels as rows of the gold contract: the source id stands for the hash, section and direction are given."""
    g = read_table(spark, d, "gold_labels").distinct()
    source = F.get_json_object("provenance", "$.source_id")
    g = g.select(
        F.col("gold_label_id").cast("string").alias("label_id"), "case_id", tidy(F.get(F.filter("labels", lambda x: F.trim(x) != ""), 0)).alias("signal_type"), F.lit("none").alias("direction"), F.lit("unknown").alias("speaker_role"),
        F.col("text").alias("evidence_text"), "reviewer", F.col("review_timestamp").alias("reviewed_at"), F.col("source").alias("source_type"), F.lit("gold_labels").alias("source_file"), F.when(source != "", F.concat(F.lit("sha256:"), source)).alias("provenance_hash"),
    )
    return g.withColumn("status", Q.gold_status(g))


@query(f"with {_AUDIT} select status, count(*) n from audit group by 1")
def gold_audit(spark, d):
    """How many votes have which status of the gold contract."""
    return audited(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_GOLD}, {_WEAK} select coalesce(gold.chunk_id, weak.chunk_id) chunk_id, coalesce(gold.label, weak.label) label, case when gold.chunk_id is null then 'existing' else 'new' end origin from gold full join weak using (chunk_id)")
def gold_merge(spark, d):
    """Weak labels as existing rows, gold labels merged over them."""
    cols = lambda df: df.select("chunk_id", "label", F.lit(0).alias("o"))
    return O.upsert(cols(weak(spark, d)), cols(gold(spark, d)), "chunk_id", "o").drop("o")


@query(f"with {_GOLD}, {_WEAK} select chunk_id, label from gold where chunk_id not in (select chunk_id from weak where label = 'neutral')")
def gold_append(spark, d):
    """Gold labels of chunks that no neutral weak label has."""
    return O.append(weak(spark, d).where("label = 'neutral'"), gold(spark, d), "chunk_id")


@query(f"""with w as (select distinct * from weak_labels), v as (select lower(trim(chunk_id)) chunk_id, {_TIDY.format('label')} label, min(weak_label_id) o, count(*) n from w where chunk_id is not null and trim(chunk_id) <> '' and trim(label) <> '' group by 1, 2)
select chunk_id, arg_max(label, (n, -o)) label, cast(sum(n) as bigint) n_votes, count(*) > 1 disagreement from v group by chunk_id""")
def fusion_vote(spark, d):
    """Majority of all votes for a chunk; equal counts go to the label voted first."""
    w = read_table(spark, d, "weak_labels").distinct().where("trim(label) <> ''")
    v = w.select(norm_key(F.col("chunk_id")).alias("chunk_id"), tidy(F.col("label")).alias("label"), "weak_label_id").where("chunk_id is not null")
    v = v.groupBy("chunk_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("weak_label_id").alias("o"))
    return v.groupBy("chunk_id").agg(F.max(F.struct("n", (-F.col("o")).alias("o"), "label"))["label"].alias("label"), F.sum("n").alias("n_votes"), (F.count(F.lit(1)) > 1).alias("disagreement"))


_CONF = "case when confidence is null or isnan(confidence) then 'unknown' when confidence < 0.4 then 'LOW' when confidence < 0.6 then 'MEDIUM' else 'HIGH' end"


@query(f"""with w as (select distinct * from weak_labels) select lower(trim(case_id)) case_id, {_TIDY.format('label')} label, count(*) n, count(*) filter (where {_CONF} = 'HIGH') n_high, count(*) filter (where {_CONF} = 'MEDIUM') n_medium, count(*) filter (where {_CONF} = 'LOW') n_low, count(*) filter (where chunk_id is null) n_unmatched
from w where trim(case_id) <> '' group by 1, 2""")
def summary_by_case_label(spark, d):
    c = F.col("confidence")
    known = c.isNotNull() & ~F.isnan(c)
    return read_table(spark, d, "weak_labels").distinct().where("trim(case_id) <> ''").groupBy(norm_key(F.col("case_id")).alias("case_id"), tidy(F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known & (c >= 0.6)).alias("n_high"), F.count_if(known & (c >= 0.4) & (c < 0.6)).alias("n_medium"), F.count_if(known & (c < 0.4)).alias("n_low"), F.count_if(F.col("chunk_id").isNull()).alias("n_unmatched")
    )


@query(f"""with w as (select distinct * from weak_labels) select {_CONF} priority, {_TIDY.format('label')} as label, count(*) n, count(distinct lower(trim(case_id))) n_cases, count(*) filter (where chunk_id is null) n_unmatched from w group by 1, 2""")
def summary_by_priority(spark, d):
    c = F.col("confidence")
    p = F.when(c.isNull() | F.isnan(c), "unknown").when(c < 0.4, "LOW").when(c < 0.6, "MEDIUM").otherwise("HIGH")
    return read_table(spark, d, "weak_labels").distinct().groupBy(p.alias("priority"), tidy(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("case_id"))).alias("n_cases"), F.count_if(F.col("chunk_id").isNull()).alias("n_unmatched"))


@query(f"""with w as (select distinct * from weak_labels), c as (select *, {_TIDY.format('label')} l, row_number() over (partition by lower(trim(case_id)), {_TIDY.format('label')} order by confidence desc nulls last, weak_label_id) k from w
  where confidence between 0 and 1 and not isnan(confidence) and trim(case_id) <> '' and trim(label) <> '')
select weak_label_id, l label, cast(k as int) k from c where k <= 3""")
def balanced_candidates(spark, d):
    """At most three candidates for each case and label, the most confident first."""
    w = read_table(spark, d, "weak_labels").distinct().where("confidence between 0 and 1 and not isnan(confidence) and trim(case_id) <> '' and trim(label) <> ''")
    w = w.select("weak_label_id", norm_key(F.col("case_id")).alias("c"), tidy(F.col("label")).alias("label"), "confidence")
    by = Window.partitionBy("c", "label").orderBy(F.desc("confidence"), "weak_label_id")
    return w.withColumn("k", F.row_number().over(by)).where("k <= 3").select("weak_label_id", "label", "k")


_LW = r"case lower(trim(label_confidence)) when 'high' then 0.9 when 'medium' then 0.6 when 'low' then 0.3 end"


@query(f"""select distinct label_row_id, round(coalesce({_LW}, least(1, greatest(0, case when try_cast(label_confidence as double) > 1 then try_cast(label_confidence as double) / 100 else try_cast(label_confidence as double) end)), 0), 4) confidence from labels where label_row_id is not null""")
def label_confidence(spark, d):
    """Words, shares and percentages as one number in [0, 1]; unreadable is 0."""
    c = F.lower(F.trim("label_confidence"))
    n = F.col("label_confidence").try_cast("double")
    n = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(n > 1, n / 100).otherwise(n)))
    w = F.when(c == "high", 0.9).when(c == "medium", 0.6).when(c == "low", 0.3)
    return read_table(spark, d, "labels").select("label_row_id", F.round(F.coalesce(w, n, F.lit(0.0)), 4).alias("confidence")).distinct()


@query(r"""select lower(trim(call_id)) call_id, regexp_extract(lower(trim(call_id)), '_([0-9]{4})q([1-4])_', 1) fiscal_year, regexp_extract(lower(trim(call_id)), '_([0-9]{4})q([1-4])_', 2) "quarter", count(*) n from labels where call_id is not null group by 1, 2, 3""")
def case_period(spark, d):
    c = norm_key(F.col("call_id"))
    p = r"_([0-9]{4})q([1-4])_"
    t = read_table(spark, d, "labels").where("call_id is not null").select(c.alias("call_id"))
    return t.groupBy("call_id", F.regexp_extract("call_id", p, 1).alias("fiscal_year"), F.regexp_extract("call_id", p, 2).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
