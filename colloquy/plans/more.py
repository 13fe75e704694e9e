"""Queries on baselines, re-ranking, quotas, fusion and chronological fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import classify as M
from colloquy.operators import labels as O
from colloquy.operators.quantiles import exact_quantiles
from colloquy.plans import documents as D
from colloquy.plans import labels as LB
from colloquy.plans import signals as SG
from colloquy.plans.registry import Registry
from colloquy.runtime import norm_key, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql

@query()
def text_classifier_prf(spark, d):
    """Held-out figures of TF-IDF with logistic regression."""
    p = M.holdout_predictions(SG.texts(spark, d), row_id="gold_label_id", text="text", label="truth")
    return O.precision_recall(p, "truth", "predicted", LB.NAMES)


@query()
def text_classifier_variants(spark, d):
    """Six variants and the majority on the same held-out rows, the best first."""
    return M.compare_variants(SG.texts(spark, d), row_id="gold_label_id", text="text", label="truth")


@query()
def text_classifier_folds(spark, d):
    """Five folds: every row predicted by the others' model."""
    p = M.cross_validated(SG.texts(spark, d), row_id="gold_label_id", text="text", label="truth")
    return O.precision_recall(p, "truth", "predicted", LB.NAMES)


@query()
def text_classifier_groups(spark, d):
    """Five folds of calls: no call is on both sides."""
    g = read_table(spark, d, "gold_labels").dropDuplicates(["gold_label_id"]).select("gold_label_id", norm_key(F.col("case_id")).alias("case_id"))
    p = M.group_validated(SG.texts(spark, d).join(g, "gold_label_id"), row_id="gold_label_id", text="text", label="truth", group="case_id")
    return O.precision_recall(p, "truth", "predicted", LB.NAMES)


_BONUS = "case when section = 'guidance_table' then 0.3 when section = 'qna' then 0.15 when section is null then -0.15 else 0 end"


@query(f"""with {D._BM25}, b as (select item_id, rk.doc_id, round(rk.score + {_BONUS}, 6) score from rk join documents using (doc_id) where rank <= 10)
select item_id, doc_id, score, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank from b""")
def bm25_reranked(spark, d):
    """The ten best by BM25, re-ranked with a bonus by section."""
    s = F.col("section")
    bonus = F.when(s == "guidance_table", 0.3).when(s == "qna", 0.15).when(s.isNull(), -0.15).otherwise(0.0)
    b = D.bm25_topk(spark, d).join(read_table(spark, d, "documents").select("doc_id", "section"), "doc_id")
    b = b.select("item_id", "doc_id", F.round(F.col("score") + bonus, 6).alias("score"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))


@query(f"""with w as (select distinct * from weak_labels), c as (select weak_label_id, lower(trim(case_id)) case_id, {LB._TIDY.format('label')} label, row_number() over (partition by lower(trim(case_id)), {LB._TIDY.format('label')} order by weak_label_id) k
  from w where trim(case_id) <> '' and trim(label) <> '')
select weak_label_id, case_id, label from c where k <= 8 order by weak_label_id limit 100""")
def capped_candidates(spark, d):
    """Candidates in order, at most eight for each case and label, the first hundred."""
    w = read_table(spark, d, "weak_labels").distinct().where("trim(case_id) <> '' and trim(label) <> ''")
    w = w.select("weak_label_id", norm_key(F.col("case_id")).alias("case_id"), LB.tidy(F.col("label")).alias("label"))
    k = F.row_number().over(Window.partitionBy("case_id", "label").orderBy("weak_label_id"))
    return w.withColumn("k", k).where("k <= 8").drop("k").orderBy("weak_label_id").limit(100)


@query("""with e as (select event_type, event_id, value y, extract(hour from ts)::double x, row_number() over (partition by event_type order by ts, event_id) r, count(*) over (partition by event_type) n from events),
f as (select event_type, regr_slope(y, x) b, regr_intercept(y, x) a, avg(y) m from e where r <= floor(n * 0.7) group by 1)
select event_type, count(*) n_test, round(avg(power(y - a - b * x, 2)), 4) model_mse, round(avg(power(y - m, 2)), 4) baseline_mse, round(avg(abs(y - a - b * x)), 4) model_mae from e join f using (event_type) where r > floor(n * 0.7) group by 1""")
def chronological_fit(spark, d):
    """Least squares on the first 70 % of each series in time, errors on the rest, beside the mean."""
    e = read_table(spark, d, "events").select("event_type", "event_id", F.col("value").alias("y"), F.hour("ts").cast("double").alias("x"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    # the time of the last early row; of rows at that time those with the smallest ids are early
    n = e.groupBy("event_type").agg(F.floor(F.count(F.lit(1)) * 0.7).alias("k"))
    at = exact_quantiles(e.where("event_type is not null"), ["event_type"], "t", {"t": 0.7}).select("event_type", F.col("x").cast("long").alias("cut"))
    e = e.join(at, "event_type").join(n, "event_type")
    below = e.where("t < cut").groupBy("event_type").agg(F.count(F.lit(1)).alias("below"))
    same = e.where("t = cut").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).select("event_id", "r")
    e = e.join(below, "event_type", "left").join(same, "event_id", "left")
    early = (F.col("t") < F.col("cut")) | ((F.col("t") == F.col("cut")) & (F.coalesce("below", F.lit(0)) + F.col("r") <= F.col("k")))
    f = e.where(early).groupBy("event_type").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("m"))
    err = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    t = e.where(~early).join(F.broadcast(f), "event_type")
    return t.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_test"), F.round(F.avg(err * err), 4).alias("model_mse"), F.round(F.avg(F.pow(F.col("y") - F.col("m"), 2)), 4).alias("baseline_mse"), F.round(F.avg(F.abs(err)), 4).alias("model_mae")
    )


@query("""with p as (select lower(trim(case_id)) case_id, person_role, count(*) n from participants group by all), s as (select lower(trim(case_id)) case_id, count(distinct message_index) n_messages from transcript_segments group by 1)
select case_id, coalesce(max(case when person_role = 'analyst' then n end), 0) n_analysts, coalesce(max(case when person_role = 'management' then n end), 0) n_management, any_value(n_messages) n_messages from p left join s using (case_id) group by case_id""")
def roster_pivot(spark, d):
    p = read_table(spark, d, "participants").groupBy(norm_key(F.col("case_id")).alias("case_id")).pivot("person_role", ["analyst", "management"]).agg(F.count(F.lit(1)))
    s = read_table(spark, d, "transcript_segments").groupBy(norm_key(F.col("case_id")).alias("case_id")).agg(F.count_distinct("message_index").alias("n_messages"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return p.join(s, "case_id", "left").select("case_id", zero(F.col("analyst")).alias("n_analysts"), zero(F.col("management")).alias("n_management"), "n_messages")
