"""Tone and behaviour of sentences by rules: contexts, evidence, scores, shifts between remarks and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T

FAMILIES = {"uncertainty": L.UNCERTAINTY_RULES, "reassurance": L.REASSURANCE_RULES, "skepticism": L.SKEPTICISM_RULES}


def sentences_of(c: Column) -> Column:
    """Trimmed sentences, up to their final signs; a text of signs only is one."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"([^.!?]+(?:[.!?]+|$))"), 1), T.strip), lambda x: x != "")
    whole = T.strip(c)
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def context_of(c: Column) -> Column:
    """Who speaks like this: operator, analyst (a question) or management."""
    t = T.compact(c)
    return F.when(T.any_pattern(t, L.OPERATOR_PATTERNS), "operator").when(T.any_pattern(t, L.QUESTION_PATTERNS), "analyst").otherwise("management")


def evidence(df: DataFrame, row: list[str], text: str) -> DataFrame:
    """(row..., sentence_no, sentence, family, rule, hint, ord, hits, strength): what rules find in each sentence.

    Caution and reassurance count in management's sentences that are no boilerplate, doubts in
    questions. hint is the kind or topic of the rule, ord its place. Null texts have no sentence."""
    s = df.where(F.col(text).isNotNull()).select(*row, F.posexplode(sentences_of(F.col(text))).alias("sentence_no", "sentence"))
    s = s.withColumn("speaker", context_of(F.col("sentence"))).where("speaker <> 'operator'")
    low, flat = F.lower("sentence"), T.compact(F.col("sentence"))
    plain = (F.col("speaker") == "management") & ~T.any_pattern(flat, L.BOILERPLATE_PATTERNS)
    modal = ~T.any_pattern(flat, L.MODAL_EXCLUSIONS)

    def cell(family: str, i: int, name: str, hint: str, pattern: str, strength: int) -> Column:
        when = F.col("speaker") == "analyst" if family == "skepticism" else plain & modal if name == "modal uncertainty" else plain
        n = F.when(when, F.regexp_count(low, F.lit(pattern))).otherwise(0)
        return F.struct(F.lit(family).alias("family"), F.lit(name).alias("rule"), F.lit(hint).alias("hint"), F.lit(i).alias("ord"), n.alias("hits"), F.lit(strength).alias("s"))

    cells = [cell(f, i, *r) for f, rules in FAMILIES.items() for i, r in enumerate(rules)]
    hit = s.select(*row, "sentence_no", "sentence", F.inline(F.filter(F.array(*cells), lambda x: x["hits"] > 0)))
    return hit.withColumn("strength", F.col("hits") * F.col("s")).drop("s")


def level(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def scores(found: DataFrame, row: list[str]) -> DataFrame:
    """(row..., uncertainty, reassurance, skepticism and their levels) of rows with evidence."""
    g = found.groupBy(*row).agg(*(F.sum(F.when(F.col("family") == f, F.col("strength")).otherwise(0)).alias(f) for f in FAMILIES))
    return g.select(*row, *FAMILIES, *(level(F.col(f)).alias(f"{f}_level") for f in FAMILIES))


def doubting_questions(found: DataFrame, row: list[str]) -> DataFrame:
    """(row..., sentence_no, matched, topic, strength, label): each doubting question with its strongest cue, the first of equal ones."""
    best = F.max(F.struct("s", (-F.col("ord")).alias("o"), "rule", "hint"))
    one = found.where("family = 'skepticism'").withColumn("s", (F.col("strength") / F.col("hits")).cast("int"))
    g = one.groupBy(*row, "sentence_no").agg(best.alias("b"), F.sum("strength").alias("strength"))
    return g.select(*row, "sentence_no", F.col("b.rule").alias("matched"), F.col("b.hint").alias("topic"), "strength", level(F.col("strength")).alias("label"))


def strongest(found: DataFrame, row: list[str], n: int = 2) -> DataFrame:
    """(row..., family, k, rule, strength, sentence): the ``n`` strongest matches of each family, then without repeats.

    A rule that hits repeatedly in a sentence counts repeatedly before the cut, so fewer than ``n`` may be left."""
    each = found.select(*row, "family", "rule", "sentence", "sentence_no", "ord", (F.col("strength") / F.col("hits")).cast("int").alias("strength"), F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("copy"))
    w = Window.partitionBy(*row, "family").orderBy(F.desc("strength"), "sentence", "sentence_no", "ord", "copy")
    top = each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return top.groupBy(*row, "family", "rule", "sentence").agg(F.min("k").alias("k"), F.first("strength").alias("strength")).select(*row, "family", "k", "rule", "strength", "sentence")


def phases(scored: DataFrame) -> DataFrame:
    """scored: (conv, turn, text, signed, start_s). Adds speaker, phase, pair_id and the turn of the last question, in order of start.

    prepared_remarks until the first question, then q_and_a; turns without text are left out."""
    t = scored.where(T.strip(F.col("text")) != "").withColumn("speaker", context_of(F.col("text")))
    w = Window.partitionBy("conv").orderBy("start_s", "turn").rowsBetween(Window.unboundedPreceding, 0)
    ask = F.col("speaker") == "analyst"
    t = t.withColumn("pair_id", F.sum(ask.cast("int")).over(w))
    t = t.withColumn("question_turn", F.last(F.when(ask, F.col("turn")), ignorenulls=True).over(w))
    return t.withColumn("phase", F.when(F.col("pair_id") > 0, "q_and_a").otherwise("prepared_remarks"))


def shift_label(delta: Column, threshold: float) -> Column:
    return F.when(delta >= threshold, "stronger").when(delta <= -threshold, "weaker").otherwise("mixed")


def phase_shifts(phased: DataFrame) -> DataFrame:
    """Per conversation: means of both phases and their shift, early against late answers, and counts."""
    ans = (F.col("phase") == "q_and_a") & (F.col("speaker") == "management")
    w = Window.partitionBy("conv", ans).orderBy("start_s", "turn")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv", ans))
    t = phased.withColumns({"ans": ans, "r": F.row_number().over(w), "half": F.greatest(F.lit(1), F.floor(n / 2))})
    # sums of shares differ in their last digits by order; nine places are the same in any
    mean = lambda cond: F.coalesce(F.round(F.avg(F.when(cond, F.col("signed"))), 9), F.lit(0.0)) + 0.0
    qa = F.col("phase") == "q_and_a"
    g = t.groupBy("conv").agg(
        mean(~qa).alias("p"), mean(qa).alias("q"), mean(F.col("ans") & (F.col("r") <= F.col("half"))).alias("early"), mean(F.col("ans") & (F.col("r") > F.col("half"))).alias("late"),
        F.count_if(~qa).alias("n_prepared"), F.count_if(qa).alias("n_q_and_a"), F.count_if(qa & (F.col("speaker") == "analyst")).alias("n_questions"), F.count_if(F.col("ans")).alias("n_answers"),
    )
    d, e = F.round(F.col("q") - F.col("p"), 9) + 0.0, F.when(F.col("n_answers") >= 2, F.round(F.col("late") - F.col("early"), 9) + 0.0).otherwise(0.0)
    return g.select(
        "conv", F.round("p", 4).alias("prepared_mean"), F.round("q", 4).alias("q_and_a_mean"), F.round(d, 4).alias("delta"), shift_label(d, 0.08).alias("label"),
        F.round(e, 4).alias("late_delta"), shift_label(e, 0.06).alias("late_label"), "n_prepared", "n_q_and_a", "n_questions", "n_answers",
    )


def pair_shifts(phased: DataFrame) -> DataFrame:
    """(conv, pair_id, question_turn, answer_minus_question): the mean of a pair's answers against its question."""
    qa = phased.where("phase = 'q_and_a'")
    g = qa.groupBy("conv", "pair_id").agg(
        F.avg(F.when(F.col("speaker") == "management", F.col("signed"))).alias("a"), F.max(F.when(F.col("speaker") == "analyst", F.col("signed"))).alias("q"), F.max("question_turn").alias("question_turn")
    )
    return g.where("a is not null and q is not null").select("conv", "pair_id", "question_turn", (F.round(F.round(F.col("a") - F.col("q"), 9), 4) + 0.0).alias("answer_minus_question"))
