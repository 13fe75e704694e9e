"""Operators on the turns of conversations.

turns: (conv, turn, role, text[, start_s, end_s]); conv and turn identify a row.
Windows are partitioned by conversation and ordered by turn. Null texts count as empty;
empty messages are dropped before turns are merged or paired, as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import lexicons as L


def by_turn():
    return Window.partitionBy("conv").orderBy("turn")


def so_far():
    return by_turn().rowsBetween(Window.unboundedPreceding, 0)


def spoken(turns: DataFrame) -> DataFrame:
    """Turns with text, white space normalised."""
    return turns.withColumn("text", T.normalize_space(F.col("text"))).where("text <> ''")


def merge_turns(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one role as one: (conv, island, role, turn, n_turns, text)."""
    t = spoken(turns).withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(by_turn()))).cast("int"))
    t = t.withColumn("island", F.sum("new").over(so_far()))
    return t.groupBy("conv", "island").agg(
        F.first("role").alias("role"),
        F.min("turn").alias("turn"),
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def pair_merged(turns: DataFrame, prompt: str, response: str) -> DataFrame:
    """Merged turns of the two roles in pairs: a prompt with the response that follows, a prompt
    without one, and a response without a prompt. (conv, prompt_turn, response_turn, prompt, response)"""
    return pairs_of(merge_turns(turns.where(F.col("role").isin(prompt, response))), prompt, response)


def pairs_of(merged: DataFrame, prompt: str, response: str) -> DataFrame:
    """pair_merged() of turns that are merged already."""
    w = Window.partitionBy("conv").orderBy("island")
    m = merged.select("*", F.lead("text").over(w).alias("next_text"), F.lead("turn").over(w).alias("next_turn"), F.lag("island").over(w).alias("before"))
    asked = m.where(F.col("role") == prompt).select("conv", F.col("turn").alias("prompt_turn"), F.col("next_turn").alias("response_turn"), F.col("text").alias("prompt"), F.col("next_text").alias("response"))
    orphan = m.where((F.col("role") == response) & F.col("before").isNull())
    none = F.lit(None)
    return asked.unionByName(orphan.select("conv", none.cast("int").alias("prompt_turn"), F.col("turn").alias("response_turn"), none.cast("string").alias("prompt"), F.col("text").alias("response")))


def pair_transparent(turns: DataFrame, prompt: str, response: str) -> DataFrame:
    """Unmerged pairs: other roles are transparent, a prompt before a prompt stays unanswered,
    only the first response is kept and unprompted ones are dropped."""
    t = spoken(turns).where(F.col("role").isin(prompt, response))
    t = t.select("*", *(F.lead(c).over(by_turn()).alias(f"next_{c}") for c in ("role", "turn", "text")))
    ok = F.col("next_role") == response
    return t.where(F.col("role") == prompt).select(
        "conv", F.col("turn").alias("prompt_turn"), F.when(ok, F.col("next_turn")).alias("response_turn"),
        F.col("text").alias("prompt"), F.when(ok, F.col("next_text")).alias("response"),
    )


def question_spans(turns: DataFrame, asker: str, answerers: list[str]) -> DataFrame:
    """The last question before each first answer: (conv, question_turn, answer_turn)."""
    t = spoken(turns).where(F.col("role").isin(asker, *answerers))
    t = t.select("*", F.lag("role").over(by_turn()).alias("p_role"), F.lag("turn").over(by_turn()).alias("p_turn"))
    return t.where(F.col("role").isin(answerers) & (F.col("p_role") == asker)).select("conv", F.col("p_turn").alias("question_turn"), F.col("turn").alias("answer_turn"))


def running_phase(turns: DataFrame, asker: str) -> DataFrame:
    """prepared until the first question, then q_and_a; running pair number and last question turn."""
    q = F.col("role") == asker
    n = F.sum(q.cast("int")).over(so_far())
    return spoken(turns).select(
        "conv", "turn", "role", F.when(n > 0, "q_and_a").otherwise("prepared").alias("phase"), n.alias("pair_id"),
        F.last(F.when(q, F.col("turn")), ignorenulls=True).over(so_far()).alias("question_turn"), "text",
    )


def next_response(turns: DataFrame, asker: str, answerer: str, reach: int = 3) -> DataFrame:
    """The first answer within the next ``reach`` turns, unless another question comes first."""
    t = spoken(turns)
    leads = F.array(*(F.struct(F.lead("role", k).over(by_turn()).alias("role"), F.lead("turn", k).over(by_turn()).alias("turn")) for k in range(1, reach + 1)))
    t = t.select("conv", "turn", "role", leads.alias("next"))
    first = F.get(F.filter("next", lambda x: x["role"].isin(asker, answerer)), 0)
    return t.where(F.col("role") == asker).select("conv", F.col("turn"), F.when(first["role"] == answerer, first["turn"]).alias("answer_turn"))


def lexicon_ratio(ts: Column, lexicon: list[str]) -> Column:
    """Aggregate: hits over tokens of all rows, four places, 0 without tokens."""
    hits, total = F.sum(F.size(F.filter(ts, lambda t: t.isin(lexicon)))), F.sum(F.size(ts))
    return F.round(T.share(hits, total), 4)


def pair_diagnostics(pairs: DataFrame) -> DataFrame:
    """Per pair: overlap, directness and whether the response deflects. No response: 0 and true."""
    p, r = (T.without(T.tokens(F.col(c)), L.STOP_WORDS) for c in ("prompt", "response"))
    hedge = T.share(F.size(F.filter(T.tokens(F.col("response")), lambda t: t.isin(L.HEDGING))), F.size(T.tokens(F.col("response"))))
    d = pairs.where("prompt is not null").select(
        "conv", "prompt_turn", "response", F.when(F.col("response").isNull(), 0.0).otherwise(T.overlap(p, r)).alias("overlap"),
        (T.phrase_count(F.col("response"), L.DIRECT) > 0).alias("direct"),
        (T.phrase_count(F.col("response"), L.DEFLECTION) > 0).alias("phrase"),
        F.round(hedge, 4).alias("hedge"),
    )
    score = 0.6 * F.col("overlap") + F.when(F.col("direct"), 0.25).otherwise(0.0) + 0.15 * (1 - F.least(F.lit(1.0), 3 * F.col("hedge"))) - F.when(F.col("phrase"), 0.35).otherwise(0.0)
    answered = F.col("response").isNotNull()
    return d.select(
        "conv", "prompt_turn", "overlap", F.when(answered, T.clamp01(score)).otherwise(0.0).alias("directness"),
        F.when(answered, F.col("phrase") | ((F.col("overlap") < 0.15) & ~F.col("direct"))).otherwise(True).alias("deflects"),
    )


def pair_cosine(pairs: DataFrame) -> DataFrame:
    """TF-IDF cosine of prompt and response, each pair a corpus of two: (conv, prompt_turn, cosine)."""
    both = pairs.where("prompt is not null and response is not null")
    t = both.select("conv", "prompt_turn", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("prompt").alias("x")), F.struct(F.lit(1).alias("side"), F.col("response").alias("x")))).alias("s"))
    t = t.select("conv", "prompt_turn", "s.side", F.explode(T.without(T.tokens(F.col("s.x")), L.STOP_WORDS)).alias("tok"))
    tf = t.groupBy("conv", "prompt_turn", "tok").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    idf = F.log(F.lit(3.0) / (1 + (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int"))) + 1
    # the scale of a side (its largest count) cancels in the cosine
    dot = tf.withColumn("w", idf * idf).groupBy("conv", "prompt_turn").agg(
        F.sum(F.expr("a * b * w")).alias("ab"), F.sqrt(F.sum(F.expr("a * a * w"))).alias("na"), F.sqrt(F.sum(F.expr("b * b * w"))).alias("nb")
    )
    c = dot.select("conv", "prompt_turn", F.when(F.expr("na * nb > 0"), F.expr("ab / (na * nb)")).otherwise(0.0).alias("c"))
    return both.select("conv", "prompt_turn").join(c, ["conv", "prompt_turn"], "left").select("conv", "prompt_turn", F.coalesce("c", F.lit(0.0)).alias("cosine"))


def conversation_features(turns: DataFrame, prompt: str, response: str) -> DataFrame:
    """Features of each conversation of two roles, their blend and flags; other roles are left out.

    Turns are merged once. Means are rounded last; without an answered pair consistency is 1,
    without a pair directness and deflection are 0."""
    m = merge_turns(turns.where(F.col("role").isin(prompt, response)))
    t = m.select("conv", "role", T.tokens(F.col("text")).alias("ts"))
    side = lambda who: F.when(F.col("role") == who, F.col("ts")).otherwise(F.array().cast("array<string>"))
    a, c = F.sum(F.size(side(response))), F.sum(F.size(side(prompt)))
    base = t.groupBy("conv").agg(
        lexicon_ratio(F.col("ts"), L.POSITIVE).alias("positive"), lexicon_ratio(F.col("ts"), L.NEGATIVE).alias("negative"),
        lexicon_ratio(side(response), L.HEDGING).alias("hedging"), lexicon_ratio(side(prompt), L.NEGATIVE).alias("prompt_negative"),
        F.round(T.share(a, a + c), 4).alias("verbosity"), F.count_if(F.col("role") == response).alias("n_responses"),
    )
    pairs = pairs_of(m, prompt, response)
    d = pair_diagnostics(pairs).groupBy("conv").agg(
        F.round(T.clamp01(F.avg("directness")), 4).alias("directness"), F.round(F.avg(F.col("deflects").cast("int")), 4).alias("deflection"), F.count(F.lit(1)).alias("n_pairs")
    )
    cos = pair_cosine(pairs).groupBy("conv").agg(F.round(F.least(F.lit(1.0), F.avg("cosine") * 2.5), 4).alias("consistency"))
    j = base.join(d, "conv", "left").join(cos, "conv", "left").fillna({"directness": 0.0, "deflection": 0.0, "n_pairs": 0, "consistency": 1.0})
    score = F.expr(
        "0.30D * directness + 0.20D * (1 - deflection) + 0.15D * consistency + 0.10D * (1 - negative) + 0.10D * positive"
        " + 0.10D * (1 - hedging) + 0.05D * greatest(0D, least(1D, 1 - abs(0.5D - verbosity) * 2))"
    )
    flags = F.array_compact(F.array(
        F.when(F.col("prompt_negative") > 0.2, "customer_frustration"), F.when(F.col("deflection") > 0.3, "agent_deflection"),
        F.when(F.col("directness") < 0.4, "low_directness"), F.when((F.col("n_responses") >= 2) & (F.col("consistency") < 0.5), "inconsistent_messaging"),
    ))
    return j.withColumns({"score": F.round(F.round(T.clamp01(score), 9), 4), "flags": F.array_join(flags, ",")})


def group_turns(turns: DataFrame, domain: str, side: str) -> DataFrame:
    """Turns of the prompting or responding roles of a domain; an unknown domain raises."""
    if domain not in L.DOMAIN_ROLES:
        raise ValueError(f"unknown domain {domain}; known are {', '.join(L.DOMAIN_ROLES)}")
    prompt, response = L.DOMAIN_ROLES[domain]
    return turns.where(F.col("role").isin(prompt if side == "prompt" else response))


def participants_of(turns: DataFrame) -> DataFrame:
    """Distinct roles of a conversation in the order in which they first speak."""
    first = spoken(turns).groupBy("conv", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("conv").orderBy("first_turn")))


def term_evidence(turns: DataFrame, terms: list[str], limit: int = 5) -> DataFrame:
    """The first ``limit`` turns of a conversation with a term, each with its first term in list order."""
    hit = spoken(turns).select("conv", "turn", F.get(T.matched_terms(F.col("text"), terms), 0).alias("term"), "text").where("term is not null")
    hit = hit.withColumn("k", F.row_number().over(by_turn())).where(F.col("k") <= limit)
    return hit.select("conv", "turn", "term", "k")


def sentiment_proxy(turns: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """(conv, proxy): (positive + 1) / (positive + negative + 2), each term once for each turn that has it."""
    t = turns.select("conv", T.plain(F.col("text")).alias("t"))
    n = lambda ws: sum((T.term_in(F.col("t"), w).cast("int") for w in ws[1:]), T.term_in(F.col("t"), ws[0]).cast("int"))
    g = t.groupBy("conv").agg(F.sum(n(positive)).alias("p"), F.sum(n(negative)).alias("n"))
    return g.select("conv", F.round((F.col("p") + 1) / (F.col("p") + F.col("n") + 2), 4).alias("proxy"))


def pair_directness(pairs: DataFrame, direct: list[str], deflection: list[str], hedges: list[str]) -> DataFrame:
    """(conv, directness): mean over prompts of .65 overlap + .25 direct cue + .10 max(0, 1 - .3 hedges) - .35 deflection; parts of words count."""
    p, r = (T.without(T.words(F.col(c)), L.SHORT_STOP_WORDS) for c in ("prompt", "response"))
    low = F.lower(F.coalesce("response", F.lit("")))
    hits = lambda ws: T.phrase_count(F.col("response"), ws)
    s = 0.65 * T.overlap(p, r) + 0.25 * T.any_phrase(low, direct).cast("int") + 0.1 * F.greatest(F.lit(0.0), 1 - 0.3 * hits(hedges)) - 0.35 * T.any_phrase(low, deflection).cast("int")
    each = pairs.where("prompt is not null").select("conv", F.when(F.col("response").isNull(), 0.0).otherwise(T.clamp01(s)).alias("s"))
    return each.groupBy("conv").agg(F.round(F.avg("s"), 4).alias("directness"))


def joined_blocks(turns: DataFrame, key: list[str]) -> DataFrame:
    """Neighbouring turns with equal ``key`` as one block: (conv, block, key..., turn, turns, text)."""
    t = spoken(turns)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(by_turn()))
    first = F.row_number().over(by_turn()) == 1
    t = t.withColumn("block", F.sum((first | ~same).cast("int")).over(so_far()))
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.groupBy("conv", "block").agg(*(F.first(k).alias(k) for k in key), F.min("turn").alias("turn"), F.transform(rows, lambda x: x["turn"]).alias("turns"), F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))


def question_blocks(blocks: DataFrame, asker: str, answerer: str) -> DataFrame:
    """(conv, pair_id, question_turn, n_answers, answer): each question block with all answer blocks up to the next question."""
    w = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("role") == asker
    t = blocks.withColumn("pair_id", F.sum(q.cast("int")).over(w)).where("pair_id > 0").where(q | (F.col("role") == answerer))
    answers = F.array_sort(F.collect_list(F.when(~q, F.struct("block", "text"))))
    g = t.groupBy("conv", "pair_id").agg(F.min(F.when(q, F.col("turn"))).alias("question_turn"), answers.alias("a"))
    return g.where("size(a) > 0").select("conv", "pair_id", "question_turn", F.size("a").alias("n_answers"), F.array_join(F.transform("a", lambda x: x["text"]), " ").alias("answer"))
