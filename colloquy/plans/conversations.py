"""Queries on conversations: merging, pairing, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import behavior as B
from colloquy.operators import conversations as C
from colloquy.operators import series as S
from colloquy.operators.signals import triggers
from colloquy.plans import sqltext as X
from colloquy.plans.common import MERGED, SCORED, TURNS, scored, turns
from colloquy.plans.registry import Registry
from colloquy.plans.sqltext import sql_list

query = Registry()
QUERIES, SQL = query.queries, query.sql
_TWO = "role in ('analyst', 'executive')"
_PAIRS = f"""{TURNS}, {MERGED.format(roles=_TWO)}, led as (
  select *, lead(text) over w nt, lead(turn) over w nturn, lag(island) over w pi from merged window w as (partition by conv order by island)
), pairs as (
  select conv, turn prompt_turn, nturn response_turn, text prompt, nt response from led where role = 'analyst'
  union all select conv, null, turn, null, text from led where role = 'executive' and pi is null
)"""
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-zA-Z'']+')"
_CONTENT = lambda c: f"list_filter({_TOK.format(c)}, lambda t: t not in ({', '.join(repr(w) for w in L.STOP_WORDS)}))"
_ANY = lambda c, ps: "(" + " or ".join(f"contains(lower({c}), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"


@query(f"with {TURNS}, {MERGED.format(roles='true')} select conv, cast(island as bigint) island, role, turn, n_turns, length(text) n_chars from merged")
def conv_turn_islands(spark, d):
    return C.merge_turns(turns(spark, d)).select("conv", "island", "role", "turn", "n_turns", F.length("text").alias("n_chars"))


@query(f"with {_PAIRS} select conv, prompt_turn, response_turn, prompt is not null and response is not null answered from pairs")
def conv_qa_pairs(spark, d):
    p = C.pair_merged(turns(spark, d), "analyst", "executive")
    return p.select("conv", "prompt_turn", "response_turn", F.expr("prompt is not null and response is not null").alias("answered"))


@query(f"""with {TURNS}, t as (
  select *, lead(role) over w nr, lead(turn) over w nt from spoken where {_TWO} window w as (partition by conv order by turn)
) select conv, turn prompt_turn, case when nr = 'executive' then nt end response_turn from t where role = 'analyst'""")
def conv_response_pairs(spark, d):
    return C.pair_transparent(turns(spark, d), "analyst", "executive").select("conv", "prompt_turn", "response_turn")


@query(f"""with {TURNS}, t as (
  select *, lead(role) over w nr from spoken where {_TWO} window w as (partition by conv order by turn)
) select conv, count(*) n_prompts, count(*) filter (where nr is distinct from 'executive') n_unanswered from t where role = 'analyst' group by conv""")
def conv_unanswered(spark, d):
    p = C.pair_transparent(turns(spark, d), "analyst", "executive")
    return p.groupBy("conv").agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.col("response").isNull()).alias("n_unanswered"))


@query(f"""with {TURNS}, t as (
  select *, lag(role) over w pr, lag(turn) over w pt from spoken where role in ('analyst', 'executive', 'unknown') window w as (partition by conv order by turn)
) select conv, pt question_turn, turn answer_turn from t where role in ('executive', 'unknown') and pr = 'analyst'""")
def conv_qa_spans(spark, d):
    return C.question_spans(turns(spark, d), "analyst", ["executive", "unknown"])


@query(f"""with {TURNS}, t as (
  select *, sum((role = 'analyst')::int) over w n, max(case when role = 'analyst' then turn end) over w q from spoken
  window w as (partition by conv order by turn rows unbounded preceding)
) select conv, turn, role, case when n > 0 then 'q_and_a' else 'prepared' end phase, cast(n as bigint) pair_id, q question_turn from t""")
def conv_running_phase(spark, d):
    return C.running_phase(turns(spark, d), "analyst").drop("text")


@query(f"""with {TURNS}, t as (
  select *, [lead(role, 1) over w, lead(role, 2) over w, lead(role, 3) over w] r, [lead(turn, 1) over w, lead(turn, 2) over w, lead(turn, 3) over w] tt
  from spoken window w as (partition by conv order by turn)
), f as (select *, list_position(list_transform(r, lambda x: x in ('analyst', 'executive')), true) i from t where role = 'analyst')
select conv, turn, case when r[i] = 'executive' then tt[i] end answer_turn from f""")
def conv_next_answer(spark, d):
    return C.next_response(turns(spark, d), "analyst", "executive")


_RATIOS = f"""tk as (select conv, role, {_TOK.format('text')} ts from spoken where {_TWO}),
nn as (select *, len(ts) n, len(list_filter(ts, lambda x: list_contains({sql_list(L.POSITIVE)}, x))) p, len(list_filter(ts, lambda x: list_contains({sql_list(L.NEGATIVE)}, x))) g,
  len(list_filter(ts, lambda x: list_contains({sql_list(L.HEDGING)}, x))) h from tk),
ratios as (select conv, round(coalesce(sum(p) / nullif(sum(n), 0), 0), 4) positive, round(coalesce(sum(g) / nullif(sum(n), 0), 0), 4) negative,
  round(coalesce(sum(h) filter (where role = 'executive') / nullif(sum(n) filter (where role = 'executive'), 0), 0), 4) hedging,
  round(coalesce(sum(g) filter (where role = 'analyst') / nullif(sum(n) filter (where role = 'analyst'), 0), 0), 4) prompt_negative,
  round(coalesce(sum(n) filter (where role = 'executive') / nullif(sum(n), 0), 0), 4) verbosity from nn group by conv)"""


@query(f"with {TURNS}, {_RATIOS} select * from ratios")
def conv_lexicon_ratios(spark, d):
    return C.conversation_features(turns(spark, d), "analyst", "executive").select("conv", "positive", "negative", "hedging", "prompt_negative", "verbosity")


_DIAG = f"""x as (
  select conv, prompt_turn, response, list_distinct({_CONTENT('prompt')}) p, list_distinct({_CONTENT('response')}) r, {_TOK.format('response')} rt,
    {_ANY('response', L.DIRECT)} direct, {_ANY('response', L.DEFLECTION)} phrase from pairs where prompt is not null
), y as (
  select *, case when response is null or len(p) = 0 then 0 else len(list_intersect(p, r)) / len(p) end ov,
    round(case when len(rt) > 0 then len(list_filter(rt, lambda t: list_contains({sql_list(L.HEDGING)}, t))) / len(rt) else 0 end, 4) hedge from x
), diag as (select conv, prompt_turn, ov,
  case when response is null then 0 else least(1, greatest(0, 0.6 * ov + case when direct then 0.25 else 0 end + 0.15 * (1 - least(1, 3 * hedge)) - case when phrase then 0.35 else 0 end)) end dn,
  case when response is null then true else phrase or (ov < 0.15 and not direct) end deflects from y)"""


@query(f"with {_PAIRS}, {_DIAG} select conv, prompt_turn, round(ov, 4) overlap, round(dn, 4) directness, deflects from diag")
def conv_pair_diagnostics(spark, d):
    p = C.pair_diagnostics(C.pair_merged(turns(spark, d), "analyst", "executive"))
    return p.select("conv", "prompt_turn", F.round("overlap", 4).alias("overlap"), F.round("directness", 4).alias("directness"), "deflects")


_COSINE = f"""both_ as (select * from pairs where prompt is not null and response is not null),
tok as (
  select conv, prompt_turn, 0 side, unnest({_CONTENT('prompt')}) t from both_ union all select conv, prompt_turn, 1, unnest({_CONTENT('response')}) from both_
), tf as (
  select conv, prompt_turn, t, count(*) filter (where side = 0) a, count(*) filter (where side = 1) b from tok group by all
), w as (select *, power(ln(3.0 / (1 + (a > 0)::int + (b > 0)::int)) + 1, 2) w from tf),
c as (select conv, prompt_turn, sum(a * b * w) / nullif(sqrt(sum(a * a * w)) * sqrt(sum(b * b * w)), 0) c from w group by all),
cosines as (select both_.conv, both_.prompt_turn, coalesce(c, 0) cosine from both_ left join c using (conv, prompt_turn))"""


@query(f"with {_PAIRS}, {_COSINE} select conv, prompt_turn, round(cosine, 4) cosine from cosines")
def conv_pair_cosine(spark, d):
    c = C.pair_cosine(C.pair_merged(turns(spark, d), "analyst", "executive"))
    return c.withColumn("cosine", F.round("cosine", 4))


@query(f"""with {_PAIRS}, {_RATIOS}, {_DIAG}, {_COSINE},
dd as (select conv, round(avg(dn), 4) directness, round(avg(deflects::int), 4) deflection, count(*) n_pairs from diag group by conv),
cc as (select conv, round(least(1, avg(cosine) * 2.5), 4) consistency from cosines group by conv),
rr as (select conv, count(*) n_responses from merged where role = 'executive' group by conv),
ff as (select r.*, coalesce(n_responses, 0) n_responses, coalesce(directness, 0) directness, coalesce(deflection, 0) deflection, coalesce(n_pairs, 0) n_pairs, coalesce(consistency, 1) consistency
  from ratios r left join dd using (conv) left join cc using (conv) left join rr using (conv))
select *, {X.exact('''least(1, greatest(0, 0.3e0 * directness + 0.2e0 * (1 - deflection) + 0.15e0 * consistency + 0.1e0 * (1 - negative) + 0.1e0 * positive + 0.1e0 * (1 - hedging)
    + 0.05e0 * greatest(0, least(1, 1 - abs(0.5e0 - verbosity) * 2))))''')} score,
  array_to_string(list_filter([case when prompt_negative > 0.2 then 'customer_frustration' end, case when deflection > 0.3 then 'agent_deflection' end,
    case when directness < 0.4 then 'low_directness' end, case when n_responses >= 2 and consistency < 0.5 then 'inconsistent_messaging' end], lambda x: x is not null), ',') flags from ff""")
def conv_qa_score(spark, d):
    return C.conversation_features(turns(spark, d), "analyst", "executive")


@query(f"""with {TURNS}, f as (select conv, role, min(turn) first_turn, count(*) n_turns from spoken group by conv, role)
select *, cast(row_number() over (partition by conv order by first_turn) as int) ord from f""")
def conv_participants(spark, d):
    return C.participants_of(turns(spark, d))


_TERMS = ["outlook", "revenue", "margin", "cash flow", "mix"]
_FIRST = "coalesce(" + ", ".join(
    (f"case when contains(lower(text), '{t}') then '{t}' end" if " " in t else f"case when regexp_matches(lower(text), '\\b{t}\\b') then '{t}' end") for t in _TERMS
) + ")"


@query(f"""with {TURNS}, h as (select conv, turn, {_FIRST} term from spoken), r as (
  select *, cast(row_number() over (partition by conv order by turn) as int) k from h where term is not null) select * from r where k <= 5""")
def conv_term_evidence(spark, d):
    return C.term_evidence(turns(spark, d), _TERMS)


@query(f"""with {TURNS}, n as (select conv, role, len({_TOK.format('text')}) n from spoken)
select conv, role, round(sum(n) / sum(sum(n)) over (partition by conv), 4) token_share from n group by conv, role""")
def conv_token_share(spark, d):
    from pyspark.sql import Window

    n = C.spoken(turns(spark, d)).groupBy("conv", "role").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("n"))
    return n.select("conv", "role", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("conv")), 4).alias("token_share"))


_SHIFT_Q = f"length(text) > 15 and (contains(text, '?') or {_ANY('text', L.SHIFT_QUESTION_PHRASES)})"
_CONTEXT = X.first_of([(X.any_pattern(X.compact("text"), L.OPERATOR_PATTERNS), "'operator'"), (X.any_pattern(X.compact("text"), L.QUESTION_PATTERNS), "'analyst'")], "'management'")


@query(f"with {TURNS} select conv, turn, {_SHIFT_Q} is_question, {_CONTEXT} context from spoken")
def conv_is_question(spark, d):
    """Whether a turn asks, by phrases, and who speaks like it, by patterns."""
    t = C.spoken(turns(spark, d))
    q = (F.length("text") > 15) & (F.col("text").contains("?") | (T.phrase_count(F.col("text"), L.SHIFT_QUESTION_PHRASES) > 0))
    return t.select("conv", "turn", q.alias("is_question"), B.context_of(F.col("text")).alias("context"))


_PHASED = f"""{TURNS}, {SCORED}, ph0 as (select *, {_CONTEXT} speaker from scored where {X.strip('text')} <> ''),
phased as (select *, sum((speaker = 'analyst')::int) over w pair_id, max(case when speaker = 'analyst' then {{'s': start_s, 't': turn}} end) over w qs,
  case when sum((speaker = 'analyst')::int) over w > 0 then 'q_and_a' else 'prepared_remarks' end phase from ph0 where start_s is not null
  window w as (partition by conv order by start_s, turn rows unbounded preceding))"""


def _phased(spark, d):
    return B.phases(scored(spark, d).where("start_s is not null"))


@query(f"""with {_PHASED}, a as (select *, phase = 'q_and_a' and speaker = 'management' ans from phased),
r as (select *, row_number() over (partition by conv, ans order by start_s, turn) r, greatest(1, count(*) over (partition by conv, ans) // 2) half from a),
g as (select conv, coalesce(round(avg(signed) filter (where phase <> 'q_and_a'), 9), 0) + 0e0 p, coalesce(round(avg(signed) filter (where phase = 'q_and_a'), 9), 0) + 0e0 q,
  coalesce(round(avg(signed) filter (where ans and r <= half), 9), 0) + 0e0 e, coalesce(round(avg(signed) filter (where ans and r > half), 9), 0) + 0e0 l,
  count(*) filter (where phase <> 'q_and_a') n_prepared, count(*) filter (where phase = 'q_and_a') n_q_and_a, count(*) filter (where phase = 'q_and_a' and speaker = 'analyst') n_questions, count(*) filter (where ans) n_answers from r group by conv),
h as (select *, round(q - p, 9) + 0e0 d, case when n_answers >= 2 then round(l - e, 9) + 0e0 else 0 end k from g)
select conv, {X.exact('p')} prepared_mean, {X.exact('q')} q_and_a_mean, {X.exact('d')} delta, case when round(d, 9) >= 0.08 then 'stronger' when round(d, 9) <= -0.08 then 'weaker' else 'mixed' end as label,
  {X.exact('k')} late_delta, case when round(k, 9) >= 0.06 then 'stronger' when round(k, 9) <= -0.06 then 'weaker' else 'mixed' end late_label, n_prepared, n_q_and_a, n_questions, n_answers from h""")
def conv_phase_shifts(spark, d):
    """Tone of prepared remarks against questions and answers, and of early against late answers."""
    return B.phase_shifts(_phased(spark, d))


@query(f"""with {_PHASED}, g as (select conv, pair_id, avg(signed) filter (where speaker = 'management') a, max(signed) filter (where speaker = 'analyst') q, max(case when speaker = 'analyst' then turn end) question_turn
  from phased where phase = 'q_and_a' group by 1, 2) select conv, cast(pair_id as bigint) pair_id, question_turn, {X.exact('a - q')} + 0e0 answer_minus_question from g where a is not null and q is not null""")
def conv_pair_shifts(spark, d):
    return B.pair_shifts(_phased(spark, d))


_TRIG = ", ".join(f"case when regexp_matches(t, {X.q(p)}) then {X.q(n)} end" for n, p in L.RISK_TRIGGERS)


@query(f"""with {TURNS}, {SCORED}, g as (select conv, avg((label = 'NEGATIVE')::int) neg, avg(case when label = 'NEGATIVE' then score else 0 end) conf,
    stddev_samp(case when label = 'NEGATIVE' then -score else score end) vol, lower(string_agg(coalesce(text, ''), ' ' order by turn)) t from scored group by conv),
k as (select *, list_filter([{_TRIG}], lambda x: x is not null) tr from g)
select conv, array_to_string(tr, ',') triggers, cast(least(100, greatest(0, round_even(60 * neg + 30 * conf + 20 * least(coalesce(vol, 0) / 0.35e0, 1) + 5 * len(tr), 0))) as int) risk from k""")
def risk_score(spark, d):
    """0 to 100 by negative turns, their confidence, the spread of tone and trigger words of the whole transcript."""
    t = scored(spark, d)
    neg = F.col("label") == "NEGATIVE"
    g = t.groupBy("conv").agg(
        F.avg(neg.cast("int")).alias("neg"), F.avg(F.when(neg, F.col("score")).otherwise(0.0)).alias("conf"), F.stddev_samp(F.when(neg, -F.col("score")).otherwise(F.col("score"))).alias("vol"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"),
    )
    g = g.withColumn("triggers", triggers(F.col("text")))
    raw = 60 * F.col("neg") + 30 * F.col("conf") + 20 * F.least(F.coalesce("vol", F.lit(0.0)) / 0.35, F.lit(1.0)) + 5 * F.size("triggers")
    return g.select("conv", F.array_join("triggers", ",").alias("triggers"), F.least(F.lit(100), F.greatest(F.lit(0), F.bround(raw, 0).cast("int"))).alias("risk"))


@query(f"""with {TURNS}, {SCORED}, g as (select conv, avg(signed) m, stddev_pop(signed) s, avg((label = 'NEGATIVE')::int) n from scored group by conv)
select conv, round(least(100, greatest(0, 0.4e0 * (1 - m) / 2 * 100 + 0.3e0 * least(greatest(s, 0), 1) * 100 + 0.3e0 * n * 100)), 2) risk from g""")
def segment_risk(spark, d):
    """0 to 100 by mean tone, its population deviation and the share of negative turns."""
    g = scored(spark, d).groupBy("conv").agg(F.avg("signed").alias("m"), F.stddev_pop("signed").alias("s"), F.avg((F.col("label") == "NEGATIVE").cast("int")).alias("n"))
    raw = F.expr("0.4D * (1 - m) / 2 * 100 + 0.3D * least(greatest(s, 0D), 1D) * 100 + 0.3D * n * 100")
    return g.select("conv", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2).alias("risk"))


@query(f"""with {TURNS}, {SCORED}, w as (select *, avg(signed) over w m, stddev_pop(signed) over w s from scored where start_s is not null window w as (partition by conv order by start_s, turn rows 4 preceding)),
z as (select *, round(case when s > 1e-9 then (signed - m) / s else 0 end, 4) z from w), t as (select conv, count(*) n_rows, count(*) filter (where abs(z) >= 1.5) n_changes from z group by conv)
select conv, count(*) n_scored, {X.exact('avg(signed)', 6)} sentiment_mean, {X.exact('coalesce(stddev_pop(signed), 0)', 6)} sentiment_std, any_value(coalesce(n_rows, 0)) tone_rows, any_value(coalesce(n_changes, 0)) tone_changes from scored left join t using (conv) group by conv""")
def conv_metrics(spark, d):
    """Count, mean and deviation of the tone of each call, and its changes."""
    t = scored(spark, d)
    z = S.tone_changes(t.where("start_s is not null"), key="conv", order=["start_s", "turn"], value="signed", threshold=1.5)
    z = z.groupBy("conv").agg(F.count(F.lit(1)).alias("tone_rows"), F.count_if("is_change").alias("tone_changes"))
    g = t.groupBy("conv").agg(F.count(F.lit(1)).alias("n_scored"), (F.round(F.round(F.avg("signed"), 9), 6) + 0.0).alias("sentiment_mean"), F.round(F.round(F.coalesce(F.stddev_pop("signed"), F.lit(0.0)), 9), 6).alias("sentiment_std"))
    return g.join(z, "conv", "left").fillna(0, ["tone_rows", "tone_changes"])


_BLOCKS = f"""bl as (select *, case when row_number() over w = 1 or role is distinct from lag(role) over w then 1 else 0 end nw from spoken window w as (partition by conv order by turn)),
bl2 as (select *, sum(nw) over (partition by conv order by turn) block from bl),
blocks as (select conv, block, any_value(role) as role, min(turn) turn, list(turn order by turn) turns, string_agg(text, ' ' order by turn) as text from bl2 group by 1, 2)"""


@query(f"with {TURNS}, {_BLOCKS} select conv, cast(block as bigint) block, role, turn, len(turns) n_turns, turns[-1] last_turn from blocks")
def conv_blocks(spark, d):
    b = C.joined_blocks(turns(spark, d), ["role"])
    return b.select("conv", "block", "role", "turn", F.size("turns").alias("n_turns"), F.element_at("turns", -1).alias("last_turn"))


@query(f"""with {TURNS}, {_BLOCKS}, p as (select *, sum((role = 'analyst')::int) over (partition by conv order by block) pair_id from blocks)
select conv, cast(pair_id as bigint) pair_id, min(turn) filter (where role = 'analyst') question_turn, count(*) filter (where role = 'executive') n_answers, sha256(string_agg(text, ' ' order by block) filter (where role = 'executive')) answer_sha
from p where pair_id > 0 and role in ('analyst', 'executive') group by 1, 2 having count(*) filter (where role = 'executive') > 0""")
def conv_block_pairs(spark, d):
    """Each question block with all answer blocks up to the next question."""
    q = C.question_blocks(C.joined_blocks(turns(spark, d), ["role"]), "analyst", "executive")
    return q.select("conv", "pair_id", "question_turn", "n_answers", F.sha2("answer", 256).alias("answer_sha"))


_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@query(f"""with {TURNS}, n as (select conv, {' + '.join(X.term_found(_NORM, w) + '::int' for w in L.SENTIMENT_UP)} p, {' + '.join(X.term_found(_NORM, w) + '::int' for w in L.SENTIMENT_DOWN)} g from turns)
select conv, round((sum(p) + 1) / (sum(p) + sum(g) + 2), 4) proxy from n group by conv""")
def conv_sentiment_proxy(spark, d):
    return C.sentiment_proxy(turns(spark, d), L.SENTIMENT_UP, L.SENTIMENT_DOWN)


_WTOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-zA-Z0-9'']+')"
_SHORT = lambda c: f"list_distinct(list_filter({_WTOK.format(c)}, lambda t: not list_contains({sql_list(L.SHORT_STOP_WORDS)}, t)))"
_CUES, _HOLD, _HEDGE = ["because", "we now expect", "driven"], ["nothing to share", "too early"], ["probably", "could", "may"]


@query(f"""with {TURNS}, t as (select *, lead(role) over w nr, lead(text) over w nx from spoken where {_TWO} window w as (partition by conv order by turn)),
p as (select conv, text prompt, case when nr = 'executive' then nx end response from t where role = 'analyst'), o as (select *, {_SHORT('prompt')} a, {_SHORT('response')} b, lower(coalesce(response, '')) low from p),
s as (select conv, case when response is null then 0 else least(1, greatest(0, 0.65e0 * case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end + 0.25e0 * {X.any_phrase('low', _CUES)}::int
  + 0.1e0 * greatest(0, 1 - 0.3e0 * {X.count_phrases('low', _HEDGE)}) - 0.35e0 * {X.any_phrase('low', _HOLD)}::int)) end s from o) select conv, round(avg(s), 4) directness from s group by conv""")
def conv_pair_directness(spark, d):
    return C.pair_directness(C.pair_transparent(turns(spark, d), "analyst", "executive"), _CUES, _HOLD, _HEDGE)


@query(f"""with {TURNS}, n as (select conv, role, len({_TOK.format('text')}) n from spoken), g as (select conv, sum(n) filter (where role in {tuple(L.DOMAIN_ROLES['earnings_call'][1] * 2)}) i, sum(n) total from n group by conv)
select conv, cast(coalesce(i, 0) as bigint) internal_tokens, round(coalesce(i, 0) / nullif(total, 0), 4) internal_share from g""")
def conv_internal_share(spark, d):
    """The share of the answering side of earnings calls in all tokens."""
    t = C.spoken(turns(spark, d)).withColumn("n", F.size(T.tokens(F.col("text"))))
    mine = C.group_turns(t, "earnings_call", "response").groupBy("conv").agg(F.sum("n").alias("i"))
    g = t.groupBy("conv").agg(F.sum("n").alias("total")).join(mine, "conv", "left").withColumn("i", F.coalesce("i", F.lit(0)))
    return g.select("conv", F.col("i").alias("internal_tokens"), F.round(F.expr("i / nullif(total, 0)"), 4).alias("internal_share"))
