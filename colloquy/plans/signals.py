"""Queries on documents and texts by rules: topics, guidance, behaviour, families, emotions, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.functions.scoring import signed_score
from colloquy.operators import behavior as B
from colloquy.operators import guidance as G
from colloquy.operators import labels as O
from colloquy.operators import signals as S
from colloquy.plans import labels as LB
from colloquy.plans import sqltext as X
from colloquy.plans.registry import Registry
from colloquy.runtime import read_spread, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def docs(spark, d):
    return read_spread(spark, d, "documents").where("text is not null")


_LOW = "lower(text)"
_PERIOD = r"""case when regexp_matches(lower(text), '\bq[1-4]\b') then 'Q' || regexp_extract(lower(text), '\bq([1-4])\b', 1) when regexp_matches(lower(text), '\bfy\b|fiscal year|full year') then 'FY'
  when contains(lower(text), 'year') then 'Year' when contains(lower(text), 'quarter') then 'Quarter' else 'Unknown' end"""


@query(f"select doc_id, {X.topic(_LOW, L.TOPICS, 'other')} topic, {X.topic(_LOW, L.BEHAVIOR_TOPICS, 'general')} hint, {_PERIOD} period from documents where text is not null")
def doc_topic_period(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", T.argmax_topic(c, L.TOPICS, "other").alias("topic"), T.argmax_topic(c, L.BEHAVIOR_TOPICS, "general").alias("hint"), T.period_tag(c).alias("period"))


_NUM = r"list_transform(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: try_cast(replace(x, ',', '') as double))"
_TOKS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z'']+')"
_N = lambda ws: f"len(list_filter({_TOKS}, lambda t: list_contains({X.sql_list(ws)}, t)))"


@query(rf"""with g0 as (select doc_id, {X.strip('text')} as text from documents where text is not null), g as (select *, {_NUM} ns, {X.count_phrases(_LOW, L.GUIDANCE_CUES)} cues, {_N(L.SENTIMENT_UP)} up, {_N(L.SENTIMENT_DOWN)} dn,
  regexp_extract(lower(text), 'between\s+(-?[0-9]+(?:\.[0-9]+)?)\s+and\s+(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) btw,
  regexp_extract(lower(text), '(-?[0-9]+(?:\.[0-9]+)?)\s*(?:to|–|-)\s*(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) ran from g0),
h as (select *, regexp_matches(lower(text), '%|percent|bps|basis points') pc, btw.a <> '' or ran.a <> '' rg, regexp_matches(lower(text), '\$|€|£|million|billion|bn\b|mm\b') cu,
  case when up > dn then round(0.5e0 + 0.5e0 * (up - dn) / (up + dn + 1), 4) else 0 end pos from g where cues > 0)
select doc_id, {X.topic(_LOW, L.TOPICS, 'other')} topic, {_PERIOD} period, len(ns) count_numbers, pc has_percent, rg has_range, cu has_currency, cues n_cues,
  round(coalesce((try_cast(btw.a as double) + try_cast(btw.b as double)) / 2, (try_cast(ran.a as double) + try_cast(ran.b as double)) / 2, ns[1]), 6) midpoint,
  round(least(1, 0.4e0 * least(1, len(ns) / 4) + case when pc then 0.15e0 else 0 end + case when rg then 0.15e0 else 0 end + case when cu then 0.1e0 else 0 end + 0.2e0 * pos + least(0.1e0, 0.02e0 * cues)), 4) guidance_strength from h""")
def doc_guidance(spark, d):
    """Guidance statements with their numbers and strength; tone by the default scorer."""
    c = F.col("text")
    t = docs(spark, d).select("doc_id", T.strip(c).alias("text")).where("text <> ''").withColumn("s", S.lexicon_sentiment(c))
    g = G.statements(t.withColumn("signed", signed_score(F.col("s.label"), F.col("s.score"))), "text", "signed")
    return g.select("doc_id", "topic", "period", "count_numbers", "has_percent", "has_range", "has_currency", "n_cues", "midpoint", "guidance_strength")


# Behaviour

_SENTENCES = f"""sl as (select doc_id, {X.strip('text')} whole, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda x: {X.strip('x')}), lambda x: x <> '') ss from documents where text is not null),
sx as (select doc_id, case when len(ss) > 0 then ss when whole <> '' then [whole] else [] end ss from sl),
sn as (select doc_id, unnest(range(len(ss))) no, ss from sx), st as (select doc_id, no, ss[no + 1] sentence from sn),
sc as (select *, lower(sentence) low, {X.compact('sentence')} flat from st),
se as (select *, {X.first_of([(X.any_pattern('flat', L.OPERATOR_PATTERNS), "'operator'"), (X.any_pattern('flat', L.QUESTION_PATTERNS), "'analyst'")], "'management'")} speaker,
  {X.any_pattern('flat', L.BOILERPLATE_PATTERNS)} boiler, {X.any_pattern('flat', L.MODAL_EXCLUSIONS)} nomodal from sc),
ru(family, ord, rule, hint, pattern, s) as (values {", ".join(f"({X.q(f)}, {i}, {X.q(n)}, {X.q(h)}, {X.q(p)}, {k})" for f, rs in B.FAMILIES.items() for i, (n, h, p, k) in enumerate(rs))}),
ev as (select doc_id, no, sentence, family, rule, hint, ord, s, len(regexp_extract_all(low, pattern)) hits from se, ru
  where case when family = 'skepticism' then speaker = 'analyst' else speaker = 'management' and not boiler and not (rule = 'modal uncertainty' and nomodal) end),
evidence as (select *, hits * s strength from ev where hits > 0)"""


def _evidence(spark, d):
    return B.evidence(docs(spark, d).select("doc_id", "text"), ["doc_id"], "text")


@query(f"with {_SENTENCES} select doc_id, family, rule, cast(sum(hits) as bigint) hits, cast(sum(strength) as bigint) strength from evidence group by all")
def doc_rule_hits(spark, d):
    return _evidence(spark, d).groupBy("doc_id", "family", "rule").agg(F.sum("hits").alias("hits"), F.sum("strength").alias("strength"))


_LV = lambda c: f"case when {c} >= 5 then 'high' when {c} >= 2 then 'medium' else 'low' end"


@query(f"""with {_SENTENCES}, g as (select doc_id, {", ".join(f"cast(coalesce(sum(strength) filter (where family = '{f}'), 0) as bigint) {f}" for f in B.FAMILIES)} from evidence group by doc_id)
select *, {", ".join(f"{_LV(f)} {f}_level" for f in B.FAMILIES)} from g""")
def doc_rule_levels(spark, d):
    return B.scores(_evidence(spark, d), ["doc_id"])


@query(f"""with {_SENTENCES}, g as (select doc_id, no, sum(strength) strength, arg_max(rule, (s, -ord)) matched, arg_max(hint, (s, -ord)) topic from evidence where family = 'skepticism' group by 1, 2)
select doc_id, cast(no as int) sentence_no, matched, topic, cast(strength as bigint) strength, {_LV('strength')} as label from g""")
def doc_doubting_questions(spark, d):
    return B.doubting_questions(_evidence(spark, d), ["doc_id"])


@query(f"""with {_SENTENCES}, c as (select * from (select *, unnest(range(hits)) copy from evidence)), r as (select *, row_number() over (partition by doc_id, family order by s desc, sentence, no, ord, copy) k from c)
select doc_id, family, cast(min(k) as int) k, rule, any_value(s) strength, sha256(sentence) sentence_sha from r where k <= 2 group by doc_id, family, rule, sentence""")
def doc_strongest_evidence(spark, d):
    s = B.strongest(_evidence(spark, d), ["doc_id"])
    return s.select("doc_id", "family", "k", "rule", "strength", F.sha2("sentence", 256).alias("sentence_sha"))


@query(f"""with {_SENTENCES} select doc_id, count(*) n_sentences, count(*) filter (where speaker = 'operator') n_operator, count(*) filter (where speaker = 'analyst') n_questions, count(*) filter (where boiler) n_boilerplate,
  cast(sum(length(sentence)) as bigint) n_chars from se group by doc_id""")
def doc_sentences(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(B.sentences_of(F.col("text"))).alias("s"))
    s = s.select("doc_id", F.length("s").alias("n"), B.context_of(F.col("s")).alias("who"), T.any_pattern(T.compact(F.col("s")), L.BOILERPLATE_PATTERNS).alias("b"))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("who") == "operator").alias("n_operator"), F.count_if(F.col("who") == "analyst").alias("n_questions"), F.count_if("b").alias("n_boilerplate"), F.sum("n").alias("n_chars")
    )


# Emotions and families

_EH = lambda k: f"contains(t, {X.q(k)})" if " " in k else f"contains(pad, {X.q(f' {k} ')})"
_ES = lambda e: "(" + " + ".join(f"case when {_EH(k)} then {w}e0 else 0e0 end" for k, w in L.EMOTIONS[e]) + ")"
_EN = lambda e: "(" + " + ".join(f"{_EH(k)}::int" for k, _ in L.EMOTIONS[e]) + ")"
_EO = ["neutral", *(e for e in L.EMOTION_ORDER if e != "neutral")]


@query(f"""with k as (select doc_id, {X.compact("coalesce(text, '')")} t from documents), p as (select *, ' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ' pad from k),
b as (select doc_id, t, {" + ".join(_ES(e) for e in L.EMOTIONS)} total, list_reverse_sort([{", ".join(f"{{'s': {_ES(e)}, 'n': {_EN(e)}, 'o': {-i}, 'e': '{e}'}}" for i, e in enumerate(_EO))}])[1] b from p)
select doc_id, case when b.s > 0 then b.e else 'neutral' end emotion, case when t = '' then 0.35 when b.s > 0 then round(greatest(0.55e0, least(0.95e0, b.s / total + 0.03e0 * b.n)), 4) else 0.42 end confidence from b""")
def doc_emotion(spark, d):
    t = S.with_emotion(read_spread(spark, d, "documents").select("doc_id", "text"), "text", to="e")
    return t.select("doc_id", F.col("e.label").alias("emotion"), F.col("e.confidence").alias("confidence"))


_FIN = {"negative": ["volatility", "shortages", "declined"], "positive": ["improved", "strongest"], "uncertainty": ["assumes", "probably"], "litigious": [], "modal": ["could", "may"], "constraining": ["committed"]}
_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_STRONG_O = "(" + " or ".join(X.term_found("t", w) for w in L.STRONG_OPPORTUNITY) + ")"
_STRONG_R = "(" + " or ".join(X.term_found("t", w) for w in L.STRONG_RISK) + ")"
_FT = lambda *ks: f"list_slice({X.sql_list([])}::varchar[] || " + " || ".join(f"list_filter({X.terms('t', sorted(_FIN[k]))}, lambda y: true)" if _FIN[k] else "[]::varchar[]" for k in ks) + ", 1, 8)"
_UNION = lambda a, b: f"({a} || list_filter({b}, lambda y: not list_contains({a}, y)))"
_DROP = lambda a, ws: f"list_filter({a}, lambda y: not list_contains({X.sql_list(ws)}, y))"
_OVER = X.first_of([(X.any_pattern("low", ps), f"{{'label': {X.q(f)}, 'term': {X.q(t)}}}") for f, t, ps in L.GUIDANCE_OVERRIDES], "null")


def weak_sql(source: str, key: str) -> str:
    """CTEs that end in weak(key, label, confidence, risk, opportunity, uncertainty, evidence) of a table with text."""
    return f"""wl0 as (select {key}, lower(coalesce(text, '')) low, {_NORM} t from {source}),
wl1 as (select *, {X.terms('t', L.RISK_TERMS)} r0, {X.terms('t', L.OPPORTUNITY_TERMS)} o0, {X.terms('t', L.UNCERTAINTY_TERMS)} u0, {_FT('negative', 'litigious', 'constraining')} fr, {_FT('positive')} fo, {_FT('uncertainty', 'modal')} fu,
  {X.any_pattern('low', L.CONDITIONAL)} and not {_STRONG_O} cond, {X.any_pattern('low', L.NEUTRAL_STATUS)} and not {_STRONG_R} status, {_STRONG_O} so, contains(low, 'please check the help center') or contains(low, 'please refer') deflects, {_OVER} ov from wl0),
wl2 as (select *, {_UNION('r0', 'fr')} r1, {_UNION('o0', 'fo')} o1, {_UNION('u0', 'fu')} u1 from wl1),
wl3 as (select *, case when status then {_DROP('r1', L.GENERIC_RISK)} else r1 end r2, case when cond or (status and not so) then {_DROP('o1', L.GENERIC_OPPORTUNITY)} else o1 end o2,
  case when cond then u1 || ['conditional_language'] else u1 end u2 from wl2),
wl4 as (select *, case when deflects then r2 || ['support_deflection'] else r2 end r3, case when deflects then {_DROP('u2', ['for now'])} else u2 end u3 from wl3),
wl5 as (select *, 2 * len(r3) + len(fr) pr, 2 * len(o2) + len(fo) po, 2 * len(u3) + len(fu) pu from wl4), wl6 as (select *, greatest(pr, po, pu) best from wl5),
weak as (select {key}, case when ov is not null then ov.label when best = 0 then 'neutral' when pr = best then 'risk_friction' when po = best then 'opportunity_commitment' else 'uncertainty_hedging' end as label,
  case when ov is not null then 0.75 else round(least(0.95e0, best / 6), 4) end confidence, case when ov is null then pr when ov.label = 'risk_friction' then 3 else 0 end risk,
  case when ov is null then po when ov.label = 'opportunity_commitment' then 3 else 0 end opportunity, case when ov is null then pu when ov.label = 'uncertainty_hedging' then 3 else 0 end uncertainty,
  case when ov is not null then [ov.term] when best = 0 then []::varchar[] when pr = best then r3 when po = best then o2 else u3 end evidence from wl6)"""


def with_family(df):
    """Adds w, the weak label of text, with the sample of a finance lexicon."""
    return S.with_weak_family(df, "text", _FIN)


@query(f"with {weak_sql('documents', 'doc_id')} select doc_id, label, confidence, risk, opportunity, uncertainty, array_to_string(evidence, ';') evidence from weak")
def doc_weak_family(spark, d):
    w = with_family(read_spread(spark, d, "documents").select("doc_id", "text"))
    return w.select("doc_id", "w.label", "w.confidence", "w.risk", "w.opportunity", "w.uncertainty", F.array_join("w.evidence", ";").alias("evidence"))


@query(f"with n as (select doc_id, {_NORM} t from documents) select doc_id, {', '.join(f'array_to_string({X.terms(chr(116), sorted(v))}, {X.q(chr(59))}) {k}' for k, v in _FIN.items() if v)} from n")
def doc_lexicon_terms(spark, d):
    """Terms of each category of a lexicon, in order, at most eight."""
    t = read_spread(spark, d, "documents").select("doc_id", T.plain(F.col("text")).alias("t"))
    found = S.lexicon_terms(F.col("t"), _FIN)
    return t.select("doc_id", *(F.array_join(found[k], ";").alias(k) for k, v in _FIN.items() if v))


# Candidates and suppression

_TXT = "lower(coalesce(text, ''))"
_CAND = X.first_of(
    [
        (f"{X.any_phrase(_TXT, ps)}" + (f" and contains({{s}}, 'qa')" if lb == "analyst_pressure" else ""), f"{{{{'label': {X.q(lb)}, 'confidence': {p}e0}}}}")
        for lb, ps, p in L.CANDIDATE_RULES
    ],
    "{{'label': 'neutral/no_signal', 'confidence': 0.2e0}}",
)
_TEXTS = f"""texts as (select gold_label_id, {LB._TIDY.format("list_filter(labels, lambda x: trim(x) <> '')[1]")} truth, text, coalesce(json_extract_string(metadata, '$.section'), '') section from (select *, row_number() over (partition by gold_label_id order by chunk_id) k from gold_labels)
  where k = 1 and text is not null and len(list_filter(labels, lambda x: trim(x) <> '')) > 0)"""
_PRED = _CAND.format(s="replace(lower(section), 'qna', 'qa')")


def texts(spark, d):
    g = read_table(spark, d, "gold_labels").dropDuplicates(["gold_label_id"]).withColumn("l", F.filter("labels", lambda x: F.trim(x) != ""))
    section = F.coalesce(F.get_json_object("metadata", "$.section"), F.lit(""))
    return g.where("text is not null and size(l) > 0").select("gold_label_id", LB.tidy(F.get("l", 0)).alias("truth"), "text", F.replace(F.lower(section), F.lit("qna"), F.lit("qa")).alias("section"))


@query(f"with {_TEXTS}, c as (select gold_label_id, truth, {_PRED} c from texts) select gold_label_id, truth, c.label predicted, c.confidence confidence from c")
def signal_rules(spark, d):
    """The first candidate rule of each gold text."""
    none = F.lit(None).cast("string")
    t = texts(spark, d).select("gold_label_id", "truth", S.candidate(F.col("text"), F.col("section"), none, none).alias("c"))
    return t.select("gold_label_id", "truth", F.col("c.label").alias("predicted"), F.col("c.confidence").alias("confidence"))


@query(f"""with {_TEXTS}, ev as (select truth, ({_PRED}).label predicted from texts), l as (select unnest({list(LB.NAMES)}) label), e2 as (select * from ev where truth in {LB._NAMES} and predicted in {LB._NAMES}), c as (
  select label, count(*) filter (where truth = label and predicted = label) tp, count(*) filter (where truth <> label and predicted = label) fp, count(*) filter (where truth = label and predicted <> label) fn
  from l cross join e2 group by label), m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r from c)
select label, tp, fp, fn, tp + fn support, round(p, 4) as precision, round(r, 4) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1 from m""")
def signal_rules_prf(spark, d):
    return O.precision_recall(signal_rules(spark, d), "truth", "predicted", LB.NAMES)


_SUP = X.first_of(
    [("lower(coalesce(section, '')) in ('safe_harbor', 'operator')", "lower(section)"), *((f"contains({_TXT}, {X.q(m)})", X.q(r)) for m, r in L.SUPPRESSION_MARKERS.items()),
     (f"contains({_TXT}, 'great quarter') and not {X.any_phrase(_TXT, ['guidance', 'outlook', 'expect', 'pressure', 'uncertain'])}", "'generic_optimism'"),
     (f"contains({_TXT}, 'last year') and not {X.any_phrase(_TXT, ['guidance', 'outlook', 'expect', 'revis'])}", "'historical_only_results'")], "''",
)
_EV = X.first_of(
    [(X.any_phrase(_TXT, ["safe harbor", "forward-looking"]), "'safe_harbor'"), (X.any_phrase(_TXT, ["non-gaap", "non gaap"]), "'non_gaap'"),
     (f"contains({_TXT}, 'operator') and {X.any_phrase(_TXT, ['instructions', 'queue'])}", "'operator_instructions'"), (X.any_phrase(_TXT, ["excited", "pleased"]), "'generic_optimism'"),
     (f"contains({_TXT}, 'last year') and not contains({_TXT}, 'guidance')", "'historical_only_results'"), (X.any_phrase(_TXT, ["factset", "refinitiv", "callstreet"]), "'vendor_disclaimer'")], "''",
)
_CT = X.compact("coalesce(text, '')")


@query(rf"""select doc_id, {_SUP} candidate_reason, {_EV} event_reason, {X.any_phrase(_TXT, L.SAFE_HARBOR)} safe_harbor, {X.any_phrase(_TXT, L.BUSINESS_TOPICS)} business,
  {X.any_phrase(_TXT, L.HISTORICAL)} and not {X.any_phrase(_TXT, L.CURRENT)} historical, regexp_matches({_TXT}, '\b(?:20[0-9]{{2}}|fy\s?[0-9]{{2,4}}|q[1-4]|quarter|year|annual|full year)\b') period,
  {_CT} <> '' and ((regexp_matches({_CT}, {X.q(L.REVIEW_BOILERPLATE)}) and not regexp_matches({_CT}, {X.q(L.REVIEW_BUSINESS)})) or (len(string_split({_CT}, ' ')) < 7 and regexp_matches({_CT}, {X.q(L.REVIEW_GREETING)}))) boilerplate from documents""")
def doc_suppression(spark, d):
    """Why texts are suppressed, by the rules of candidates, spans, turns and the review queue."""
    c = F.col("text")
    low = F.lower(F.coalesce(c, F.lit("")))
    return read_spread(spark, d, "documents").select(
        "doc_id", S.candidate_suppression(c, F.col("section"), F.lit(None).cast("string")).alias("candidate_reason"), S.event_suppression(c).alias("event_reason"),
        T.any_phrase(low, L.SAFE_HARBOR).alias("safe_harbor"), T.any_phrase(low, L.BUSINESS_TOPICS).alias("business"), S.historical_only(c).alias("historical"), S.period_present(c).alias("period"), S.likely_boilerplate(c).alias("boilerplate"),
    )
