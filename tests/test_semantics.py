"""Defined results of rules on handwritten texts, the edge cases included."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import behavior as B
from colloquy.operators import chunking as K
from colloquy.operators import contracts as Q
from colloquy.operators import conversations as C
from colloquy.operators import corpus as O
from colloquy.operators import evidence as E
from colloquy.operators import fusion as U
from colloquy.operators import privacy as P
from colloquy.operators import queues
from colloquy.operators import signals as S
from colloquy.operators import transcripts as R
from colloquy.operators import validate as V


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def features(spark, *messages):
    df = spark.createDataFrame([("c", i, r, t) for i, (r, t) in enumerate(messages)], "conv string, turn int, role string, text string")
    return C.conversation_features(df, "customer", "agent").head()


def test_conversation_features(spark):
    f = features(spark, ("customer", "Hello?"))
    assert f.deflection == 1.0 and f.directness == 0.0 and "low_directness" in f.flags
    f = features(spark, ("customer", "Why is my invoice wrong?"), ("customer", "I still need an answer."))
    assert f.deflection == 1.0 and f.n_pairs == 1 and "agent_deflection" in f.flags
    f = features(spark, ("customer", "Why was my order delayed?"), ("agent", "I checked the shipment. The delay happened because the address was incomplete and you can update it now."))
    assert all(0 <= f[k] <= 1 for k in ("positive", "negative", "hedging", "directness", "deflection", "consistency", "verbosity", "score"))
    # 0.30 directness + 0.20 (1 - deflection) + 0.15 consistency + 0.10 (1 - negative) + 0.10 positive + 0.10 (1 - hedging) + 0.05 balance
    want = 0.3 * f.directness + 0.2 * (1 - f.deflection) + 0.15 * f.consistency + 0.1 * (1 - f.negative) + 0.1 * f.positive + 0.1 * (1 - f.hedging) + 0.05 * max(0, 1 - abs(0.5 - f.verbosity) * 2)
    assert abs(f.score - want) < 1e-4
    angry = features(spark, ("customer", "wrong failed upset angry now"), ("agent", "no"), ("customer", "wrong"), ("agent", "never mind"))
    assert angry.flags == "customer_frustration,agent_deflection,low_directness,inconsistent_messaging"


def test_behaviour(spark):
    df = texts(
        spark, "We may see timing uncertainty this quarter and visibility remains limited.", "Revenue grew 20% and the company shipped all committed units in the quarter.", "It's hard to estimate with precision what the demand will be.\nI wouldn't want\nto predict it.",
        "While we expect tightness in the supply for our advanced architectures to persist, we remain confident in execution.", "What gives you confidence that margins hold?", "We could not be more pleased.", "This call may be recorded.", None, "...",
    )
    found = {(r.id, r.rule): r.strength for r in B.evidence(df, ["id"], "text").collect()}
    assert {k: v for k, v in found.items() if k[0] == 0} == {(0, "modal uncertainty"): 1, (0, "timing uncertainty"): 3, (0, "limited visibility"): 3}
    assert (2, "wouldn't want to predict") in found and (2, "hard to estimate with precision") in found and found[3, "tightness in the supply to persist"] == 2 and found[3, "remain confident"] == 3
    assert found[4, "what gives you confidence"] == 1 and found[4, "what gives you confidence that"] == 4 and {i for i, _ in found} == {0, 2, 3, 4}
    s = {r.id: r for r in B.scores(B.evidence(df, ["id"], "text"), ["id"]).collect()}
    assert s[0].uncertainty == 7 and s[0].uncertainty_level == "high" and s[3].uncertainty_level == "medium" and s[4].skepticism_level == "high"
    q = B.doubting_questions(B.evidence(df, ["id"], "text"), ["id"]).head()
    assert (q.matched, q.strength, q.label) == ("what gives you confidence that", 5, "high")
    top = B.strongest(B.evidence(texts(spark, "We may, might and could wait."), ["id"], "text"), ["id"]).collect()
    assert [(r.rule, r.k) for r in top] == [("modal uncertainty", 1)]  # cut to two before repeats go


def test_families(spark):
    df = texts(
        spark, "Guidance was revised down.", "We raised our guidance.", "The guidance is flat.", "We expect more.", "I am frustrated and the fix is still broken.", "We might send the pilot if legal agrees.", "For reference, the renewal is still open.",
        "Please refer to the FAQ for now.", "nothing", None, "resolved and unresolved",
    )
    w = {r.id: r.w for r in S.with_weak_family(df, "text").collect()}
    assert [w[i].label for i in range(4)] == ["risk_friction", "opportunity_commitment", "opportunity_commitment", "uncertainty_hedging"] and w[0].confidence == 0.75 and w[0].risk == 3
    assert w[4].label == "risk_friction" and w[4].evidence == ["frustrated", "still broken"] and w[4].confidence == round(4 / 6, 4)
    assert w[5].label == "uncertainty_hedging" and "conditional_language" in w[5].evidence and w[5].opportunity == 0
    assert w[6].label == "neutral" and w[6].risk == 0 and w[7].evidence == ["please refer to", "support_deflection"] and w[7].uncertainty == 0 and w[8].label == w[9].label == "neutral" and w[9].confidence == 0.0
    assert w[10].label == "risk_friction"  # risk wins ties
    lm = S.with_weak_family(texts(spark, "litigation again"), "text", {"negative": ["litigation"]}).head().w
    assert lm.risk == 5 and lm.evidence == ["again", "litigation"]  # twice in the family, once more by itself


def test_emotions(spark):
    df = texts(spark, "I am furious, this is unacceptable", "thanks, that works", "", None, "plain words", "ASAP today", "I am not sure, it is a risk")
    e = {r.id: r.emotion for r in S.with_emotion(df, "text").collect()}
    assert [e[i].label for i in range(6)] == ["anger", "satisfaction", "neutral", "neutral", "neutral", "urgency"] and (e[2].confidence, e[4].confidence) == (0.35, 0.42) and e[0].confidence == 0.95
    assert e[6].label == "confusion"
    only = {r.id: r.emotion for r in S.with_emotion(df, "text", labels=["concern", "urgency"]).collect()}
    assert only[4].label == "concern" and only[4].confidence == 0.34
    with pytest.raises(ValueError):
        S.with_emotion(df, "text", labels=["odd"])


def test_candidates_and_suppression(spark):
    df = spark.createDataFrame([("We raised guidance", "qa", None, None), ("Why is that?", "qna_qa", None, None), ("Why is that?", "prepared", None, None), ("plain", None, "guidance_statement", None), ("why", "x", None, "evidence_object"), (None, None, None, None)], "t string, s string, p string, o string")
    got = [(r.c.label, r.c.confidence) for r in df.select(S.candidate(*(F.col(x) for x in "tspo")).alias("c")).collect()]
    assert got == [("guidance_revision", 0.82), ("analyst_pressure", 0.66), ("neutral/no_signal", 0.2), ("guidance_statement", 0.7), ("analyst_pressure", 0.66), ("neutral/no_signal", 0.2)]
    why = [r[0] for r in texts(spark, "A great quarter", "Last year we sold", "Non-GAAP, operator", "fine", None).select(S.candidate_suppression(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))).collect()]
    assert why == ["generic_optimism", "historical_only_results", "non_gaap", "", ""]


def test_event_chunks(spark):
    text = "Prepared remarks\nCEO: We narrowed guidance.\nQuestion-and-Answer\nAnalyst: Question?\nCFO: Answer."
    df = spark.createDataFrame([("a", text), ("b", "plain words only"), ("c", None), ("d", "")], "case string, text string")
    c = R.event_chunks(df, case="case", text="text").collect()
    assert {r.chunk_type for r in c if r.case == "a"} >= {"guidance_revision_candidate", "qa_question", "qa_answer", "qa_pair"} and [r.chunk_type for r in c if r.case == "b"] == ["semantic_fallback"] and {r.case for r in c} == {"a", "b"}
    pair = next(r for r in c if r.chunk_type == "qa_pair")
    assert text[pair.start : pair.end] == "Question?\nCFO: Answer."
    assert all(r.chunk_id.startswith("chunk_") and len(r.chunk_id) == 22 for r in c)


def test_line_candidates(spark):
    text = "CEO: We expect revenue to be higher this year.\nQuestion and answer\nJane Analyst: why is margin under pressure?\nOperator: hold on\nCFO: let me frame it; demand is confident.\nAnalyst Two: why the cost?\n"
    c = {(r.signal, r.turn_no): r for r in R.turn_candidates(R.line_turns(texts(spark, text), ["id"], "text"), ["id"]).collect()}
    assert c["guidance_revision", 0].direction == "raised" and c["analyst_pressure", 2].confidence == "medium" and c["answer_shift", 2].direction == "reframing" and c["neutral/no_signal", 3].bucket == "boilerplate_safe_harbor"
    assert c["analyst_pressure", 5].bucket == "analyst_only_unpaired" and ("answer_shift", 5) not in c and c["reassurance", 4].rule == "reassurance_v1"


def test_cleaning(spark):
    text = "﻿A\r\nA\n\n\nADVERTISEMENT\nB  b\n" + "nav\nC\n" * 6 + "end�\n"
    r = O.clean_transcripts(texts(spark, text, None, ""), row="id", text="text").orderBy("id").collect()
    assert r[0].clean == "A\n\nB b\n" + "nav\nC\n" * 4 + "end\n" and (r[0].n_encoding, r[0].n_repeated, r[0].n_boilerplate) == (1, 1, 5)
    assert len(r) == 2 and r[1].clean == "\n"


def test_headed_turns_and_signals(spark):
    text = "Jane Doe - CEO, Acme 1\nIn 2024 we raised our revenue guidance. We remain confident in all 3 of it.\n\nQuestions and Answers\nJohn Roe\nWhat changed in the outlook of 2025? It seems weaker to us now.\n"
    df = texts(spark, text, "short", None)
    t = {(r.id, r.turn_no): r for r in O.headed_turns(df, row="id", text="text").collect()}
    assert t[0, 0].speaker == "Jane Doe" and t[0, 0].role == "executive" and t[0, 1].role == "analyst" and t[0, 1].section == "q_and_a" and t[1, 0].speaker == "Unknown" and len(t) == 3
    assert text[t[0, 1].start : t[0, 1].end].strip() == t[0, 1].body
    s = O.signals(df, O.headed_turns(df, row="id", text="text"), row="id", text="text").collect()
    got = {(r.id, r.signal): r for r in s}
    assert got[0, "guidance_revision"].confidence == 0.72 and got[0, "analyst_pressure"].confidence == 0.65 and got[0, "commitment"].speaker == "Jane Doe" and got[1, "neutral"].confidence == 0.25
    labels = {r.signal: (r.label, r.confidence) for r in O.labels_of_signals(spark.createDataFrame([("risk_friction", 0.9), ("opportunity_commitment", 0.5)], "signal string, confidence double")).collect()}
    assert labels == {"risk_friction": ("uncertainty", 0.75), "opportunity_commitment": ("commitment", 0.5)}


def test_span_match_is_greedy(spark):
    kind = "k string, no int, start int, `end` int, label string"
    gold = spark.createDataFrame([("a", 1, 0, 10, "x"), ("a", 2, 0, 12, "x"), ("a", 3, 50, 60, "y"), ("b", 1, 0, 5, "x")], kind)
    weak = spark.createDataFrame([("a", 1, 2, 12, "x"), ("a", 2, 8, 12, "z"), ("a", 3, 90, 99, "x")], kind)
    m = {(r.k, r.gold_no): r.weak_no for r in O.match_spans(gold, weak, key="k").collect()}
    assert m == {("a", 1): 1, ("a", 2): 2, ("a", 3): None, ("b", 1): None}
    s = {r.k: r for r in O.span_scores(gold, weak, key="k").collect()}
    assert (s["a"].matched, s["a"].missed, s["a"].extra, s["a"].type_match, s["a"].type_mismatch, s["a"].exact) == (2, 1, 1, 1, 1, 1) and s["b"].n_weak == 0


def test_personal_data(spark):
    t = "Email me at ops@northwind.example, call +1 (415) 555-0114, bill 4111 1111 1111 1111, use DE89370400440532013000, and ship to 123 Market Street."
    clean, found = P.redact_text(t)
    assert all(f"[{k}]" in clean for k in ("EMAIL", "PHONE", "CARD", "IBAN", "ADDRESS")) and len(found) == 5 and "415" not in clean
    assert P.redact_text(None) == ("", []) and P.redact_text("4111 1111 1111 1112")[1][0]["kind"] == "phone" if P.redact_text("4111 1111 1111 1112")[1] else True
    df = spark.createDataFrame([("c", [("customer", "call 415-555-0114 or finance@northwind.example"), ("agent", "card 4111 1111 1111 1111 at 123 Market Street.")])], "id string, messages array<struct<role:string,text:string>>")
    r = P.redact_messages(df, messages="messages", fields=["text"])
    assert sorted((x.path, x.kind) for x in r.collect()) == [("messages[0].text", "email"), ("messages[0].text", "phone"), ("messages[1].text", "address"), ("messages[1].text", "card")]
    assert P.redaction_summary(r).agg(F.sum("n")).head()[0] == 4
    assert [x.t for x in texts(spark, t, None).select(P.redacted(F.col("text"))["text"].alias("t")).collect()] == [clean, ""]


def test_quotes(spark):
    text = "We said  that\nrevenue grew. Margins were held by better utilization this year. The rest is noise."
    assert E.find_quote(text, "that\nrevenue") == {"status": "exact", "start": 9, "end": 21}
    n = E.find_quote(text, "SAID that revenue")
    assert n["status"] == "normalized" and text[n["start"] : n["end"]] == "said  that\nrevenue"
    f = E.find_quote(text, "margins held by better utilization in this year")
    assert f["status"] == "fuzzy" and "utilization" in text[f["start"] : f["end"]]
    assert E.find_quote(text, "totally other words than those here")["status"] == "not_found" and E.find_quote(None, "x")["status"] == "missing"
    b = E.best_window("alpha beta gamma", "x " * 4000 + "alpha beta gamma " * 400)
    assert b["score"] > 0.3 and b["start"] > 0 and E.best_window(" ", "x")["score"] == 0.0


def test_review_pieces(spark):
    assert K.review_pieces("a\r\n\r\n" + "b" * 950 + ". " + "c" * 10, 900) == ["a", "b" * 900, "b" * 50 + ".", "c" * 10] and K.review_pieces(None) == []
    t = texts(spark, "one two. " * 300).select(K.timeline(K.review_chunks(F.col("text"))).alias("x")).head().x
    assert t[0]["start"] == 0.0 and all(a["end"] == b["start"] for a, b in zip(t, t[1:])) and all(5 <= x["end"] - x["start"] <= 90.001 for x in t)


def test_fusion_of_modalities(spark):
    fam = {f"p_{f}": v for f, v in zip(("risk_friction", "opportunity_commitment", "uncertainty_hedging", "neutral"), (0.25, 0.25, 0.25, 0.25))}
    df = spark.createDataFrame([(1, *fam.values()), (2, *fam.values()), (3, 0.0, 0.0, 0.0, 0.0)], "id long, " + ", ".join(f"{k} double" for k in fam))
    audio = spark.createDataFrame([(1, 5.0, 0.0, 0.0)], "id long, hesitation_score double, confidence_score double, intensity_score double")
    video = spark.createDataFrame([(2, 30.0, 1.0)], "id long, motion_intensity double, stress_indicator double")
    r = {x.id: x for x in U.fuse(df, audio, video, key="id").collect()}
    assert r[1].fused_signal == "uncertainty_hedging" and abs(r[1].confidence - round(0.39 / 1.14, 4)) < 1e-9 and r[2].fused_signal == "risk_friction" and r[2].has_video and not r[1].has_video
    assert r[3].f_neutral == 0.25 and r[3].fused_signal == "risk_friction"
    s = [(1, "transcript", "hedging", "high", 0.6), (1, "audio", "pause_length", "low", 0.5), (2, "audio", "pause_length", "medium", 0.9), (3, "transcript", "odd", "high", 0.9)]
    b = {x.id: x for x in U.fuse_buckets(spark.createDataFrame(s, "id int, modality string, signal string, strength string, confidence double"), key="id").collect()}
    assert (b[1].strength, b[1].confidence, b[1].modalities) == ("high", 0.65, "audio,transcript") and (b[2].strength, b[2].confidence) == ("medium", 0.42) and 3 not in b


def test_contracts(spark):
    sha = "sha256:" + "a" * 64
    df = spark.createDataFrame([("1", "odd", "abstain", 0, None), ("2", "x", "bm25", 0, "buy now")], "query_id string, section_label string, retrieval_method string, result_rank int, notes string").withColumns({"speaker_role": F.lit("u"), "raw_text_returned": F.lit(False)})
    e = {r.query_id: r.errors for r in V.validate(df, Q.retrieval_result(df)).collect()}
    assert e["1"] == [] and {"rank", "claims", "missing_object_id", "bad_source_hash"} <= set(e["2"])
    q = spark.createDataFrame([("1", "text", "find", True, False, ["x"]), ("2", "text", "find", False, False, []), ("3", "text", "find", False, False, ["x"])], "query_id string, query_text string, query_intent string, abstention_expected boolean, negative_control boolean, expected_evidence_ids array<string>")
    e = {r.query_id: r.errors for r in V.validate(q, Q.evaluation_query(q)).collect()}
    assert e == {"1": ["abstention_expects"], "2": ["expects_nothing"], "3": []}
    b = spark.createDataFrame([("b", "external_dataset", "s", "train", "1", False, False, False, False)], "benchmark_id string, benchmark_group string, status string, default_use string, minimum_gold_labels string, writes_gold boolean, weak_labels_can_be_gold boolean, production_ml_claim_allowed boolean, training_allowed boolean")
    assert V.validate(b, Q.benchmark(b)).head().errors == ["external_use"]
    o = spark.createDataFrame([("rom_event_" + "0" * 16, "c", "s", "p", "r", 5, 1)], "object_id string, case_id string, source_type string, provenance_ref string, rights_tier string, span_start_char int, span_end_char int").withColumns({f: F.lit(sha) for f in ("source_hash", "text_hash", "normalized_transcript_hash", "provenance_hash")})
    assert V.validate(o, Q.retrieval_object(o)).head().errors == ["span_order", "content_included_must_be_false", "embeddings_included_must_be_false", "vector_db_included_must_be_false"]
    for rules in (Q.turn_candidate, Q.extracted_candidate, Q.review_candidate, Q.promotion):
        assert V.validate(df, rules(df)).count() == 2
    k = Q.with_known(spark.createDataFrame([("a",), ("z",), (None,)], "obj string"), spark.createDataFrame([("a",), ("a",)], "id string"), "obj")
    assert sorted(str((r.obj, r.obj_known)) for r in k.collect()) == ["('a', True)", "('z', False)", "(None, True)"]
    assert [r[0] for r in texts(spark, "NO_CAUSAL_CLAIM here", "it causes alpha").select(Q.claim_language(F.col("text"))).collect()] == [[], ["NO_CAUSAL_CLAIM", "NO_TRADING_CLAIM"]]


def test_queues(spark):
    df = spark.createDataFrame([(i, "k" if i % 3 else "h", "x" if i % 2 else "y", float(i)) for i in range(30)], "id int, k string, l string, s double")
    r = queues.ranked(df, [F.desc("s"), F.col("id")])
    assert [x.id for x in r.orderBy("rank").collect()] == list(range(29, -1, -1)) and sorted(x.rank for x in r.collect()) == list(range(1, 31))
    c = queues.capped(df, caps={"a": ([F.col("k"), F.col("l")], 2), "b": ([F.col("k")], 3)}, order=[F.col("id")])
    assert sorted(x.id for x in c.collect()) == [0, 1, 2, 3, 4, 6]
    t = queues.take_until(df, df.where("id < 5").select("id"), key="id", order=[F.col("id")], fits=F.col("l") == "x", need=3)
    assert [x.id for x in t.orderBy("rank").collect()] == [5, 7, 9]
