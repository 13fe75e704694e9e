"""Whole results where queries once did less."""

import datetime
import time

import numpy as np

from colloquy.plans import extra, relational, series
from colloquy.streaming import chunker

SEGMENT = "case_id string, message_index int, segment_id string, role string, text string, start_s double, end_s double"


def segments(spark, tmp_path, rows):
    """A data directory with transcript_segments of (case, role, text, start, end)."""
    data = [(c, i, f"s{i}", r, t, s, e) for i, (c, r, t, s, e) in enumerate(rows)]
    spark.createDataFrame(data, SEGMENT).write.parquet(str(tmp_path / "transcript_segments.parquet"))
    return str(tmp_path)


def labels(spark, tmp_path, rows):
    """A data directory with labels of (id, call, evidence)."""
    spark.createDataFrame(rows, "label_row_id long, call_id string, evidence_text string").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_last_window_is_kept(spark, tmp_path):
    long = "x" * 50
    d = segments(spark, tmp_path, [
        ("a", None, long, 0.0, 9.0), ("a", None, "short in the middle", 31.0, 35.0), ("a", None, long, 61.0, 70.0), ("a", None, "That concludes.", 95.0, 99.0),
        ("b", None, "only", 5.0, 6.0), ("c", None, long, 0.0, 1.0), ("c", None, "  ", 40.0, 41.0), ("c", None, None, 41.0, 42.0),
    ])
    got = sorted((r["conv"], r["win"], r["n_chars"]) for r in series.window_chunks(spark, d).collect())
    assert got == [("a", 0, 50), ("a", 2, 50), ("a", 3, 15), ("b", 0, 4), ("c", 0, 50)]


def test_last_chunk_of_a_silent_stream(spark, tmp_path):
    src, kind = str(tmp_path / "seg"), "key string, start double, end double, text string"
    rows = [("k", 0.0, 9.0, "x" * 50), ("k", 31.0, 35.0, "short in the middle"), ("k", 61.0, 65.0, "That concludes.")]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(kind).parquet(src)
    q = chunker.chunk_segments(stream, idle_ms=500).writeStream.format("memory").queryName("idle_chunks").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while spark.table("idle_chunks").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.start, r.text) for r in spark.table("idle_chunks").collect()) == [(0.0, "x" * 50), (60.0, "That concludes.")]


def test_revision_of_the_matched_statement(spark, tmp_path):
    margin, sales = "FY gross margin outlook {} percent.", "FY revenue guidance {} million."
    d = labels(spark, tmp_path, [
        (1, "acme_2024Q1_x", margin.format("45 to 47")), (2, "acme_2024Q1_x", sales.format("10 to 12")),
        (3, "acme_2024Q2_x", sales.format("10 to 14")), (4, "acme_2024Q2_x", margin.format("43 to 47")), (5, "acme_2024Q2_x", "Q3 tax rate near 21 percent."),
        (6, "acme_2024Q4_x", sales.format("10 to 14")),
    ])
    got = {r["rid"]: r["revision"] for r in extra.guidance_revision(spark, d).collect()}
    assert got == {1: "unclear", 2: "unclear", 3: "raised", 4: "lowered", 5: "unclear", 6: "unclear"}


def test_match_needs_a_shared_number(spark, tmp_path):
    d = labels(spark, tmp_path, [
        (1, "acme_2024Q1_x", "FY gross margin outlook 45 to 47 percent."), (2, "acme_2024Q2_x", "FY gross margin outlook 30 to 31 percent."), (3, "acme_2024Q2_x", "FY gross margin outlook 45 to 47 percent."),
    ])
    got = {r["rid"]: (r["prior_rid"], r["matched"]) for r in extra.guidance_match(spark, d).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (1, True)}


def test_questions_of_any_role_are_thinned(spark, tmp_path):
    d = segments(spark, tmp_path, [
        ("a", "analyst", "Prepared remarks continue.", 15.0, 25.0), ("a", None, "Revenue improved and grew.", 70.0, 99.0),
        ("a", "unknown", "Could you discuss demand trends for next quarter?", 100.0, 108.0), ("a", "analyst", "What about regional growth?", 112.0, 118.0),
        ("a", "speaker", "It declined on shortages.", 120.0, 150.0), ("a", " ", "Can you explain margin pressure in more detail", 180.0, None),
        ("a", "analyst", "Why?", 300.0, 301.0), ("a", "analyst", "Thank you for that.", 330.0, 331.0),
    ])
    got = {r["aid"]: r for r in series.question_shifts(spark, d).collect()}
    assert sorted(got) == ["2", "5"] and got["2"]["shift"] < 0 < got["2"]["before"]


def test_review_batch_takes_disagreement_and_rare_labels(spark):
    from colloquy.operators import fusion as U

    r = [("s1", "neutral", 0.9, ["model_vote_disagreement"]), ("s2", "neutral", 0.5, []), ("s3", "risk_friction", 0.9, []), ("s4", "neutral", 0.9, []), ("s5", "odd", None, [])]
    df = spark.createDataFrame(r, "segment_id string, final_signal string, confidence double, flags array<string>")
    got = [(x.segment_id, x.review_priority, x.review_reason) for x in U.review_batch(df, key="segment_id", limit=4).orderBy("rank").collect()]
    assert got == [("s5", 5, "low_confidence;rare_label"), ("s1", 3, "model_disagreement"), ("s2", 3, "low_confidence"), ("s3", 3, "rare_label;high_value_signal")]


def test_bootstrap_of_the_difference(spark, tmp_path):
    rnd = np.random.default_rng(1)
    price, day = rnd.random(300).round(6), rnd.integers(0, 90, 300)
    rows = [(i, float(p), datetime.date(2024, 1, 7) + datetime.timedelta(int(x))) for i, (p, x) in enumerate(zip(price, day))]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    got = relational.bootstrap_ci(spark, str(tmp_path)).head()
    y, (lo, hi) = day % 7, np.quantile(price, [0.3, 0.7])
    a, b = y[price >= hi], y[price <= lo]
    diff = [rnd.choice(a, len(a)).mean() - rnd.choice(b, len(b)).mean() for _ in range(20_000)]
    assert np.allclose([got["mean_diff"], got["low"], got["high"]], [np.mean(diff), *np.quantile(diff, [0.025, 0.975])], atol=0.08)
