import random

import pytest

from colloquy.llm.leakage import leaked_passages, words
from colloquy.llm.nearest_time import nearest_time


def test_words():
    assert words("So­ft ﬁne_x ZERO​width, 3½") == ["soft", "fine", "x", "zerowidth", "31", "2"]


def brute(docs, items, span):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
        for q, p in items:
            v = words(p or "")
            if any(tuple(v[i : i + span]) in grams for i in range(len(v) - span + 1)):
                out.add((d, q))
    return out


@pytest.mark.parametrize("bound", [32_000_000, -1])
def test_leaks_equal_brute_force(spark, bound):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for d in range(80):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([0, 5, 60, 300]))]
        if d % 3 == 0:
            v = items[d % 12][1].split()
            n = rnd.choice([14, 15, 16, 17, 25])
            s = rnd.randrange(0, 40 - n + 1)
            text[len(text) // 2 : len(text) // 2] = v[s : s + n]
        docs.append((d, ", ".join(text).upper()))
    docs += [(200, None), (201, ""), (202, items[0][1]), (203, items[0][1])]
    c = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, h int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, pos int")
    run = lambda c, q: leaked_passages(c, q, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", broadcast_bytes=bound)
    assert {(r.doc_id, r.item_id) for r in run(c, q).collect()} == brute(docs, items, 16)
    assert run(c.limit(0), q).collect() == [] and run(c, q.limit(0)).collect() == []


def pairs(spark, left, right, tol=2.5):
    a = spark.createDataFrame(left, "audio_id long, case_id string, t double, lo2 int")
    b = spark.createDataFrame(right, "segment_id long, case_id string, t double, bucket int")
    out = nearest_time(
        a, b, left_id="audio_id", left_entity="case_id", left_time="t", right_id="segment_id", right_entity="case_id", right_time="t", tolerance_s=tol
    )
    return sorted((r.audio_id, r.segment_id) for r in out.collect())


def test_nearest_ties_nulls_and_tolerance(spark):
    left = [(1, " A", 10.0, 0), (1, " A", 10.0, 0), (2, "a", 12.5, 0), (3, "a", None, 0), (4, None, 1.0, 0), (5, "b", 1.0, 0), (6, "a", float("nan"), 0), (7, "a", 30.0, 0)]
    right = [(9, "A ", 9.5, 0), (8, "a", 10.5, 0), (7, "a", 15.0, 0), (6, "a", 15.0, 0), (5, "a", None, 0), (4, "c", 1.0, 0)]
    assert pairs(spark, left, right) == [(1, 8), (2, 8)]
    assert pairs(spark, [(1, "a", 12.5, 0)], [(7, "a", 15.0, 0), (6, "a", 15.0, 0), (3, "a", 15.001, 0)]) == [(1, 6)]
    assert pairs(spark, [], right) == [] and pairs(spark, left, []) == []


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice("ab"), rnd.randrange(-300000, 600000) / 1000, 0) for i in range(400)]
    right = [(i, rnd.choice("aaab"), rnd.randrange(-300000, 600000, 500) / 1000, 0) for i in range(500)]
    want = []
    for i, e, t, _ in left:
        near = sorted((abs(round(t * 1000) - round(s * 1000)), j) for j, f, s, _ in right if f == e)
        if near and near[0][0] <= 2500:
            want.append((i, near[0][1]))
    assert pairs(spark, left, right) == sorted(want)
