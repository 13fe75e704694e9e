import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import chunking as K
from colloquy.operators import conversations as C
from colloquy.operators import guidance as G
from colloquy.operators import labels as O
from colloquy.operators import retrieval as R
from colloquy.operators import series as S
from colloquy.operators import validate as V
from colloquy.runtime import salted_join

TURNS = "conv string, turn int, role string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).head()[0]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([
        ("a", 0, "x", "first  question?"), ("a", 1, "x", " more "), ("a", 2, "y", "an answer because"), ("a", 3, "x", None), ("a", 4, "x", "alone"), ("a", 5, "x", " "),
        ("b", 0, "y", "orphan"), ("b", 1, None, "aside"), ("b", 2, "x", "late"), ("c", 0, None, None)], TURNS)


def test_merge_and_pairs(spark, turns):
    assert rows(C.merge_turns(turns).select("conv", "role", "turn", "n_turns", "text")) == [
        ("a", "x", 0, 2, "first question? more"), ("a", "x", 4, 1, "alone"), ("a", "y", 2, 1, "an answer because"),
        ("b", "x", 2, 1, "late"), ("b", "y", 0, 1, "orphan"), ("b", None, 1, 1, "aside")]
    p = C.pair_merged(turns, "x", "y").select("conv", "prompt_turn", "response_turn")
    assert rows(p) == [("a", 0, 2), ("a", 4, None), ("b", 2, None), ("b", None, 0)]
    assert rows(C.pair_transparent(turns, "x", "y").select("conv", "prompt_turn", "response_turn")) == [("a", 0, None), ("a", 1, 2), ("a", 4, None), ("b", 2, None)]
    assert rows(C.merge_turns(turns.limit(0))) == [] and rows(C.conversation_features(turns.limit(0), "x", "y")) == []


def test_features_defaults(spark, turns):
    f = {r["conv"]: r for r in C.conversation_features(turns, "x", "y").collect()}
    assert f["b"]["consistency"] == 1.0 and f["b"]["directness"] == 0.0 and f["b"]["deflection"] == 1.0
    d = rows(C.pair_diagnostics(C.pair_merged(turns, "x", "y")))
    assert ("a", 4, 0.0, 0.0, True) in d


def test_text_functions(spark):
    assert one(spark, lambda c: T.term_found(c, "may"), "Maybe not") is False and one(spark, lambda c: T.term_found(c, "may not"), "dismay  not") is True
    assert one(spark, T.number_range, "between 10 and 8.5") == [8.5, 10.0] and one(spark, T.number_range, "12 to 14") == [12.0, 14.0] and one(spark, T.number_range, "none") is None
    assert one(spark, T.midpoint, "10 to 12") == 11.0 and one(spark, T.midpoint, "about 1,250.5 units") == 1250.5 and one(spark, T.midpoint, None) is None
    assert one(spark, T.round_significant, 12345.0, "double") == 12300.0 and one(spark, T.round_significant, 0.0, "double") == 0.0
    assert one(spark, T.words, None) == [] and one(spark, T.slug, "Q&A -- x!") == "q_a_x" and one(spark, T.slug, None) == "unknown"
    assert one(spark, T.normalize_lines, "a\r\n\r\n\r\n\tb  c ") == "a\n\n b c"
    assert one(spark, lambda c: T.excerpt(c, "needle"), "x" * 50 + " needle " + "y" * 100).startswith("...")


def test_series(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 1, 1, 1, 9, 1])] + [("s", 0, 5.0)], "k string, t int, v double")
    out = {(r["k"], r["t"]): (r["z"], r["is_change"]) for r in S.tone_changes(df, key="k", order=["t"], value="v", threshold=1.5).collect()}
    assert out["k", 4] == (2.0, True) and out["k", 0] == (0.0, False) and out["s", 0] == (0.0, False)
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 3, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("a", 9, 90.0)], "k string, t int, v double")
    assert rows(S.as_of(left, right, key="k", time="t", value="v").select("id", "as_of")) == [(1, 50.0), (2, None), (3, None)]
    assert rows(S.as_of(left, right, key="k", time="t", value="v", forward=True).select("id", "as_of")) == [(1, 50.0), (2, 10.0), (3, None)]
    t = spark.createDataFrame([("a", x) for x in (0.0, 20.0, 31.0, 50.0, 62.0)] + [(None, 1.0), ("b", None)], "k string, t double")
    assert rows(S.thin(t, key="k", time="t", gap=30.0)) == [("a", 0.0), ("a", 31.0), ("a", 62.0)]


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(1)
    make = lambda n: [(rnd.choice("ab"), i, *sorted((rnd.uniform(-50, 100), rnd.uniform(-50, 100)))) for i in range(n)]
    a, b = make(60), make(60) + [("a", 99, 5.0, 5.0), ("a", 98, 9.0, 1.0)]
    got = S.overlaps(spark.createDataFrame(a, "k string, lid int, ls double, le double"), spark.createDataFrame(b, "k string, rid int, rs double, re double"), key="k", width=20.0)
    want = [(k, i, j) for k, i, s, e in a for f, j, x, y in b if k == f and x < y and s < y and x < e]
    assert sorted((r["k"], r["lid"], r["rid"]) for r in got.collect()) == sorted(want)


def test_labels(spark):
    df = spark.createDataFrame([("a", "a", 0.95), ("a", "b", 1.0), ("b", "b", 0.05), (None, "a", 0.5), ("a", "a", float("nan"))], "t string, p string, s double")
    assert rows(O.confusion(df, "t", "p", ["a", "b"])) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 0), ("b", "b", 1)]
    assert rows(O.precision_recall(df, "t", "p", ["a", "b", "c"]))[2][-3:] == (0.0, 0.0, 0.0)
    c = {r["bin"]: r["n"] for r in O.calibration(df, "s", F.col("t") == F.col("p")).collect()}
    assert len(c) == 10 and c[9] == 2 and c[0] == 1 and c[3] == 0
    k = O.kappa(df, "t", "p").head()
    assert (k["n"], k["agreement"]) == (4, 75.0)
    votes = spark.createDataFrame([(["b", "a", "a", "b"],), ([None],), ([],)], "v array<string>")
    assert [r[0] for r in votes.select(O.majority(F.col("v"))).collect()] == ["b", None, None]


def test_guidance(spark):
    kind = "entity string, period_no int, rid long, topic string, period string, sig array<double>"
    r = spark.createDataFrame([("e", 1, 1, "margin", "FY", [10.0, 12.0]), ("e", 2, 2, "margin", "FY", [10.0, 12.0]), ("e", 2, 3, "margin", "FY", [10.0, 12.0]), ("e", 3, 4, "other", "Unknown", None)], kind)
    got = {x["rid"]: (x["prior_rid"], x["matched"]) for x in G.match_prior(r, key="entity").collect()}
    assert got == {1: (None, False), 2: (1, True), 3: (None, False), 4: (None, False)}
    df = spark.createDataFrame([([10.0], [12.0], 10.0, 12.0), ([1.0, 5.0], [2.0, 3.0], 1.0, 1.0), ([1.0], [1.0], None, 1.0), ([1.0], [1.01], 1.0, 1.01)], "a array<double>, b array<double>, m double, n double")
    assert [x[0] for x in df.select(G.revision(*(F.col(c) for c in "abmn"))).collect()] == ["raised", "mixed", "unclear", "reaffirmed"]


def test_chunks(spark):
    text = " ".join(f"Sentence {i} ends here." for i in range(60))
    spans = K.pack_sentences(text, 200, 20, 30)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] == a[1] - 20 for a, b in zip(spans, spans[1:]))
    assert K.pack_sentences("x" * 500, 200, 20, 30) == [(0, 500)] and K.pack_sentences(None, 9, 1, 1) == [] and K.pack_sentences("", 9, 1, 1) == []
    # a short tail is joined to the piece before it
    assert K.pack_sentences("A" * 99 + ". B.", 100, 5, 20) == [(0, 103)]
    s = spark.createDataFrame([("k", i, float(10 * i), 10.0 * i + 9) for i in range(7)] + [("k", 9, None, 1.0)], "k string, ord int, start double, `end` double")
    assert rows(K.pack_time(s, key="k").select("start", "end", "n")) == [(0.0, 29.0, 3), (30.0, 59.0, 3), (60.0, 69.0, 1)]
    x = spark.createDataFrame([("intro Q&A rest",), ("nothing",)], "t string").select(K.marker_spans(F.col("t"), {"qa": "q&a"})).collect()
    assert [[tuple(y) for y in r[0]] for r in x] == [[("unknown", 0, 6), ("qa", 6, 14)], [("unknown", 0, 7)]]
    p = spark.createDataFrame([("ab", "ab"), (None, "x")], "a string, b string")
    assert [r[0] for r in p.select(K.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple plum"), (3, None), (4, "fig")], "d long, text string")
    q = spark.createDataFrame([(0, "apple"), (0, "plum"), (1, "zzz")], "q long, token string")
    got = R.bm25(docs, q, doc="d", query="q", ts=T.tokens(F.col("text")), k=5).orderBy("rank").collect()
    assert [(r["q"], r["d"]) for r in got] == [(0, 2), (0, 1)]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "i long, v array<float>")
    assert [(r["neighbour"], r["rank"]) for r in R.nearest_vectors(v, row="i", vector="v", k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_validation_and_salted_join(spark):
    df = spark.createDataFrame([(1, "x"), (None, " ")], "i int, t string")
    rules = {"no_id": F.col("i").isNotNull(), "no_text": F.trim("t") != ""}
    assert [r["errors"] for r in V.validate(df, rules).collect()] == [[], ["no_id", "no_text"]] and rows(V.summary(df, rules)) == [("no_id", 1), ("no_text", 1)]
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 0), (None, 1)], "k string, n int")
    small = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, v string")
    assert len(salted_join(big, small, ["k"]).collect()) == 51 and len(salted_join(big, small, ["k"], how="left").collect()) == 52


def test_entry_survives_without_llm(spark, sf, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() >= 0
    for name in [m for m in sys.modules if m.startswith("colloquy.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def absent(name, *a):
        if name.startswith("colloquy.llm"):
            raise ModuleNotFoundError(name, name="colloquy.llm")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert "p7_found" in e.queries() and "p1_found" not in e.queries()

    def broken(name, *a):
        if name.startswith("colloquy.llm"):
            raise ModuleNotFoundError("x", name="zstandard")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()


def test_hot_keys_get_salts(spark):
    from colloquy.runtime import hot_keys

    big = spark.range(40_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) k", "id n")
    hot = hot_keys(big, ["k"]).collect()
    assert [r.k for r in hot] == ["hot"] and hot[0]["_salts"] >= 8
    small = big.select("k").distinct().selectExpr("k", "length(k) v")
    j = salted_join(big, small, ["k"])
    assert j.count() == 40_000 and j.where("v <> length(k)").count() == 0


def test_as_of_in_blocks_equals_one_pass(spark):
    rnd = random.Random(2)
    left = spark.createDataFrame([(rnd.choice("hhhab"), rnd.randrange(1000), i) for i in range(300)], "k string, t int, id int")
    right = spark.createDataFrame([(rnd.choice("hhhab"), rnd.randrange(1000), float(i)) for i in range(60)], "k string, t int, v double")
    for forward in (False, True):
        a = S.as_of(left, right, key="k", time="t", value="v", forward=forward)
        b = S.as_of(left, right, key="k", time="t", value="v", forward=forward, block=F.floor(F.col("t") / 50))
        assert rows(a) == rows(b)


def test_exact_quantiles_of_a_hot_group(spark):
    import numpy as np

    from colloquy.operators.quantiles import exact_quantiles

    rnd = np.random.default_rng(3)
    v = np.round(rnd.exponential(1.0, 30_000), 3)
    df = spark.createDataFrame([("hot" if i % 10 else f"g{i % 7}", float(x)) for i, x in enumerate(v)] + [("none", None)], "g string, v double")
    got = {(r.g, r.name): r.x for r in exact_quantiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p97": 0.97, "top": 1.0}, linear=True).collect()}
    for g in ("hot", "g0"):
        mine = [x for i, x in enumerate(v) if ("hot" if i % 10 else f"g{i % 7}") == g]
        assert np.allclose([got[g, n] for n in ("p1", "p50", "p97", "top")], np.quantile(mine, [0.01, 0.5, 0.97, 1.0]))
    assert not any(g == "none" for g, _ in got)
