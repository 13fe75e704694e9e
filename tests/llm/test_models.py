"""Models against simulations and wordings that no dictionary was made from."""

import random
from collections import Counter

import numpy as np

from colloquy.llm.broken_pairs import broken_pairs
from colloquy.llm.consensus import consensus, habit_consensus, reliabilities
from colloquy.llm.grouped_splits import assign_splits, split_shares
from colloquy.llm.speaker_turns import speaker_turns, turn_starts

SEGMENT = "segment_id long, case_id string, message_index int, role string, text string, speaker_id string"
PERSON = "participant_id string, case_id string, full_name string, person_role string, title string"


def simulate(seed=1, items=1500, annotators=24):
    """Votes of annotators of uneven reliability and activity, some of whom take one label for another."""
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    skill = {f"r{i:02d}": 0.05 if i < 4 else 0.25 + 0.65 * i / annotators for i in range(annotators)}
    mixed = {"r20": ("a", "b"), "r21": ("c", "d"), "r22": ("e", "a")}
    votes, truth = [], {}
    for i in range(items):
        t = truth[f"i{i}"] = rnd.choice(names)
        for r in rnd.sample(sorted(skill), rnd.choice([3, 3, 4, 5, 6])):
            v = t if rnd.random() < skill[r] else rnd.choice(names)
            if r in mixed and v == mixed[r][0]:
                v = mixed[r][1]
            votes.append((f"i{i}", r, v))
    return votes, truth, skill


def test_consensus_beats_counts(spark):
    votes, truth, skill = simulate()
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    out, rel = consensus(df)
    right = lambda got: sum(truth[i] == v for i, v in got.items()) / len(truth)
    counts: dict = {}
    for i, _, v in votes:
        counts.setdefault(i, Counter())[v] += 1
    plain = right({i: min(c, key=lambda v: (-c[v], v)) for i, c in counts.items()})
    spectral = right({r["item"]: r.label for r in out.collect()})
    habits = right({r["item"]: r.label for r in habit_consensus(df, rel).collect()})
    assert spectral > plain + 0.03 and habits >= spectral - 0.005
    got = {r.annotator: r.reliability for r in rel.collect()}
    honest = [r for r in skill if r not in ("r20", "r21", "r22")]
    assert np.corrcoef([skill[r] for r in honest], [got[r] for r in honest])[0, 1] > 0.95
    row = out.where("n_votes = 3").head()
    mine = Counter(v for i, _, v in votes if i == row["item"])
    assert abs(row.agreement - sum(n * (n - 1) for n in mine.values()) / 6) < 1e-9 and abs(row.vote_share - mine[row.label] / 3) < 1e-9


def test_reliability_is_the_leading_eigenvector(spark):
    """On complete votes the matrix needs no correction: compared with numpy's eigenvector, the diagonal completed."""
    rnd = np.random.default_rng(4)
    skill, n, k = np.array([0.9, 0.8, 0.6, 0.4, 0.2, 0.7]), 3000, 4
    truth = rnd.integers(0, k, n)
    votes = np.where(rnd.random((n, 6)) < skill, truth[:, None], rnd.integers(0, k, (n, 6)))
    df = spark.createDataFrame([(f"i{i}", f"r{j}", str(votes[i, j])) for i in range(n) for j in range(6)], "item string, annotator string, label string")
    got = [r.reliability for r in reliabilities(df).orderBy("annotator").collect()]
    m = np.array([[np.mean(votes[:, a] == votes[:, b]) for b in range(6)] for a in range(6)])
    h = np.array([np.bincount(votes[:, a], minlength=k) / n for a in range(6)])
    m = (m - h @ h.T) / (1 - h @ h.T)
    r = np.full(6, 0.5)
    for _ in range(200):
        np.fill_diagonal(m, r * r)
        w, v = np.linalg.eigh(m)
        r = np.abs(v[:, -1]) * np.sqrt(w[-1])
    assert np.allclose(got, r, atol=0.01) and np.allclose(got, skill, atol=0.06)


def test_many_labels_and_empty_votes(spark):
    kind = "item string, annotator string, label string"
    votes = [(f"i{i}", f"r{j}", f"label{i % 200}") for i in range(400) for j in range(4)]
    out, rel = consensus(spark.createDataFrame(votes, kind))
    assert {(r["item"], r.label) for r in out.collect()} == {(f"i{i}", f"label{i % 200}") for i in range(400)}
    out, rel = consensus(spark.createDataFrame([], kind))
    assert out.collect() == [] and rel.collect() == [] and habit_consensus(spark.createDataFrame([], kind), rel).collect() == []
    lone, rel = consensus(spark.createDataFrame([("x", "r", "a"), ("y", "s", "b")], kind), min_annotators=1)
    assert {(r["item"], r.label) for r in lone.collect()} == {("x", "a"), ("y", "b")} and {r.reliability for r in rel.collect()} == {None}


def test_shares_of_splits(spark):
    rnd = random.Random(3)
    rows = [(f"g{i}", rnd.choice(["a", "b", None]), k) for i in range(3000) for k in range(rnd.randrange(1, 5))] + [("hot", "a", k) for k in range(2500)]
    df = spark.createDataFrame(rows, "group string, label string, no int")
    s = {r.split: r for r in split_shares(assign_splits(df, ["train", "validation", "test"], [0.8, 0.1, 0.1])).collect()}
    assert abs(s["train"].share - 0.8) < 0.005 and abs(s["test"].share - 0.1) < 0.005 and abs(s["validation"].share - 0.1) < 0.005
    assert sum(r.n_rows for r in s.values()) == len(rows) and all(r.label_deviation < 0.12 for r in s.values())


def people(*rows):
    return [(f"p{i}", "c", name, role, None) for i, (name, role) in enumerate(rows)]


def run(spark, rows, persons, **kw):
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SEGMENT)
    p = spark.createDataFrame(persons, PERSON)
    out = sorted(speaker_turns(s, p, **kw).collect(), key=lambda r: (r.case_id, r.turn_no))
    starts = sorted(turn_starts(s, p, **kw).collect(), key=lambda r: (r.case_id, r.turn_no))
    assert [(r.case_id, r.turn_no, r.speaker_id, r.message_index) for r in out] == [(r.case_id, r.turn_no, r.speaker_id, r.message_index) for r in starts]
    return [(r.case_id, r.speaker_id, r.message_index) for r in out]


def test_transitions_alone_decide(spark):
    """The unnamed first message says a word that nobody uses: only who speaks before whom can tell."""
    persons = [(f"{c}_{k}", c, n, r, None) for c in "cdefgh" for k, n, r in (("o", "Opal Reed", "operator"), ("m", "Mia Noon", "management"), ("a", "Ada Quill", "analyst"))]
    rows = []
    for c in "defgh":  # analysts always follow the operator, management always analysts
        for i, who in enumerate("oamoamoam"):
            rows.append((c, i, None, "zero", f"{c}_{who}"))
    rows += [("c", 0, None, "unheard", None), ("c", 1, None, "zero", "c_a")]
    assert run(spark, rows, persons)[0] == ("c", "c_o", 0)
    rows = rows[:-1] + [("c", 1, None, "zero", "c_m")]
    assert run(spark, rows, persons)[0] == ("c", "c_a", 0)


def test_profiles_decide_between_likely_transitions(spark):
    persons = people(("Ann Bell", "management"), ("Bo Carr", "management"))
    talk = {"p0": "revenue margin cash outlook", "p1": "factory labour freight energy"}
    rows = [("c", i, None, talk[f"p{i % 2}"], f"p{i % 2}") for i in range(2, 40)]
    got = run(spark, [("c", 0, None, "freight and energy", None), ("c", 1, None, "labour", None), *rows], persons)
    assert got[0] == ("c", "p1", 0) and got[1] == ("c", "p0", 2)


def test_switching_between_named_messages(spark):
    """With a chance to switch the decoder reads unnamed runs between names too; without, they continue."""
    persons = people(("Ann Bell", "management"), ("Bo Carr", "analyst"))
    talk = {"p0": "revenue margin cash outlook " * 4, "p1": "why how what question " * 4}
    rows = [("c", i, None, talk[f"p{i % 2}"], f"p{i % 2}") for i in range(20)]
    rows += [("c", 20, None, talk["p0"], "p0"), ("c", 21, None, talk["p1"], None), ("c", 22, None, talk["p0"], None), ("c", 23, None, talk["p1"], "p1")]
    assert run(spark, rows, persons)[-2:] == [("c", "p0", 20), ("c", "p1", 23)]
    assert run(spark, rows, persons, switch=0.3)[-4:] == [("c", "p0", 20), ("c", "p1", 21), ("c", "p0", 22), ("c", "p1", 23)]


def test_long_annotations_and_labels(spark):
    persons = people(("Ann Bell", "management"), ("Bo Carr", "analyst"))
    rows = [("c", 0, None, "Words.", "p0"), ("c", 1, None, "[" + "noise " * 40 + "]", "p1"), ("c", 2, None, "Bo Carr, Head of a Very Long Named Department for Matters of Many Kinds: so we asked", None)]
    assert run(spark, rows, persons) == [("c", "p0", 0)] or run(spark, rows, persons)[-1][1] == "p1"
    assert run(spark, rows[:2], persons) == [("c", "p0", 0)]


#: Of other fields than finance, in words that are in no dictionary of the operator.
ASK = "Where do the gulls of this harbour nest once the ferries stop for the winter?"
TOLD = "They move to the cliffs behind the old mill, where it is dry and the wind is weak. "
UNSEEN = [
    ("copy", ASK, "Where do the gulls of this harbour nest once the ferries stop for the winter", "copied_question"), ("copy2", ASK, "So: " + ASK.replace("gulls", "birds"), "copied_question"),
    ("echo", ASK, ASK + " Well, " + TOLD.lower() + TOLD, None), ("part", ASK, "The gulls of this harbour nest on the cliffs behind the mill, well above the reach of any tide or fox.", None),
    ("italian", ASK, "Gli uccelli si spostano sulle rocce che sono dietro il mulino, dove non c'è il vento della costa.", "other_language"),
    ("dutch", ASK, "De vogels gaan naar de rotsen achter de molen, omdat het daar droog is en niet te veel waait.", "other_language"),
    ("russian", ASK, "Птицы улетают на скалы за старой мельницей, где сухо и почти нет ветра.", "other_language"), ("polish_name", ASK, "They move to Świnoujście, as they have for years, and they come back in the spring.", None),
    ("no", ASK, "I'd rather not say.", "refusal"), ("but", ASK, "I can't discuss the cliffs, but the birds are fine there and they come back in the spring.", None), ("cut", ASK, TOLD + "They come back when the", "truncated_answer"),
    ("none", ASK, "n/a", "empty_answer"), ("fine", ASK, TOLD, None),
]


def test_pairs_in_unseen_words(spark):
    more = [(f"f{i}", ASK, TOLD * 2 + "It is the time when the boats stop. ", None) for i in range(12)]
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in UNSEEN + more], "id string, q string, a string")
    got = {r.id: r.defect for r in broken_pairs(df, pair_id="id", prompt="q", response="a").collect()}
    assert got == {a: d for a, _, _, d in UNSEEN if d}


def test_contexts_outside_the_filter_change_nothing(spark, monkeypatch):
    """A saturated filter lets all contexts through; the join then keeps those asked for."""
    import colloquy.llm.broken_pairs as bp

    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in UNSEEN], "id string, q string, a string")
    run_ = lambda: sorted(tuple(r) for r in broken_pairs(df, pair_id="id", prompt="q", response="a").collect())
    want = run_()
    monkeypatch.setattr(bp, "FILTER_BITS", 1 << 15)
    assert run_() == want
