"""Quotations in texts: many pairs at once give what each gives alone."""

from __future__ import annotations

import random
import time

from colloquy.operators import evidence as E
from colloquy.plans import extra

_WORDS = "we expect net sales of $12.5 million in the third quarter margin was 4% higher Ärger ſtock İs straße growth demand outlook".split()
_TAILS = [".", "!", "?", ".\n", " ", ".  "]


def _sentence(rnd: random.Random, most: int = 16) -> str:
    return " ".join(rnd.choice(_WORDS) for _ in range(rnd.randint(1, most))) + rnd.choice(_TAILS)


def _group(seed: int, n_quotes: int, n_texts: int) -> tuple[list, list]:
    rnd = random.Random(seed)
    pool = [_sentence(rnd) for _ in range(40)] + [_sentence(rnd, 220) for _ in range(2)]
    texts = [" ".join(rnd.choice(pool) if rnd.random() < 0.5 else _sentence(rnd) for _ in range(rnd.randint(0, 9))) for _ in range(n_texts - 3)] + [None, "", " \n"]
    quotes: list = [None, "", "  ", "a b", "12.5"]
    while len(quotes) < n_quotes:
        q = list(rnd.choice(pool))
        for _ in range(rnd.choice([0, 0, 3, 12])):
            q[rnd.randrange(len(q))] = rnd.choice("abc $K漢þ")
        q = "".join(q)
        quotes.append(rnd.choice([q, q.upper(), q.replace(" ", "\n "), q[: len(q) // 2]]))
    return quotes, texts


def test_pairs_of_groups_equal_single_ones():
    groups = [_group(1, 60, 40), ([None], ["x"]), _group(2, 30, 10), (["one two three four."], [None])]
    seen = set()
    for (quotes, texts), found in zip(groups, E.find_quotes(groups), strict=True):
        for i, q in enumerate(quotes):
            for j, t in enumerate(texts):
                s, a, b = (int(m[i, j]) for m in found)
                one = E.find_quote(t, q)
                assert (E.STATUSES[s], a if a >= 0 else None, b if b >= 0 else None) == (one["status"], one["start"], one["end"]), (q, t)
                seen.add(one["status"])
    assert seen == set(E.STATUSES)


def test_likeness_is_that_of_sequence_matcher():
    rnd = random.Random(5)
    draw = lambda: "".join(rnd.choice(rnd.choice(["ab", "abc ", "aéþÿ", "ab漢"])) for _ in range(rnd.choice([0, 1, 30, 120, 199, 230])))
    a, b = [draw() for _ in range(300)], [draw() for _ in range(300)]
    assert E.likenesses(a, b).tolist() == [E.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


def test_keys_are_dealt_out_in_blocks(spark, monkeypatch):
    quotes, texts = _group(3, 25, 30)
    monkeypatch.setattr(E, "QUOTES", 4)
    monkeypatch.setattr(E, "TEXTS", 5)
    q = spark.createDataFrame([("k", i, x) for i, x in enumerate(quotes)] + [("other", 99, "alone here.")], "key string, quote_id long, quote string")
    t = spark.createDataFrame([("k", i, x) for i, x in enumerate(texts)], "key string, text_id long, text string")
    got = sorted(map(tuple, E.quote_spans(q, t).collect()))
    assert got == sorted((i, j, *E.find_quote(y, x).values()) for i, x in enumerate(quotes) for j, y in enumerate(texts))


def test_evidence_spans_compares_many_pairs_at_once(spark, tmp_path):
    rnd = random.Random(7)
    line = lambda: " ".join(rnd.choice(_WORDS[:17]) for _ in range(rnd.randint(8, 20))) + "."
    labels = [(i, "AB" if i % 2 else " ab ", ["2020-01-02", "02 Jan 2020", "2021/01/02", None][i % 4], line()) for i in range(400)]
    docs = [(i, "ab", 2020 + i % 3, " ".join(line() for _ in range(10))) for i in range(600)]
    spark.createDataFrame(labels, "label_row_id long, ticker string, event_date string, evidence_text string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(docs, "doc_id long, ticker string, fiscal_year int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {(r[0], r[1]): tuple(r)[2:] for r in extra.evidence_spans(spark, str(tmp_path)).collect()}
    took, began = time.time() - began, time.time()
    pairs = [(i, d, q, t) for i, _, day, q in labels for d, _, year, t in docs if day and str(year) in day]
    assert len(got) == len(pairs) == 60_000
    for i, d, q, t in rnd.sample(pairs, 200):
        assert got[i, d] == tuple(E.find_quote(t, E.re.match(r"[^.!?]+[.!?]", q)[0]).values())
    # four cores that take the pairs one at a time need twice that
    assert took < (time.time() - began) / 200 * len(pairs) / 8
