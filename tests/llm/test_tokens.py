import random

import pytest
from tokenizers import Tokenizer

from colloquy.llm.pieces import split_oversized, split_text
from colloquy.llm.tokenizer import TOKENIZERS, VOCABULARY, automaton, compile_merges, encode_texts


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{TOKENIZERS}/{VOCABULARY}")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(4)
    parts = ["a", "b", "th", "e", "ing", " ", "  ", "\n", "é", "漢字", "😀", "0", "99", "_", "--", "​", "'s", "aaaa", "<|endoftext|>", "\t", "ß"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    return out + [c * k for c in "a= \n" for k in range(1, 130)]


def test_automaton_equals_merges(reference):
    a, texts = automaton(), odd_texts()
    a_ids = [a.encode(t) for t in texts]
    assert a_ids == reference(texts)
    assert [a.decode(i) for i in a_ids] == texts


def test_gadgets_of_a_small_vocabulary():
    vocab = {"a": 0, "b": 1, "aa": 2, "aab": 3, "ab": 4}
    a = compile_merges(vocab, [["a", "a"], ["a", "b"], ["aa", "b"]])
    ids = lambda t: a.encode_word(t.encode())
    assert ids("aaa") == [2, 0] and ids("aaaa") == [2, 2] and ids("ab") == [4]
    assert ids("aab") == [3] and ids("aaab") == [2, 4] and ids("") == []


def test_encode_texts(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, "", 5), (3, None, 5), (4, "  \n", 5), (4, "  \n", 5)], "doc_id long, text string, ids long")
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect())
    hello, blank = reference(["Hello world", "  \n"])
    assert got == [(1, hello), (2, []), (3, []), (4, blank), (4, blank)]
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []


def pieces_hold(text, limit, overlap):
    a = automaton()
    ps = split_text(text, limit, overlap, a)
    if len(a.encode(text)) <= limit:
        return ps == ([(0, len(text), len(a.encode(text)))] if text else [])
    assert len(ps) > 1 and ps[0][0] == 0 and ps[-1][1] == len(text)
    assert all(n == len(a.encode(text[s:e])) <= limit for s, e, n in ps)
    assert all(s < s2 <= e < e2 for (s, e, _), (s2, e2, _) in zip(ps, ps[1:]))
    return True


def test_pieces_cover_and_fit():
    rnd = random.Random(2)
    prose = " ".join(f"Sentence number {i} says {rnd.choice(['much', 'little', 'nothing'])}." for i in range(600))
    texts = ["", "short", prose, prose.replace(". ", ".\n\n"), "x" * 9000, "漢字" * 3000, " " * 5000, "\n" * 5000, "a b " * 3000]
    texts.append("".join(rnd.choice("abcdef0123456789_-=+/") for _ in range(9000)))
    assert all(pieces_hold(t, limit, overlap) for t in texts for limit, overlap in ((256, 16), (1024, 64)))


def test_pieces_end_at_boundaries_and_share_about_the_overlap():
    a = automaton()
    prose = " ".join(f"Sentence number {i} says nothing new." for i in range(900))
    ps = split_text(prose, 512, 64, a)
    assert all(prose[e - 1] == "." for _, e, _ in ps)
    shared = [len(a.encode(prose[s2:e])) for (_, e, _), (s2, _, _) in zip(ps, ps[1:])]
    assert all(32 <= n <= 96 for n in shared)
    paragraphs = "\n\n".join(" ".join(["word"] * 150) for _ in range(20))
    assert all(paragraphs[e - 2 : e] == "\n\n" for _, e, _ in split_text(paragraphs, 512, 64, a)[:-1])


def test_split_oversized(spark):
    long = "one two three four. " * 400
    df = spark.createDataFrame([(1, long, "z"), (2, "short", "z"), (3, None, "z"), (4, "", "z"), (1, long, "z")], "doc_id long, text string, piece_no string")
    out = split_oversized(df, "doc_id", "text").collect()
    assert {r.doc_id for r in out} == {1} and len(out) == 2 * max(r.piece_no for r in out)
    small = split_oversized(df, "doc_id", "text", keep_small=True).collect()
    assert {r.doc_id for r in small} == {1, 2}
    assert split_oversized(df.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        split_oversized(df, "doc_id", "text", limit=64, overlap=64)
