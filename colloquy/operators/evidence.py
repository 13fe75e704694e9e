"""Where a quotation stands in a text: exactly, with other white space, or nearly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import shuffle_partitions

SPAN = "struct<status:string,start:int,end:int>"
_WORDS = re.compile(r"[a-z0-9$%]+")
_TOKENS = re.compile(r"[a-z0-9]+")
#: Characters of a quotation and of a window whose likeness is measured.
LIKENESS_CHARS = 1200
#: Likeness from which a window is nearly the quotation.
LEAST = 0.72
#: Quotations and texts of one key that a task holds at once, pairs that are compared at once, and pairs and
#: characters from which small keys are no longer put together.
QUOTES, TEXTS, PAIRS, BUNDLE_PAIRS, BUNDLE_CHARS = 1024, 256, 8192, 50_000, 2_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def spaced(quote: str) -> re.Pattern | None:
    """A pattern for the quotation with any white space between its words, without letter case."""
    ws = quote.split()
    return re.compile(r"\s+".join(map(re.escape, ws)), re.I) if ws else None


def sentence_cuts(text: str) -> list[int]:
    """Where the sentences of a text start, and its end."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    return [0, *ends] + ([len(text)] if not ends or ends[-1] < len(text) else [])


def nearly(text: str, quote: str, least: float = LEAST) -> tuple[int, int] | None:
    """The window of one to four sentences most like the quotation: the larger of the share of its words and the likeness of
    the sequence. Quotations of fewer than four different words are never nearly found."""
    want = " ".join(quote.lower().split())
    words = set(_WORDS.findall(want))
    if len(words) < 4:
        return None
    cuts = sentence_cuts(text)
    best, at = 0.0, None
    for i in range(len(cuts) - 1):
        for j in range(i + 1, min(i + 5, len(cuts))):
            have = " ".join(text[cuts[i] : cuts[j]].lower().split())
            mine = set(_WORDS.findall(have))
            if not mine:
                continue
            share = len(words & mine) / len(words)
            s = SequenceMatcher(None, want[:LIKENESS_CHARS], have[:LIKENESS_CHARS])
            if share < 1 and s.real_quick_ratio() > max(best, share) and s.quick_ratio() > max(best, share):
                share = max(share, s.ratio())
            if share > best:
                best, at = share, (cuts[i], cuts[j])
    return at if best >= least else None


def find_quote(text: str | None, quote: str | None) -> dict:
    """exact, normalized or fuzzy with start and end, or not_found; missing without a text or quotation."""
    if not text or not quote or not quote.strip():
        return {"status": "missing", "start": None, "end": None}
    at = text.find(quote)
    if at >= 0:
        return {"status": "exact", "start": at, "end": at + len(quote)}
    if m := spaced(quote).search(text):
        return {"status": "normalized", "start": m.start(), "end": m.end()}
    if span := nearly(text, quote):
        return {"status": "fuzzy", "start": span[0], "end": span[1]}
    return {"status": "not_found", "start": None, "end": None}


def quote_span(text: Column, quote: Column) -> Column:
    """Struct (status, start, end) of a quotation in a text; Arrow batches, whole texts."""

    @F.pandas_udf(SPAN)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, q in batches:
            yield pd.DataFrame([find_quote(a, b) for a, b in zip(t, q)], columns=["status", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    return run(text, quote)


def folded(text: str) -> str:
    """Equal for all that spaced() takes as equal: without letter case, single spaces."""
    return " ".join(text.replace("İ", "i").lower().upper().split())


#: Classes of characters for bounds: letters each, digits, the rest in four.
_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 if 48 <= c <= 57 else 27 if c == 32 else 28 + c % 4 for c in range(128)], np.int64)


def _codes(texts: list[str]) -> list[np.ndarray]:
    """A code under 128 for each character. Different ones may share a code, which can only raise a bound."""
    return [np.frombuffer(t.encode("latin-1", "replace"), np.uint8) & 127 for t in texts]


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, i repeated n[i] times, beside first[i], first[i] + 1, ..."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n - first, n)


class _Quotes:
    """Quotations, with what is compared of them."""

    def __init__(self, quotes: list[str]):
        self.want = [" ".join(q.lower().split()) for q in quotes]
        sets = [set(_WORDS.findall(w)) for w in self.want]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for s in sets for x in s))}
        self.n_words = np.array([len(s) for s in sets], np.int64)
        self.bits = self.words(sets)
        self.head = [w[:LIKENESS_CHARS] for w in self.want]
        codes = _codes(self.head)
        self.n = np.array([len(c) for c in codes], np.int64)
        self.classes = _histograms(codes)
        # of each quotation, code and 64 characters: where the code stands
        self.blocks = (self.n + 63) // 64
        self.at = np.zeros((int(self.blocks.max(initial=1)), len(quotes) * 128), np.uint64)
        for q, c in enumerate(codes):
            i = np.arange(len(c))
            np.bitwise_or.at(self.at, (i // 64, q * 128 + c.astype(np.int64)), np.uint64(1) << (i % 64).astype(np.uint64))

    def words(self, sets: list[set[str]]) -> np.ndarray:
        """The words of quotations in each set, as bits."""
        bits = np.zeros((len(sets), max(1, -(-len(self.vocabulary) // 64)) * 64), np.uint8)
        for i, s in enumerate(sets):
            if ks := [k for w in s if (k := self.vocabulary.get(w)) is not None]:
                bits[i, ks] = 1
        return np.packbits(bits, axis=1).view(np.uint64)


def _histograms(codes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(codes), 32), np.int16)
    for i, c in enumerate(codes):
        out[i] = np.bincount(_CLASS[c], minlength=32)
    return out


class _Texts:
    """Texts by sentences: windows of one to four by where they start, and those short enough to be like a quotation."""

    def __init__(self, texts: list[str], quotes: _Quotes):
        longest = quotes.n.max(initial=0)
        most = LIKENESS_CHARS if longest * (2 / LEAST - 1) >= LIKENESS_CHARS else int(longest * (2 / LEAST - 1)) + 1
        self.cuts = [sentence_cuts(t) for t in texts]
        sets: list[set[str]] = []
        heads: list[str] = []
        spans: list[tuple[int, int]] = []
        self.n_starts, self.n_windows = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for d, (text, cuts) in enumerate(zip(texts, self.cuts)):
            parts = [" ".join(text[a:b].lower().split()) for a, b in zip(cuts, cuts[1:])]
            own = [set(_WORDS.findall(p)) for p in parts]
            self.n_starts[d], before = len(parts), len(heads)
            sets += own
            for i in range(len(parts)):
                head, words = "", False
                for j in range(i, min(i + 4, len(parts))):
                    head, words = f"{head} {parts[j]}" if head and parts[j] else head or parts[j], words or bool(own[j])
                    if len(head) > most and most < LIKENESS_CHARS:
                        break
                    if words:
                        heads.append(head[:LIKENESS_CHARS])
                        spans.append((i, j + 1))
            self.n_windows[d] = len(heads) - before
        self.first_start, self.first_window = np.cumsum(self.n_starts) - self.n_starts, np.cumsum(self.n_windows) - self.n_windows
        # words of the windows of 1, 2, 3 and 4 sentences (as many as there are) from each start, and of the texts
        one = quotes.words(sets)
        last = np.repeat(self.first_start + self.n_starts, self.n_starts) - 1
        self.words = [one]
        for k in range(1, 4):
            after = np.minimum(np.arange(len(sets)) + k, last)
            self.words.append(self.words[-1] | one[after] if len(sets) else one)
        self.all_words = np.bitwise_or.reduceat(one, self.first_start, axis=0) if len(sets) else one
        self.heads, self.spans = heads, spans
        codes = _codes(heads)
        self.n = np.array([len(c) for c in codes], np.int64)
        self.classes = _histograms(codes)
        codes_at = np.zeros((len(codes), int(self.n.max(initial=0))), np.uint8)
        for i, c in enumerate(codes):
            codes_at[i, : len(c)] = c
        self.codes = np.ascontiguousarray(codes_at.T)


def _common(quotes: _Quotes, texts: _Texts, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of quotations q and windows w, bit by bit for many pairs at once.

    The blocks that SequenceMatcher matches are one, so this is a bound for them."""
    out = np.zeros(len(q), np.int64)
    # by quotation within windows of about one length, so that little of the tables is looked up at a time
    order = np.lexsort((q, texts.n[w] // 16, quotes.blocks[q]))
    for part in np.split(order, np.flatnonzero(np.diff(quotes.blocks[q][order])) + 1):
        blocks = int(quotes.blocks[q[part[0]]]) if len(part) else 0
        for k in range(0, len(part), 4096):
            at = part[k : k + 4096]
            base, win = q[at] * 128, w[at]
            i, u, s = np.empty(len(at), np.int64), np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
            rows = np.full((blocks, len(at)), ~np.uint64(0))
            for j in range(int(texts.n[win].max())):
                np.add(base, texts.codes[j].take(win), out=i)
                carry = None
                for b in range(blocks):
                    v = rows[b]
                    # indices are within bounds; this mode needs no buffer
                    quotes.at[b].take(i, out=u, mode="clip")
                    u &= v
                    np.add(v, u, out=s)
                    over = s < v if b + 1 < blocks else None
                    if carry is not None:
                        s += carry
                        if over is not None:
                            over |= s < carry
                    carry = over
                    v -= u
                    v |= s
            out[at] = 64 * blocks - np.bitwise_count(rows).sum(0, dtype=np.int64)
    return out


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, size) of the longest common run of each column, the first in a, then in b. Fewer than 255 rows."""
    run, after, size = np.zeros(b.shape, np.uint8), np.ones(b.shape, np.uint8), np.zeros(b.shape[1], np.uint8)
    at_a, at_b = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for i in range(len(a)):
        np.add(run[:-1], np.uint8(1), out=after[1:])
        after[0] = 1
        after *= (b == a[i]).view(np.uint8)
        run, after = after, run
        top = run.max(0)
        if len(up := np.flatnonzero(top > size)):
            size[up] = top[up]
            at_a[up], at_b[up] = i, run[:, up].argmax(0)
    n = size.astype(np.int64)
    return at_a - n + 1, at_b - n + 1, n


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """SequenceMatcher's ratio() of each pair, its blocks found for many pairs at once.

    Where SequenceMatcher takes frequent characters as junk (from 200 on) and for characters beyond Latin-1 it measures itself."""
    out = np.zeros(len(a))
    plain = np.array([len(x) < 200 and len(y) < 200 and max(x + y, default=" ") < "þ" for x, y in zip(a, b)], bool)
    for k in np.flatnonzero(~plain):
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    left = np.flatnonzero(plain)
    for first in range(0, len(left), 20_000):
        part = left[first : first + 20_000]
        # two codes that no character has end the rows
        rows = []
        for xs, end in ((a, 254), (b, 255)):
            m = np.full((len(part), max(len(xs[k]) for k in part) + 1), end, np.uint8)
            for i, k in enumerate(part):
                m[i, : len(xs[k])] = np.frombuffer(xs[k].encode("latin-1"), np.uint8)
            rows.append(m)
        n_a, n_b = (np.array([len(xs[k]) for k in part], np.int64) for xs in (a, b))
        found = np.zeros(len(part), np.int64)
        todo = np.stack([np.arange(len(part)), 0 * n_a, n_a, 0 * n_b, n_b])
        while todo.shape[1]:
            todo = todo[:, np.lexsort((todo[4] - todo[3], todo[2] - todo[1]))]
            more = []
            for k in range(0, todo.shape[1], 1024):
                i, a0, a1, b0, b1 = todo[:, k : k + 1024]
                sides = []
                for m, lo, hi in ((rows[0], a0, a1), (rows[1], b0, b1)):
                    at = lo + np.arange(int((hi - lo).max()))[:, None]
                    sides.append(np.where(at < hi, m[i, np.minimum(at, m.shape[1] - 1)], m[0, -1]))
                x, y, n = _longest(*sides)
                x, y, hit = a0 + x, b0 + y, n > 0
                np.add.at(found, i, n)
                more += [np.stack([i, a0, x, b0, y])[:, hit], np.stack([i, x + n, a1, y + n, b1])[:, hit]]
            todo = np.concatenate(more, axis=1)
            todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
        total = n_a + n_b
        out[part] = np.where(total > 0, 2.0 * found / np.maximum(total, 1), 1.0)
    return out


def _shares(quotes: _Quotes, words: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(quotes.bits[q] & words[at]).sum(1, dtype=np.int64)
    return n / quotes.n_words[q]


def nearly_all(quotes: _Quotes, texts: _Texts, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) as by nearly() for pairs of quotations q and texts d, -1 where there are none.

    A window counts from LEAST on. Words of all sentences of a text, then of the four from a start, bound the shares of
    words; lengths, characters and common subsequences bound the likeness, which is measured where they leave it open."""
    start, end = np.full(len(q), -1, np.int64), np.full(len(q), -1, np.int64)
    some = np.flatnonzero((quotes.n_words[q] >= 4) & (texts.n_starts[d] > 0))
    share = np.zeros(len(q))
    span: dict[int, tuple[int, int]] = {}
    may = some[_shares(quotes, texts.all_words, q[some], d[some]) >= LEAST]
    if len(may):
        of, at = _ranges(texts.first_start[d[may]], texts.n_starts[d[may]])
        s = _shares(quotes, texts.words[3], q[may][of], at)
        n = texts.n_starts[d[may]]
        most = np.maximum.reduceat(s, np.cumsum(n) - n)
        hit = np.flatnonzero(s == most[of])
        _, first = np.unique(of[hit], return_index=True)
        at = at[hit[first]]
        keep = most >= LEAST
        may, at, most = may[keep], at[keep], most[keep]
        share[may] = most
        size = np.full(len(may), 4)
        for k in (2, 1, 0):
            size[_shares(quotes, texts.words[k], q[may], at) == most] = k + 1
        i = at - texts.first_start[d[may]]
        j = np.minimum(i + size, texts.n_starts[d[may]])
        span = dict(zip(may.tolist(), zip(i.tolist(), j.tolist())))
    of, w = _ranges(texts.first_window[d[some]], texts.n_windows[d[some]])
    p = some[of]
    for bound in (
        lambda x, y: np.minimum(quotes.n[x], texts.n[y]),
        lambda x, y: np.minimum(quotes.classes[x], texts.classes[y]) .sum(1, dtype=np.int16),
        lambda x, y: _common(quotes, texts, x, y),
    ):
        # a likeness as high as the share of words counts where its window comes first
        open_ = 2.0 * bound(q[p], w) / (quotes.n[q[p]] + texts.n[w]) >= np.maximum(share[p], LEAST)
        p, w = p[open_], w[open_]
    best: dict[int, tuple[float, int, int]] = {}
    likeness = likenesses([quotes.head[x] for x in q[p]], [texts.heads[x] for x in w])
    for k, x, r in zip(p.tolist(), w.tolist(), likeness.tolist()):
        if r >= LEAST and r > best.get(k, (0.0,))[0]:
            best[k] = (r, *texts.spans[x])
    for k, (r, i, j) in best.items():
        if r > share[k] or r == share[k] and (i, j) < span[k]:
            span[k] = (i, j)
    for k, (i, j) in span.items():
        cuts = texts.cuts[d[k]]
        start[k], end[k] = cuts[i], cuts[j]
    return start, end


STATUSES = ["missing", "exact", "normalized", "fuzzy", "not_found"]


def find_quotes(groups: list[tuple[list[str | None], list[str | None]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """find_quote() of each quotation in each text of its group: (status as a place in STATUSES, start, end) of each
    group, by quotation and text; -1 for null."""
    qs: dict[str, int] = {}
    ts: dict[str, int] = {}
    for quotes, texts in groups:
        for x in quotes:
            if x and x.strip():
                qs.setdefault(x, len(qs))
        for x in texts:
            if x:
                ts.setdefault(x, len(ts))
    all_q, all_t = list(qs), list(ts)
    forms = [folded(x) for x in all_q]
    made = _Quotes(all_q)
    read = _Texts(all_t, made)
    flat = [folded(x) for x in all_t]
    for quotes, texts in groups:
        mine = list(dict.fromkeys(qs[x] for x in quotes if x in qs))
        here = list(dict.fromkeys(ts[x] for x in texts if x in ts))
        status = np.full((len(mine) + 1, len(here) + 1), STATUSES.index("not_found"), np.int8)
        start, end = np.full(status.shape, -1, np.int64), np.full(status.shape, -1, np.int64)
        status[-1], status[:, -1] = 0, 0
        # one string of all texts: no form holds a line end
        joined = "\n".join(flat[t] for t in here)
        begins = np.cumsum([0, *(len(flat[t]) + 1 for t in here)])
        for i, x in enumerate(mine):
            at = joined.find(forms[x])
            while at >= 0:
                k = int(np.searchsorted(begins, at, "right")) - 1
                text = all_t[here[k]]
                if (a := text.find(all_q[x])) >= 0:
                    status[i, k], start[i, k], end[i, k] = 1, a, a + len(all_q[x])
                elif m := spaced(all_q[x]).search(text):
                    status[i, k], start[i, k], end[i, k] = 2, m.start(), m.end()
                at = joined.find(forms[x], int(begins[k + 1]))
        qi, di = np.nonzero(status == STATUSES.index("not_found"))
        mine_at, here_at = np.array(mine, np.int64), np.array(here, np.int64)
        for k in range(0, len(qi), PAIRS):
            a, b = qi[k : k + PAIRS], di[k : k + PAIRS]
            s, e = nearly_all(made, read, mine_at[a], here_at[b])
            start[a, b], end[a, b] = s, e
            status[a[s >= 0], b[s >= 0]] = STATUSES.index("fuzzy")
        row, col = {x: i for i, x in enumerate(mine)}, {x: i for i, x in enumerate(here)}
        rows = [row[qs[x]] if x in qs else -1 for x in quotes]
        cols = [col[ts[x]] if x in ts else -1 for x in texts]
        yield tuple(m[np.ix_(rows, cols)] for m in (status, start, end))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, key, b, qb, side, id, text) -> (quote_id, text_id, status, start, end): side 0 are the quotations of a key, side 1 its texts."""
    names = pa.array(STATUSES)

    def null(x: np.ndarray) -> pa.Array:
        return pa.array(x, pa.int32(), mask=x < 0)

    def flush(groups: list) -> Iterator[pa.RecordBatch]:
        for (qs, ds), found in zip(groups, find_quotes([([x for _, x in qs], [x for _, x in ds]) for qs, ds in groups])):
            status, start, end = (x.ravel() for x in found)
            q, d = (x.ravel() for x in np.meshgrid(np.arange(len(qs)), np.arange(len(ds)), indexing="ij"))
            q_ids, d_ids = pa.array([x for x, _ in qs], pa.int64()), pa.array([x for x, _ in ds], pa.int64())
            for k in range(0, len(status), 65_536):
                part = slice(k, k + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(q[part])), d_ids.take(pa.array(d[part])), names.take(pa.array(status[part])), null(start[part]), null(end[part])],
                    names=["quote_id", "text_id", "status", "start", "end"],
                )

    key, groups, pairs, chars = None, [], 0, 0
    for b in batches:
        for *k, side, i, text in zip(*(b.column(c).to_pylist() for c in range(7))):
            if k != key:
                if groups and not all(groups[-1]):
                    groups.pop()
                pairs += len(groups[-1][0]) * len(groups[-1][1]) if groups else 0
                if pairs > BUNDLE_PAIRS or chars > BUNDLE_CHARS:
                    yield from flush(groups)
                    groups, pairs, chars = [], 0, 0
                key = k
                groups.append(([], []))
            groups[-1][side].append((i, text))
            chars += len(text or "")
    yield from flush([g for g in groups if all(g)])


def quote_spans(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id, status, start, end) as by find_quote() of each quotation in each text of its key.

    quotes: (key, quote_id, quote), texts: (key, text_id, text). Keys with many rows on either side are dealt
    out in blocks of about QUOTES times TEXTS, so that no task holds a key as a whole."""
    n = quotes.groupBy("key").agg(F.count(F.lit(1)).alias("nq")).join(texts.groupBy("key").agg(F.count(F.lit(1)).alias("nt")), "key")
    n = n.select("key", F.ceil(F.col("nq") / QUOTES).cast("int").alias("nq"), F.ceil(F.col("nt") / TEXTS).cast("int").alias("nt"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    q = quotes.join(n, "key").withColumn("qb", deal("quote_id", "nq")).withColumn("b", every("nt"))
    t = texts.join(n, "key").withColumn("b", deal("text_id", "nt")).withColumn("qb", every("nq"))
    h = F.xxhash64("key", "b", "qb").alias("h")
    rows = q.select(h, "key", "b", "qb", F.lit(0).alias("side"), F.col("quote_id").cast("long").alias("id"), F.col("quote").alias("text")).unionByName(
        t.select(h, "key", "b", "qb", F.lit(1).alias("side"), F.col("text_id").cast("long").alias("id"), "text")
    )
    # as many parts as asked for: rows are few beside the pairs that they make
    rows = rows.repartition(4 * shuffle_partitions(rows.sparkSession), "h").sortWithinPartitions("h", "key", "b", "qb", "side")
    return rows.mapInArrow(_spans, "quote_id long, text_id long, status string, start int, end int")


def best_window(heard: str | None, text: str | None, width: int = 6000, stride: int = 1500) -> dict:
    """The window of a text most like what was heard: 0.7 of the Jaccard of words and 0.3 of the likeness of their first 400."""
    if not (heard or "").strip() or not (text or "").strip():
        return {"score": 0.0, "start": 0, "end": 0}
    mine = _TOKENS.findall(heard[:width].lower())
    want, head = set(mine), " ".join(mine[:400])
    best = {"score": 0.0, "start": 0, "end": min(len(text), width)}
    for start in range(0, max(1, len(text) - width + 1), stride):
        end = min(len(text), start + width)
        ws = _TOKENS.findall(text[start:end].lower())
        union = want | set(ws)
        share = len(want & set(ws)) / len(union) if want and ws else 0.0
        if 0.7 * share + 0.3 <= best["score"]:
            continue
        score = 0.7 * share + 0.3 * SequenceMatcher(None, head, " ".join(ws[:400])).ratio()
        if score > best["score"]:
            best = {"score": score, "start": start, "end": end}
    return best


def window_score(heard: Column, text: Column, width: int = 6000, stride: int = 1500) -> Column:
    """Struct (score, start, end) of best_window(); Arrow batches."""

    @F.pandas_udf("struct<score:double,start:int,end:int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([best_window(x, y, width, stride) for x, y in zip(a, b)], columns=["score", "start", "end"])

    return run(heard, text)
