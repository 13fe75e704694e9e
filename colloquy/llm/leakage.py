"""Evaluation passages inside training texts, by winnowing.

Words are hashed, k-grams of words are hashed from these, and of every window of
``span - k + 1`` consecutive k-grams the one with the least hash is kept. Any run of
``span`` words that two texts share has the same windows in both, so it shares a kept
k-gram: no such run is missed. Shared k-grams are then extended word by word in both
directions, and a run counts from ``span`` words on; this is compared on the words.

The fingerprints of the passages are joined with those of the corpus in one of two ways
with the same result. Passages under ``broadcast_bytes`` of text (checked) are sent to
every task, which probes its fingerprints in a sorted array and extends hits on the spot:
a map over the scan without any shuffle. Larger sets are joined by hash, and texts with
hits are joined in again to be extended.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import salted_join

#: Soft hyphen and zero-width characters, dropped before words are read.
INVISIBLE = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None}
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Words per k-gram.
K = 8
MEMO_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits after dropping invisible characters, NFKC and lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    return WORD.findall(text.lower())


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> list[int]:
        memo, out = self.memo, []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in ws:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return out


def fingerprints(word_hashes: np.ndarray, doc: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept (position, hash) of texts laid end to end; doc names the text of each word.
    No k-gram and no window reaches over the end of a text. The last of equal least hashes is kept."""
    n = len(word_hashes)
    if n < k + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            g = g * _MULTIPLIER + word_hashes[i : n - k + 1 + i]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
    inside = doc[: n - k - window + 2] == doc[k + window - 2 :]
    best, at = g[: n - k - window + 2].copy(), np.arange(n - k - window + 2)
    for i in range(1, window):
        nxt = g[i : n - k - window + 2 + i]
        less = nxt <= best
        best[less] = nxt[less]
        at[less] = np.flatnonzero(less) + i
    at = np.unique(at[inside])
    return at, g[at]


def common_run(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int]:
    """Start in a and length of the run of equal words around a[i] = b[j]."""
    s = 0
    while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1]:
        s += 1
    e = 0
    while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
        e += 1
    return i - s, s + e


def _flat(texts: list[str | None], hasher: Hasher) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    ws = [words(t) if t else [] for t in texts]
    lens = np.array([len(w) for w in ws], np.int64)
    flat = np.array([h for w in ws for h in hasher(w)], np.uint64)
    return ws, flat, np.repeat(np.arange(len(ws)), lens), np.concatenate([[0], np.cumsum(lens)])


def _extend(found: Iterator[tuple[int, int, int, int]], ws: list[list[str]], items: list[list[str]], span: int) -> dict[tuple[int, int], int]:
    """(doc, position, item, position) -> longest shared run of each (doc, item) with at least span words."""
    best: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int, int], int] = {}
    for d, p, q, r in found:
        diagonal = (d, q, p - r)
        if p < seen.get(diagonal, -1):
            continue
        start, length = common_run(ws[d], p, items[q], r)
        seen[diagonal] = start + length
        if length >= span and length > best.get((d, q), 0):
            best[d, q] = length
    return best


def _print_batches(id_column: str, span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            _, flat, doc, starts = _flat(b.column(1).to_pylist(), hasher)
            at, h = fingerprints(flat, doc, k, span - k + 1)
            d = doc[at] if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d)), pa.array(h.view(np.int64)), pa.array((at - starts[d]).astype(np.int32))],
                names=[id_column, "h", "pos"],
            )

    return run


def _probe_broadcast(spark, corpus, items, doc_id, item_id, span, k):
    ids, texts = [], []
    for r in items.collect():  # its size is checked by the caller
        ids.append(r[0])
        texts.append(r[1])
    ws, flat, doc, starts = _flat(texts, Hasher())
    at, h = fingerprints(flat, doc, k, span - k + 1)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    item = doc[at] if len(at) else np.empty(0, np.int64)
    sent = spark.sparkContext.broadcast((ids, ws, h, item, at - starts[item]))
    kinds = dict(corpus.dtypes), dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, keys, item, item_pos = sent.value
        hasher = Hasher()
        for whole in batches:
            for o in range(0, whole.num_rows, 500):
                b = whole.slice(o, 500)
                ws, flat, doc, starts = _flat(b.column(1).to_pylist(), hasher)
                at, h = fingerprints(flat, doc, k, span - k + 1)
                lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                hit = np.flatnonzero(lo < hi)
                found = (
                    (int(doc[at[x]]), int(at[x] - starts[doc[at[x]]]), int(item[y]), int(item_pos[y]))
                    for x in hit
                    for y in range(lo[x], hi[x])
                )
                best = _extend(found, ws, item_words, span)
                if best:
                    d, q = zip(*best)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), pa.array([ids[x] for x in q]), pa.array(list(best.values()), pa.int32())],
                        names=[doc_id, item_id, "n_words"],
                    )

    schema = f"`{doc_id}` {kinds[0][doc_id]}, `{item_id}` {kinds[1][item_id]}, n_words int"
    return corpus.mapInArrow(run, schema)


def _probe_join(corpus, items, doc_id, item_id, span, k):
    kinds = dict(corpus.dtypes), dict(items.dtypes)
    print_of = lambda df, i, kind: df.mapInArrow(_print_batches(i, span, k), f"`{i}` {kind}, h long, pos int")
    mine = print_of(corpus, doc_id, kinds[0][doc_id])
    theirs = print_of(items, item_id, kinds[1][item_id]).withColumnRenamed("pos", "item_pos")
    both = salted_join(mine, theirs, ["h"])  # a common print may hold a large part of all
    # one hit of a diagonal for each k words: hits nearer than k lie in the same run
    near = both.groupBy(doc_id, item_id, (F.col("pos") - F.col("item_pos")).alias("d"), F.floor(F.col("pos") / k)).agg(F.min("pos").alias("pos"))
    hits = near.groupBy(doc_id, item_id).agg(F.collect_list(F.struct("pos", (F.col("pos") - F.col("d")).alias("item_pos"))).alias("hits"))
    d, q = corpus.columns[1], items.columns[1]
    full = hits.join(corpus.withColumnRenamed(d, "_text"), doc_id).join(items.withColumnRenamed(q, "_item"), item_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n = [], []
            for i, (t, q, hs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                found = sorted((0, h["pos"], 0, h["item_pos"]) for h in hs)
                for length in _extend(iter(found), [words(t)], [words(q)], span).values():
                    keep.append(i)
                    n.append(length)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32())], names=[doc_id, item_id, "n_words"])

    schema = f"`{doc_id}` {kinds[0][doc_id]}, `{item_id}` {kinds[1][item_id]}, n_words int"
    return full.select(doc_id, item_id, "_text", "_item", "hits").mapInArrow(run, schema)


def leaked_passages(
    corpus: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    span: int = 16,
    k: int = K,
    broadcast_bytes: int = 32_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_words): each document and item that share at least ``span``
    consecutive words, with the longest such run.

    Null and empty texts and texts of fewer than ``span`` words have no such run. Repeated
    rows and copies come out once for each id; an empty table gives an empty result; other
    columns are ignored. Whole texts are read.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    c = corpus.select(F.col(doc_id), F.col(doc_text))
    q = items.select(F.col(item_id), F.col(item_text))
    size = q.agg(F.sum(F.octet_length(item_text)).alias("n")).head()["n"] or 0
    if size <= broadcast_bytes:
        out = _probe_broadcast(c.sparkSession, c, q, doc_id, item_id, span, k)
    else:
        out = _probe_join(c, q, doc_id, item_id, span, k)
    return out.groupBy(doc_id, item_id).agg(F.max("n_words").alias("n_words"))
