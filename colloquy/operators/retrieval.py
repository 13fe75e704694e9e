"""Inverted index, BM25, hash embeddings, nearest neighbours and their evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import hash_bucket, hash_sign
from colloquy.runtime import salted_join

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, ts: Column) -> DataFrame:
    """(doc, token, tf): one row for each token of a document, counted before it is shuffled."""
    return docs.select(doc, F.explode(ts).alias("token")).groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


#: Tokens of queries that are sent to the tasks; more are joined.
SENT_TOKENS = 200_000


def bm25(docs: DataFrame, queries: DataFrame, *, doc: str, query: str, ts: Column, k: int, context: list[str] | None = None) -> DataFrame:
    """(query, doc, score, rank): the ``k`` best documents of each query.

    queries: (query, token), a repeated token counts repeatedly. With ``context``, columns of both
    sides, a query searches only the documents that equal it there, and counts and lengths are
    those of these documents; null is a context of its own. The postings are cut down to the
    tokens of the queries. Documents of equal score rank by id; documents without a token of the
    query are no hits; empty documents count for the average length. Few query tokens (counted)
    go to the tasks, more are joined with hot tokens dealt out: the same rows either way.
    """
    ctx = context or []
    # nulls of a context are equal; tokens are made before the generator, which would make them again for each of its rows
    norm = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_x{i}") for i, c in enumerate(ctx)]
    xs = [f"_x{i}" for i in range(len(ctx))]
    read = docs.select(doc, *norm, ts.alias("ts")).select(doc, *xs, "ts", F.size("ts").alias("len"))
    stats = read.groupBy(*xs).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    asked = queries.groupBy(query, *norm, "token").agg(F.count(F.lit(1)).alias("qtf"))
    few = asked.limit(SENT_TOKENS + 1).count() <= SENT_TOKENS
    small = F.broadcast if few else (lambda df: df)
    words = small(asked.select("token", *xs).distinct())
    p = read.select(doc, *xs, "len", F.explode("ts").alias("token")).join(words, ["token", *xs], "left_semi")
    p = p.groupBy(doc, *xs, "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("token", *xs).agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    joined = df.join(stats, xs) if xs else df.join(F.broadcast(stats))
    weighed = asked.join(joined.select("token", *xs, idf.alias("idf"), "avgdl"), ["token", *xs])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    hits = p.join(small(weighed), ["token", *xs]) if few else salted_join(p, weighed, ["token", *xs])
    hits = hits.groupBy(query, doc).agg(F.sum(part).alias("score")).where("score > 0").withColumn("score", F.round("score", 6))
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, doc, "score", "rank")


def shared_shingles(docs: DataFrame, items: DataFrame, *, doc: str, item: str, words: int = 8, least: int = 3) -> DataFrame:
    """(item, doc): texts that share at least ``least`` different runs of ``words`` tokens. docs: (doc, ts); items: (item, ts)."""
    runs = lambda df, i: df.where(F.size("ts") >= words).select(i, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ts") - words + 1), lambda j: F.xxhash64(F.array_join(F.slice("ts", j, words), " "))))).alias("h"))
    both = runs(docs, doc).join(runs(items, item), "h").groupBy(item, doc).agg(F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") >= least).select(item, doc)


def hash_embedding(posts: DataFrame, doc: str, dimensions: int) -> DataFrame:
    """(doc, bucket, value): feature-hashed counts with signs, of unit length. Sparse rows."""
    v = posts.groupBy(doc, hash_bucket(F.col("token"), dimensions).alias("bucket")).agg(F.sum(F.col("tf") * hash_sign(F.col("token"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(doc)))
    return v.where("v <> 0").withColumn("norm", norm).select(doc, "bucket", (F.col("v") / F.col("norm")).alias("value"))


#: Vectors of a batch of rows, and of a batch of queries.
ROW_BATCH, QUERY_BATCH = 4096, 1024


def _pack(size: int):
    """(id, v) -> batches (width, ids, flat) of unit vectors of equal length."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array(v, np.float64)
                norm = np.linalg.norm(x)
                if not len(x) or not np.isfinite(norm) or norm == 0:
                    continue
                rows = held.setdefault(len(x), [])
                rows.append((i, x / norm))
                if len(rows) == size:
                    yield _packed(len(x), held.pop(len(x)))
        for width, rows in held.items():
            yield _packed(width, rows)

    return run


def _packed(width: int, rows: list) -> pa.RecordBatch:
    ids = pa.array([[i for i, _ in rows]], pa.list_(pa.int64()))
    flat = pa.array([np.concatenate([x for _, x in rows])], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), ids, flat], names=["width", "ids", "flat"])


def nearest_vectors(vectors: DataFrame, *, row: str, vector: str, k: int, every: int = 100) -> DataFrame:
    """Exact cosine neighbours of every ``every``-th row among all rows: (row, neighbour, similarity, rank).

    Rows are scanned once and packed into batches, the stated set of queries likewise; each batch of
    rows meets each batch of queries in one matrix product, which leaves it as at most ``k`` rows for
    each query. Nothing goes through the driver. Equal similarities (to six places) rank by id.
    Null and zero vectors take no part; rows of other lengths than a query's are no neighbours of it.
    """
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(row).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    kind = "width int, ids array<long>, flat array<double>"
    rows = v.mapInArrow(_pack(ROW_BATCH), kind)
    asked = v.where(F.col("id") % every == 0).repartition(1).mapInArrow(_pack(QUERY_BATCH), kind)
    asked = asked.select(F.col("width").alias("qw"), F.col("ids").alias("qids"), F.col("flat").alias("qflat"))

    def best(ids: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Positions of the k highest, equal ones by id."""
        near = np.flatnonzero(sim >= np.partition(sim, -k)[-k]) if len(sim) > k else np.arange(len(sim))
        near = near[np.isfinite(sim[near])]
        return near[np.lexsort((ids[near], -sim[near]))][:k]

    def run(batches):
        for b in batches:
            for width, ids, flat, qids, qflat in zip(*(b.column(c).to_pylist() for c in ("width", "ids", "flat", "qids", "qflat"))):
                ids, qids = np.array(ids), np.array(qids)
                sims = np.round(np.array(flat).reshape(-1, width) @ np.array(qflat).reshape(-1, width).T, 6)
                sims[ids[:, None] == qids[None, :]] = -np.inf
                at = [best(ids, sims[:, c]) for c in range(len(qids))]
                n = [len(x) for x in at]
                pos = np.concatenate(at)
                cols = [np.repeat(qids, n), ids[pos], sims[pos, np.repeat(np.arange(len(qids)), n)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["q", "neighbour", "similarity"])

    pairs = rows.join(asked, F.col("width") == F.col("qw")).select("width", "ids", "flat", "qids", "qflat")
    sim = pairs.mapInArrow(run, "q long, neighbour long, similarity double")
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour")
    top = sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(row), "neighbour", "similarity", "rank")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, *, query: str, doc: str, at: list[int]) -> DataFrame:
    """Recall at each cut and mean reciprocal rank of the first relevant hit, over the queries of ``relevant``."""
    hit = relevant.join(ranked, [query, doc], "left").groupBy(query).agg(F.min("rank").alias("first"))
    return hit.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *(F.round(F.avg(F.coalesce(F.col("first") <= n, F.lit(False)).cast("int")), 4).alias(f"recall_at_{n}") for n in at),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


def outcomes(queries: DataFrame, ranked: DataFrame, expected: DataFrame, *, query: str, doc: str) -> DataFrame:
    """(query, n_expected, n_returned, first_rank, abstained): first_rank is that of the first expected document, 0 for none."""
    hit = ranked.join(expected, [query, doc]).groupBy(query).agg(F.min("rank").alias("first"))
    n = lambda df, name: df.groupBy(query).agg(F.count(F.lit(1)).alias(name))
    j = queries.join(n(expected, "e"), query, "left").join(n(ranked, "r"), query, "left").join(hit, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(query, zero("e").alias("n_expected"), zero("r").alias("n_returned"), zero("first").alias("first_rank"), F.col("r").isNull().alias("abstained"))


def outcome_rates(out: DataFrame) -> DataFrame:
    """Recall at 1, 3 and 5, mean reciprocal rank and hit rate of the queries that expect a document, and how far
    queries that expect none abstain. A rate without queries is null, of abstention 0."""
    some = F.col("n_expected") > 0
    share = lambda cond: F.round(F.avg(F.when(some, cond.cast("int"))), 4)
    first = F.col("first_rank")
    return out.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(some).alias("n_expecting"), *(share(first.between(1, k)).alias(f"recall_at_{k}") for k in (1, 3, 5)),
        F.round(F.avg(F.when(some, F.when(first > 0, 1 / first).otherwise(0.0))), 4).alias("mrr"), share(first > 0).alias("hit_rate"),
        F.count_if("abstained").alias("n_abstained"), F.round(F.coalesce(F.avg(F.when(~some, F.col("abstained").cast("int"))), F.lit(0.0)), 4).alias("abstention_correctness"),
    )
