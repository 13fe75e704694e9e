"""Consensus from several annotators' labels.

The agreement of two annotators, centred on what their label habits give by chance, is about
the product of their reliabilities, so the reliabilities are the leading eigenvector of that
matrix. Its entries are corrected for overlap counts: an entry is shrunk by how few items the
two share, and rows are scaled to the number of partners an annotator would have if all shared
enough. The diagonal, which no data give, is the square of the reliability found so far. The
eigenvector is found by power iteration, each step one join of the sparse matrix with the
vector, until it moves no more.

The reliabilities weight the votes: an annotator of reliability r gives the true label with
chance r and else one at random by its frequency, and each item gets the likeliest of the
labels voted for it.

``habit_consensus`` is an operator of its own for annotators who take one label for another,
which one number each can't express: from the spectral weights on, it estimates which label
each gives for which true one, and votes again with that.

An item's votes are at most one per annotator. Pairs of annotators are counted as matrix
products in each batch of items, in tiles of annotators, and leave a task already summed.
Labels are rows throughout, so that any number of them will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import checkpoint, norm_key, salted_join

#: Power steps between checkpoints; rounds of them at most; movement of an entry that ends the iteration.
STEPS, ROUNDS, STILL = 3, 8, 2e-3
#: Shared items at which an entry of the matrix counts half.
OVERLAP = 8.0
#: Items and annotators whose counts are one matrix product; bounds a task's memory.
ITEM_TILE, ANNOTATOR_TILE = 4096, 1024
#: Reliabilities are taken to lie in these bounds when they weight votes; that of an annotator who shares no item with another.
BOUNDS, UNKNOWN = (0.0, 0.97), 0.5
#: Votes' worth of trust in the one reliability when label habits are estimated, and rounds of that.
SMOOTHING, REFINEMENTS = 12.0, 2
#: Share of a label's votes from which on another label counts as one it is commonly given for.
COMMON = 0.01


def norm_label(c: Column) -> Column:
    """Lower case with underscores; blank is null."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")
    return F.when(t != "", t)


def latest_votes(df: DataFrame, *, item: str, annotator: str, labels: str, time: str, row_id: str) -> DataFrame:
    """(item, annotator, label): the latest vote of an annotator on an item.

    A null array or one of blanks only is no vote. Of several different labels in one
    vote the first counts. Equal times go to the larger row id; an unreadable time is the
    earliest.
    """
    label = F.get(F.filter(F.transform(F.col(labels), norm_label), lambda x: x.isNotNull()), 0)
    v = df.select(
        norm_key(F.col(item)).alias("item"),
        norm_key(F.col(annotator)).alias("annotator"),
        label.alias("label"),
        F.struct(F.col(time).try_cast("timestamp").alias("t"), F.col(row_id).alias("r")).alias("at"),
    ).where("item is not null and annotator is not null and label is not null")
    return v.groupBy("item", "annotator").agg(F.max(F.struct("at", "label")).alias("m")).select("item", "annotator", F.col("m.label").alias("label"))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their lists of votes -> (a, b, same, both), a < b, summed over each tile."""
    for whole in batches:
        for o in range(0, whole.num_rows, ITEM_TILE):
            lists = whole.column(0).slice(o, ITEM_TILE)
            flat, lens = lists.flatten(), lists.value_lengths().to_numpy()
            item = np.repeat(np.arange(len(lens)), lens)
            names, who = np.unique(flat.field("annotator").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            _, what = np.unique(flat.field("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            tiles = range(0, len(names), ANNOTATOR_TILE)

            def votes(tile: int, k: int | None = None) -> np.ndarray:
                mine = (who >= tile) & (who < tile + ANNOTATOR_TILE) & (True if k is None else what == k)
                m = np.zeros((len(lens), min(ANNOTATOR_TILE, len(names) - tile)), np.float32)
                m[item[mine], who[mine] - tile] = 1
                return m

            for x in tiles:
                for y in (t for t in tiles if t >= x):
                    both = votes(x).T @ votes(y)
                    same = sum((votes(x, k).T @ votes(y, k) for k in range(what.max() + 1)), np.zeros_like(both)) if len(what) else both
                    a, b = np.nonzero(both)
                    keep = a + x < b + y
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a + x], pa.string()), pa.array(names[b + y], pa.string()), pa.array(same[a, b], pa.float64()), pa.array(both[a, b], pa.float64())],
                        names=["a", "b", "same", "both"],
                    )


def agreement_matrix(votes: DataFrame) -> DataFrame:
    """(a, b, m): the chance-centred agreement of every two annotators who share items, both ways
    round, corrected for overlap counts."""
    items = votes.groupBy("item").agg(F.collect_list(F.struct("annotator", "label")).alias("votes")).where(F.size("votes") > 1)
    pairs = items.select("votes").mapInArrow(_count_pairs, "a string, b string, same double, both double")
    pairs = pairs.groupBy("a", "b").agg(F.sum("same").alias("same"), F.sum("both").alias("both"))
    counts = votes.groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    habits = counts.groupBy("annotator").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("h"))
    side = lambda x: habits.select(F.col("annotator").alias(x), F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}"))
    chance = F.aggregate(F.map_entries("ha"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("hb", e["key"]), F.lit(0)))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("chance", chance / F.col("na") / F.col("nb"))
    centred = (F.col("same") / F.col("both") - F.col("chance")) / F.greatest(1 - F.col("chance"), F.lit(0.05))
    half = pairs.select("a", "b", centred.alias("m"), (F.col("both") / (F.col("both") + OVERLAP)).alias("s"))
    full = checkpoint(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "m", "s")))
    seen = full.groupBy("a").agg(F.sum("s").alias("t"))
    others = full.agg((F.count_distinct("a") - 1).alias("others"))
    e = full.join(seen, "a").join(seen.select(F.col("a").alias("b"), F.col("t").alias("u")), "b").join(F.broadcast(others))
    return e.select("a", "b", F.expr("m * s * others / sqrt(t * u)").alias("m"))


def reliabilities(votes: DataFrame) -> DataFrame:
    """(annotator, reliability, n_votes); reliability is about 1 for no errors, 0 for chance,
    and null for an annotator who shares no item with another."""
    totals = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_votes"))
    matrix = checkpoint(agreement_matrix(votes))
    vec = matrix.groupBy(F.col("a").alias("i")).agg(F.sqrt(F.greatest(F.avg("m"), F.lit(0.01))).alias("r"))
    for _ in range(ROUNDS):
        before = vec = checkpoint(vec)
        # r_i squared stands for the missing diagonal
        full = matrix.unionByName(vec.select(F.col("i").alias("a"), F.col("i").alias("b"), F.expr("r * r").alias("m")))
        x = vec.withColumnRenamed("r", "x")
        for _ in range(STEPS):
            x = full.join(x.withColumnRenamed("i", "b"), "b").groupBy(F.col("a").alias("i")).agg(F.sum(F.expr("m * x")).alias("x"))
        x = x.join(before, "i")
        # the length of r is that for which r r' is nearest to the matrix
        size = x.agg(F.sqrt(F.sum(F.expr("x * x"))).alias("norm"), F.sum(F.expr("x * r")).alias("along"), F.sum(F.expr("r * r")).alias("rr"))
        value = F.pow(F.greatest(F.col("along") / F.col("rr"), F.lit(1e-9)), 1 / STEPS)
        vec = x.join(F.broadcast(size)).select("i", (F.col("x") / F.col("norm") * F.sqrt(value)).alias("r"))
        vec = checkpoint(vec)
        if (vec.join(before.withColumnRenamed("r", "q"), "i").agg(F.max(F.abs(F.col("r") - F.col("q")))).head()[0] or 0.0) < STILL:
            break
    sign = vec.agg(F.signum(F.sum("r")).alias("sign"))
    vec = vec.join(F.broadcast(sign)).select("i", (F.col("r") * F.col("sign")).alias("r"))
    return totals.join(vec, totals["annotator"] == vec["i"], "left").select("annotator", F.when(F.col("r").isNotNull(), F.least("r", F.lit(1.0))).alias("reliability"), "n_votes")


#: Rows of a table of annotators and labels that are sent to the tasks; more are joined.
SENT_ROWS = 200_000


def _with_table(big: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a table of annotators and labels: few rows (counted) go to the tasks, more are joined with hot keys dealt
    out; the same rows either way."""
    table = checkpoint(table)
    if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return big.join(F.broadcast(table), keys)
    return salted_join(big, table, keys)


def _weighed(votes: DataFrame, rel: DataFrame) -> DataFrame:
    """votes with r, the bounded reliability of the annotator, and p, the frequency of the label."""
    r = F.least(F.greatest(F.coalesce("reliability", F.lit(UNKNOWN)), F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))
    used = votes.groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    freq = used.groupBy("label").agg(F.sum("n").alias("n"))
    freq = freq.join(F.broadcast(freq.agg(F.sum("n").alias("all")))).select("label", (F.col("n") / F.col("all")).alias("p"))
    used = used.drop("n").join(rel.select("annotator", r.alias("r")), "annotator").join(freq, "label")
    return _with_table(votes, used, ["annotator", "label"])


def _decide(per: DataFrame, min_annotators: int) -> DataFrame:
    """per: (item, label, s, n): score and votes of each label voted for an item."""
    best = F.min(F.struct((-F.round("s", 9)).alias("s"), "label", "n"))
    out = per.groupBy("item").agg(best.alias("b"), F.sum("n").alias("size"), F.sum(F.expr("n * (n - 1)")).alias("same")).where(F.col("size") >= min_annotators)
    size = F.col("size")
    agreement = F.when(size > 1, F.col("same") / (size * (size - 1)))
    return out.select("item", "b.label", size.cast("int").alias("n_votes"), agreement.alias("agreement"), (F.col("b.n") / size).alias("vote_share"))


def consensus(votes: DataFrame, *, min_annotators: int = 3) -> tuple[DataFrame, DataFrame]:
    """votes: (item, annotator, label), one vote each (see latest_votes).

    Returns (item, label, n_votes, agreement, vote_share) for items with votes of at least
    ``min_annotators``, and (annotator, reliability, n_votes). agreement is the share of
    pairs of votes that agree, vote_share that of votes for the consensus. Equal scores go
    to the label first in order. An annotator without shared items counts with a
    reliability of 0.5; no votes give empty results.
    """
    votes = checkpoint(votes.select("item", "annotator", "label").distinct())
    rel = checkpoint(reliabilities(votes))
    # how much likelier a vote is under its own label than under any other, and the frequency of that
    w = F.log(1 + F.col("r") / ((1 - F.col("r")) * F.col("p")))
    per = _weighed(votes, rel).groupBy("item", "label").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.first("p").alias("p"))
    return _decide(per.select("item", "label", (F.col("w") + F.log("p")).alias("s"), "n"), min_annotators), rel


def habit_consensus(votes: DataFrame, rel: DataFrame, *, min_annotators: int = 3) -> DataFrame:
    """The same columns as consensus(), by label habits.

    rel: (annotator, reliability) of consensus(), the start and what habits are smoothed
    towards. Each round reads every vote under each label its item may have (those voted for it and
    those for which these are commonly given), with the chance that its annotator gives this
    label for that one, and counts the habits anew by how likely each label is. Ties and empty tables as there.
    """
    votes = checkpoint(_weighed(votes.select("item", "annotator", "label").distinct(), rel).repartition("item"))
    freq = votes.groupBy(F.col("label").alias("truth")).agg(F.log(F.first("p")).alias("prior"))
    voted = votes.groupBy("item", F.col("label").alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    cell, item, each = ["annotator", "label", "truth"], Window.partitionBy("item"), Window.partitionBy("item", "truth")

    def readings(candidates: DataFrame) -> DataFrame:
        """Every vote under every candidate of its item, with its chance by the one reliability."""
        base = (1 - F.col("r")) * F.col("p") + F.when(F.col("label") == F.col("truth"), F.col("r")).otherwise(0.0)
        read = _with_table(votes.join(candidates, "item"), freq, ["truth"])
        return read.select("item", "annotator", "label", "truth", "n", "prior", base.alias("q"))

    def cells(logs: DataFrame) -> DataFrame:
        """(annotator, label, truth, c, q): how often each label was given for each truth."""
        x = logs.withColumns({"s": F.sum("l").over(each) + F.col("prior"), "k": F.count(F.lit(1)).over(each)})
        x = x.withColumn("x", F.exp(F.col("s") - F.max("s").over(item)))
        # an item's candidates have a row for each of its k votes
        chance = F.col("x") * F.col("k") / F.sum("x").over(item)
        return checkpoint(x.withColumn("c", chance).groupBy(*cell).agg(F.sum("c").alias("c"), F.first("q").alias("q")))

    first_logs = lambda read: read.withColumn("l", F.log(F.greatest("q", F.lit(1e-6))))
    taken = cells(first_logs(readings(voted))).groupBy("label", "truth").agg(F.sum("c").alias("c"))
    taken = taken.withColumn("all", F.sum("c").over(Window.partitionBy("label"))).where(F.col("c") >= COMMON * F.col("all"))
    implied = voted.withColumnRenamed("truth", "label").join(taken.select("label", "truth"), "label").select("item", "truth", F.lit(0).cast("long").alias("n"))
    read = checkpoint(readings(voted.unionByName(implied).groupBy("item", "truth").agg(F.max("n").alias("n"))).repartition("item"))
    logs = first_logs(read)
    for _ in range(REFINEMENTS):
        seen = cells(logs).withColumn("all", F.sum("c").over(Window.partitionBy("annotator", "truth")))
        habit = seen.select(*cell, F.log(F.greatest((F.col("c") + SMOOTHING * F.col("q")) / (F.col("all") + SMOOTHING), F.lit(1e-6))).alias("l"))
        logs = _with_table(read, habit, cell)
    scores = logs.groupBy("item", "truth").agg((F.sum("l") + F.first("prior")).alias("s"), F.first("n").alias("n"))
    return _decide(scores.withColumnRenamed("truth", "label"), min_annotators)
