"""Operators on labels: evaluation, agreement, calibration, merging, queues, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import share


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Dense counts of every (truth, predicted) pair of the given labels, zeros included."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} string, {predicted} string")
    n = df.where(F.col(truth).isin(labels) & F.col(predicted).isin(labels)).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, [truth, predicted], "left").fillna(0, ["n"])


def precision_recall(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1); 0 where a ratio has no denominator."""
    c = confusion(df, truth, predicted, labels)
    each = c.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), truth, predicted, "n")
    g = each.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when((F.col(truth) == F.col(predicted)) & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col(truth) != F.col(predicted)) & (F.col("x.p") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col(truth) != F.col(predicted)) & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement in percent, kappa) of two label columns; kappa is 0 where chance is certain."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c + "_n"))
    chance = one(a).join(one(b), "label").agg(F.sum(F.col(a + "_n") * F.col(b + "_n")).alias("chance"))
    tot = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same")).join(F.broadcast(chance))
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0)) / F.col("n") / F.col("n")
    return tot.select("n", F.round(po * 100, 4).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(0.0), 4).alias("kappa"))


def calibration(df: DataFrame, score: str, positive: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins on [0, 1], 1.0 in the last, empty bins included: (bin, n, avg_score, positive_rate)."""
    spark = df.sparkSession
    ok = df.where(F.col(score).between(0, 1) & ~F.isnan(score)).select(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin"), score, positive.cast("int").alias("y"))
    g = ok.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("avg_score"), F.round(F.avg("y"), 4).alias("positive_rate"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").fillna(0, ["n"])


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """merge: all keys, the latest new row wins; origin says where a row is from."""
    e = existing.withColumns({"origin": F.lit("existing"), "_p": F.lit(0)})
    n = new.withColumns({"origin": F.lit("new"), "_p": F.lit(1)})
    return keep_first(e.unionByName(n), [key], [F.desc("_p"), F.desc(order)]).drop("_p")


def append(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key does not exist yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def majority(votes: Column) -> Column:
    """The most frequent entry of a short array, the first of equal ones; null for none."""
    v = F.filter(votes, lambda x: x.isNotNull())
    counts = F.transform(v, lambda x, i: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-i).alias("o"), x.alias("x")))
    return F.array_max(counts)["x"]
