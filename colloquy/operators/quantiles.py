"""Exact quantiles of groups of any size.

Equal values are counted before they are shuffled. The counted values are placed in ranges of
(group, value), so that a group's values lie in order over tasks; the sums of the ranges are carried
from range to range, and the wanted ranks are found in the range that holds them. No task holds
all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import checkpoint


def exact_quantiles(df: DataFrame, group: list[str], value: str, ps: dict[str, float], *, linear: bool = False) -> DataFrame:
    """(group..., name, n, x): each quantile of ``ps`` (name -> share) by nearest rank, or linear between neighbours.

    Null and NaN values take no part; a group without values has no row."""
    v = df.select(*group, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = v.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    placed = checkpoint(counts.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy(*group, "part").agg(F.sum("c").alias("s"))
    every = Window.partitionBy(*group)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("part").alias("_p"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"), F.sum("s").over(every).alias("n"))
    on = F.col("part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    t = placed.join(sums, on).select(*group, "part", "v", "c", "offset", "n")
    w = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("upto", F.col("offset") + F.sum("c").over(w)).withColumn("from", F.col("upto") - F.col("c"))
    n = F.col("n")
    at = {k: (n - 1) * F.lit(p) if linear else F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)) for k, p in ps.items()}
    # the row that holds rank r has from <= r < upto
    holds = lambda r: (F.col("from") <= r) & (r < F.col("upto"))
    cells = F.array(*(F.struct(F.lit(k).alias("name"), a.cast("double").alias("at"), holds(F.floor(a)).alias("low"), holds(F.ceil(a)).alias("high")) for k, a in at.items()))
    hit = t.select(*group, "n", "v", F.inline(F.filter(cells, lambda x: x["low"] | x["high"])))
    g = hit.groupBy(*group, "name", "n", "at").agg(F.max(F.when(F.col("low"), F.col("v"))).alias("a"), F.max(F.when(F.col("high"), F.col("v"))).alias("z"))
    return g.select(*group, "name", "n", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("x"))


def wide(quantiles: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """One row for each group, a column for each quantile."""
    return quantiles.groupBy(*group, "n").agg(*(F.max(F.when(F.col("name") == m, F.col("x"))).alias(m) for m in names))
