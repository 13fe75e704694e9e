"""Queues for review: quotas, caps that work together, balanced batches, samples, merges of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """Adds rank from 1 in the given order; with ``limit`` the first rows only (a top-k report).

    Without a limit ranks come from a range partition: counts of partitions are carried, no task sorts all rows."""
    if limit is not None:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    t = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    n = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return t.join(F.broadcast(n), "_p").withColumn("rank", (F.col("_o") + F.col("_r")).cast("int")).drop("_p", "_r", "_o")


def seeded(seed: int, *ids: str) -> Column:
    """A repeatable random order: the SHA-256 of seed and ids."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)), 256)


def round_robin(df: DataFrame, bucket: str, order: list[Column]) -> DataFrame:
    """Adds turn: the place of a row in its bucket; ordered by turn and bucket, buckets take turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def capped(df: DataFrame, *, caps: dict[str, tuple[list[Column], int]], order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows in order, at most so many for each key of every cap, and at most ``limit`` in all.

    A cap's count runs over the rows that the caps before it let through, so the caps are given from the
    narrowest on; a row that a cap refuses frees no place of another."""
    t = df
    for name, (keys, most) in caps.items():
        k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        t = t.withColumn(f"_{name}", k).where(F.col(f"_{name}") <= most).drop(f"_{name}")
    return t if limit is None else t.orderBy(*order).limit(limit)


def balanced_batch(df: DataFrame, *, key: str, label: str, order: list[Column], per_label: int = 3, per_key: int = 12) -> DataFrame:
    """For each key the first ``per_label`` rows of each label, filled up to ``per_key`` with the next ones; picked says how."""
    t = df.withColumn("_l", F.row_number().over(Window.partitionBy(key, label).orderBy(*order)))
    first = (F.col("_l") <= per_label).cast("int")
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(first), *order)))
    return t.where(F.col("_k") <= per_key).withColumn("picked", F.when(F.col("_l") <= per_label, "quota").otherwise("fill")).drop("_l", "_k")


def quota_then_fill(df: DataFrame, *, label: str, fits: Column, order: list[Column], quota: int, limit: int) -> DataFrame:
    """Up to ``quota`` fitting rows of each label, then the best of the rest, ``limit`` in all, in order."""
    ok = F.coalesce(fits, F.lit(False))
    t = df.withColumn("_ok", ok).withColumn("_l", F.when(ok, F.row_number().over(Window.partitionBy(label, "_ok").orderBy(*order))))
    t = t.withColumn("_q", (F.col("_l") <= quota) & F.col("_ok"))
    chosen = t.orderBy(F.desc(F.coalesce("_q", F.lit(False)).cast("int")), *order).limit(limit)
    return chosen.drop("_ok", "_l", "_q").withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def calibration_batch(df: DataFrame, *, row_id: str, label: str, quotas: dict[str, int], order: list[Column], unsure: Column, n_unsure: int) -> DataFrame:
    """The first rows of each label by its quota, and of all others those of which one is least sure, each row once."""
    q = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    t = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    mine = t.where(F.col("_r") <= F.coalesce(F.try_element_at(q, F.col(label)), F.lit(0))).drop("_r").withColumn("bucket", F.col(label))
    rest = df.join(mine.select(row_id), row_id, "left_anti").orderBy(unsure, row_id).limit(n_unsure).withColumn("bucket", F.lit("unsure"))
    return mine.unionByName(rest)


def merge_sources(sources: list[DataFrame], existing: DataFrame, *, row_id: str, keys: list[str], valid: Column, order: str) -> DataFrame:
    """Rows of all sources in order with state: imported, invalid, duplicate_id or duplicate_content against ``existing``
    and what was imported before. keys: the columns that make the content. Null keys are equal."""
    every = reduce(DataFrame.unionByName, (s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)))
    every = every.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    content = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)
    at = [F.col("_s"), F.col(order)]
    old_ids = existing.select(F.col(row_id)).distinct().withColumn("_old", F.lit(True))
    old_keys = existing.select(content.alias("_c")).distinct().withColumn("_oldc", F.lit(True))
    t = every.withColumn("_c", content).join(old_ids, row_id, "left").join(old_keys, "_c", "left")
    t = t.withColumn("_id", F.row_number().over(Window.partitionBy(row_id, "_ok").orderBy(*at)))
    t = t.withColumn("_fresh", F.col("_ok") & F.col("_old").isNull() & (F.col("_id") == 1))
    t = t.withColumn("_cn", F.row_number().over(Window.partitionBy("_c", "_fresh").orderBy(*at)))
    state = F.when(~F.col("_ok"), "invalid").when(~F.col("_fresh"), "duplicate_id").when(F.col("_oldc").isNotNull() | (F.col("_cn") > 1), "duplicate_content").otherwise("imported")
    return t.withColumn("state", state).drop("_s", "_ok", "_c", "_old", "_oldc", "_id", "_fresh", "_cn")


def update_rows(current: DataFrame, updates: DataFrame, *, key: str, fixed: list[str], changing: list[str]) -> DataFrame:
    """current with the changing fields of its update, and what speaks against it: missing or unexpected rows, repeated
    keys, changed fixed fields. Every row of either side comes out once for each key."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n), *(F.first(c).alias(f"_{n}_{c}") for c in [*fixed, *changing]))
    j = count(current, "a").join(count(updates, "b"), key, "full_outer")
    moved = F.array_compact(F.array(*(F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in fixed))) if fixed else F.array().cast("array<string>")
    error = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when((F.col("a") > 1) | (F.col("b") > 1), "repeated")
        .when(F.size(moved) > 0, F.concat(F.lit("changed:"), F.array_join(moved, ",")))
    )
    ok = error.isNull()
    return j.select(key, *(F.col(f"_a_{c}").alias(c) for c in fixed), *(F.when(ok, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in changing), error.alias("error"))


def take_until(candidates: DataFrame, existing: DataFrame, *, key: str, order: list[Column], fits: Column, need: int) -> DataFrame:
    """The first ``need`` fitting candidates in order whose key does not exist yet; repeated keys count once."""
    t = candidates.where(F.coalesce(fits, F.lit(False))).join(existing.select(key).distinct(), key, "left_anti")
    t = t.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
    return ranked(t, order, need)
