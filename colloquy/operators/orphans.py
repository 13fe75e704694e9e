"""References to records that do not exist.

Keys are placed in equal ranges of their 64-bit hash. Each range keeps its parents as
arrays sorted by hash; the references of the same range are probed in one vectorised
binary search and confirmed on the key itself, so that equal hashes of different keys
do no harm. References are aggregated by (table, key, month) and parents by key before
any of it is shuffled by range, so a key that holds a large part of all rows reaches a
range as a handful of rows, and ranges stay even because distinct keys hash evenly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import checkpoint, norm_key, shuffle_partitions

#: Keys and references of a range, about.
RANGE_KEYS = 250_000
ORPHAN_SCHEMA = "from_table string, ref_key string, ref_month string, orphan_kind string, n_refs long"


def references(df: DataFrame, table: str, key: Column, created: Column) -> DataFrame:
    """References of one table, aggregated by key and month. Null and blank keys are none."""
    month = F.date_format(created, "yyyy-MM")
    return (
        df.select(norm_key(key).alias("k"), created.alias("c"), month.alias("m"))
        .where(F.col("k").isNotNull())
        .groupBy("k", "m")
        .agg(F.min("c").alias("first_ref"), F.count(F.lit(1)).alias("n_refs"))
        .select(F.lit(table).alias("from_table"), "k", "m", "first_ref", "n_refs")
    )


def parents(df: DataFrame, key: Column, created: Column, deleted: Column) -> DataFrame:
    """One row per parent key: its earliest creation and whether all its rows are deleted."""
    return (
        df.select(norm_key(key).alias("k"), created.alias("c"), deleted.isNotNull().alias("d"))
        .where(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.min("c").alias("created"), F.min("d").alias("deleted"))
    )


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: parents of a range, right: references of the range."""
    h = left["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    h = h[order]
    keys = left["k"].take(pa.array(order)).combine_chunks() if len(h) else pa.array([], pa.string())
    created = left["created_us"].to_numpy()[order]
    deleted = left["deleted"].to_numpy()[order]
    rh = right["h"].to_numpy()
    rk = right["k"].combine_chunks() if right.num_rows else pa.array([], pa.string())
    at = np.full(len(rh), -1)
    lo, hi = np.searchsorted(h, rh, "left"), np.searchsorted(h, rh, "right")
    step = 0
    while True:  # one pass; more only where different keys share a hash
        todo = np.flatnonzero((at < 0) & (lo + step < hi))
        if not len(todo):
            break
        cand = lo[todo] + step
        same = pc.equal(keys.take(pa.array(cand)), rk.take(pa.array(todo))).to_numpy(zero_copy_only=False)
        at[todo[same]] = cand[same]
        step += 1
    found = at >= 0
    kind = np.full(len(rh), "", dtype=object)
    kind[~found] = "missing"
    if len(h):
        i = np.where(found, at, 0)
        gone = found & deleted[i].astype(bool)
        none = np.iinfo(np.int64).min
        first = right["first_us"].to_numpy()
        late = found & ~gone & (created[i] != none) & (first != none) & (created[i] > first)
        kind[gone] = "deleted"
        kind[late] = "late"
    bad = pa.array(np.flatnonzero(kind != ""))
    out = right.take(bad)
    return pa.table(
        {
            "from_table": out["from_table"],
            "ref_key": out["k"],
            "ref_month": out["m"],
            "orphan_kind": pa.array(kind[kind != ""], pa.string()),
            "n_refs": out["n_refs"],
        }
    )


def orphan_references(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """Each failing (table, key, month) of ``refs`` (see references()) with the way it fails.

    missing: no parent row has the key. deleted: all its rows are deleted. late: not
    deleted, but the earliest creation lies after the first reference of the month.
    References or parents without a time are never late; an empty parent table makes
    every reference missing; an empty reference table gives an empty result. n_refs
    counts the references of the key in the month.
    """
    spark = refs.sparkSession
    refs, parent = checkpoint(refs), checkpoint(parent)
    # a range is one task's: as many as its keys ask for, and some for each task
    ranges = max(4 * shuffle_partitions(spark), -(-(refs.count() + parent.count()) // RANGE_KEYS))
    bits = max(4, (ranges - 1).bit_length())
    none = F.lit(int(np.iinfo(np.int64).min))
    us = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), none)
    h = F.xxhash64("k")
    rng = F.shiftrightunsigned(h, 64 - bits).alias("rng")
    left = parent.select(rng, h.alias("h"), "k", us("created").alias("created_us"), "deleted")
    right = refs.select(rng, h.alias("h"), "from_table", "k", "m", us("first_ref").alias("first_us"), "n_refs")
    return left.groupBy("rng").cogroup(right.groupBy("rng")).applyInArrow(_probe, ORPHAN_SCHEMA)


def orphan_report(orphans: list[DataFrame]) -> DataFrame:
    """Failing keys and their references by table, month and kind."""
    every = reduce(DataFrame.unionByName, orphans)
    return every.groupBy("from_table", "ref_month", "orphan_kind").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs")
    )
