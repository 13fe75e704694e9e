"""Pairing records with the nearest record in time of the same entity.

Every right-hand time becomes the interval of times to which it is nearest: bounded by
the midpoints to its neighbours and by the tolerance. A left-hand time then falls into
at most one interval, so the range join needs no aggregation after it. Intervals are at
most two tolerances long; they are indexed by (entity, bucket of two tolerances), which
also spreads an entity that holds a large part of all rows over its time line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.runtime import norm_key

#: Neighbours are looked up in blocks of this many tolerances, with a halo of two.
BLOCK_TOLERANCES = 64


def _micros(c: Column) -> Column:
    """Whole microseconds of seconds in a double; null, NaN and infinite give null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 9e11), F.round(d * 1e6).cast("long"))


def nearest_intervals(right: DataFrame, tolerance_us: int) -> DataFrame:
    """right: (e, t, rid), t in microseconds. Adds lo2 and hi2: the inclusive bounds, in
    half microseconds, of the times nearest to each distinct (e, t); equally near ones go
    to the smaller rid. Only neighbours within two tolerances matter, so the look-up runs
    in blocks of time, each with the rows of a halo around it."""
    r = right.groupBy("e", "t").agg(F.min("rid").alias("rid"))
    size, halo = BLOCK_TOLERANCES * max(tolerance_us, 1), 2 * tolerance_us
    own = F.floor(F.col("t") / F.lit(size))
    blocks = F.array_distinct(F.array(own, F.floor((F.col("t") - halo) / F.lit(size)), F.floor((F.col("t") + halo) / F.lit(size))))
    r = r.select("e", "t", "rid", own.alias("own"), F.explode(blocks).alias("block"))
    w = Window.partitionBy("e", "block").orderBy("t")
    r = r.select(
        "*",
        *(f("t").over(w).alias(f"{n}_t") for f, n in ((F.lag, "p"), (F.lead, "n"))),
        *(f("rid").over(w).alias(f"{n}_rid") for f, n in ((F.lag, "p"), (F.lead, "n"))),
    ).where(F.col("block") == F.col("own"))
    lo_mid = F.col("p_t") + F.col("t") + F.when(F.col("rid") < F.col("p_rid"), 0).otherwise(1)
    hi_mid = F.col("t") + F.col("n_t") - F.when(F.col("rid") < F.col("n_rid"), 0).otherwise(1)
    return r.select(
        "e",
        "t",
        "rid",
        F.greatest(2 * (F.col("t") - tolerance_us), lo_mid).alias("lo2"),
        F.least(2 * (F.col("t") + tolerance_us), hi_mid).alias("hi2"),
    )


def nearest_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    left_entity: str,
    left_time: str,
    right_id: str,
    right_entity: str,
    right_time: str,
    tolerance_s: float,
) -> DataFrame:
    """(left_id, right_id, gap_s) for each left row with a right row of its entity at most
    ``tolerance_s`` away in time; the nearest one, of equally near ones the smallest id.

    Entities are compared trimmed and without letter case. Rows with a null entity, or a
    null, NaN or infinite time take no part; left rows without a partner are left out; a
    left row delivered twice comes out once. Other columns, whatever their names, are
    ignored. Empty tables give an empty result. Times are compared in whole microseconds.
    """
    tol = round(tolerance_s * 1e6)
    a = left.select(
        F.col(left_id).alias("lid"), norm_key(F.col(left_entity)).alias("e"), _micros(F.col(left_time)).alias("a")
    ).where(F.col("e").isNotNull() & F.col("a").isNotNull())
    b = right.select(
        F.col(right_id).alias("rid"), norm_key(F.col(right_entity)).alias("e"), _micros(F.col(right_time)).alias("t")
    ).where(F.col("e").isNotNull() & F.col("t").isNotNull() & F.col("rid").isNotNull())
    width = F.lit(max(4 * tol, 1))
    b = nearest_intervals(b, tol).where("lo2 <= hi2")
    b = b.select("*", F.explode(F.sequence(F.floor(F.col("lo2") / width), F.floor(F.col("hi2") / width))).alias("bucket"))
    a = a.select("*", F.floor(2 * F.col("a") / width).alias("bucket"))
    hit = a.join(b, ["e", "bucket"]).where((2 * F.col("a")).between(F.col("lo2"), F.col("hi2")))
    return hit.select(
        F.col("lid").alias(left_id), F.col("rid").alias(right_id), (F.abs(F.col("a") - F.col("t")) / 1e6).alias("gap_s")
    ).distinct()
