"""Operators on ordered series: rolling changes, runs, as-of look-ups, interval joins, thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def tone_changes(df: DataFrame, *, key: str, order: list[str], value: str, threshold: float, window: int = 5) -> DataFrame:
    """Rolling mean and population deviation over ``window`` rows, z-score and whether it is a change.
    A deviation of at most 1e-9 gives z = 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    t = df.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w)})
    z = F.when(F.col("std") > 1e-9, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    t = t.withColumn("z", F.round(z, 4))
    return t.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "is_change": F.abs("z") >= threshold})


def runs(df: DataFrame, *, key: str, order: list[str], state: Column) -> DataFrame:
    """Runs of equal consecutive states (gaps and islands): adds run and keeps the state."""
    w = Window.partitionBy(key).orderBy(*order)
    t = df.withColumn("_state", state).withColumn("_new", (~F.col("_state").eqNullSafe(F.lag("_state").over(w))).cast("int"))
    return t.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def as_of(left: DataFrame, right: DataFrame, *, key: str, time: str, value: str, forward: bool = False, block: Column | None = None) -> DataFrame:
    """The value at or before (or at or after) each left time, by a union and one ordered pass.

    No range join: both sides share one sort by key and time; linear in their size. Left
    rows without such a value get null. Equal times on the right take the last of them in
    order of value (the first for forward). ``block`` (such as the day of the time) cuts the
    series of a key into blocks, between which the last value is carried, so that the rows of a
    hot key are spread over tasks.
    """
    side = F.lit(1 if not forward else -1)
    a = left.select(*left.columns, side.alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(F.col(key), F.col(time), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_b", F.lit(0) if block is None else block)
    way = lambda c: c.desc() if forward else c.asc()
    order = [F.col(time), F.col("_side"), F.col("_v")]
    w = Window.partitionBy(key, "_b").orderBy(*(way(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_side <> 0")
    if block is not None:
        edge = F.struct(F.col(time).alias("t"), F.col("_v").alias("v"))
        edges = u.where("_v is not null").groupBy(F.col(key).alias("_k"), "_b").agg((F.min(edge) if forward else F.max(edge))["v"].alias("_e"))
        blocks = u.select(F.col(key).alias("_k"), "_b").distinct().join(edges, ["_k", "_b"], "left")
        before = Window.partitionBy("_k").orderBy(way(F.col("_b"))).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select("_k", F.col("_b").alias("_c"), F.last("_e", ignorenulls=True).over(before).alias("_carry"))
        out = out.join(carried, (out[key] == carried["_k"]) & (out["_b"] == carried["_c"]), "left").withColumn("as_of", F.coalesce("as_of", "_carry"))
    return out.select(*left.columns, "as_of")


def overlaps(left: DataFrame, right: DataFrame, *, key: str, width: float) -> DataFrame:
    """Pairs of intervals of one key that strictly overlap: (key, lid, rid, overlap).

    left: (key, lid, ls, le); right: (key, rid, rs, re). Both are placed in every bucket of
    ``width`` they touch, joined on (key, bucket), and counted in the bucket of the later
    start only, so that no pair comes twice. Empty and reversed intervals overlap nothing.
    """
    b = lambda c: F.floor(F.col(c) / width)
    a = left.where("ls < le").withColumn("bucket", F.explode(F.sequence(b("ls"), b("le"))))
    r = right.where("rs < re").withColumn("bucket", F.explode(F.sequence(b("rs"), b("re"))))
    j = a.join(r, [key, "bucket"]).where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    j = j.where(F.col("bucket") == F.floor(F.greatest("ls", "rs") / width))
    return j.select(key, "lid", "rid", (F.least("le", "re") - F.greatest("ls", "rs")).alias("overlap"))


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """One ordered pass over the rows of each key, for what needs the rows before it.

    ``step(state, row)`` gets the state of the key so far (None at first) and a tuple of the columns,
    and returns the new state and a list of output rows; with row None the key has ended. Rows
    stream through in Arrow batches, so that a task holds one state and never the rows of a key."""
    names = df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                now = tuple(row[i] for i in at)
                if now != key:
                    if key is not None:
                        out += step(state, None)[1]
                    key, state = now, None
                state, rows = step(state, row)
                out += rows
            if len(out) > 10_000:
                yield from _rows(out)
                out = []
        if key is not None:
            out += step(state, None)[1]
        yield from _rows(out)

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def thin(df: DataFrame, *, key: str, time: str, gap: float) -> DataFrame:
    """(key, time): the times of a key kept when at least ``gap`` after the last kept one, in order.
    Null keys and times take no part."""
    rows = df.select(key, time).where(F.col(time).isNotNull() & F.col(key).isNotNull())
    types = dict(rows.dtypes)

    def step(last, row):
        if row is None or last is not None and row[1] - last < gap:
            return last, []
        return row[1], [row]

    return ordered_scan(rows, [key], [time], step, f"`{key}` {types[key]}, `{time}` {types[time]}")


def window_means(anchors: DataFrame, chunks: DataFrame, *, key: str, before: float, after: float) -> DataFrame:
    """Mean score of the chunks that overlap the time before and after each anchor, and the shift.

    anchors: (key, aid, t); chunks: (key, cid, start, end, score)."""
    spans = anchors.select(key, F.explode(F.array(
        F.struct(F.concat(F.lit("b"), F.col("aid").cast("string")).alias("lid"), (F.col("t") - before).alias("ls"), F.col("t").alias("le")),
        F.struct(F.concat(F.lit("a"), F.col("aid").cast("string")).alias("lid"), F.col("t").alias("ls"), (F.col("t") + after).alias("le")),
    )).alias("s")).select(key, "s.*")
    c = chunks.select(key, F.col("cid").alias("rid"), F.col("start").alias("rs"), F.col("end").alias("re"))
    hit = overlaps(spans, c, key=key, width=before + after).join(chunks.select(key, F.col("cid").alias("rid"), "score"), [key, "rid"])
    m = hit.groupBy(key, F.substring("lid", 2, 40).alias("aid")).agg(
        F.avg(F.when(F.col("lid").startswith("b"), F.col("score"))).alias("before"), F.avg(F.when(F.col("lid").startswith("a"), F.col("score"))).alias("after")
    )
    out = anchors.withColumn("aid", F.col("aid").cast("string")).join(m, [key, "aid"], "left")
    fine = lambda c: F.round(F.round(c, 9), 6)  # noqa: E731  (sums differ in their last digits by order)
    return out.select(key, "aid", fine(F.col("before")).alias("before"), fine(F.col("after")).alias("after"), fine(F.col("after") - F.col("before")).alias("shift"))


def pause_stats(frames: DataFrame, *, key: str, order: list[str], silent: Column, hop_ms: float, least_ms: float = 120.0, burst_ms: float = 450.0) -> DataFrame:
    """(key, n_frames, silence_ratio, pause_count, burst_count, mean_ms, max_ms): runs of silent frames of at least ``least_ms``,
    bursts of at least ``burst_ms``; 0 where there is none."""
    r = runs(frames, key=key, order=order, state=silent)
    one = r.groupBy(key, "run").agg(F.first("_state").alias("s"), F.count(F.lit(1)).alias("n"))
    ms = F.when(F.col("s") & (F.col("n") * hop_ms >= least_ms), F.col("n") * F.lit(hop_ms))
    g = one.groupBy(key).agg(
        F.sum("n").alias("n_frames"), F.round(F.sum(F.when(F.col("s"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("silence_ratio"), F.count(ms).alias("pause_count"),
        F.count_if(ms >= burst_ms).alias("burst_count"), F.round(F.coalesce(F.avg(ms), F.lit(0.0)), 4).alias("mean_ms"), F.round(F.coalesce(F.max(ms), F.lit(0.0)), 4).alias("max_ms"),
    )
    return g


def leading_silence(frames: DataFrame, anchors: DataFrame, *, key: str, time: str, silent: Column, hop_ms: float, most_ms: float = 2000.0) -> DataFrame:
    """anchors with silence_ms: how long the frames just before each were silent without a break, at most ``most_ms``."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    f = frames.withColumn("_i", F.count(F.lit(1)).over(w))
    f = f.withColumn("_loud", F.max(F.when(~silent, F.col("_i"))).over(w))
    f = f.select(key, time, (F.col("_i") - F.coalesce("_loud", F.lit(0))).cast("double").alias("quiet"))
    out = as_of(anchors, f, key=key, time=time, value="quiet")
    return out.withColumn("silence_ms", F.least(F.coalesce("as_of", F.lit(0.0)) * hop_ms, F.lit(most_ms))).drop("as_of")
