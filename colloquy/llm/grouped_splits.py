"""Splits that keep related records together.

Groups are the connected components of the bipartite graph of records and entities,
found by propagating the least record label from entity to record and back. Each round
also follows the label map to its end in doubled steps, so that each round leaves at most
half of the labels of a component and long chains take a logarithmic number of rounds. Only records that bind two or more entities take part in
the rounds; all others read the label of their entity once at the end.

The links of a giant component come to share one label, and a hot entity or record may hold a
large part of them, so the joins on labels, entities and records deal hot keys out.

Groups then go to splits. Groups of more than ``unit_share`` of the rows (at most 2,000 by
default) are placed one by one; all smaller ones are gathered by label and hash into buckets,
which are placed as a whole. That table of units has a bound that the parameters give, whatever
the data; ``split_shares`` tells how near the splits come.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import checkpoint, salted_join

def norm_ticker(c: Column) -> Column:
    """Upper-case ticker without surrounding space, leading $ or an exchange prefix; blank is null."""
    t = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    t = F.regexp_replace(t, r"^[^:]*:\s*", "")
    t = F.regexp_replace(t, r"^\$+\s*|\s+$", "")
    return F.when(t != "", t)


def _relabel(df: DataFrame, m: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its image under the map m (src, dst), where it has one."""
    rest = [c for c in df.columns if c != column]
    hit = salted_join(df, m.withColumnRenamed("src", column), [column], how="left")
    return hit.select(*rest, F.coalesce("dst", column).alias(column))


def _compose(total: DataFrame, m: DataFrame) -> DataFrame:
    """First total, then m; labels that only m knows are kept."""
    t = total.select(F.col("src").alias("s1"), F.col("dst").alias("d1"))
    old = t.join(m, t["d1"] == m["src"], "left").select(F.col("s1").alias("src"), F.coalesce("dst", "d1").alias("dst"))
    new = m.join(t, m["src"] == t["s1"], "left_anti").select("src", "dst")
    return checkpoint(old.unionByName(new))


def entity_groups(edges: DataFrame) -> DataFrame:
    """edges: (record, entity). Returns (record, group): the least record of the component.

    A null entity binds nothing: a record that has no other is a group of its own. Null
    records are dropped, repeated edges are one. An empty table gives an empty result.
    """
    e = edges.select("record", "entity").where(F.col("record").isNotNull()).distinct()
    bound = checkpoint(e.where(F.col("entity").isNotNull()))
    first = bound.groupBy("entity").agg(F.min("record").alias("label"))
    bridges = bound.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
    links = checkpoint(salted_join(salted_join(bound, bridges, ["record"]), first, ["entity"]).select("record", "label").distinct())
    total = None  # label at first -> label now
    while links.head(1):
        least = links.groupBy("record").agg(F.min("label").alias("low"))
        m = salted_join(links, least, ["record"]).groupBy(F.col("label").alias("src")).agg(F.min("low").alias("dst"))
        m = checkpoint(m)
        while True:  # follow the map to its end: each pass doubles the step
            n = m.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
            far = m.join(n, m["dst"] == n["s2"], "left").select("src", F.coalesce("d2", "dst").alias("dst"), (F.col("d2") < F.col("dst")).alias("moved"))
            far = checkpoint(far)
            m = far.select("src", "dst")
            if not far.where("moved").head(1):
                break
        total = m if total is None else _compose(total, m)
        links = _relabel(links, m, "label").distinct()
        open_ = links.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
        links = checkpoint(links.join(open_, "record"))
    labels = first if total is None else _relabel(first, total, "label")
    own = bound.groupBy("record").agg(F.min("entity").alias("entity"))
    named = salted_join(own, labels, ["entity"]).select("record", "label")
    alone = e.groupBy("record").agg(F.max("entity").alias("entity")).where(F.col("entity").isNull()).select("record", F.col("record").alias("label"))
    return named.unionByName(alone).select("record", F.col("label").alias("group"))


def _place(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """sizes: units x strata, the first stratum all rows. The split of each unit: largest
    units first, each where it brings the splits' label counts nearest to their shares."""
    target = np.maximum(shares[:, None] * sizes.sum(axis=0)[None, :], 1e-9)
    now = np.zeros_like(target)
    weight = np.ones(sizes.shape[1])
    weight[0] = sizes.shape[1]  # the number of rows matters as much as all labels together
    out = np.zeros(len(sizes), dtype=int)
    for u in np.lexsort((np.arange(len(sizes)), -sizes[:, 0])):
        add = sizes[u][None, :]
        cost = ((((now + add - target) ** 2 - (now - target) ** 2) / target) * weight).sum(axis=1)
        out[u] = s = int(np.argmin(cost))
        now[s] += sizes[u]
    return out


def assign_splits(
    rows: DataFrame, names: list[str], shares: list[float], *, unit_share: float = 1 / 2000, buckets: int = 128, strata: int = 64
) -> DataFrame:
    """rows: (group, label, ...). Adds split; all rows of a group get the same one.

    Shares are met as nearly as the groups allow, and label shares alike. Groups above
    ``unit_share`` of the rows are placed singly, smaller ones in ``buckets`` per leading
    label. The ``strata`` most frequent labels are balanced each, all others as one. Null
    labels are a label of their own; rows with a null group are left out (give a row that is
    bound to nothing its own id as group). An empty table gives an empty result.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpoint(counts)
    by_label = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(strata).collect()
    total = counts.agg(F.sum("n")).head()[0]
    if not total:
        return rows.withColumn("split", F.lit(None).cast("string"))
    place = spark.createDataFrame([(r["label"], i) for i, r in enumerate(by_label, 1)], "known string, stratum int")
    counts = counts.join(F.broadcast(place), F.col("label").eqNullSafe(F.col("known")), "left")
    counts = counts.select("group", F.coalesce("stratum", F.lit(len(by_label) + 1)).alias("stratum"), "n")
    lead = counts.groupBy("group").agg(
        F.sum("n").alias("size"), F.max(F.struct(F.col("n"), -F.col("stratum"))).alias("top")
    )
    unit = F.when(
        F.col("size") > total * unit_share, F.concat(F.lit("g:"), F.col("group"))
    ).otherwise(F.concat_ws(":", F.lit("b"), F.col("top.col2").cast("string"), F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("string")))
    lead = checkpoint(lead.select("group", unit.alias("unit")))
    per = counts.join(lead, "group").groupBy("unit", "stratum").agg(F.sum("n").alias("n")).collect()
    units = sorted({r["unit"] for r in per})
    at = {u: i for i, u in enumerate(units)}
    sizes = np.zeros((len(units), len(by_label) + 2))
    for r in per:
        sizes[at[r["unit"]], r["stratum"]] += r["n"]
        sizes[at[r["unit"]], 0] += r["n"]
    where = _place(sizes[:, sizes.sum(axis=0) > 0], np.array(shares) / sum(shares))
    chosen = spark.createDataFrame([(u, names[int(s)]) for u, s in zip(units, where)], "unit string, split string")
    to_split = lead.join(F.broadcast(chosen), "unit").select("group", "split")
    return salted_join(rows, to_split, ["group"]).select(*rows.columns, "split")


def split_shares(split: DataFrame) -> DataFrame:
    """(split, n_rows, n_groups, share, label_deviation): what assign_splits() reached. label_deviation
    is the largest difference between a label's share in the split and in all rows."""
    cells = checkpoint(split.groupBy("split", "label", "group").agg(F.count(F.lit(1)).alias("n")))
    per = cells.groupBy("split", "label").agg(F.sum("n").alias("n"))
    every = per.groupBy("label").agg(F.sum("n").alias("label_n"))
    groups = cells.select("split", "group").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"))
    sizes = per.groupBy("split").agg(F.sum("n").alias("n_rows")).join(groups, "split")
    all_rows = sizes.agg(F.sum("n_rows").alias("total"))
    s = sizes.join(F.broadcast(all_rows))
    known = every.withColumnRenamed("label", "known")
    cells = s.join(known).join(per.select(F.col("split").alias("of"), F.col("label").alias("is"), "n"), (F.col("split") == F.col("of")) & F.col("known").eqNullSafe(F.col("is")), "left")
    dev = F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("n_rows") - F.col("label_n") / F.col("total")))
    return cells.groupBy("split", "n_rows", "n_groups", "total").agg(F.round(dev, 6).alias("label_deviation")).select(
        "split", "n_rows", "n_groups", F.round(F.col("n_rows") / F.col("total"), 6).alias("share"), "label_deviation"
    )
