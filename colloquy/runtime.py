"""Session helpers shared by every layer."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a
    session on one machine (``local[...]``, as in tests) gets a folder of its own, which all its
    tasks can read; on a cluster it is an error, as executors could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="colloquy-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Fixed value: what trimming takes off.
WHITE = " \t\n\x0b\f\r"


def norm_key(c):
    """Ids are compared trimmed and without letter case; a blank id is no id.

    >>> # "  AbC " -> "abc"; "" and null -> null
    """
    return F.nullif(F.lower(F.trim(c, F.lit(WHITE))), F.lit(""))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _salts) of the keys with more rows than a quarter of an even partition, and over how
    many salts their rows must be dealt to come down to that size.

    There are at most four such keys for each shuffle partition, whatever the data, so the
    result may be broadcast. One aggregation of the keys; null keys are none."""
    parts = 4 * shuffle_partitions(df.sparkSession)
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fair = known.agg((F.greatest(F.sum("_n") / parts, F.lit(1000.0))).alias("_fair"))
    hot = known.join(F.broadcast(fair)).where("_n > _fair")
    return hot.select(*keys, F.ceil(F.col("_n") / F.col("_fair")).cast("int").alias("_salts"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where few keys may hold most rows of ``big``; ``small`` has one row per key.

    The hot keys of ``big`` are measured (see hot_keys): their rows are dealt out over as many
    salts as their size asks for and their rows of ``small`` are copied as often; all other rows
    are joined as they are. Both keep their other columns.
    """
    hot = F.broadcast(hot_keys(big, keys))
    deal = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*big.columns), F.col("_salts"))).otherwise(0).cast("int")
    dealt = big.join(hot, keys, "left").withColumn("_salt", deal).drop("_salts")
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


#: A core is worth a task of its own from this many bytes of file on.
TASK_BYTES = 4_000_000


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``, in at least as many partitions as there are cores.

    A few small files give fewer tasks than cores; what is costly for each row then runs on
    one. Decided by the files' sizes, which are listed without being read: large tables are
    read as they are and are not shuffled.
    """
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir}/{name}.parquet")
    sizes = files.agg(F.sum(F.ceil(F.col("length") / (8 * TASK_BYTES))).alias("tasks")).head()
    return df if (sizes["tasks"] or 0) >= cores else df.repartition(cores)
