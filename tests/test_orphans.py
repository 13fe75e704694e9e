from datetime import datetime as dt

from pyspark.sql import functions as F

from colloquy.operators.orphans import _probe, orphan_references, orphan_report, parents, references


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, refs, pars):
    r = references(spark.createDataFrame(refs, "k string, created_at timestamp_ntz, m string"), "t", F.col("k"), F.col("created_at"))
    p = parents(
        spark.createDataFrame(pars, "k string, created_at timestamp_ntz, deleted_at timestamp_ntz"), F.col("k"), F.col("created_at"), F.col("deleted_at")
    )
    return orphan_references(r, p)


def test_kinds_keys_and_nulls(spark):
    a, b, c = dt(2024, 1, 5), dt(2024, 1, 20), dt(2024, 3, 1)
    refs = [(" K1 ", b, "x"), ("k2", b, "x"), ("k3", b, "x"), ("k3", c, "x"), ("k4", b, "x"), (None, b, "x"), ("", b, "x"), ("k5", None, "x"), ("k1", b, "x")]
    pars = [("k1", a, None), ("K2", a, b), ("k2 ", a, a), ("k3", dt(2024, 2, 1), None), ("k3", dt(2024, 2, 2), None), ("k5", None, None), (None, a, None)]
    assert rows(run(spark, refs, pars)) == [("t", "k2", "2024-01", "deleted", 1), ("t", "k3", "2024-01", "late", 1), ("t", "k4", "2024-01", "missing", 1)]


def test_empty_tables(spark):
    a = dt(2024, 1, 5)
    assert rows(run(spark, [], [("k", a, None)])) == []
    assert rows(run(spark, [("k", a, "x"), ("k", a, "x")], [])) == [("t", "k", "2024-01", "missing", 2)]
    assert rows(orphan_report([run(spark, [("k", a, "x")], [])])) == [("t", "2024-01", "missing", 1, 1)]


def test_hot_key_and_equal_hashes(spark):
    a = dt(2024, 1, 5)
    refs = [("hot", a, str(i)) for i in range(300)] + [(f"k{i}", a, "x") for i in range(50)]
    assert rows(run(spark, refs, [(f"k{i}", a, None) for i in range(50)])) == [("t", "hot", "2024-01", "missing", 300)]
    import pyarrow as pa

    left = pa.table({"h": [7, 7, 9], "k": ["a", "b", "c"], "created_us": [1, 1, 1], "deleted": [False, True, False]})
    right = pa.table({"h": [7, 7, 7], "from_table": ["t"] * 3, "k": ["b", "a", "z"], "m": ["m"] * 3, "first_us": [5, 5, 5], "n_refs": [1, 1, 1]})
    assert _probe(left, right).select(["ref_key", "orphan_kind"]).to_pylist() == [
        {"ref_key": "b", "orphan_kind": "deleted"}, {"ref_key": "z", "orphan_kind": "missing"}
    ]
