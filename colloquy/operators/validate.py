"""Row-level constraints as lists of error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """Codes of the rules a row breaks, in order. A condition that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items())))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("errors", errors(rules))


def summary(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(code, n) for every rule, zeros included, in one aggregation."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(code) for code, ok in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in rules))).alias("x")).select("x.*")
