"""Frequency analytics over cases: everything is aggregated with map-side combine; hot keys never gather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNSPECIFIED = "(unspecified)"


def exploded_counts(df: DataFrame, column: str, label: str) -> DataFrame:
    """(label, n) of an array column's elements, without empty and unspecified ones."""
    return df.select(F.explode(column).alias(label)).filter(F.col(label).isNotNull() & (F.col(label) != "") & (F.col(label) != UNSPECIFIED)).groupBy(label).agg(F.count("*").alias("n"))


def pareto(counts: DataFrame, label: str, n: int) -> DataFrame:
    """The n most frequent with their shares of the grand total and the running share. The window holds n rows."""
    total = counts.agg(F.sum("n").alias("_total"))
    first = counts.orderBy(F.desc("n"), label).limit(n).join(F.broadcast(total))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), label).rowsBetween(Window.unboundedPreceding, 0))
    return first.select(label, "n", F.round(upto / F.col("_total") * 100, 6).alias("cumulative_pct"), F.round(F.col("n") / F.col("_total") * 100, 6).alias("share_pct"))


def modes(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """The most frequent value of each column in each group, ties to the smaller: counts first, then the best count."""
    out = None
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(group, c).agg(F.count("*").alias("n"))
        one = counts.groupBy(group).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
        out = one if out is None else out.join(one, group, "full_outer")
    return out


def watchlist(cases: DataFrame, group: str, first: str, order: str, least: int, n: int, columns: list[str]) -> DataFrame:
    """Groups of ``least`` rows or more with outcome counts, the first problem and the modes, largest first."""
    counts = cases.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("work_orders"), F.min_by(first, order).alias(first), F.count_if(F.col("outcome") == "positive").alias("positive_outcomes"),
        F.count_if(F.col("outcome").isin("negative", "mixed")).alias("negative_outcomes"),
    ).filter(F.col("work_orders") >= least)
    best = counts.withColumn("outcome_unknown", F.col("work_orders") - F.col("positive_outcomes") - F.col("negative_outcomes")).orderBy(F.desc("work_orders"), group).limit(n)
    return best.join(modes(cases.join(F.broadcast(best.select(group)), group, "left_semi"), group, columns), group, "left")
