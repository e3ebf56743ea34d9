"""Ranking metrics, calibration and resampling, all on additive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hangarlake.sources.tables import numbered


def family_votes(hits: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, family, evidence, support, rank): families by the sum over clusters of each cluster's best (or whole) score."""
    inner = F.max("score") if how == "max" else F.sum("score")
    votes = hits.groupBy("query_id", "family", "cluster").agg(inner.alias("s")).groupBy("query_id", "family").agg(F.round(F.sum("s"), 6).alias("evidence"), F.count("*").alias("support"))
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("evidence"), "family")).cast("long"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """Of (query_id, rank of the right answer or null): hits at 1, 3 and 5, mean reciprocal rank, nDCG at 5 with one relevant answer."""
    at = lambda k: F.round(F.avg((F.coalesce(F.col("rank"), F.lit(1_000_000)) <= k).cast("int")), 6)
    gain = F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return ranks.agg(
        F.count("*").alias("queries"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(5).alias("hit_5"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(gain), 6).alias("ndcg_5"),
    )


def bins(p: Column, n: int = 10) -> Column:
    """Equal-width bins; the last one is closed."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("long")


def calibration_table(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy(bins(F.col("p"), n).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("accuracy"))


def calibration_error(df: DataFrame, n: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    b = df.groupBy(bins(F.col("p"), n).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"), F.sum((F.col("p") - F.col("y")) ** 2).alias("s"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("s") / F.sum("n"), 6).alias("brier"))


def risk_coverage(df: DataFrame, key: str) -> DataFrame:
    """Accuracy of the surest ceil(n * c) rows for c = 0.1 ... 1; of equally sure ones the smaller key comes first.

    Places come from a range-partitioned sort, so no task holds all rows, nor
    all rows of one probability; then one aggregation has every coverage.
    """
    placed = numbered(df.select((-F.col("p")).alias("_p_down"), F.col(key).alias("_key"), "y"), "_p_down", "_key")
    n = placed.agg(F.count("*").alias("n"))
    want = lambda tenth: F.ceil(F.col("n") * tenth / 10)
    sums = placed.join(F.broadcast(n)).groupBy("n").agg(*[F.sum(F.when(F.col("_place") < want(i), F.col("y")).otherwise(0)).alias(f"y{i}") for i in range(1, 11)])
    each = F.explode(F.array(*[F.struct(F.lit(i / 10).alias("coverage"), want(i).alias("rows"), F.round(F.col(f"y{i}") / want(i), 6).alias("accuracy")) for i in range(1, 11)]))
    return sums.select(each.alias("v")).select("v.*")


def bootstrap(df: DataFrame, key: str, rounds: int, **sums: Column) -> DataFrame:
    """(round, sums of each statistic) over resampled rows.

    A row's weight in a round is drawn from its own digest with the odds of a
    Poisson variable of mean 1, so no rows are exchanged but the sums.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("round").cast("string"), F.col(key))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    # The cumulative Poisson probabilities of mean 1.
    steps = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)
    weight = sum((u >= s).cast("int") for s in steps)
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("weight", weight)
    return rows.groupBy("round").agg(*[F.sum(F.col("weight") * c).alias(name) for name, c in sums.items()])


def evidence_tier(support: Column, margin: Column, coverage: Column) -> Column:
    """A grade of evidence from support, margin and coverage; the first that fits."""
    strong = (support >= 3) & (margin >= 0.08) & (coverage >= 0.75)
    moderate = (support >= 2) & (margin >= 0.03) & (coverage >= 0.5)
    return F.when(strong, "strong").when(moderate, "moderate").when(support == 1, "limited").otherwise("exploratory")
