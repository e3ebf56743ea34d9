"""Exact radius join of texts by the cosine of weighted character runs, and the clusters that it makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangarlake.functions import text as x
from hangarlake.operators.components import connected_components
from hangarlake.session import cut


def char_weights(texts: DataFrame) -> DataFrame:
    """(id, gram, df, w): tf * (ln((1 + n) / (1 + df)) + 1) of the 3- to 5-runs within words, of length 1; texts are (id, m, text), m rows each."""
    tf = texts.select("id", "m", F.explode(x.char_grams("text")).alias("gram")).groupBy("id", "m", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.sum("m").alias("df"))
    n = texts.agg(F.sum("m").alias("n"))
    w = tf.join(df, "gram").join(F.broadcast(n)).select("id", "gram", "df", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("id"))))


def cosine_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs of ids whose cosine is ``threshold`` or more.

    Runs are ordered by rarity. Two such texts share a run that neither has in
    its tail, the longest end of its order with a length below the threshold.
    At the first run that they share, its product and the tails behind it bound
    the cosine. What is left is compared exactly.
    """
    weights = cut(char_weights(texts))
    order = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, 0)
    rows = weights.withColumn("rest", 1 - F.sum(F.col("w") ** 2).over(order))
    prefix = rows.filter(F.col("rest") + F.col("w") ** 2 >= threshold**2 - 1e-9).withColumn("rest", F.sqrt(F.greatest("rest", F.lit(0.0))))
    a, b = (prefix.select("gram", F.col("id").alias(s), F.col("w").alias(f"w_{s}"), F.col("rest").alias(f"r_{s}")) for s in "ab")
    near = a.join(b, "gram").filter((F.col("a") < F.col("b")) & (F.col("w_a") * F.col("w_b") + F.col("r_a") * F.col("r_b") >= threshold - 1e-9)).select("a", "b").distinct()
    left, right = (weights.select(F.col("id").alias(s), "gram", F.col("w").alias(f"w_{s}")) for s in "ab")
    dots = near.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("likeness"))
    return dots.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b", F.round("likeness", 6).alias("likeness"))


def numbered_texts(df: DataFrame, text: str) -> DataFrame:
    """(id, m, text) of each distinct text, with its number of rows."""
    return cut(df.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()))


def text_pairs(df: DataFrame, text: str, threshold: float) -> DataFrame:
    """(a, b, likeness) of distinct texts, a before b."""
    texts = numbered_texts(df, text)
    left, right = (texts.select(F.col("id").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab")
    rows = cosine_pairs(texts, threshold).join(left, "a").join(right, "b")
    return rows.select(F.least("t_a", "t_b").alias("a"), F.greatest("t_a", "t_b").alias("b"), "likeness")


def text_clusters(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(key, text, label) of every row: equal texts and those within the radius are one cluster, named by its smallest text."""
    component = connected_components(cut(text_pairs(df, text, threshold)))
    rows = df.select(key, text).distinct().join(component, F.col(text) == F.col("node"), "left")
    return rows.select(key, text, x.stable_hash("normgrp-", F.coalesce("component", text), 12).alias("label"))
