"""Exact similarity join of sets by prefix filter, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.session import cut, sent

#: Sets that begin with one element from which its pairs are made by several tasks.
PART = 2048
#: One of four words of bits of a set.
_BITS = "aggregate(s, 0L, (m, v) -> m | if(pmod(xxhash64(v), 4) = {}, shiftleft(1L, cast(pmod(shiftright(xxhash64(v), 8), 64) as int)), 0L))"


def _sets(df: DataFrame, key: str, elements: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.sort_array(F.array_distinct(elements)).alias("s")).filter(F.size("s") > 0)


def set_members(df: DataFrame, key: str, elements: str) -> DataFrame:
    """(key, representative) of every row that has elements: the name of its set in ``similar_sets``."""
    sets = _sets(df, key, elements).distinct()
    return sets.join(sets.groupBy("s").agg(F.min("k").alias("representative")), "s").select(F.col("k").alias(key), "representative")


def similar_sets(df: DataFrame, key: str, elements: str, threshold: float) -> DataFrame:
    """(a, b, likeness) of representatives whose sets have a Jaccard likeness of ``threshold`` or more.

    Rows with equal sets are one set, named by its smallest key. Sets are
    ordered by rare elements; two similar ones share an element among the first
    n - ceil(threshold * n) + 1 of each. Then sizes and bits are compared, before
    a pair is exchanged, and at last the sets themselves. Each element sets one
    of 256 bits, so sets have at least as many elements apart as bits.
    """
    sets = _sets(df, key, elements).groupBy("s").agg(F.min("k").alias("k"))
    sets = cut(sets.select("*", F.size("s").alias("n"), F.struct(*[F.expr(_BITS.format(i)).alias(f"b{i}") for i in range(4)]).alias("bits")))
    one = sets.select("k", "n", F.explode("s").alias("e"))
    counts = one.groupBy("e").agg(F.count("*").alias("df"))
    ordered = one.join(counts, "e").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("o"))
    prefix = ordered.select("k", "n", F.explode(F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("x")).select("k", "n", "x.e")
    prefix = cut(prefix.join(sets.select("k", "bits"), "k"))
    # An element that many sets begin with is divided into parts, so that its pairs are made by many tasks.
    hot = sent(cut(prefix.groupBy("e").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")))
    part, marked = F.coalesce("parts", F.lit(1)), prefix.join(hot, "e", "left")
    a = marked.select(F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), "e", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))
    b = marked.select(F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), "e", F.pmod(F.xxhash64("k"), part).cast("int").alias("part"))
    apart = sum(F.bit_count(F.col(f"bits_a.b{i}").bitwiseXOR(F.col(f"bits_b.b{i}"))) for i in range(4))
    near = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (apart <= (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    pairs = a.join(b, ["e", "part"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    left, right = (sets.select(F.col("k").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("likeness", shared / (F.size("s_a") + F.size("s_b") - shared))
    return scored.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b", F.round("likeness", 6).alias("likeness"))
