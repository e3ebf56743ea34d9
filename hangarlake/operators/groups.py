"""Duplicate groups, clusters and splits of records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.functions import text as x
from hangarlake.operators.components import connected_components
from hangarlake.session import sent
from hangarlake.sources.tables import numbered


def near_digest(a: str, b: str):
    """A name for records whose parts have the same near keys; a whole digest, since a short one merges strangers among many records."""
    return F.concat(F.lit("nr_"), F.md5(F.concat(x.near_key(a), F.lit(" ||| "), x.near_key(b))))


def exact_near_groups(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, exact_group, near_group, exact_label, near_label): digests of the two parts as they are and of their near keys, and their short labels for display."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    exact = F.concat(F.lit("ex_"), F.md5(F.concat(plain(a), F.lit(" ||| "), plain(b))))
    rows = df.select(key, exact.alias("exact_group"), near_digest(a, b).alias("near_group"))
    return rows.select("*", F.substring("exact_group", 1, 11).alias("exact_label"), F.substring("near_group", 1, 11).alias("near_label"))


def merged_clusters(df: DataFrame, cluster: str, record: str) -> DataFrame:
    """(cluster, component): clusters that share a record, through any number of steps, by the smallest cluster."""
    pairs = df.select(F.col(cluster).alias("a"), F.col(record).alias("_r")).filter("a is not null and _r is not null")
    least = pairs.groupBy("_r").agg(F.min("a").alias("b"), F.max("a").alias("_m")).filter("b < _m").select("_r", "b")
    component = connected_components(pairs.join(least, "_r").select("a", "b").filter("a <> b"))
    return pairs.select("a").distinct().join(component.withColumnRenamed("node", "a"), "a", "left").select(F.col("a").alias(cluster), F.coalesce("component", "a").alias("component"))


def hashed_split(df: DataFrame, group: str, cuts: list[tuple[str, float]], seed: str) -> DataFrame:
    """A split for each group by the place of its digest in [0, 1): all rows of a group agree, nothing is exchanged."""
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(group)), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out = F.lit(cuts[-1][0])
    for name, end in reversed(cuts[:-1]):
        out = F.when(place < end, name).otherwise(out)
    return df.withColumn("assigned", out)


def packing(counts: list[tuple[int, int]], ratios: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, from, to): how the groups of each size, by their place, are dealt out by "the largest first, into the split that is emptiest for its ratio".

    ``counts`` has (size, number of groups). Equal sizes need no turn for each
    group: a split's k-th group of a size goes in at (filled + (k - 1) * size) /
    ratio, and those that go in lowest are taken; ties by name.
    """
    filled = dict.fromkeys(ratios, 0)
    plan = []
    for size, many in sorted(counts, reverse=True):
        level = lambda x: {s: min(many, max(0, math.floor((x * r - filled[s]) / size) + 1)) for s, r in ratios.items()}  # noqa: E731,B023
        low, high = 0.0, (max(filled[s] / r for s, r in ratios.items()) + (many + 1) * size / min(ratios.values()))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if sum(level(middle).values()) >= many else (middle, high)
        taken = level(low) if sum(level(low).values()) <= many else dict.fromkeys(ratios, 0)
        for _ in range(many - sum(taken.values())):
            best = min(ratios, key=lambda s: ((filled[s] + taken[s] * size) / ratios[s], s))  # noqa: B023
            taken[best] += 1
        begin = 0
        for split, n in taken.items():
            if n:
                plan.append((size, split, begin, begin + n))
            begin, filled[split] = begin + n, filled[split] + n * size
    return plan


def packed_split(sizes: DataFrame, group: str, n: str, ratios: dict[str, float], seed: str = "pack") -> DataFrame:
    """(group, assigned): the largest group first into the split that is emptiest for its ratio; among equal sizes a digest decides who goes where.

    Only the numbers of groups of each size come to the driver: of N rows there
    are less than sqrt(2 N) different sizes, however many groups.
    """
    rows = sizes.select(F.col(group).alias("_g"), F.col(n).cast("long").alias("_n")).filter("_n > 0")
    counts = [(r[0], r[1]) for r in rows.groupBy("_n").agg(F.count("*").alias("c")).collect()]
    schema = "_n long, assigned string, _from long, _to long"
    before, first = 0, {}
    for size, many in sorted(counts, reverse=True):
        first[size], before = before, before + many
    plan = [(size, split, first[size] + begin, first[size] + end) for size, split, begin, end in packing(counts, ratios)]
    dealt = sent(sizes.sparkSession.createDataFrame(plan, schema))
    placed = numbered(rows.withColumn("_down", -F.col("_n")).withColumn("_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_g").cast("string")), 256)), "_down", "_digest", "_g")
    return placed.join(dealt, "_n").filter("_place >= _from and _place < _to").select(F.col("_g").alias(group), "assigned")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in several splits; empty where a split keeps groups whole."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).filter("splits > 1")
