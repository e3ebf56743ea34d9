"""Problem 4: splits that keep linked records together.

Units (clusters) that share a link value (a record id) are joined to components
by alternating large-star and small-star; the hash of a component's identifier
falls into one of the splits' ranges of [0, 1), which are as wide as the target
shares. Before the iteration only the smallest and largest unit of each link
value is aggregated, so link values with one unit, nearly all, make no edge.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangarlake.llm.crosssplit import split_name
from hangarlake.operators.components import connected_components
from hangarlake.session import cut


def unit_edges(df: DataFrame, unit: str, link: str) -> DataFrame:
    """(a, b): a star of edges for each link value that has several units; nulls link nothing."""
    pairs = df.select(F.col(unit).cast("string").alias("a"), F.col(link).cast("string").alias("link")).filter("a is not null and link is not null")
    hubs = pairs.groupBy("link").agg(F.min("a").alias("b"), F.max("a").alias("_most")).filter("b < _most").select("link", "b")
    return pairs.join(hubs, "link").filter("a <> b").select("a", "b").distinct()


def unit_components(df: DataFrame, unit: str = "cluster_id", links: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(node, component) of the units that are linked to another one."""
    edges = unit_edges(df, unit, links[0])
    for link in links[1:]:
        edges = edges.unionByName(unit_edges(df, unit, link))
    return connected_components(edges)


def broken_units(df: DataFrame, unit: str = "cluster_id", links: tuple[str, ...] = ("record_id",), split: str = "split") -> DataFrame:
    """(unit): each unit whose component's rows name two or more splits; null and blank splits name none."""
    named = df.select(F.col(unit).cast("string").alias("unit"), F.nullif(split_name(split), F.lit("")).alias("part")).filter("unit is not null")
    spans = named.groupBy("unit").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low is not null")
    component = cut(unit_components(df, unit, links))
    labelled = spans.join(component, spans["unit"] == component["node"], "left").select("unit", F.coalesce("component", "unit").alias("label"), "low", "high")
    broken = labelled.groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("label")
    units = df.select(F.col(unit).cast("string").alias("unit")).filter("unit is not null").distinct()
    every = units.join(component, units["unit"] == component["node"], "left").select("unit", F.coalesce("component", "unit").alias("label"))
    return every.join(broken, "label", "left_semi").select(F.col("unit").alias(unit))


def _position(label):
    """A label's place in [0, 1): the first 32 bits of its digest."""
    return F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split_ranges(targets: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
    """(split, upper end) in order of the names; shares are scaled to 1, null and negative ones count as 0."""
    shares = sorted((name, max(0.0, share or 0.0)) for name, share in targets if name is not None)
    total, end, out = sum(x for _, x in shares), 0.0, []
    if total <= 0:
        raise ValueError("no split has a positive target share")
    for name, share in shares:
        end += share / total
        if share:
            out.append((name, end))
    return out


def grouped_splits(df: DataFrame, targets: DataFrame, record_id: str = "record_id", unit: str = "cluster_id", links: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(record_id, split): every distinct record id, with all linked records in one split.

    A record without a unit stands for itself. ``targets`` (split,
    target_share) has one row for each split, a handful. A component is never
    divided, so one that holds a third of all records moves the actual shares
    away from the targets; ``split_shares`` reports them. Null record ids are left out.
    """
    ranges = split_ranges([(r[0], r[1]) for r in targets.select("split", "target_share").toLocalIterator()])
    component = cut(unit_components(df, unit, links))
    rows = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(unit).cast("string").alias("unit")).filter("record_id is not null")
    records = rows.groupBy("record_id").agg(F.min("unit").alias("unit"))
    labelled = records.join(component, records["unit"] == component["node"], "left")
    label = F.coalesce(F.concat(F.lit("unit:"), F.coalesce("component", "unit")), F.concat(F.lit("record:"), F.col("record_id")))
    place = _position(label)
    chosen = F.lit(ranges[-1][0])
    for name, end in reversed(ranges[:-1]):
        chosen = F.when(F.col("_place") < end, F.lit(name)).otherwise(chosen)
    return labelled.withColumn("_place", place).select("record_id", chosen.alias("split"))


def split_shares(df: DataFrame, targets: DataFrame, **names) -> DataFrame:
    """(split, target_share, records, share): the shares that came about."""
    counts = grouped_splits(df, targets, **names).groupBy("split").agg(F.count("*").alias("records"))
    rows = targets.select("split", "target_share").join(counts, "split", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return rows.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1))))
