"""Sets of records: latest delivery, keys, guards and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first); ties go to the larger of the remaining columns' values.

    An aggregation with map-side combine, not a window: a key with many rows isn't gathered.
    """
    rest = [c for c in df.columns if c not in keys and c not in order and not df.schema[c].dataType.typeName() == "map"]
    maps = [c for c in df.columns if df.schema[c].dataType.typeName() == "map"]
    ranked = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order, *rest)) if maps else F.max(F.struct(*order, *rest))
    return df.groupBy(*keys).agg(ranked.alias("_r")).select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def require_columns(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {', '.join(missing)}")
    return df


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) of keys that come more than once; empty where the key is unique."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A full outer join with ``merge``: left_only, right_only or both."""
    rows = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    return rows.withColumn("merge", F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")).drop("_l", "_r")


def first_per_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group; with map-side combine, as for keep_last."""
    rest = [c for c in df.columns if c != group]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(group).agg(first.alias("_r")).select(group, *[F.col("_r")[c].alias(c) for c in rest])


def top(df: DataFrame, by: str, label: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(label)).limit(n)


def quotas(counts: DataFrame, group: str, total: int) -> DataFrame:
    """(group, n, quota): ``total`` places by the largest-remainder method; ties by name. One row for each group, so few."""
    everything = Window.partitionBy(F.lit(1))
    exact = F.col("n") * total / F.sum("n").over(everything)
    rows = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.asc(group)))
    return rows.withColumn("_left", left).withColumn("_place", place).select(group, "n", (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).cast("long").alias("quota"))


def exact_count(df: DataFrame, rows: int, label: str) -> DataFrame:
    """``df``, or a ValueError if it hasn't exactly so many rows."""
    found = df.limit(rows + 1).count()
    if found != rows:
        raise ValueError(f"{label}: {'more than' if found > rows else found} {rows if found > rows else f'rows, not {rows}'}")
    return df


def covered(df: DataFrame, column: str) -> DataFrame:
    """``df``, or a ValueError if the column is null anywhere."""
    if not df.filter(F.col(column).isNull()).isEmpty():
        raise ValueError(f"{column} is not known for every row")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join, or a ValueError if a key comes more than once on either side."""
    for name, df in (("left", left), ("right", right)):
        if not repeated_keys(df, key).isEmpty():
            raise ValueError(f"{key} is not unique on the {name} side")
    return left.join(right, key, "left")


def joined_or_zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join by id with ``method``; by place, in order of the ids, where no id agrees and both sides have as many rows.

    Without a common id and with different counts it is a ValueError: rows are never matched by guess.
    """
    found = left.join(right, key)
    if not found.isEmpty() or left.isEmpty() or right.isEmpty():
        return found.withColumn("method", F.lit("id"))
    from hangarlake.sources.tables import zipped

    return zipped(left, right.withColumnRenamed(key, f"other_{key}"), key, f"other_{key}").withColumn("method", F.lit("place"))
