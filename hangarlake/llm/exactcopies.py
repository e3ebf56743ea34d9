"""Problem 1: copies hidden by formatting and field order.

Canonical records are range-partitioned and sorted outside memory, then each
partition is scanned once in Arrow batches. A run of equal keys may span
partitions, so a group of copies of any size is never held by one task: every
partition reports its first and last run in one row, and the runs that go on
are completed from these rows, of which there are as many as partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.operators.components import connected_components
from hangarlake.session import cut, sent

_SCAN = "kind string, pid int, copy_key string, keep_id string, copy_id string"


def _letters(name: str):
    return F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", "")


def canonical(df: DataFrame, record_id: str, text: str, part_a: str, part_b: str) -> DataFrame:
    """(record_id, same, turned, copy_key): the letters and digits as written, with the parts exchanged, and the lesser of both.

    The boundary of the parts is found from whichever part is given; where
    neither is, or the text doesn't hold it, ``turned`` equals ``same``.
    """
    base = df.select(F.col(record_id).alias("record_id"), _letters(text).alias("same"), _letters(part_a).alias("_a"), _letters(part_b).alias("_b"))
    size = F.length("same")

    def first(x: str):
        return F.col("same").startswith(F.col(x)) & (F.length(x) > 0)

    def last(x: str):
        return F.col("same").endswith(F.col(x)) & (F.length(x) > 0)

    whole = F.col("same") == F.concat("_a", "_b")
    other = F.col("same") == F.concat("_b", "_a")
    cutoff = (
        F.when(whole, F.length("_a")).when(other, F.length("_b"))
        .when(first("_a"), F.length("_a")).when(last("_b"), size - F.length("_b"))
        .when(last("_a"), size - F.length("_a")).when(first("_b"), F.length("_b")).otherwise(F.lit(0))
    )
    base = base.filter("record_id is not null and same <> ''").withColumn("_at", cutoff)
    turned = F.concat(F.expr("substring(same, _at + 1)"), F.expr("substring(same, 1, _at)"))
    return base.select("record_id", "same", turned.alias("turned")).withColumn("copy_key", F.least("same", "turned"))


def _scan(batches):
    """Copies in a sorted partition: equal keys follow each other, the least id first."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    head_key = head_keep = key = keep = last_id = None
    runs = 0

    def rows(kind, keys, keeps, copies):
        n = len(copies)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n), pa.array([pid] * n, pa.int32()), pa.array(keys, pa.string()), pa.array(keeps, pa.string()), pa.array(copies, pa.string())],
            ["kind", "pid", "copy_key", "keep_id", "copy_id"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0), batch.column(1)
        n = len(keys)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        first_key = keys[0].as_py()
        new[0] = first_key != key
        same_id = np.zeros(n, bool)
        same_id[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        same_id[0] = ids[0].as_py() == last_id
        if runs == 0:
            head_key, head_keep = first_key, ids[0].as_py()
        run = np.cumsum(new) + runs
        firsts = np.flatnonzero(new)
        keep_of = [keep] * (0 if new[0] else 1) + ids.take(pa.array(firsts)).to_pylist()
        which = run - run[0]
        out = np.flatnonzero(~new & ~same_id)
        if len(out):
            in_head = run[out] == 1
            copies = ids.take(pa.array(out)).to_pylist()
            keeps = [keep_of[w] for w in which[out]]
            head = in_head.tolist()
            yield rows("copy", [first_key if h and runs == 0 else head_key if h else None for h in head], keeps, copies)
        runs = int(run[-1])
        key, keep, last_id = keys[n - 1].as_py(), keep_of[int(which[-1])], ids[n - 1].as_py()
    if runs:
        yield rows("head", [head_key], [head_keep], [str(runs)])
        yield rows("tail", [key], [keep], [last_id])


def formatting_copies(df: DataFrame, record_id: str = "record_id", text: str = "full_text", part_a: str = "problem_text", part_b: str = "action_text", partitions: int | None = None) -> DataFrame:
    """(keep_id, copy_id): each record that equals another but for blanks, case, signs or the order of its two parts.

    keep_id is the smallest id of the copies. Repeated rows of an id count
    once; null ids, null texts and texts without letters or digits have no
    copies; other columns are ignored, whatever their names. Keys are compared
    in full. Texts of any length are sorted whole.
    """
    spark = df.sparkSession
    records = canonical(df, record_id, text, part_a, part_b)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.select("copy_key", F.col("record_id").cast("string").alias("record_id")).repartitionByRange(parts, "copy_key", "record_id").sortWithinPartitions("copy_key", "record_id")
    scanned = cut(ordered.mapInArrow(_scan, _SCAN))
    carry: dict[int, str] = {}
    key = keep = last = None
    ends = scanned.filter("kind <> 'copy'").orderBy("pid", "kind").toLocalIterator()
    heads: dict[int, tuple[str, str, int]] = {}
    extra: list[tuple[str, str]] = []
    for row in ends:
        if row["kind"] == "head":
            heads[row["pid"]] = (row["copy_key"], row["keep_id"], int(row["copy_id"]))
            if row["copy_key"] == key:
                carry[row["pid"]] = keep
                if row["keep_id"] != last:
                    extra.append((keep, row["keep_id"]))
        else:
            went_on = row["pid"] in carry and heads[row["pid"]][2] == 1
            keep = carry[row["pid"]] if went_on else row["keep_id"]
            key, last = row["copy_key"], row["copy_id"]
    copies = scanned.filter("kind = 'copy'")
    if carry:
        known = spark.createDataFrame(list(carry.items()), "pid int, carried string")
        copies = copies.join(F.broadcast(known), "pid", "left").withColumn("keep_id", F.when(F.col("copy_key").isNotNull(), F.coalesce("carried", "keep_id")).otherwise(F.col("keep_id")))
    found = copies.select("keep_id", "copy_id").filter("keep_id <> copy_id")
    if extra:
        found = found.unionByName(spark.createDataFrame(extra, "keep_id string, copy_id string"))
    return _join_boundaries(records, found.distinct())


def _join_boundaries(records: DataFrame, found: DataFrame) -> DataFrame:
    """Joins groups whose texts agree in one order though their parts are divided at different places.

    Hashes of the orders only choose the few records that are looked at; these
    are compared by their whole texts.
    """
    forms = F.array_distinct(F.array(F.xxhash64("same"), F.xxhash64("turned")))
    hashed = records.select(F.xxhash64("copy_key").alias("k"), F.explode(forms).alias("form"))
    several = cut(hashed.groupBy("form").agg(F.min("k").alias("_a"), F.max("k").alias("_b")).filter("_a <> _b").select("form"))
    if several.isEmpty():
        return found
    whole = F.explode(F.array_distinct(F.array("same", "turned"))).alias("text")
    named = records.select(F.col("record_id").cast("string").alias("record_id"), "copy_key", whole).withColumn("form", F.xxhash64("text"))
    met = cut(named.join(sent(several), "form", "left_semi").select("record_id", "copy_key", "text"))
    keys = cut(met.groupBy("copy_key").agg(F.min("record_id").alias("node")))
    texts = met.select("copy_key", "text").distinct().join(keys, "copy_key").select("text", "node").distinct()
    least = texts.groupBy("text").agg(F.min("node").alias("a"), F.max("node").alias("_b")).filter("a <> _b").select("text", "a")
    links = texts.join(least, "text").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    merged = connected_components(links)
    linked = keys.join(merged, "node").select("copy_key", "component")
    touched = cut(records.join(sent(linked), "copy_key").select(F.col("record_id").cast("string").alias("record_id"), "component").distinct())
    first = touched.groupBy("component").agg(F.min("record_id").alias("keep_id"))
    again = touched.join(first, "component").filter("record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))
    rest = found.join(touched.select(F.col("record_id").alias("copy_id")), "copy_id", "left_anti").join(touched.select(F.col("record_id").alias("keep_id")), "keep_id", "left_anti")
    return rest.select("keep_id", "copy_id").unionByName(again)


def copy_counts(df: DataFrame, **names) -> DataFrame:
    """(keep_id, copies): one representative of every record, copied or not, with the exact number of ids that are copies of it."""
    record_id = names.get("record_id", "record_id")
    found = cut(formatting_copies(df, **names))
    single = df.select(F.col(record_id).cast("string").alias("keep_id")).filter("keep_id is not null").distinct()
    single = single.join(found.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    counted = found.groupBy("keep_id").agg(F.count("*").alias("n"))
    return single.join(counted, "keep_id", "left").select("keep_id", (F.coalesce("n", F.lit(0)) + 1).alias("copies"))
