"""Problem 6: records of an evaluation split that are also, or almost, in the training split.

An exact prefix-filter join of two sides. Tokens are runs of k words; all sets
are ordered by how rare their tokens are, and two sets that reach the threshold
share a token among the first ``n - ceil(threshold * n) + 1`` of each. Evaluation
prefixes are the index, training prefixes probe it, with filters on size, on
the position of the shared token and on a 112-bit map of the set; what remains
is checked exactly. The order comes from a table of counters of the tokens, as
many as there are rows, within bounds. Counters may be shared and are held on a
logarithmic scale, which changes the order alike for all sets and so costs only
speed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.llm import chosenpath as cp
from hangarlake.llm import textvec as tv
from hangarlake.session import cut, sent

_U = np.uint64
#: The binary logarithm of the number of counters, one byte each, at least and at most.
ORDER_BITS = (16, 22)
#: Held-out prefixes of one token from which its pairs are made by several tasks.
PART = 2048


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tv.mix(tokens ^ _U(0xC0FFEE)) >> _U(64 - bits)).astype(np.int64)


def _count(k: int, bits: int):
    def run(batches):
        for *_, tokens in cp._distinct_sets(batches, k):
            n = np.bincount(_slots(tokens, bits), minlength=1 << bits)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["slot", "n"])

    return run


def _prefixes(k: int, threshold: float, bits: int, counts: np.ndarray):
    def run(batches):
        for sig, pack, more, sizes, offsets, tokens in cp._distinct_sets(batches, k):
            owner = np.repeat(np.arange(len(sig)), sizes)
            order = np.lexsort((tokens, counts[_slots(tokens, bits)], owner))
            place = np.arange(len(tokens)) - np.repeat(offsets[:-1], sizes)
            length = (sizes - np.ceil(sizes * threshold - 1e-9) + 1).astype(np.int64)
            take = place < np.repeat(length, sizes)
            token, who, place = tokens[order][take], owner[take], place[take]
            for i in range(0, len(token), 1 << 16):
                w = who[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tv.to_long(token[i : i + (1 << 16)])), pa.array(tv.to_long(sig[w])), pa.array(tv.to_long(pack[w])), pa.array(tv.to_long(more[w])), pa.array(place[i : i + (1 << 16)].astype(np.int32)), pa.array(sizes[w].astype(np.int32))],
                    ["token", "sig", "pack", "more", "place", "size"],
                )

    return run


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", F.col("sig").alias(name), F.col("pack").alias(f"pack_{name}"), F.col("more").alias(f"more_{name}"), F.col("place").alias(f"place_{name}"), F.col("size").alias(f"n_{name}"))


def similar_across(train: DataFrame, held: DataFrame, text: str, k: int, threshold: float, order_bits: int | None = None) -> DataFrame:
    """(a, b): signatures of the distinct sets of train and held-out texts that reach the threshold, equal ones included."""
    train = train.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    held = held.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    both = train.unionByName(held)
    bits = order_bits or min(max(int(both.count()).bit_length(), ORDER_BITS[0]), ORDER_BITS[1])
    total = both.mapInArrow(_count(k, bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.uint8)
    counts[total.column(0).to_numpy()] = np.minimum(np.round(6 * np.log2(1.0 + total.column(1).to_numpy())), 255)
    schema = "token long, sig long, pack long, more long, place int, size int"
    a = _side(train.mapInArrow(_prefixes(k, threshold, bits, counts), schema), "a")
    b = cut(_side(held.mapInArrow(_prefixes(k, threshold, bits, counts), schema), "b"))
    # A token of many held-out sets is divided into parts.
    hot = sent(cut(b.groupBy("token").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")))
    part = F.coalesce("parts", F.lit(1))
    b = b.join(hot, "token", "left").withColumn("part", F.pmod(F.col("b"), part).cast("int")).drop("parts")
    a = a.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), part - 1))).drop("parts")
    both = F.col("n_a") + F.col("n_b")
    least = F.ceil(both * (threshold / (1 + threshold)) - 1e-9)
    apart = F.bit_count(F.shiftrightunsigned(F.col("pack_a").bitwiseXOR(F.col("pack_b")), 16)) + F.bit_count(F.col("more_a").bitwiseXOR(F.col("more_b")))
    reach = (
        (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
        & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + F.least("place_a", "place_b") >= least)
        & (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-9)
    )
    pairs = cut(a.join(b, ["token", "part"]).filter((F.col("a") == F.col("b")) | reach).select("a", "b").distinct())
    equal = pairs.filter("a = b")
    return equal.unionByName(cp.verified(pairs.filter("a <> b"), train.unionByName(held), "text", k, threshold).select("a", "b"))


def split_name(column: str):
    """A split as written, without case and outer blanks; dev, val and validation are one."""
    name = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return F.when(name.isin("dev", "val", "validation"), F.lit("validation")).otherwise(name)


def _linked(df: DataFrame, record_id: str, text: str, split: str, k: int, threshold: float, train_split: str, held_splits: tuple[str, ...], **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links (a, b) of signatures, members (a, id_a) in train, members (b, id_b) held out)."""
    rows = df.select(F.col(record_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), split_name(split).alias("part")).filter("id is not null and text is not null")
    train, held = rows.filter(F.col("part") == train_split), rows.filter(F.col("part").isin(*held_splits))
    links = cut(similar_across(train, held, "text", k, threshold, **how))

    def members(side: DataFrame, name: str) -> DataFrame:
        return side.select("id", "text").mapInArrow(cp._signatures(k), "id string, sig long").filter("sig <> 0").select(F.col("sig").alias(name), F.col("id").alias(f"id_{name}")).distinct()

    return links, members(train, "a"), members(held, "b")


def cross_split_pairs(df: DataFrame, record_id: str = "record_id", text: str = "problem_text", split: str = "split", k: int = 5, threshold: float = 0.8, train_split: str = "train", held_splits: tuple[str, ...] = ("validation", "test"), **how) -> DataFrame:
    """(record_id_a, record_id_b): each pair of records, one in train and the other held out, whose texts reach the threshold.

    The smaller id comes first; a pair comes once. A record is in every split
    that any of its rows names. Rows of null id, text or split, and texts of
    fewer than k words, pair with nothing. Other columns are ignored.
    """
    links, train, held = _linked(df, record_id, text, split, k, threshold, train_split, held_splits, **how)
    right = cut(held.join(links.select("b").distinct(), "b", "left_semi"))
    # A set that many records have is divided into parts, so that its pairs are made by many tasks.
    parts = right.groupBy("b").agg(F.ceil(F.count("*") / 128).cast("int").alias("parts"))
    right = right.join(parts, "b").select("b", F.pmod(F.xxhash64("id_b"), F.col("parts")).cast("int").alias("part"), "id_b")
    left = links.join(parts, "b").join(train, "a").select("b", "id_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["b", "part"]).filter("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b")).distinct()


def overlap_report(df: DataFrame, source: str = "dataset_id", record_id: str = "record_id", text: str = "problem_text", split: str = "split", k: int = 5, threshold: float = 0.8, train_split: str = "train", held_splits: tuple[str, ...] = ("validation", "test"), **how) -> DataFrame:
    """(split, source, records, overlapping): of the held-out records of each split and source, how many are also in train.

    No pairs are made: of the training records that a held-out set is linked
    with, the least and the greatest id tell whether there is another one than
    the record itself.
    """
    links, train, held = _linked(df, record_id, text, split, k, threshold, train_split, held_splits, **how)
    ends = train.groupBy("a").agg(F.min("id_a").alias("low"), F.max("id_a").alias("high"))
    reach = links.join(ends, "a").groupBy("b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hit = held.join(reach, "b").filter("low <> id_b or high <> id_b").select(F.col("id_b").alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = df.select(F.col(record_id).cast("string").alias("id"), F.col(source).alias("source"), split_name(split).alias("part")).filter("id is not null").distinct()
    out = rows.filter(F.col("part").isin(*held_splits)).join(hit, "id", "left").groupBy(F.col("part").alias("split"), "source")
    return out.agg(F.count("*").alias("records"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))
