"""Problem 8: sources mixed to target weights by Pareto order sampling.

Each source is to bring its share of all tokens. The total is the largest that
every source can fill with its allowed repeats, unless one is given. Of what a
source must bring, whole copies of all its documents are certain; the rest is a
sample of fixed size with unequal probabilities, in proportion to the square
root of a document's tokens. Documents are ranked by random odds divided by
inclusion odds, and the first ones are taken. The cut in the ranking is found
from counts in fine classes of the rank, so no source is ever sorted whole.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangarlake.session import cut, sent

#: Fixed value: how the tokenizer's vocabulary divides a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Classes of the rank in each doubling.
CLASSES = 256
#: Sources in the targets at most.
SOURCES = 10_000


def _tokens(path: str):
    def run(batches):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [0 if t is None else len(encoder.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def source_name(column: str):
    """A source as written, in lower case, with one underscore for each run of other signs between its words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of each document; of repeated rows of an id the one with the least source and tokens counts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_name(source).alias("source"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    counted = rows.mapInArrow(_tokens(vocabulary), "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.source", "r.tokens")


def mixed(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that are taken at least once.

    ``counts`` has (doc_id, source, tokens); ``targets`` (source, target_share,
    max_repeats). Documents of sources without a positive target, of a null
    source or without tokens are not taken. A source without documents brings
    nothing and doesn't bound the total. With a given total a source that
    can't fill its part brings all copies that it may.
    """
    named = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("target_share > 0 and max_repeats > 0")
    plan = {r.source: (r.target_share, r.max_repeats) for r in named.limit(SOURCES + 1).collect()}
    if len(plan) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources in the targets")
    spark = counts.sparkSession
    docs = counts.filter("tokens > 0").join(F.broadcast(named.select("source").distinct()), "source", "left_semi").select("doc_id", "source", "tokens")
    # Sizes by source are all that the plan needs; the documents are read once for it.
    sizes = cut(docs.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("n")).collect()}
    total = total_tokens if total_tokens is not None else min((have[s] * plan[s][1] / plan[s][0] for s in have), default=0)
    need = {s: min(plan[s][1], plan[s][0] * total / have[s]) for s in have}
    rest = {s: need[s] - int(need[s] + 1e-9) for s in have}
    rest = {s: (f if f > 1e-9 else 0.0) for s, f in rest.items()}
    weight = F.sqrt(F.col("tokens").cast("double"))
    # The factor of each source, with documents whose probability would pass 1 taken for certain, until none is new.
    factor = dict.fromkeys(have, 0.0)
    for _ in range(30):
        sure = F.col("factor") * weight >= 1
        sums = _with(sizes, "factor", factor).groupBy("source").agg(F.sum(F.when(sure, F.col("tokens") * F.col("n")).otherwise(0)).alias("sure"), F.sum(F.when(sure, 0.0).otherwise(weight * F.col("tokens") * F.col("n"))).alias("w")).collect()
        new = {r.source: max(factor[r.source], (rest[r.source] * have[r.source] - r.sure) / r.w if r.w > 0 else factor[r.source]) for r in sums}
        if all(abs(new[s] - factor[s]) <= 1e-12 * max(1.0, new[s]) for s in new):
            break
        factor = new
    p = F.least(F.lit(1.0), F.col("factor") * weight)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    ranked = _with(docs, "factor", factor).withColumn("p", p).withColumn("u", u).filter("p > 0")
    # Certain ones come first, whatever their random number.
    rank = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    ranked = cut(ranked.withColumn("rank", rank).withColumn("class", F.when(F.col("rank") <= 0, -1_000_000).otherwise(F.floor(F.log2("rank") * CLASSES)).cast("long")).select("doc_id", "source", "tokens", "p", "rank", "class"))
    size = ranked.groupBy("source").agg(F.round(F.sum("p")).cast("long").alias("size"))
    classes = ranked.groupBy("source", "class").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    classes = cut(classes.withColumn("upto", upto).join(size, "source").withColumn("left", F.col("size") - (F.col("upto") - F.col("n"))).filter("left > 0").select("source", "class", "n", "left"))
    chosen = ranked.join(sent(classes), ["source", "class"])
    whole = chosen.filter("n <= left").select("doc_id")
    last = chosen.filter("n > left").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id"))).filter("place <= left").select("doc_id")
    extra = whole.unionByName(last).withColumn("extra", F.lit(1))
    out = _with(docs, "sure", {s: float(int(need[s] + 1e-9)) for s in have}).join(extra, "doc_id", "left").withColumn("copies", F.col("sure").cast("int") + F.coalesce("extra", F.lit(0)))
    return out.filter("copies > 0").select("doc_id", "source", "tokens", "copies") if have else spark.createDataFrame([], "doc_id long, source string, tokens long, copies int")


def _with(df: DataFrame, name: str, values: dict[str, float]) -> DataFrame:
    """``df`` with the value of each row's source; there is one for each source, of which there are ``SOURCES`` at most."""
    table = df.sparkSession.createDataFrame(list(values.items()), f"source string, {name} double")
    return df.join(F.broadcast(table), "source")


def mix_sources(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None, **names) -> DataFrame:
    return mixed(cut(token_counts(docs, vocabulary=vocabulary, **names)), targets, total_tokens)


def mix_shares(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None, **names) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share): the shares of all tokens that came about."""
    taken = mix_sources(docs, targets, vocabulary, total_tokens, **names)
    sums = taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").join(sums, "source", "left").withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return rows.withColumn("share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
