"""Problem 9: long verbatim spans shared between records, by compacting a De Bruijn graph.

A text is divided into tokens at places that depend only on the neighbouring
characters: of any ``PLACES`` places in a row the one whose four characters have
the least hash begins a token, so no token is longer, whatever the text is made
of. The graph's edges are token k-mers, each as many tokens as reach ``reach``
characters. Of each window of ``window`` k-mers that with the least hash is
kept, so texts that share a span keep the same ones within it. k-mers of one
text alone are dropped.

Of the others, each is linked to the next one in its text if the two overlap.
Paths without branches, where a k-mer has one successor and that has one
predecessor in all texts, become one by connected components over Spark joins.
Texts meet once for each such path, at its first k-mer, instead of once for
each k-mer, and source coordinates are extended sign by sign to the longest
verbatim span of the two. Where only the pairs are asked for, the characters
around the place go along instead of the texts, as many as can matter.

Equal texts, by their digests, are one text for all of this, so a text that
makes up a third of all rows is compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangarlake.llm import textvec as tv
from hangarlake.operators.components import connected_components
from hangarlake.session import cut, sent

_U = np.uint64
#: A token's greatest length.
PLACES = 16
_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        factor = _U(pow(int(tv._BASE), -1, 2**64))
        grown = np.full(max(n, 2 * len(_inverse), 4096), factor, np.uint64)
        grown[0] = 1
        _inverse = np.cumprod(grown, dtype=np.uint64)
    return _inverse[:n]


def _least(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """The places that hold the least hash of some ``window`` places in a row of one text; of equal ones the last."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64)
    key = (hashes & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - (np.arange(n).astype(np.uint64) & _U(0xFFFFFFFF)))
    size, best = 1, key
    while 2 * size <= window:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < window:
        best = np.minimum(best[: n - window + 1], best[window - size :][: n - window + 1])
    best = best[row[: n - window + 1] == row[window - 1 :]]
    return np.unique((_U(0xFFFFFFFF) - (best & _U(0xFFFFFFFF))).astype(np.int64))


def kept_kmers(texts: list[str], reach: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, size, hash) of the kept k-mers of a run of texts, in order."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    none = np.empty(0, np.int64)
    if len(code) < 4:
        return none, none, none, np.empty(0, np.uint64)
    near = np.zeros(len(code) - 3, np.uint64)
    for j in range(4):
        near = near * _U(0xD6E8FEB86659FD93) + code[j : len(code) - 3 + j]
    inside = np.flatnonzero(row[:-3] == row[3:])
    at = inside[_least(tv.mix(near[inside]), row[inside], PLACES)]
    ends = np.searchsorted(at, at + reach)
    whole = ends < len(at)
    whole[whole] = row[at[ends[whole]]] == row[at[whole]]
    at, ends = at[whole], at[ends[whole]]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(code + _U(1)) * tv.powers(len(code)), dtype=np.uint64)])
    value = tv.mix((sums[ends] - sums[at]) * _inverse_powers(len(code))[at])
    owner = row[at]
    keep = _least(value, owner, window)
    # Texts of fewer k-mers than a window keep them all.
    few = np.bincount(owner, minlength=len(texts)) < window
    keep = np.union1d(keep, np.flatnonzero(few[owner])) if len(owner) else none
    at, ends, value, owner = at[keep], ends[keep], value[keep], owner[keep]
    if len(at) > 2:
        # Of a run of equal k-mers, as one sign repeated gives, the first and the last are enough.
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        inner = np.zeros(len(at), bool)
        inner[1:-1] = same[:-1] & same[1:]
        at, ends, value, owner = at[~inner], ends[~inner], value[~inner], owner[~inner]
    return owner, at - first[owner], ends - at, value


def _occurrences(reach: int, window: int):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            digests = batch.column(0).to_pylist()
            for begin, texts in tv.chunks(batch.column(1)):
                new = []
                for i in range(len(texts)):
                    if digests[begin + i] not in seen:
                        seen.add(digests[begin + i])
                        new.append(i)
                if len(seen) > 2_000_000:
                    seen.clear()
                owner, at, size, value = kept_kmers([texts[i] for i in new], reach, window)
                sig = pa.array([digests[begin + i] for i in new], pa.binary()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(tv.to_long(value)), sig, pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["kmer", "sig", "at", "size"])

    return run


def _extended(least: int):
    """The longest equal stretch through two places of two texts, in characters; ``skip`` characters of each were left out before."""

    def common(a: str, b: str) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        low, high = 0, n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
        return low

    def run(batches):
        for batch in batches:
            rows = []
            for sa, sb, pa_, pb, ta, tb, ka, kb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                right = common(ta[pa_ - ka :], tb[pb - kb :])
                left = common(ta[: pa_ - ka][::-1], tb[: pb - kb][::-1])
                if right and left + right >= least:
                    rows.append((sa, sb, pa_ - left, pb - left, left + right))
            if rows:
                types = [pa.binary(), pa.binary(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "b", "at_a", "at_b", "size"])

    return run


def compacted(occurrences: DataFrame) -> DataFrame:
    """The occurrences (kmer, sig, at, size) at which paths without branches begin; each k-mer occurs in two texts at least."""
    order = Window.partitionBy("sig").orderBy("at")
    next_kmer, next_at = F.lead("kmer").over(order), F.lead("at").over(order)
    steps = occurrences.select("kmer", "sig", "at", F.when(next_at <= F.col("at") + F.col("size"), next_kmer).alias("next"))
    steps = steps.withColumn("step", F.when(F.col("next").isNotNull(), F.lead("at").over(order) - F.col("at")))
    ahead = steps.groupBy("kmer").agg(F.min("next").alias("next"), F.max("next").alias("_next"), F.min("step").alias("step"), F.max("step").alias("_step"), F.count("*").alias("n"), F.count("next").alias("followed"))
    one_next = ahead.filter("n = followed and next = _next and step = _step").select("kmer", "next")
    back = steps.filter("next is not null").groupBy("next").agg(F.min("kmer").alias("kmer"), F.max("kmer").alias("_kmer"), F.count("*").alias("preceded"))
    counts = ahead.select(F.col("kmer").alias("next"), F.col("n").alias("n_next"))
    one_back = back.join(counts, "next").filter("kmer = _kmer and preceded = n_next").select("kmer", "next")
    links = cut(one_next.join(one_back, ["kmer", "next"], "left_semi").filter("kmer <> next"))
    # A path's first k-mer is no one's only successor; a ring has none, so its least k-mer stands for it.
    inner = links.select(F.col("next").alias("kmer")).distinct()
    heads = occurrences.select("kmer", "sig", "at", "size").join(inner, "kmer", "left_anti")
    paths = connected_components(links.select(F.col("kmer").alias("a"), F.col("next").alias("b")))
    opened = paths.join(links.select(F.col("next").alias("node")).distinct(), "node", "left_anti").select("component").distinct()
    rings = paths.join(opened, "component", "left_anti").filter("node = component").select(F.col("node").alias("kmer"))
    return heads.unionByName(occurrences.select("kmer", "sig", "at", "size").join(rings, "kmer", "left_semi"))


def _spans(docs: DataFrame, least: int, reach: int, window: int, whole: bool) -> DataFrame:
    """(a, b, at_a, at_b, size) of the verbatim spans of different texts, by their digests; ``docs`` has (id, t, sig).

    The spans are followed to their ends if ``whole``, else ``least`` characters far on both sides.
    """
    texts = docs.select("sig", "t")
    found = texts.mapInArrow(_occurrences(reach, window), "kmer long, sig binary, at int, size int")
    repeated = cut(found.groupBy("kmer").agg(F.min("sig").alias("_a"), F.max("sig").alias("_b")).filter("_a <> _b").select("kmer"))
    occurrences = cut(found.join(sent(repeated), "kmer", "left_semi").distinct())
    heads = cut(compacted(occurrences))
    skip = F.lit(0) if whole else F.greatest(F.lit(0), F.col("at") - least)
    around = F.col("t") if whole else F.substring("t", skip + 1, F.col("at") - skip + F.col("size") + least)
    one = texts.join(sent(heads.select("sig").distinct()), "sig", "left_semi").dropDuplicates(["sig"])
    placed = one.join(heads, "sig").select("kmer", "sig", "at", skip.cast("int").alias("skip"), around.alias("t"))
    # A head that many texts have is divided into parts, so that its pairs are made by many tasks.
    parts = sent(heads.groupBy("kmer").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts")))
    placed = placed.join(parts, "kmer")
    side = lambda x, y: [F.col("sig").alias(x), F.col("at").alias(f"at_{x}"), F.col("skip").alias(f"skip_{x}"), F.col("t").alias(f"t{x}"), y.alias("part")]
    left = placed.select("kmer", *side("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    right = placed.select("kmer", *side("b", F.pmod(F.xxhash64("sig", "at"), F.col("parts")).cast("int")))
    both = left.join(right, ["kmer", "part"]).filter("a < b")
    return both.select("a", "b", "at_a", "at_b", "ta", "tb", "skip_a", "skip_b").mapInArrow(_extended(least), "a binary, b binary, at_a long, at_b long, size long").distinct()


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and t is not null")
    return rows.withColumn("sig", F.substring(F.unhex(F.sha2("t", 256)), 1, 20))


def _check_room(least: int, reach: int, window: int) -> None:
    """A span must hold ``window`` k-mers: each begins within a token's length of the one before and ends within one beyond ``reach``."""
    if (window + 1) * PLACES + 2 + reach + PLACES > least:
        raise ValueError(f"spans of {least} characters hold no {window} k-mers of {reach}")


def shared_span_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 400, reach: int = 256, window: int = 6) -> DataFrame:
    """(doc_id_a, doc_id_b): each pair of documents with ``least`` or more consecutive characters verbatim in common.

    The smaller id comes first. Nulls and texts shorter than ``least`` pair
    with nothing; repeated rows count once; equal texts pair with each other.
    ``least`` must leave room for a window of k-mers beyond ``reach``, else a
    ValueError says so; then every span is found, whatever it is made of. Ids
    are whole numbers; other columns are ignored.
    """
    _check_room(least, reach, window)
    rows = _prepared(docs, doc_id, text).filter(F.length("t") >= least)
    spans = _spans(rows, least, reach, window, whole=False).select("a", "b").distinct()
    members = cut(rows.select("id", "sig").distinct())
    size = members.groupBy("sig").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"), F.count("*").alias("n"))
    equal = size.filter("n > 1").select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    links = spans.unionByName(equal).join(size.select(F.col("sig").alias("b"), "parts"), "b")
    left = links.join(members.select(F.col("sig").alias("a"), F.col("id").alias("x")), "a").select("b", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = members.join(size, "sig").select(F.col("sig").alias("b"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("y"))
    pairs = left.join(right, ["b", "part"]).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 400, reach: int = 256, window: int = 6) -> DataFrame:
    """(doc_id, chars, shared_chars, share): how much of each document stands in spans that another one has too.

    Overlapping spans count once. A text that several documents have is shared
    whole if it has ``least`` characters. An empty text has the share 0.
    """
    _check_room(least, reach, window)
    rows = _prepared(docs, doc_id, text)
    long = rows.filter(F.length("t") >= least)
    spans = cut(_spans(long, least, reach, window, whole=True))
    ends = spans.select(F.col("a").alias("sig"), F.col("at_a").alias("at"), "size").unionByName(spans.select(F.col("b").alias("sig"), F.col("at_b").alias("at"), "size")).distinct()
    before = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("sig").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce(before, F.lit(0))))
    covered = ends.withColumn("own", own).groupBy("sig").agg(F.sum("own").alias("covered"))
    members = rows.select("id", "sig", F.length("t").cast("long").alias("chars")).distinct()
    copies = members.groupBy("sig").agg(F.count("*").alias("n"))
    out = members.join(copies, "sig").join(covered, "sig", "left")
    shared = F.when((F.col("n") > 1) & (F.col("chars") >= least), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select(F.col("id").alias("doc_id"), "chars", shared.alias("shared_chars"), F.coalesce(shared / F.nullif("chars", F.lit(0)), F.lit(0.0)).alias("share"))
