"""Problem 7: evaluation texts that leak into training text, by spaced seeds.

A seed is a hash of the words at a mask's marked positions; the unmarked ones
may differ. The seeds of all evaluation texts are sorted and sent to the
executors; each training text's seeds are looked up there, and around every hit
the two texts are compared along the whole diagonal: the longest run of equal
words, and the best stretch where a differing word costs as much as two equal
ones bring. Every mask spans at most ``min_words`` words, so an unbroken run of
that length is always hit. Training texts are read once, in place, and never
exchanged; only the matches are.

Evaluation texts beyond ``block_words`` words are handled in blocks of that
size, one pass over the training texts each, so what is sent has a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.llm import textvec as tv

_U = np.uint64
#: Masks by falling span; the fourth and its like fit where every fourth word is exchanged.
MASKS = ("110110101011", "101110010111", "11101001011", "11101110111", "1101100101", "1110111", "1101011", "11011", "1011", "111", "11", "1")
#: Masks in use: the first so many that span no more than the least passage.
MASKS_USED = 4
BLOCK_WORDS = 2_000_000
#: Places of equal seeds that are unfolded at once.
_UNFOLDED = 1 << 20


def seeds(words: tv.Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, seed hash) wherever the mask fits into a text."""
    n = len(words.hash) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[len(mask) - 1 :])
    total = np.full(len(at), len(mask), np.uint64)
    for j, marked in enumerate(mask):
        if marked == "1":
            total = total * _U(0xD6E8FEB86659FD93) + words.hash[at + j]
    return at, tv.mix(total)


class Index:
    """Seeds and word hashes of a block of evaluation texts."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...]):
        words = tv.Words(texts)
        self.ids, self.masks, self.hash = np.array(ids, np.int64), masks, words.hash
        size = np.bincount(words.row, minlength=len(texts))
        self.first, self.size = np.concatenate([[0], np.cumsum(size)])[:-1], size
        self.tables = []
        for mask in masks:
            at, value = seeds(words, mask)
            order = np.argsort(value, kind="stable")
            at, value = at[order], value[order]
            distinct, first = np.unique(value, return_index=True)
            self.tables.append((distinct, np.concatenate([first, [len(value)]]), words.row[at], at - self.first[words.row[at]] if len(at) else at))


def _matches(index: Index, words: tv.Words, bounds: np.ndarray):
    """(text, item, longest run, words of the best stretch, equal ones in it) of each diagonal with a hit."""
    found = []
    for mask, (distinct, first, item, place) in zip(index.masks, index.tables, strict=True):
        if not len(distinct):
            continue
        at, value = seeds(words, mask)
        slot = np.minimum(np.searchsorted(distinct, value), len(distinct) - 1)
        hit = np.flatnonzero(distinct[slot] == value)
        if not len(hit):
            continue
        many = first[slot[hit] + 1] - first[slot[hit]]
        # Seeds of repetitive texts meet often; they are unfolded in steps, of which the distinct diagonals stay.
        steps = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), _UNFOLDED)))
        for begin, end in zip(steps, np.append(steps[1:], len(many)), strict=True):
            where, n = hit[begin:end], many[begin:end]
            entry = np.repeat(first[slot[where]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = np.stack([words.row[np.repeat(at[where], n)], item[entry], np.repeat(at[where], n) - place[entry]], 1)
            found.append(np.unique(rows, axis=0))
    if not found:
        return np.empty((0, 5), np.int64)
    diagonal = np.unique(np.concatenate(found), axis=0)
    out = np.zeros((len(diagonal), 5), np.int64)
    for begin in range(0, len(diagonal), 4096):
        row, item, start = diagonal[begin : begin + 4096].T
        run, best, score, span, longest, equal_in, stretch = (np.zeros(len(row), np.int64) for _ in range(7))
        same, best_same = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for j in range(int(index.size[item].max(initial=0))):
            here = start + j
            inside = (j < index.size[item]) & (here >= bounds[row]) & (here < bounds[row + 1])
            equal = inside & (words.hash[np.clip(here, 0, len(words.hash) - 1)] == index.hash[np.minimum(index.first[item] + j, len(index.hash) - 1)])
            run = np.where(equal, run + 1, 0)
            longest = np.maximum(longest, run)
            score = np.where(equal, score + 1, score - 2)
            over = (score <= 0) | ~inside
            score, span, same = np.where(over, 0, score), np.where(over, 0, span + 1), np.where(over, 0, same + equal)
            better = score > best
            best, stretch, best_same = np.where(better, score, best), np.where(better, span, stretch), np.where(better, same, best_same)
        out[begin : begin + 4096] = np.stack([row, item, longest, stretch, best_same], 1)
    return out


def _probe(index: Index, min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for begin, texts in tv.chunks(batch.column(1)):
                words = tv.Words(texts)
                bounds = np.searchsorted(words.row, np.arange(len(texts) + 1))
                found = _matches(index, words, bounds)
                found = found[np.maximum(found[:, 2], found[:, 4]) >= min_words]
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index.ids[found[:, 1]]), ids.take(pa.array(found[:, 0] + begin)).cast(pa.int64()), *(pa.array(found[:, i]) for i in (2, 3, 4))],
                        ["item_id", "doc_id", "longest_run", "stretch_words", "equal_words"],
                    )

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, longest_run, stretch_words, equal_words) of each text and evaluation item that share a passage.

    A passage has at least ``min_words`` equal words, in one unbroken run
    (``longest_run``) or with single words exchanged (``equal_words`` of a
    stretch of ``stretch_words``). Runs are always found; a stretch with
    exchanged words is found if a mask fits it, as where every fourth word or
    fewer are exchanged. Items and texts of fewer words,
    nulls and empty texts match nothing; repeated rows count once. Ids are whole numbers.
    """
    masks = tuple(m for m in masks if len(m) <= min_words)[:MASKS_USED]
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).filter("id is not null and t is not null").distinct()
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).filter("id is not null and t is not null")
    size = items.agg(F.sum(F.size(F.split("t", "[^A-Za-z0-9]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_words))
    parts = None
    for block in range(blocks):
        own = (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block)).toPandas()
        index = Index(own["id"].tolist(), own["t"].tolist(), masks)
        one = docs.mapInArrow(_probe(index, min_words), "item_id long, doc_id long, longest_run long, stretch_words long, equal_words long")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("item_id", "doc_id").agg(F.max("longest_run").alias("longest_run"), F.max_by("stretch_words", "equal_words").alias("stretch_words"), F.max("equal_words").alias("equal_words"))
