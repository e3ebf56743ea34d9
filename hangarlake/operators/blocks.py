"""Scores of many queries against many documents, block by block.

A pair of a query and a document is never a row: a task takes a partition of
documents in the order of their ids, makes the scores of one query after the
other as an array over its documents, and gives out only rows that can be in
the result. What the queries weigh is sent to every task, QUERIES at a time.
The time stays queries times documents; rows exchanged are queries times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.session import cut

#: Documents of a block, about, and queries of a pass.
BLOCK, QUERIES = 1 << 16, 20_000


class Channel(NamedTuple):
    """What each query weighs of each term, by the query's number."""

    terms: dict[str, int]
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def of(self, q: int) -> zip:
        part = slice(self.start[q], self.start[q + 1])
        return zip(self.term[part].tolist(), self.weight[part].tolist(), strict=True)


def channel(ids: pa.Array, weights: DataFrame) -> Channel:
    """Of (query_id, term, w)."""
    rows = weights.select("query_id", "term", F.col("w").cast("double").alias("w")).toArrow().combine_chunks()
    number = pc.index_in(rows["query_id"], ids).to_numpy()
    order = np.argsort(number, kind="stable")
    coded = pa.array(rows["term"].to_pylist(), pa.string()).dictionary_encode()
    terms = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
    return Channel(terms, np.searchsorted(number[order], np.arange(len(ids) + 1)), coded.indices.to_numpy()[order].astype(np.int64), rows["w"].to_numpy()[order])


def _coded(column: pa.ChunkedArray, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of a column of arrays, without terms that no query has."""
    arrays = column.combine_chunks()
    rows = np.repeat(np.arange(len(arrays)), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy())
    flat = arrays.flatten().dictionary_encode()
    known = np.array([terms.get(v, -1) for v in flat.dictionary.to_pylist()], np.int64)
    if not len(known):
        return rows[:0], known
    of = known[flat.indices.to_numpy()]
    return rows[of >= 0], of[of >= 0]


class Postings:
    """Of each term, the rows that have it and how often."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, n: int, size: int):
        keys, tf = np.unique(terms * n + rows, return_counts=True)
        of, self.rows = np.divmod(keys, max(n, 1))
        self.tf, self.start, self.n = tf.astype(np.float64), np.searchsorted(of, np.arange(size + 1)), n

    def scores(self, wanted: zip) -> np.ndarray:
        out = np.zeros(self.n)
        for term, weight in wanted:
            at = slice(self.start[term], self.start[term + 1])
            out[self.rows[at]] += weight * self.tf[at]
        return out


class Block:
    """Documents in the order of their ids, with the scores of each channel by a query's number.

    Channels: ``bm25`` over the column words, ``tfidf`` over words with norm_words, ``word`` over terms with norm_terms,
    ``char`` over the words in runs with norm_runs, ``struct`` over marks.
    """

    COLUMNS = {"bm25": "words", "tfidf": "words", "word": "terms", "char": "runs", "struct": "marks"}

    def __init__(self, table: pa.Table, shared: dict):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")]))
        self.table, self.n, self.ids, self.shared = table, table.num_rows, np.array(table["doc_id"].to_pylist(), object), shared
        self.postings = {}
        for name, c in shared["channels"].items():
            column = self.COLUMNS[name]
            if name == "char":
                self._runs(table[column], c)
                continue
            p = self.postings[name] = Postings(*_coded(table[column], c.terms), self.n, len(c.terms))
            if name == "bm25":
                size = pc.fill_null(pc.list_value_length(table[column]), 0).to_numpy()
                p.tf = p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * size[p.rows] / shared["mean"]))
            elif name in ("tfidf", "word"):
                p.tf = p.tf / table[f"norm_{column}"].to_numpy()[p.rows]

    def _runs(self, column: pa.ChunkedArray, c: Channel) -> None:
        """The runs of a word are looked up once for the block; a document's score is the sum of its words'."""
        arrays = column.combine_chunks()
        self.rows = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy())
        words = arrays.flatten().dictionary_encode()
        self.words, at, of = words.indices.to_numpy(), [], []
        for i, w in enumerate(words.dictionary.to_pylist()):
            w = f" {w} "
            found = [k for n in (3, 4, 5) for j in range(len(w) - n + 1) if (k := c.terms.get(w[j : j + n])) is not None]
            at += [i] * len(found)
            of += found
        self.norm = self.table["norm_runs"].to_numpy(zero_copy_only=False)
        self.postings["char"] = Postings(np.array(at, np.int64), np.array(of, np.int64), len(words.dictionary), len(c.terms))

    def scores(self, name: str, q: int) -> np.ndarray:
        out = self.postings[name].scores(self.shared["channels"][name].of(q))
        if name != "char":
            return out
        if not len(self.words):
            return np.zeros(self.n)
        sums = np.bincount(self.rows, out[self.words], self.n)
        return np.divide(sums, self.norm, out=np.zeros(self.n), where=sums > 0)

    def own(self, column: str) -> tuple[np.ndarray, dict[str, int]]:
        """A column as numbers, and the number of each value."""
        coded = self.table[column].combine_chunks().dictionary_encode()
        return coded.indices.to_numpy(), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Whole numbers in the order of the rounded scores."""
    return np.floor(scores * 10.0**digits + 0.5).astype(np.int64)


def best(keys: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest, of equal ones the first; in no order."""
    if len(keys) <= k:
        return np.arange(len(keys))
    last = np.partition(keys, len(keys) - k)[len(keys) - k]
    more = np.flatnonzero(keys > last)
    return np.concatenate([more, np.flatnonzero(keys == last)[: k - len(more)]])


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents kept for several passes, in partitions of about BLOCK rows, as many as there are cores at least."""
    docs = cut(docs)
    n = docs.count()
    return cut(docs.repartition(max(min(docs.sparkSession.sparkContext.defaultParallelism, n // 1024), -(-n // BLOCK), 1), "doc_id"))


def over_blocks(docs: DataFrame, shared: dict, schema: str, work: Callable[[Block], Iterator[tuple]]) -> DataFrame:
    """What ``work`` gives of each block, as rows."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows: list[tuple] = []
        for row in work(Block(pa.Table.from_batches(parts), sent.value)):
            rows.append(row)
            if len(rows) == 20_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return docs.mapInArrow(block, schema)


def passes(queries: DataFrame) -> list[pa.Array]:
    """The ids of the queries in order, QUERIES at a time."""
    ids = queries.select("query_id").toArrow()["query_id"].combine_chunks().unique()
    ids = ids.take(pc.sort_indices(ids))
    return [ids[i : i + QUERIES] for i in range(0, len(ids), QUERIES)]


def within(df: DataFrame, ids: pa.Array) -> DataFrame:
    return df.filter(F.col("query_id").between(ids[0].as_py(), ids[-1].as_py()))


# What the tasks give


def channel_ends(block: Block) -> Iterator[tuple]:
    """(query_id, least, greatest) of bm25 over all documents."""
    for q, query in enumerate(block.shared["ids"]):
        s = block.scores("bm25", q)
        yield query, float(s.min()), float(s.max())


def weighted_best(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, score, text_score) of the best documents of the block by a weighted sum of channels; bm25 scaled by its ends where they are known."""
    shared = block.shared
    for q, query in enumerate(shared["ids"]):
        score, other = np.zeros(block.n), np.zeros(block.n)
        for name in shared["channels"]:
            s = block.scores(name, q)
            if name == "bm25" and "ends" in shared:
                low, high = shared["ends"][query]
                s = (s - low) / (high - low) if high - low > 1e-12 else np.zeros(block.n)
            score += shared["weights"].get(name, 0.0) * s
            other += shared["text_weights"].get(name, 0.0) * s
        for i in best(rounded(score, 6), shared["k"]).tolist():
            yield query, block.ids[i], float(score[i]), float(other[i])


def _order(block: Block, name: str, q: int) -> np.ndarray:
    """Numbers whose ascending order is that of the ranks: by rounded score, then document."""
    return -rounded(block.scores(name, q), 9) * (block.n + 1) + np.arange(block.n)


def _among(block: Block, score: np.ndarray, docs: list[str]) -> np.ndarray:
    """The same numbers for documents of any block; one of another block comes before its place here."""
    return -score.astype(np.int64) * (block.n + 1) + np.searchsorted(block.ids, np.array(docs, object))


FUSED = ("bm25", "word", "char", "struct")


def fusion_start(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, its rounded scores): the best of the block by fused ranks within it, and in each channel documents at growing ranks, between which the others' ranks are bounded."""
    steps = [4**i - 1 for i in range(1, 20) if 4**i <= block.n]
    for q, query in enumerate(block.shared["ids"]):
        total, chosen, keys = np.zeros(block.n), set(), {}
        for name in FUSED:
            key = keys[name] = _order(block, name, q)
            order = np.argsort(key)
            rank = np.empty(block.n)
            rank[order] = np.arange(1, block.n + 1)
            total += 1 / (60 + rank)
            chosen |= set(order[steps].tolist())
        chosen |= set(best(rounded(total, 12), 5).tolist())
        for i in sorted(chosen):
            yield query, block.ids[i], *[float(-(int(keys[name][i]) // (block.n + 1))) for name in FUSED]


def fusion_ranks(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, in each channel the number of the block's documents before it) of the given documents."""
    for q, query in enumerate(block.shared["ids"]):
        docs, scores = block.shared["given"].get(query, ([], None))
        if docs:
            before = [np.searchsorted(np.sort(_order(block, name, q)), _among(block, scores[:, c], docs)) for c, name in enumerate(FUSED)]
            yield from zip([query] * len(docs), docs, *[b.tolist() for b in before], strict=True)


def fusion_rest(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, its rounded scores) of the documents that can be among the best, but were not given: their ranks are below those of the given ones before them."""
    for q, query in enumerate(block.shared["ids"]):
        docs, scores, ranks, least = block.shared["bounds"][query]
        bound, keys = np.zeros(block.n), {}
        for c, name in enumerate(FUSED):
            key = keys[name] = _order(block, name, q)
            at = np.lexsort((docs, -scores[:, c]))
            rank = np.concatenate([[0], ranks[at, c]])
            bound += 1 / (61 + rank[np.searchsorted(_among(block, scores[at, c], [docs[i] for i in at]), key, "right")])
        known = set(docs)
        for i in np.flatnonzero(bound >= least - 1e-11).tolist():
            if block.ids[i] not in known:
                yield query, block.ids[i], *[float(-(int(keys[name][i]) // (block.n + 1))) for name in FUSED]


def first_best(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, bm25, tfidf) of the block's best documents by bm25 that share a term."""
    for q, query in enumerate(block.shared["ids"]):
        s = block.scores("bm25", q)
        at = np.flatnonzero(s)
        at = at[best(rounded(s[at], 6), block.shared["k"])]
        other = block.scores("tfidf", q) if "tfidf" in block.shared["channels"] else s
        for i in at.tolist():
            yield query, block.ids[i], float(s[i]), float(other[i])


def cluster_best(block: Block) -> Iterator[tuple]:
    """(query_id, doc_id, score) of the best document by bm25 of each of the k best clusters of the block, without the query's own."""
    k, (cluster, numbers) = block.shared["k"], block.own("cluster")
    for q, query in enumerate(block.shared["ids"]):
        if query not in block.shared["facts"]:
            continue
        s = block.scores("bm25", q)
        s[cluster == numbers.get(block.shared["facts"][query][0], -1)] = 0.0
        at = np.flatnonzero(s)
        keys, size = rounded(s[at], 6), 8 * k
        while True:
            if size < len(keys):
                few = np.flatnonzero(keys >= np.partition(keys, len(keys) - size)[len(keys) - size])
            else:
                few = np.arange(len(keys))
            few = few[np.argsort(-keys[few], kind="stable")]
            firsts = np.sort(np.unique(cluster[at[few]], return_index=True)[1])[:k]
            if len(firsts) == k or len(few) == len(keys):
                break
            size *= 8
        for i in at[few[firsts]].tolist():
            yield query, block.ids[i], float(s[i])


def _strangers(block: Block) -> Iterator[tuple]:
    """(method, query, its rounded scores, those that count) for each channel, without the query's cluster."""
    cluster, numbers = block.own("cluster")
    for q, query in enumerate(block.shared["ids"]):
        if query in block.shared["facts"]:
            other = cluster != numbers.get(block.shared["facts"][query][0], -1)
            for method in block.shared["channels"]:
                s = block.scores(method, q)
                yield method, query, rounded(s, 6), (s > 0) & other


def best_right(block: Block) -> Iterator[tuple]:
    """(method, query_id, rounded score, doc_id) of the block's best document of the query's family; nulls where there are only others."""
    family, numbers = block.own("family")
    where = {name: np.flatnonzero(family == i) for name, i in numbers.items()}
    for method, query, keys, counted in _strangers(block):
        at = where.get(block.shared["facts"][query][1], family[:0])
        at = at[counted[at]]
        if len(at):
            i = at[np.argmax(keys[at])]
            yield method, query, float(keys[i]), block.ids[i]
        elif counted.any():
            yield method, query, None, None


def before_right(block: Block) -> Iterator[tuple]:
    """(method, query_id, number of documents before the given one)."""
    for method, query, keys, counted in _strangers(block):
        if (method, query) in block.shared["given"]:
            score, doc = block.shared["given"][method, query]
            place = np.searchsorted(block.ids, doc)
            yield method, query, int((counted & (keys > score)).sum() + (counted & (keys == score))[:place].sum())
