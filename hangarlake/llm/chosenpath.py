"""Problem 5: near-duplicate records by a chosen-path similarity join.

Each text is the set of its runs of k words. A set goes to the buckets of its
tokens; two sets meet if they share a token. Buckets of up to ``bucket`` sets
are compared by brute force. Larger ones are split again: their sets go to the
buckets of sampled pairs of frequent tokens, then triples, and so on (these
buckets, of which there are fewer, may hold ``deep_bucket`` sets). A set
follows a level only while its frequent tokens alone can still reach the
threshold. What is crowded after the last level is compared exactly, in
blocks, and so are, on every level, the short sets of a crowded path that may
share no more tokens than it has. Sampling is by hash of the path, so all sets decide alike.

As in the variant of the method for skewed frequencies, paths are sampled the
more sparsely the more frequent they are: a rare token, whose bucket ends the
path at once, is always taken, since it may be the only one that two sets
share. On deeper levels one run samples each path with probability ``rate``;
runs are repeated until two sets at the threshold meet with the probability
``target_recall``. As runs differ only by their seeds, all of a set's runs are
carried out in one pass: a path is taken if any of them takes it. A set of very
many frequent tokens takes part with a sample of them, by hash of the token, and
so does the set it is compared with; such samples, too, are repeated until the
recall is reached.

Skew: equal sets are one set before anything is exchanged, and a map task
sends at most ``bucket`` sets of a token; of more it sends only word that the
token is crowded. No task ever holds a bucket of unbounded size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.llm import textvec as tv
from hangarlake.operators.components import connected_components
from hangarlake.session import cut

_U = np.uint64
#: Tokens that a map task gathers before it sends them; 8 bytes each.
SEGMENT = 1 << 21
#: Frequent tokens sent to every executor at most (8 bytes each); beyond it they are joined.
BROADCAST_TOKENS = 1 << 20
#: Signatures of candidate sets sent to every executor at most (8 bytes each); beyond it they are joined.
BROADCAST_SETS = 1 << 20
#: A bucket limit that nothing reaches.
_ALL = 1 << 40
_PATHS = "path long, sig long, pack long, more long"
#: Paths are kept in 48 bits: two that fall together only share a bucket.
_PATH_SHIFT = _U(16)
#: Subsets of a set's frequent tokens that are looked at for one level; of more tokens a sample is taken.
SUBSETS = 200_000


def _pack(sizes: np.ndarray, bits: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
    """48 bits of a set's map, its number of frequent tokens and its size (each as far as 254) in one long; -1 stands for a crowded path.

    On the first level all tokens count as frequent, and 64 more bits of the map
    go along. On deeper ones the map and the number are those of the frequent
    tokens: what two sets share otherwise has already brought them together.
    """
    some = sizes if frequent is None else frequent
    return bits | (np.minimum(some, 254).astype(np.uint64) << _U(8)) | np.minimum(sizes, 254).astype(np.uint64)


def _sampled(paths: np.ndarray, p, seed: int) -> np.ndarray:
    return (tv.mix(paths ^ _U(seed)) >> _U(11)).astype(np.float64) < np.asarray(p) * 2.0**53


def sampling_rate(shared, rate: float, target_recall: float):
    """The joint probability of a path under as many runs as ``shared`` chances need for the target recall."""
    shared = np.maximum(np.asarray(shared, np.float64), 1)
    runs = np.ceil(math.log1p(-target_recall) / (shared * math.log1p(-rate)))
    return 1 - (1 - rate) ** runs


def _emit(path: np.ndarray, sig: np.ndarray, pack: np.ndarray, more: np.ndarray, bucket: int):
    """Rows of a segment; a path that is crowded within it goes as one row."""
    path = path >> _PATH_SHIFT
    order = np.argsort(path, kind="stable")
    path, sig, pack, more = path[order], sig[order], pack[order], more[order]
    first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(path)]]))
    crowded = count > bucket
    keep = ~np.repeat(crowded, count)
    marks = path[first[crowded]]
    zero = np.zeros(len(marks), np.uint64)
    out = (np.concatenate([path[keep], marks]), np.concatenate([sig[keep], zero]), np.concatenate([pack[keep], ~zero]), np.concatenate([more[keep], zero]))
    for i in range(0, len(out[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(tv.to_long(x[i : i + (1 << 16)])) for x in out], ["path", "sig", "pack", "more"])


def _distinct_sets(batches, k: int, most: float = math.inf):
    """(signatures, packs, maps, sizes, offsets, tokens) of the distinct sets of each segment, of those of up to ``most`` tokens."""
    held: list[tuple] = []
    size = 0

    def join():
        sig = np.concatenate([h[0] for h in held])
        sizes = np.concatenate([np.diff(h[1]) for h in held])
        tokens = np.concatenate([h[2] for h in held])
        upper, other = (np.concatenate(x) for x in zip(*(tv.bitmaps(h[1], h[2], True) for h in held), strict=True))
        _, one = np.unique(sig, return_index=True)
        one = one[(sizes[one] > 0) & (sizes[one] <= most)]
        mask = np.zeros(len(sig), bool)
        mask[one] = True
        return sig[mask], _pack(sizes[mask], upper[mask]), other[mask], sizes[mask], np.concatenate([[0], np.cumsum(sizes[mask])]), tokens[np.repeat(mask, sizes)]

    for batch in batches:
        for _, texts in tv.slices(batch.column(0)):
            offsets, tokens = tv.shingle_sets(texts, k)
            held.append((tv.set_signatures(offsets, tokens), offsets, tokens))
            size += len(tokens)
            if size >= SEGMENT:
                yield join()
                held, size = [], 0
    if held:
        yield join()


def _first_level(k: int, bucket: int, most: float = math.inf):
    def run(batches):
        for sig, pack, more, sizes, _, tokens in _distinct_sets(batches, k, most):
            yield from _emit(tokens, np.repeat(sig, sizes), np.repeat(pack, sizes), np.repeat(more, sizes), bucket)

    return run


def _kept(level: int) -> int:
    """The frequent tokens of a set of which all subsets of ``level`` are looked at."""
    n = level
    while math.comb(n + 1, level) <= SUBSETS:
        n += 1
    return n


def _turns(level: int, threshold: float, rate: float, recall: float) -> int:
    """Independent samples of their tokens that two large sets need for the recall.

    Two sets at the threshold share that part of the smaller one's tokens; the
    larger one, by up to 1 / threshold, samples the more sparsely. What both
    keep is a Poisson number.
    """
    mean = _kept(level) * threshold**2
    p = float(sampling_rate(math.comb(max(level, int(mean)), level), rate, recall))
    missed = sum(math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1)) * (1 - p) ** math.comb(n, level) for n in range(int(mean + 20 * math.sqrt(mean)) + 20))
    return max(1, math.ceil(math.log1p(-recall) / math.log(min(max(missed, 1e-12), 0.9))))


def _thinned(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, level: int, threshold: float, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, owner, need): frequent tokens of the sets that can reach the threshold by them; need is how many two such sets share at least, or mostly if sampled.

    Of more than ``_kept`` a hash of the token chooses about as many, for two
    similar sets mostly the same; turns after the first are for such sets alone.
    """
    need = np.ceil(sizes * threshold - 1e-9).astype(np.int64)
    many = np.bincount(owner, minlength=len(sizes))
    keep = (many >= np.maximum(need, level))[owner]
    share = np.minimum(1.0, _kept(level) / np.maximum(many, 1))
    if turn or (share < 1).any():
        keep &= ((share[owner] >= 1) & (turn == 0)) | ((share[owner] < 1) & _sampled(tokens, share[owner], 0x77 + 0x1000 * turn))
    need = np.where(share < 1, np.maximum(level, (need * share * threshold).astype(np.int64)), need)
    return tokens[keep], owner[keep], need


def _subsets(tokens: np.ndarray, level: int, need: int, rate: float, recall: float, known: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the sampled subsets of ``level`` tokens in each row, without those of which a part was a small bucket.

    Only a part that every set in reach of the row's took as well counts: the
    larger of two similar sets needs up to 1 / threshold as many tokens, and
    samples its parts the more sparsely.
    """
    picks = np.array(list(combinations(range(tokens.shape[1]), level)))

    def path_of(columns):
        path = np.zeros((len(tokens), len(picks)), np.uint64)
        for j in columns:
            path = tv.mix(path * _U(0xD6E8FEB86659FD93) + tokens[:, picks[:, j]])
        return path

    path = path_of(range(level))
    keep = _sampled(path, sampling_rate(math.comb(need, level), rate, recall), 0x51 + level)
    if known is not None:
        p = sampling_rate(math.comb(int(need / threshold + 1e-9), level - 1), rate, recall)
        for left_out in range(level):
            part = path_of([j for j in range(level) if j != left_out])
            keep &= ~_sampled(part, p, 0x50 + level) | np.isin(part >> _PATH_SHIFT, known)
    row, column = np.nonzero(keep)
    return row, path[row, column]


def _deep_level(level: int, threshold: float, rate: float, recall: float, bucket: int, crowded: list[np.ndarray], k: int | None, most: float = math.inf):
    """Of texts, where k is given and the frequent tokens are sent along; else of (sig, size, frequent tokens). Only sets of up to ``most`` tokens."""
    known = crowded[level - 2] if level > 2 and len(crowded) >= level - 1 else None
    turns = _turns(level, threshold, rate, recall)

    def sets(batches):
        if k is not None:
            for sig, _, _, sizes, _, tokens in _distinct_sets(batches, k, most):
                frequent = np.isin(tokens >> _PATH_SHIFT, crowded[0])
                yield sig, sizes, tokens[frequent], np.repeat(np.arange(len(sig)), sizes)[frequent]
            return
        for batch in batches:
            lists = batch.column(2)
            many = np.diff(lists.offsets.to_numpy())
            sig, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield sig.view(np.uint64), sizes.astype(np.int64), lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sig)), many)

    def run(batches):
        for sig, sizes, tokens, owner in sets(batches):
            count = np.bincount(owner, minlength=len(sig))
            pack = _pack(sizes, tv.bitmaps(np.concatenate([[0], np.cumsum(count)]), tokens, False)[0], count)
            for turn in range(turns if (count > _kept(level)).any() else 1):
                some_tokens, some_owner, need = _thinned(tokens, owner, sizes, level, threshold, turn)
                order = np.lexsort((some_tokens, some_owner))
                some_tokens, some_owner = some_tokens[order], some_owner[order]
                many = np.bincount(some_owner, minlength=len(sig))
                first = np.concatenate([[0], np.cumsum(many)])[:-1]
                paths, whose = [], []
                usable = np.flatnonzero(many >= level)
                # Sets of like shape are one matrix.
                shapes = np.stack([many[usable], need[usable]], 1)
                for shape in np.unique(shapes, axis=0) if len(usable) else []:
                    alike = usable[(shapes == shape).all(1)]
                    step = max(1, (1 << 20) // math.comb(int(shape[0]), level))
                    for i in range(0, len(alike), step):
                        some = alike[i : i + step]
                        # The first turn's samples are those of the level before; others aren't, so nothing is known of their parts.
                        row, path = _subsets(some_tokens[first[some][:, None] + np.arange(shape[0])], level, int(shape[1]), rate, recall, known if turn == 0 else None, threshold)
                        paths.append(path)
                        whose.append(some[row])
                if paths:
                    who = np.concatenate(whose)
                    yield from _emit(np.concatenate(paths), sig[who], pack[who], np.zeros(len(who), np.uint64), bucket)

    return run


def _alike(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Whether two sets can reach the threshold, by their sizes and by the bits that differ; (sig, pack, more) of each."""
    (sig_a, pack_a, more_a), (sig_b, pack_b, more_b) = a, b
    na, nb = (pack_a & _U(255)).astype(np.int64), (pack_b & _U(255)).astype(np.int64)
    some = ((pack_a >> _U(8)) & _U(255)).astype(np.int64) + ((pack_b >> _U(8)) & _U(255)).astype(np.int64)
    apart = np.bitwise_count((pack_a ^ pack_b) >> _U(16)).astype(np.int64) + np.bitwise_count(more_a ^ more_b)
    long = (na == 254) | (nb == 254)
    fits = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (some - apart >= 2 * (na + nb) * threshold / (1 + threshold) - 1e-9)
    return (sig_a != sig_b) & (long | fits)


def _reach(packs: np.ndarray, threshold: float) -> np.ndarray:
    """Of each set what it allows of differing bits: two sets that are ``_alike`` differ in as many as both allow, at most."""
    n = (packs & _U(255)).astype(np.float32)
    some = ((packs >> _U(8)) & _U(255)).astype(np.float32)
    return np.where(n == 254, np.float32(np.inf), some - n * np.float32(2 * threshold / (1 + threshold)) + np.float32(0.01))


def _joined(batches, least: int):
    """The batches' four columns, together until they have ``least`` rows."""
    held: list[tuple] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(4)))
            rows += batch.num_rows
        if rows >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _compare(threshold: float, bucket: int):
    """Pairs of the buckets in a partition that is sorted by path; (path, null) of each crowded one."""

    def batch_of(a, b):
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    def run(batches):
        path = np.empty(0, np.uint64)
        sets, full = (path, path, path), False

        def settle(path, sets, full):
            """All whole runs of the arrays; ``full`` says that the first run was already crowded."""
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            count = np.diff(np.concatenate([first, [len(path)]]))
            marked = np.maximum.reduceat((sets[1] == _U(2**64 - 1)).astype(np.int8), first) > 0
            crowded = (count > bucket) | marked
            if full:
                crowded[0] = True
            heavy = path[first[crowded]]
            small = ~np.repeat(crowded, count)
            p, q = path[small], tuple(x[small] for x in sets)
            reach, bits, more = _reach(q[1], threshold), q[1] >> _U(16), q[2] if q[2].any() else None
            left, right = [], []

            def keep(i, j):
                """Of places side by side those of sets that are alike."""
                fits = _alike(tuple(c[i] for c in q), tuple(c[j] for c in q), threshold)
                left.append(q[0][i[fits]])
                right.append(q[0][j[fits]])

            def near(i, j):
                """Whether sets may be alike, by the bits that differ."""
                apart = np.bitwise_count(bits[i] ^ bits[j])
                if more is not None:
                    apart += np.bitwise_count(more[i] ^ more[j])
                return apart <= reach[i] + reach[j]

            sizes = count[~crowded]
            begins = np.cumsum(sizes) - sizes
            for begin, size in zip(begins[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
                for i in range(begin, begin + size, 256):
                    x, y = np.nonzero(near(np.arange(i, min(i + 256, begin + size))[:, None], np.arange(i, begin + size)[None, :]))
                    x, y = x[y > x], y[y > x]
                    keep(x + i, y + i)
            # Of the others each place with the ``step``-th after it, as long as that is of the same run.
            narrow = sizes <= 64
            at = np.flatnonzero(np.repeat(narrow, sizes))
            last = np.repeat((begins + sizes)[narrow], sizes[narrow])
            for step in range(1, int(sizes[narrow].max(initial=1))):
                inside = at + step < last
                at, last = at[inside], last[inside]
                some = at[near(at, at + step)]
                keep(some, some + step)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                if len(pairs):
                    yield batch_of(pa.array(tv.to_long(pairs[:, 0])), pa.array(tv.to_long(pairs[:, 1])))
            if len(heavy):
                yield batch_of(pa.array(tv.to_long(heavy)), pa.nulls(len(heavy), pa.int64()))

        for new in _joined(batches, max(1 << 17, 4 * min(bucket, 1 << 20))):
            path, *rest = (np.concatenate(x) for x in zip((path, *sets), new, strict=True))
            sets = tuple(rest)
            end = int(np.searchsorted(path.view(np.int64), path.view(np.int64)[-1], "left"))
            if end:
                yield from settle(path[:end], tuple(x[:end] for x in sets), full)
                path, sets, full = path[end:], tuple(x[end:] for x in sets), False
            if len(path) > bucket:
                full = True
                path, sets = path[:1], tuple(x[:1] for x in sets)
        if len(path):
            yield from settle(path, sets, full)

    return run


def _blocks(rows: DataFrame, crowded: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """Exact pairs of the buckets that the last level left crowded: blocks of a bucket against each other."""
    rows = cut(rows.join(crowded, "path", "left_semi").distinct())
    count = rows.groupBy("path").agg(F.ceil(F.count("*") / block).alias("parts"))
    rows = rows.join(count, "path").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    spread = rows.select(key.alias("path"), "sig", "pack", "more").repartition("path").sortWithinPartitions("path")
    return spread.mapInArrow(_compare(threshold, _ALL), "a long, b long").filter("b is not null")


def _arrays(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for begin, texts in tv.slices(batch.column(1)):
                offsets, tokens = tv.shingle_sets(texts, k)
                sig = tv.to_long(tv.set_signatures(offsets, tokens))
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), pa.array(sig), tv.list_array(offsets, tokens)], ["id", "sig", "tokens"])

    return run


def _signatures(k: int):
    def run(batches):
        for batch in _arrays(k)(batches):
            yield batch.select(["id", "sig"])

    return run


def _set_rows(df: DataFrame, text: str, k: int) -> DataFrame:
    rows = df.select(F.lit("").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_arrays(k), "id string, sig long, tokens array<long>")
    return rows.filter("sig <> 0").select("sig", "tokens")


def set_arrays(df: DataFrame, text: str, k: int) -> DataFrame:
    """(sig, tokens) of every distinct set."""
    return _set_rows(df, text, k).dropDuplicates(["sig"])


def verified(pairs: DataFrame, df: DataFrame, text: str, k: int, threshold: float) -> DataFrame:
    """(a, b, shared, size_a, size_b) of the candidate pairs (a, b) of signatures that reach the threshold exactly."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    small = wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    found = _set_rows(df, text, k).join(F.broadcast(wanted) if small else wanted, "sig", "left_semi").dropDuplicates(["sig"])
    left = found.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    right = found.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), F.size("ta").alias("size_a"), F.size("tb").alias("size_b"))
    return joined.filter(F.col("shared") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("shared")) - 1e-9)


def similar_sets(df: DataFrame, text: str, k: int = 5, threshold: float = 0.8, rate: float = 0.1, target_recall: float = 0.999, bucket: int = 96, deep_bucket: int = 4096, max_depth: int = 4) -> DataFrame:
    """(a, b, shared, size_a, size_b): the linked pairs of distinct shingle sets of ``text``, by signature."""
    spark = df.sparkSession
    texts = df.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    crowded: list[np.ndarray] = []
    found: list[DataFrame] = []
    frequent = None

    def paths(level: int, bucket: int, most: float = math.inf) -> DataFrame:
        if level == 1:
            return texts.mapInArrow(_first_level(k, bucket, most), _PATHS)
        if crowded:
            return texts.mapInArrow(_deep_level(level, threshold, rate, target_recall, bucket, list(crowded), k, most), _PATHS)
        return _joined_sets(texts, k, frequent, threshold).filter(F.col("size") <= most).mapInArrow(_deep_level(level, threshold, rate, target_recall, bucket, [], None), _PATHS)

    rows = paths(1, bucket)
    for level in range(1, max_depth + 1):
        limit = bucket if level == 1 else deep_bucket
        scanned = cut(rows.repartition("path").sortWithinPartitions("path").mapInArrow(_compare(threshold, limit), "a long, b long"))
        found.append(scanned.filter("b is not null"))
        heavy = scanned.filter("b is null").select(F.col("a").alias("path"))
        many = heavy.count()
        if not many:
            break
        if level == 1:
            frequent = heavy
        if level == max_depth:
            found.append(_blocks(paths(level, _ALL), heavy, threshold))
            break
        # Two different sets that share ``level`` tokens have no path on the next level; only short ones can reach the threshold so.
        if level + 1 <= level / threshold + 1e-9:
            found.append(_blocks(paths(level, _ALL, level / threshold + 1e-9), heavy, threshold))
        if many <= BROADCAST_TOKENS and len(crowded) == level - 1:
            crowded.append(np.sort(np.array(heavy.toArrow().column(0).to_numpy(), np.int64).view(np.uint64)))
        rows = paths(level + 1, deep_bucket)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return verified(pairs.distinct(), df, text, k, threshold)


def _joined_sets(texts: DataFrame, k: int, frequent: DataFrame, threshold: float) -> DataFrame:
    """(sig, size, frequent tokens) where those tokens are too many to send to every executor."""
    arrays = set_arrays(texts, "text", k).withColumn("size", F.size("tokens"))
    tokens = arrays.select("sig", "size", F.explode("tokens").alias("token"))
    tokens = tokens.withColumn("path", F.shiftrightunsigned("token", int(_PATH_SHIFT))).join(frequent, "path", "left_semi")
    sets = tokens.groupBy("sig", "size").agg(F.collect_list("token").alias("tokens"))
    sets = sets.filter(F.size("tokens") >= F.ceil(F.col("size") * threshold - 1e-9))
    return sets.select("sig", "size", "tokens")


def near_duplicate_groups(df: DataFrame, record_id: str, text: str, k: int = 5, threshold: float = 0.8, **how) -> DataFrame:
    """(group_id, record_id): every record of a group of two or more, linked through any number of steps.

    Two records are linked if the sets of runs of ``k`` words of their texts
    reach the Jaccard likeness ``threshold``; group_id is the group's smallest
    record id. Equal sets are linked even beyond the sampling. Nulls, empty
    texts and texts of fewer than k words are in no group; repeated rows of an
    id count once; other columns are ignored.
    """
    links = similar_sets(df, text, k, threshold, **how).select("a", "b")
    component = connected_components(links)
    ids = df.select(F.col(record_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    members = ids.mapInArrow(_signatures(k), "id string, sig long").filter("sig <> 0")
    members = cut(members.join(component, members["sig"] == component["node"], "left").select("id", F.coalesce("component", "sig").alias("label")))
    groups = members.groupBy("label").agg(F.min("id").alias("group_id"), F.max("id").alias("_last")).filter("group_id <> _last").select("label", "group_id")
    return members.join(groups, "label").select("group_id", F.col("id").alias("record_id")).distinct()
