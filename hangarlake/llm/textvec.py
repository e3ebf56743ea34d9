"""Word and shingle hashes of whole text batches, vectorized over Arrow data.

A word is a longest run of a-z and 0-9 in the lower-cased text. All hashes are
64-bit and depend on the words alone, so they agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_TABLE = np.random.default_rng(20_240_611).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, grown when a longer word comes."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        grown = np.full(size, _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def _lowered(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each lowered text, their bytes with a line break after each)."""
    if isinstance(texts, pa.Array) and len(texts):
        texts = pc.fill_null(texts, "")
        # Other letters are lowered by Python, which may change their number.
        other = pc.invert(pc.string_is_ascii(texts))
        texts = pc.replace_with_mask(texts, other, pa.array([t.lower() for t in texts.filter(other).to_pylist()], texts.type))
        one = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar("\n", texts.type))[0].as_buffer()
        return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), _LOWER[np.concatenate([np.frombuffer(one, np.uint8), [10]])]
    lowered = [("" if t is None else t).lower().encode("utf-8", "surrogatepass") for t in texts]
    return np.fromiter(map(len, lowered), np.int64, len(lowered)), np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)


class Words:
    """Words of a run of texts: ``row`` and ``hash`` by word; byte spans relative to the row's lowered text."""

    def __init__(self, texts: list[str | None] | pa.Array):
        sizes, data = _lowered(texts)
        self.first_byte = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        word = _IS_WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        self.row = np.searchsorted(self.first_byte, start, "right") - 1
        self.rows = len(texts)
        if len(start):
            inside = np.flatnonzero(word)
            size = end - start
            place = inside - np.repeat(start, size)
            sums = _TABLE[data[inside]] * powers(int(size.max()))[place]
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            self.hash = mix(np.add.reduceat(sums, first) + size.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)
        self.start, self.end = start - self.first_byte[self.row], end - self.first_byte[self.row]


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position of the first word, hash) of every run of k words within one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * _U(0xD6E8FEB86659FD93) + words.hash[at + j]
    return words.row[at], at, mix(total)


def shingle_sets(texts: list[str | None] | pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): for each text its distinct runs of k words, ascending by hash."""
    words = Words(texts)
    row, _, value = gram_hashes(words, k)
    order = np.argsort(value)
    # Rows of a chunk mostly fit into 16 bits, which are sorted by their digits.
    order = order[np.argsort((row if len(texts) > 1 << 16 else row.astype(np.uint16))[order], kind="stable")]
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int64), value


def set_signatures(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash for each set; equal sets have equal hashes, the empty set has 0."""
    size = np.diff(offsets)
    total = np.zeros(len(size), np.uint64)
    full = size > 0
    if len(values):
        total[full] = np.add.reduceat(mix(values ^ _U(0xA0761D6478BD642F)), offsets[:-1][full])
    out = mix(total + size.astype(np.uint64))
    out[~full] = 0
    return out


def bitmaps(offsets: np.ndarray, values: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """A map of each set as the upper 48 bits of one number and, if ``wide``, 64 of another.

    The bits that differ between two maps number at most the elements that differ.
    """
    place = ((mix(values + _U(77)) >> _U(32)) * _U(112 if wide else 48)) >> _U(32)
    upper = np.where(place < _U(48), _U(1) << (place % _U(48) + _U(16)), _U(0))
    other = np.where(place >= _U(48), _U(1) << ((place - _U(48)) & _U(63)), _U(0))
    out = np.zeros(len(offsets) - 1, np.uint64), np.zeros(len(offsets) - 1, np.uint64)
    full = np.diff(offsets) > 0
    if len(values):
        for one, bits in zip(out, (upper, other), strict=True):
            one[full] = np.bitwise_xor.reduceat(bits, offsets[:-1][full])
    return out


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in runs of about ``limit`` characters; a longer text is a run of its own."""
    texts, begin, size = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        n = 1 if t is None else len(t) + 1
        if size and size + n > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts) or not texts:
        yield begin, texts[begin:]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """``chunks`` whose texts stay in Arrow."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin, before = 0, 0
    while begin < len(column) or not begin:
        end = max(int(np.searchsorted(ends, before + limit, "right")), begin + 1)
        yield begin, column.slice(begin, end - begin)
        begin, before = end, ends[min(end, len(column)) - 1] if len(column) else 0


def to_long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(to_long(values)))
