"""The numeric parts of the chosen-path join: texts that stay in Arrow, and what a scan of buckets compares."""

import numpy as np
import pyarrow as pa

from hangarlake.llm import chosenpath, textvec


def test_p5_texts_in_arrow_are_those_of_python():
    import random

    rng, words = random.Random(1), ["AA", "b", "Ü", "É9", "İİ", "日本", "a\nb", "Kilo"]
    for _ in range(60):
        texts = [rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))]) for _ in range(rng.randrange(12))]
        for array in (pa.array(texts, pa.string()), pa.array([None, *texts, "q"], pa.string()).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            for k in (1, 3):
                assert all(np.array_equal(a, b) for a, b in zip(textvec.shingle_sets(texts, k), textvec.shingle_sets(array, k), strict=True))
            assert [(i, t.to_pylist()) for i, t in textvec.slices(array, 10)] == list(textvec.chunks(array, 10))


def test_p5_bits_are_compared_before_sizes(monkeypatch):
    """The pairs of a scan are those of comparing all places of each bucket; few of them are compared in full."""
    rng, none, looked = np.random.default_rng(5), np.uint64(2**64 - 1), []
    sets = [rng.choice(300, n, replace=False).astype(np.uint64) for n in rng.integers(2, 30, 400)]
    sets = [np.unique(s) for s in sets + [np.append(s, [900 + i]).astype(np.uint64) for i, s in enumerate(sets)]]
    sizes = np.array([len(s) for s in sets])
    upper, more = textvec.bitmaps(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets), True)
    sig, pack = np.arange(1, len(sets) + 1).astype(np.uint64), chosenpath._pack(sizes, upper)
    pack[7] |= np.uint64(0xFFFF) - np.uint64(0x101)  # a set of a size that is not known
    path = np.sort(np.concatenate([np.zeros(300), rng.integers(1, 9, 500)]).astype(np.uint64))
    alike = chosenpath._alike
    want = {tuple(sorted((int(sig[i]), int(sig[j])))) for i in range(len(sig)) for j in range(i) if path[i] == path[j] and alike(*[tuple(c[[x]] for c in (sig, pack, more)) for x in (i, j)], 0.5)[0]}
    monkeypatch.setattr(chosenpath, "_alike", lambda a, b, t: looked.append(len(a[0])) or alike(a, b, t))
    rows = pa.RecordBatch.from_arrays([pa.array(textvec.to_long(c)) for c in (path, sig, pack, more)], ["path", "sig", "pack", "more"])
    got = {(a, b) for batch in chosenpath._compare(0.5, 1 << 40)([rows]) for a, b in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True)}
    assert got == want and len(want) > 300 and none not in pack
    pairs = sum(n * (n - 1) // 2 for n in np.unique(path, return_counts=True)[1])
    assert sum(looked) < pairs / 3


def test_p5_short_sets_alone_are_sent_to_blocks():
    texts = ["a b", "a b c", "a b c d", "e f g h i j"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sent = [s for rows in chosenpath._first_level(2, 1 << 40, 2)([batch]) for s in rows.column(2).to_pylist()]
    assert sorted(s & 255 for s in sent) == [1, 2, 2]
