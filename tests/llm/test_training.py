"""The operators for training data against SQL, brute force and small fixtures with every kind of dirt."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hangarlake.llm import canonicalmap, chosenpath, crosssplit, exactcopies, groupsplits, oracle, queries, seedleaks, sharedspans, sourcemix, truncation
from hangarlake.llm import textvec as tv
from tests.oracle import connection, expected, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()
WORD = re.compile("[a-z0-9]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == expected(connection(FOLDER), SQL[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def corpus(rng, n, words=30, size=14):
    """Texts of few words, with copies, small edits, nulls, empty, short and long ones."""
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = (rng.choice(out)[1] or "x").split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
            out.append((f"r{i:04}", " ".join(w)))
        else:
            out.append((f"r{i:04}", " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, size)))))
    return [*out, ("r9000", None), ("r9001", ""), ("r9002", "..."), ("r9003", "W1, w2! w3"), ("r9004", "w1 w2 w3"), ("r9005", "w5 " * 3000), (None, "w1 w2 w3"), out[0]]


# word and shingle hashes


def test_hashes_depend_on_words_alone():
    a, b = tv.shingle_sets(["The QUICK, brown\tfox!", "x the-quick brown fox", None, "", "one two"], 3)
    sizes = np.diff(a).tolist()
    assert sizes == [2, 3, 0, 0, 0] and set(b[:2]) < set(b[2:5])
    long = "w " * 5 + "z" * 5000
    assert tv.shingle_sets([long], 3)[1].tolist() == tv.shingle_sets(["pad", long], 3)[1].tolist()


def test_signatures_and_maps():
    offsets, values = tv.shingle_sets(["a b c d", "D C B A", "a b c d!", ""], 3)
    s = tv.set_signatures(offsets, values)
    assert s[0] == s[2] != s[1] and s[3] == 0
    for wide in (True, False):
        maps = tv.bitmaps(offsets, values, wide)
        apart = sum(int(np.bitwise_count(m[0] ^ m[1])) for m in maps)
        assert apart <= 4 and all(m[0] == m[2] for m in maps)


# problem 1


def test_copies_with_every_kind_of_dirt(spark):
    rows = [
        ("b", "Oil leak. / Fixed it", "Oil leak.", "Fixed it"), ("a", "FIXED IT; oil-leak", "oil-leak", "FIXED IT"), ("a", "FIXED IT; oil-leak", "oil-leak", "FIXED IT"),
        ("c", "fixed it oil leak", None, "fixed it"), ("d", "oil leak fixed it", None, None), ("e", "oil leak", "oil leak", ""), ("f", "OIL LEAK", "OIL LEAK", None),
        ("g", None, None, None), ("h", "", "", ""), ("i", "...", "...", ""), (None, "oil leak", "oil leak", ""), ("j", "x" * 5000, "x" * 5000, ""), ("k", "X" * 5000, None, ""),
    ]
    df = spark.createDataFrame(rows, "record_id string, full_text string, problem_text string, action_text string")
    want = {("a", "b"), ("a", "c"), ("a", "d"), ("e", "f"), ("j", "k")}
    for parts in (1, 2, 7):
        assert {tuple(r) for r in exactcopies.formatting_copies(df, partitions=parts).select("keep_id", "copy_id").collect()} == want
    other = df.withColumn("keep_id", F.lit(1)).withColumn("copy_key", F.lit(2)).withColumn("pid", F.lit(3))
    assert exactcopies.formatting_copies(other).count() == len(want)
    counts = {r["keep_id"]: r["copies"] for r in exactcopies.copy_counts(df).collect()}
    assert counts["a"] == 4 and counts["e"] == 2 and counts["g"] == 1
    assert exactcopies.formatting_copies(df.limit(0)).count() == 0


def test_a_run_over_many_partitions(spark):
    df = spark.range(300).select(F.format_string("r%04d", "id").alias("record_id"), F.lit("Same text").alias("full_text"), F.lit("Same").alias("problem_text"), F.lit("text").alias("action_text"))
    rows = exactcopies.formatting_copies(df, partitions=6).collect()
    assert len(rows) == 299 and {r["keep_id"] for r in rows} == {"r0000"}


def test_boundaries_at_different_places_are_joined(spark):
    rows = [("a", "cd ab", "cd", "ab"), ("b", "c dab", "c", "dab"), ("z", "dab c", "dab", "c")]
    df = spark.createDataFrame(rows, "record_id string, full_text string, problem_text string, action_text string")
    assert {tuple(r) for r in exactcopies.formatting_copies(df).select("keep_id", "copy_id").collect()} == {("a", "b"), ("a", "z")}


# problem 2


def test_cut_texts_are_found(spark):
    rng = random.Random(5)
    items, faults, ends = ["pump", "fuel valve", "brake line", "oil cooler"], ["leaking", "cracked", "badly worn", "corroded"], ["near firewall", "on taxi", "in cruise", "at shutdown"]
    rows = []
    for i in range(4000):
        text = f"found {rng.choice(items)} tag {rng.randrange(10**5):05}x {rng.choice(faults)} {rng.choice(ends)}"
        cut = rng.random() < 0.03 and i % 2 == 0
        whole = text
        if i % 2:
            text = text[:38]
        elif cut:
            text = text[: rng.randrange(12, len(text) - 3)]
        rows.append((f"r{i}", "wide" if i % 2 else "free", text, None if i % 3 else "", whole != text))
    extra = [("x1", "free", None, None, False), ("x2", "free", "", " ", False), ("x3", None, "...", None, False), (None, "free", "found pump ta", None, True), ("x4", "free", "found pump tag 123" * 400, None, False)]
    df = spark.createDataFrame([r[:4] for r in rows + extra], "record_id string, dataset_id string, problem_text string, action_text string").withColumn("posterior", F.lit(1))
    got = {(r["record_id"], r["field_name"]) for r in truncation.truncated_fields(df).collect()}
    true = {(r[0], "problem_text") for r in rows if r[4]}
    assert len(got & true) > 0.9 * len(true) and len(got - true) < 0.03 * len(got)
    rates = {r["source"]: r for r in truncation.truncation_rates(df).filter("field_name = 'problem_text'").collect()}
    assert rates["wide"]["field_limit"] == 38 and rates["free"]["field_limit"] is None
    assert truncation.truncated_fields(df.limit(0)).count() == 0


def test_censored_lengths_recover_the_share():
    rng = np.random.default_rng(3)
    whole = np.round(rng.normal(55, 8, 200_000)).astype(int)
    size, n = np.unique(np.minimum(whole, 60), return_counts=True)
    _, cut = truncation.fit_lengths(size, n, 60)
    assert abs(cut - (whole > 60).sum() / (whole >= 60).sum()) < 0.05


# problem 3

TERMS = [(1, "component", "oil cooler"), (2, "component", "fuel pump"), (3, "component", "cooler"), (4, "component", "trim tab hinge"), (5, "fault", "fatigue crack")]
ALIASES = [("clr", "cooler"), ("hge", "hinge"), ("reg", "regulator"), ("reg", "register")]


@pytest.mark.parametrize("value, term", [("OIL COOLER", 1), ("oil-clr (new)", 1), ("cooler", None), ("the cooler!", 3), ("pump, fuel", 2), ("FUELPUMP", 2), ("fule pumb", 2), ("trim tab hge", 4), ("tirm tab hinge #4", 4), ("hinge trim tab", 4), ("coffee mug", 0), ("fuel truck", 0), ("", None), ("  ", None), (None, None), ("??", 0), ("oil cooler" + " x" * 4000, 1)])
def test_values_map(value, term):
    m = canonicalmap.Mapper([(i, t) for i, k, t in TERMS if k == "component"], ALIASES)
    assert m.map(value) == (term if value != "cooler" else None)


def test_mapping_of_dirty_arrays(spark):
    rows = [("r1", ["oil clr", None, "", "fuel pump", "mug"], None), ("r1", ["oil clr", None, "", "fuel pump", "mug"], None), ("r2", None, ["FATIGUE  CRACK", "crakc fatigue"]), (None, ["oil clr"], []), ("r3", [], [])]
    df = spark.createDataFrame(rows, "record_id string, components array<string>, fault_surfaces array<string>").withColumn("pos", F.lit(9)).withColumn("term_id", F.lit(9))
    terms = spark.createDataFrame(TERMS, "term_id long, kind string, term string")
    alias = spark.createDataFrame(ALIASES, "a string, b string")
    fields = {"components": "component", "fault_surfaces": "fault"}
    got = {tuple(r) for r in canonicalmap.map_values(df, terms, [alias], fields).collect()}
    assert got == {("r1", "components", 0, 1), ("r1", "components", 4, 0), ("r2", "fault_surfaces", 0, 5), ("r2", "fault_surfaces", 1, 5)}
    assert {tuple(r) for r in canonicalmap.unmatched_values(df, terms, [alias], fields).collect()} == {("components", "mug", 1)}
    assert canonicalmap.map_values(df, terms.limit(0), [alias], fields).filter("term_id <> 0").count() == 0
    assert canonicalmap.map_values(df.limit(0), terms, [alias], fields).count() == 0


# problem 4


def test_splits_keep_linked_records(spark):
    rows = [("r1", "c1", "train"), ("r1", "c2", " Train"), ("r2", "c2", "dev"), ("r3", "c3", "val"), ("r4", "c3", "VALIDATION"), ("r5", None, "test"), ("r6", None, None), (None, "c9", "test"), ("r7", "c9", "train"), ("r8", "c4", None), ("r8", "c5", "test"), ("r8", "c5", "")]
    df = spark.createDataFrame(rows, "record_id string, cluster_id string, split string").withColumn("unit", F.lit(0)).withColumn("label", F.lit(0))
    assert {r[0] for r in groupsplits.broken_units(df).collect()} == {"c1", "c2", "c9"}
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), (None, 0.1), ("none", 0.0)], "split string, target_share double")
    got = {r["record_id"]: r["split"] for r in groupsplits.grouped_splits(df, targets).collect()}
    assert set(got) == {f"r{i}" for i in range(1, 9)} and got["r1"] == got["r2"] and got["r3"] == got["r4"]
    many = spark.range(6000).select(F.format_string("r%d", "id").alias("record_id"), F.format_string("c%d", F.col("id") % 2500).alias("cluster_id"), F.lit("train").alias("split"))
    shares = {r["split"]: r["share"] for r in groupsplits.split_shares(many, targets.filter("target_share > 0.12")).collect()}
    assert all(abs(shares[s] - t) < 0.04 for s, t in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))
    assert groupsplits.broken_units(df.limit(0)).count() == 0


# problem 5


def groups_of(rows, k, t):
    sets = {i: shingles(x, k) for i, x in rows if i and x is not None}
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if likeness(sets[a], sets[b]) >= t:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    size = defaultdict(int)
    for i in ids:
        size[root(i)] += 1
    return {(root(i), i) for i in ids if size[root(i)] > 1}


@pytest.mark.parametrize("bucket, deep, depth", [(96, 4096, 4), (3, 4, 4), (2, 2, 2), (2, 2, 1)])
def test_groups_match_brute_force_at_every_depth(spark, bucket, deep, depth):
    rows = corpus(random.Random(11), 150)
    df = spark.createDataFrame(rows, "record_id string, text string").withColumn("sig", F.lit(0)).withColumn("label", F.lit(0)).repartition(3)
    how = {"bucket": bucket, "deep_bucket": deep, "max_depth": depth, "target_recall": 0.999999}
    got = {tuple(r) for r in chosenpath.near_duplicate_groups(df, "record_id", "text", 3, 0.5, **how).collect()}
    assert got == groups_of(rows, 3, 0.5)


def test_frequent_tokens_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(chosenpath, "BROADCAST_SETS", 0)
    rows = corpus(random.Random(12), 120)
    df = spark.createDataFrame(rows, "record_id string, text string")
    got = {tuple(r) for r in chosenpath.near_duplicate_groups(df, "record_id", "text", 3, 0.5, bucket=3, deep_bucket=4, target_recall=0.999999).collect()}
    assert got == groups_of(rows, 3, 0.5)
    assert chosenpath.near_duplicate_groups(df.limit(0), "record_id", "text").count() == 0


# problem 6


@pytest.mark.parametrize("k, t", [(3, 0.5), (2, 0.8), (1, 0.34)])
def test_cross_split_pairs_match_brute_force(spark, k, t):
    rng = random.Random(k)
    names = ["train", " TRAIN", "Train", "test", "dev", "val ", "Validation", None, "", "other"]
    rows = [(i, x, rng.choice(names)) for i, x in corpus(rng, 110)]
    rows += [("r0001", dict((a, b) for a, b, _ in rows)["r0001"], s) for s in ("train", "test")]
    df = spark.createDataFrame(rows, "record_id string, problem_text string, split string").withColumn("a", F.lit(0)).withColumn("part", F.lit(0))
    train, held, sets = set(), set(), {}
    for i, x, s in rows:
        if i and x is not None:
            sets[i] = shingles(x, k)
            name = (s or "").strip().lower()
            (train if name == "train" else held if name in ("test", "dev", "val", "validation") else set()).add(i)
    true = {(min(a, b), max(a, b)) for a in train for b in held if a != b and likeness(sets[a], sets[b]) >= t}
    got = [tuple(r) for r in crosssplit.cross_split_pairs(df, k=k, threshold=t, order_bits=8).collect()]
    assert set(got) == true and len(got) == len(true)
    assert crosssplit.cross_split_pairs(df.limit(0), k=k, threshold=t).count() == 0


# problem 7


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "short one"), (None, "x")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(80))]
        if rng.random() < 0.6:
            part = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.randrange(6, 20)]
            if rng.random() < 0.3 and len(part) > 8:
                part[4] = "other"
            w[3:3] = part
        docs.append((i, rng.choice(["{}", "  {}!", "{}\n"]).format(", ".join(w).upper() if i % 3 else " ".join(w))))
    docs += [(500, None), (501, ""), (None, "x"), docs[0], (502, "v1 " * 20000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: shingles(t, 12)
    held = [(i, grams(t)) for i, t in items if i is not None]
    read = [(j, grams(t)) for j, t in docs if j is not None]
    true = {(i, j) for i, a in held for j, b in read if a & b}
    for block in (1_000_000, 200):
        found = seedleaks.leaked_passages(d, q, block_words=block)
        assert {tuple(r) for r in found.filter("longest_run >= 12").select("item_id", "doc_id").collect()} == true
    assert seedleaks.leaked_passages(d, q.limit(0)).count() == 0 and seedleaks.leaked_passages(d.limit(0), q).count() == 0


def test_exchanged_words_are_tolerated(spark):
    text = [f"a{i}" for i in range(30)]
    other = ["z", *text[:9], "odd", *text[10:20]]
    d = spark.createDataFrame([(1, " ".join(other))], "doc_id long, text string")
    q = spark.createDataFrame([(5, " ".join(text))], "item_id long, text string")
    row = seedleaks.leaked_passages(d, q).first()
    assert row["longest_run"] == 10 and row["equal_words"] == 19 and row["stretch_words"] == 20


# problem 8


def test_mix_reaches_its_shares(spark):
    rng = random.Random(8)
    rows = [(i, s, rng.randrange(20, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 900 + ["small"] * 150 + ["none"] * 50)] + [(9000, None, 10), (9001, "big", 0)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("Big", 0.5, 2), ("mid ", 0.3, 4), ("SMALL", 0.2, 4), ("absent", 0.1, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    taken = sourcemix.mixed(counts, targets).collect()
    size = defaultdict(int)
    for r in taken:
        size[r["source"]] += r["tokens"] * r["copies"]
    total = sum(size.values())
    assert set(size) == {"big", "mid", "small"} and max(r["copies"] for r in taken) <= 4
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(size[s] / total - t) < 0.02
    assert sorted(map(tuple, sourcemix.mixed(counts.repartition(5), targets).collect())) == sorted(map(tuple, taken))
    assert sourcemix.mixed(counts.limit(0), targets).count() == 0 and sourcemix.mixed(counts, targets.limit(0)).count() == 0


def test_larger_documents_are_likelier(spark):
    counts = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 100).otherwise(900).cast("long").alias("tokens"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    taken = {r["tokens"]: r["count"] for r in sourcemix.mixed(counts, targets, total_tokens=2_000_000).groupBy("tokens").count().collect()}
    assert 2.6 < taken[900] / taken[100] < 3.4
    assert abs(100 * taken[100] + 900 * taken[900] - 2_000_000) < 100_000


@pytest.mark.skipif(not os.path.exists(sourcemix.VOCABULARY), reason="no vocabulary here")
def test_tokens_of_dirty_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world", "Work Log"), (1, "Hello world", "work_log"), (2, None, "x"), (3, "", None), (None, "a", "x"), (4, "<|endoftext|> " * 500, " WORK-log ")], "doc_id long, text string, source string").withColumn("tokens", F.lit(5))
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in sourcemix.token_counts(docs).collect()}
    assert got[1] == ("work_log", 2) and got[2] == ("x", 0) and got[3] == (None, 0) and got[4][0] == "work_log" and set(got) == {1, 2, 3, 4}


# problem 9


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(12)).capitalize() + rng.choice([". ", "!\n", "; "])
    pool = ["".join(sentence() for _ in range(n)) for n in (3, 4, 5, 6, 7, 8, 9, 12)]
    docs = []
    for i in range(60):
        text = "".join(sentence() for _ in range(rng.randrange(8)))
        for _ in range(rng.randrange(3)):
            part = rng.choice(pool)
            a = rng.randrange(60)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + part[a : len(part) - rng.randrange(60)] + text[at:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "ü" * 900), (103, "ü" * 900), (104, docs[5][1]), (105, docs[5][1]), (None, docs[5][1]), docs[7], (106, docs[3][1] * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sig", F.lit(0)).withColumn("kmer", F.lit(0)).repartition(3)
    windows = defaultdict(set)
    for i, t in docs:
        if i is not None and t:
            for k in range(len(t) - 399):
                windows[t[k : k + 400]].add(i)
    true = {(a, b) for v in windows.values() for a in v for b in v if a < b}
    got = [tuple(r) for r in sharedspans.shared_span_pairs(df).collect()]
    assert set(got) == true and len(got) == len(true)
    covered = defaultdict(set)
    for t, v in windows.items():
        if len(v) > 1:
            for i, text in docs:
                if i in v:
                    at = text.find(t)
                    while at >= 0:
                        covered[i].update(range(at, at + 400))
                        at = text.find(t, at + 1)
    shared = {r["doc_id"]: r["shared_chars"] for r in sharedspans.shared_parts(df).collect()}
    assert {i: n for i, n in shared.items() if n} == {i: len(v) for i, v in covered.items() if i != 106} | ({106: shared[106]} if shared.get(106) else {})
    assert sharedspans.shared_span_pairs(df.limit(0)).count() == 0 and sharedspans.shared_parts(df.limit(0)).count() == 0


def test_many_aliases_and_separate_mentions():
    aliases = [(f"{w}{i}", w) for w in ("alpha", "beta", "gamma", "delta") for i in range(9)] + [("abg", "alpha beta gamma"), ("de lta", "delta")]
    m = canonicalmap.Mapper([(1, "alpha beta gamma delta"), (2, "beta"), (3, "gamma delta")], aliases)
    assert m.map("alpha8 beta7 gamma6 delta8") == 1 and m.map("(abg) de-lta") == 1 and m.map("betas, alpha") == 2
    found = m.mentions(m.spaced, m.names, " beta3 and gamma0 delta1 ", 0)
    assert [t for *_, t in found] == [3, 2]


def test_spelling_candidates_match_brute_force():
    rng = random.Random(5)
    names = ["".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(60)]
    m = canonicalmap.Mapper([(i, n) for i, n in enumerate(names)], [])
    for _ in range(200):
        word = list(rng.choice(names))
        word[rng.randrange(len(word))] = rng.choice("abcdez")
        word = "".join(word)
        if word in m.spellings or word[:-1] in m.spellings:
            continue
        want = {n for n in set(names) if canonicalmap.distance(word, n, 9) <= int(max(len(n), len(word)) * 0.4)}
        assert want <= set(m._near(word))


@pytest.mark.parametrize("signs", ["0123456789", "01", "abcdef0123456789", "-", "ab ", "äöü"])
def test_every_span_of_the_least_length_has_a_common_kmer(signs):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices(signs, k=n))
    for _ in range(60):
        span = make(400)
        texts = [make(rng.randrange(300)) + span + make(rng.randrange(300)) for _ in range(2)]
        owner, _, _, value = sharedspans.kept_kmers(texts, 256, 6)
        assert set(value[owner == 0]) & set(value[owner == 1])
    with pytest.raises(ValueError):
        sharedspans._check_room(300, 256, 6)


def test_long_sets_of_frequent_words_are_found(spark):
    """Sets of many more frequent tokens than are looked at together, in every size ratio that the threshold allows."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = rng.sample(words, 160)
        rows.append((f"a{i:02}", " ".join(base)))
        other = base[: rng.choice([85, 110, 150])] + (rng.sample(sorted(set(words) - set(base)), 10) if i % 2 else [])
        rng.shuffle(other)
        rows.append((f"b{i:02}", " ".join(other)))
    df = spark.createDataFrame(rows, "record_id string, text string").repartition(2)
    assert chosenpath._turns(4, 0.5, 0.1, 0.999) > 1 == chosenpath._turns(4, 0.8, 0.1, 0.999)
    got = {tuple(r) for r in chosenpath.near_duplicate_groups(df, "record_id", "text", k=1, threshold=0.5, bucket=3, deep_bucket=8, max_depth=3).collect()}
    assert got == groups_of(rows, 1, 0.5)


@pytest.mark.parametrize("apart, least", [(4, 1.0), (5, 1.0), (7, 1.0), (9, 1.0), (3, 0.0)])
def test_recall_of_passages_with_exchanged_words(spark, apart, least):
    """Every ``apart``-th word exchanged: a stretch of 40 words has enough equal ones if at least three of four are."""
    rng = random.Random(apart)
    items, docs = [], []
    for i in range(60):
        words = [f"{rng.randrange(10**6)}" for _ in range(40)]
        shift = rng.randrange(apart)
        items.append((i, " ".join(words)))
        docs.append((i, " ".join(["x", "y", *(w if (j + shift) % apart else f"odd{j}" for j, w in enumerate(words)), "z"])))
    found = seedleaks.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).filter("item_id = doc_id")
    assert found.count() >= least * len(items)


def test_cut_texts_with_signs_marks_and_strays(spark):
    """Limits below a dozen stray lengths, cuts behind a comma and at a blank, marks put behind a cut, words that few texts have."""
    rng = random.Random(12)
    items = [f"{a} {b}" for a in ("outer", "inner", "spare", "main") for b in ("pump", "valve", "line", "cooler", "harness", "coupling")]
    rare = ["".join(rng.choices("bcdfghklmnprst", k=3)) + rng.choice(["ation", "ment", "ness"]) for _ in range(150)]
    rows, true = [], set()
    strays = set(range(1, 20000, 2600))
    for i in range(20000):
        whole = f"found {rng.choice(items)} with {rng.choice(rare)}, {rng.choice(['lever heavy', 'stain visible', 'smell present'])} on {rng.choice(['taxi', 'climb', 'runup', 'descent', 'cold start'])}" + rng.choice(["", "."])
        text, lost = whole, False
        if i in strays:
            text = whole.rstrip(".") + " still" * (4 + i // 2600)
        elif i % 2:
            text = whole[:52].rstrip()
            lost = len(text) < len(whole.rstrip("."))
        elif rng.random() < 0.04:
            text, lost = whole[: rng.randrange(15, len(whole) - 6)] + rng.choice(["", ">>", "~"]), True
        if lost:
            true.add(f"r{i}")
        rows.append((f"r{i}", "wide" if i % 2 else "free", text, None))
    df = spark.createDataFrame(rows, "record_id string, dataset_id string, problem_text string, action_text string")
    scored, limits = truncation.scored_endings(df, "record_id", "dataset_id", ["problem_text"])
    assert {(r["source"], r["limit"]) for r in limits.collect()} == {("wide", 52), ("free", -1)}
    got = {r["id"] for r in scored.filter("posterior >= 0.5").collect()}
    assert len(got & true) > 0.9 * len(true) and len(got - true) < 0.05 * len(got)


def test_planted_values_map():
    rng = random.Random(31)
    firsts, seconds = ["fuel", "oil", "brake", "rudder", "cowl", "magneto", "exhaust", "starter"], ["pump", "cooler", "cylinder", "pulley", "actuator", "harness", "manifold", "solenoid", "bulkhead", "linkage"]
    terms = [(i + 1, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in firsts for b in seconds)]
    short = {"cooler": "clr", "cylinder": "cyl", "actuator": "actr", "manifold": "mnfld", "solenoid": "sol"}
    m = canonicalmap.Mapper(terms, [(b, a) for a, b in short.items()])

    def dirty(name):
        words = [short.get(w, w) if rng.random() < 0.3 else w for w in name.split()]
        if rng.random() < 0.4:
            k = rng.randrange(len(words))
            if len(words[k]) > 4:
                at = rng.randrange(1, len(words[k]) - 1)
                words[k] = words[k][:at] + rng.choice([words[k][at + 1 :], rng.choice("aeiost") + words[k][at:], words[k][at + 1] + words[k][at] + words[k][at + 2 :]])
        if rng.random() < 0.3:
            words.reverse()
        text = rng.choice([" ", " ", "-", "  ", ""]).join(words)
        return rng.choice([text, text.upper(), f"the {text}", f"{text} (new)", f"#2 {text}!"])

    cases = [(t, v) for t, n in terms for _ in range(6) if (v := dirty(n)) != n] + [(0, v) for v in ("coffee mug", "unknown", "see notes", "n/a", "window blind")]
    right = sum((m.map(v) or 0) == t for t, v in cases)
    assert right >= 0.97 * len(cases), [(v, t, m.map(v)) for t, v in cases if (m.map(v) or 0) != t]
