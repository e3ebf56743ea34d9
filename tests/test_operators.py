"""Operators on small fixtures, with the values that results are known by."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hangarlake.functions import align
from hangarlake.functions import text as x
from hangarlake.operators import evaluate, graph, groups, records
from hangarlake.operators.components import connected_components
from hangarlake.operators.setjoin import similar_sets
from hangarlake.sources import tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def components_of(pairs):
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {a: root(a) for a in parent}


def test_components_of_chain_star_and_ring(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5), (3, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components_of([p for p in pairs if p[0] != p[1]])


def test_components_of_random_graph_with_nulls(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, "n1"), ("n2", None)], "a string, b string")).collect()}
    assert got == components_of([p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_key_drops_numbers_and_signs(spark):
    assert one(spark, x.near_key("a"), a="Found #2 cylinder, number 14 - LEAKING!") == "found cylinder leaking"
    assert one(spark, x.near_key("a"), a=None) == ""


@pytest.mark.parametrize("text, family", [("REPLACED GASKET", "Replace"), ("leak check good", "Inspect"), ("tightened hardware", "Adjust"), ("", "Other"), (None, "Other")])
def test_action_family(spark, text, family):
    assert one(spark, x.action_family("a"), a=text) == family


@pytest.mark.parametrize("text, kind", [("ops check good", "positive"), ("part deferred", "negative"), ("deferred, ops check good", "mixed"), ("", "unknown")])
def test_outcome(spark, text, kind):
    assert one(spark, x.outcome("a"), a=text) == kind


def test_locations(spark):
    assert one(spark, x.locations("a"), a="LH nose, no. 3 fwd") == ["left", "nose", "#3", "forward"]
    assert one(spark, x.locations("a"), a="fwd upper fwd no 3") == ["forward", "upper", "#3"]


@pytest.mark.parametrize("words, digits", [("one hundred and fifty rpm", "150 rpm"), ("one, two and three", "1, 2 and 3"), ("twelve hundred", "1200"), ("one hundred to one hundred and fifty", "100 to 150"), ("", "")])
def test_digitized(words, digits):
    assert align.digitized(words) == digits


@given(st.integers(0, 999_999))
def test_numbers_round_trip(n):
    assert align.digitized(align.number_in_words(n)) == str(n)


@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_word_distance_is_a_metric(a, b):
    d = align.word_distance(a, b)
    assert d == align.word_distance(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


@given(st.text(alphabet="ab 12#/'&.-", max_size=30))
def test_typed_tokens_cover_the_text(text):
    assert "".join(t[0] for t in align.typed_tokens(text)) == align.plain(text)


def test_greedy_spans_take_the_longest():
    assert align.greedy_spans([(0, 5, "a"), (3, 12, "b"), (12, 14, "c"), (13, 20, "d")]) == [(3, 12, "b"), (13, 20, "d")]


def test_bio_round_trip(spark):
    rows = spark.createDataFrame([("r", ["B-A", "I-A", "O", "I-B", "B-B", "I-A"]), ("e", [])], "ident string, bio array<string>")
    got = sorted((r["type"], r["begin"], r["end"]) for r in graph.spans_of_bio(rows, ["ident"]).collect())
    assert got == [("A", 0, 2), ("A", 5, 6), ("B", 3, 4), ("B", 4, 5)]


def test_keep_last_and_quotas(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w")], "k string, t int, v string")
    assert sorted(tuple(r) for r in records.keep_last(rows, ["k"], ["t"]).collect()) == [("a", 3, "y"), ("b", None, "w")]
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, n long")
    assert {r["g"]: r["quota"] for r in records.quotas(counts, "g", 7).collect()} == {"a": 4, "b": 2, "c": 1}


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b, c"):
        records.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b", "c"], "t")


def test_hashed_split_keeps_groups(spark):
    rows = groups.hashed_split(spark.range(2000).withColumn("g", (F.col("id") % 300).cast("string")), "g", [("train", 0.7), ("dev", 0.85), ("test", 1.0)], "s")
    assert groups.leaks(rows, "g", "assigned").count() == 0
    share = rows.groupBy("assigned").count().filter("assigned = 'train'").first()["count"] / 2000
    assert 0.6 < share < 0.8


def test_risk_coverage_matches_sorting(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03}", rng.choice([0.1, 0.5, 0.9, rng.random()]), rng.randrange(2)) for i in range(57)]
    got = {round(r["coverage"], 1): (r["rows"], r["accuracy"]) for r in evaluate.risk_coverage(spark.createDataFrame(rows, "k string, p double, y int"), "k").collect()}
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for c in range(1, 11):
        n = math.ceil(57 * c / 10)
        assert got[c / 10] == (n, round(sum(r[2] for r in ordered[:n]) / n, 6))


def test_set_join_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [f"e{rng.randrange(12)}" for _ in range(rng.randrange(9))]) for i in range(60)]
    got = {(r["a"], r["b"]) for r in similar_sets(spark.createDataFrame(rows, "k int, s array<string>"), "k", "s", 0.5).collect()}
    first = {}
    for k, s in rows:
        first.setdefault(frozenset(s), k)
    sets = {k: s for s, k in first.items() if s}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]) - 1e-9}
    assert got == true


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "", ["a"]), ("NA", 'say "x", y', [])], "ident string, text string, tags array<string>")
    for kind in ("parquet", "jsonl"):
        tables.write_table(rows, f"{tmp_path}/t.{kind}")
        assert tables.content_digest(tables.read_table(spark, f"{tmp_path}/t.{kind}").select("ident", "text", "tags")) == tables.content_digest(rows)
    tables.write_table(rows, f"{tmp_path}/t.csv")
    back = sorted(tuple(r) for r in tables.read_table(spark, f"{tmp_path}/t.csv").collect())
    assert back == [("1", "", '["a"]'), ("NA", 'say "x", y', "[]")]
    with pytest.raises(ValueError, match="suffix"):
        tables.read_table(spark, f"{tmp_path}/t.xlsx")


def test_numbered_places_are_dense(spark):
    rows = tables.numbered(spark.range(500).withColumn("o", F.col("id") * 7 % 500), "o")
    assert rows.filter("o <> _place").count() == 0


def test_trimmed_names_guard(spark):
    with pytest.raises(ValueError, match="a"):
        tables.trimmed_names(spark.range(1).select(F.col("id").alias("a"), F.col("id").alias(" a")))


def test_stream_counts_by_hour(spark, tmp_path):
    from hangarlake.streaming.register import first_deliveries, register_updates

    rows = spark.createDataFrame([("r1", "Leak at #1", "deferred", "2024-01-01 00:00:00"), ("r1", "Leak at #1", "deferred", "2024-01-01 01:00:00"), ("r2", "Leak at #2", "ops check good", "2024-01-02 00:00:00")], "record_id string, problem_text string, action_text string, received_at string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("first", first_deliveries(stream), "append"), ("reg", register_updates(stream), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("select record_id from first").count() == 2
    assert [tuple(r) for r in spark.sql("select near_key, work_orders, bad from reg").collect()] == [("leak at", 3, 2)]
