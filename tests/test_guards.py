"""Guards, normalizers, spans, taggers and files on small fixtures."""

import difflib
import random
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from hangarlake.functions import align
from hangarlake.operators import evaluate, graph, normalize, records, tagging
from hangarlake.operators.setjoin import similar_sets
from hangarlake.sources import tables


def first(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_joins_are_held_to_their_guards(spark):
    a, b = (spark.createDataFrame(rows, "id string, v int") for rows in ([("x", 1), ("y", 2)], [("x", 3), ("z", 4)]))
    b = b.withColumnRenamed("v", "w")
    assert [tuple(r) for r in records.joined_or_zipped(a, b, "id").collect()] == [("x", 1, 3, "id")]
    other = spark.createDataFrame([("p", 8), ("q", 9)], "id string, w int")
    assert sorted((r["id"], r["other_id"], r["method"]) for r in records.joined_or_zipped(a, other, "id").collect()) == [("x", "p", "place"), ("y", "q", "place")]
    with pytest.raises(ValueError, match="can't be zipped"):
        records.joined_or_zipped(a, other.limit(1), "id")
    with pytest.raises(ValueError, match="not unique on the right"):
        records.one_to_one(a, b.unionByName(b), "id")
    with pytest.raises(ValueError, match="not known"):
        records.covered(spark.createDataFrame([("a", None)], "k string, part string"), "part")
    with pytest.raises(ValueError, match="rows"):
        records.exact_count(a, 3, "t")
    assert records.exact_count(a, 2, "t").count() == 2


def test_zipped_tables_must_agree(spark):
    a = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n int, left string")
    b = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "m int, right string")
    assert sorted((r["left"], r["right"]) for r in tables.zipped(a, b, "n", "m", ("left", "right")).collect()) == [("a", "a"), ("b", "b"), ("c", "c")]
    with pytest.raises(ValueError, match="don't agree"):
        tables.zipped(a, b.withColumn("right", F.lit("z")), "n", "m", ("left", "right"))


@pytest.mark.parametrize("raw, reference, category", [("", "x", "unmatched_or_empty"), ("a b", "a b", "unchanged"), ("A b", "a B", "formatting_only"), ("LEAK AT CYL", "LEAK AT CYLINDER", "possible_truncation_reconstruction"), ("a b c", "a b c d e f", "possible_unsupported_addition"), ("ENG LEAK OIL", "ENGINE LEAK OIL", "possible_abbreviation_expansion"), ("crakc seen", "crack seen", "lexical_edit")])
def test_pair_categories(spark, raw, reference, category):
    assert first(spark, normalize.pair_category("raw", "reference"), raw=raw, reference=reference) == category


def test_likeness_joins_the_categories(spark):
    raw = "one two three four five six seven eight nine ten"
    reference = "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    ratio = difflib.SequenceMatcher(None, raw, reference).ratio()
    assert ratio < 0.55
    got = first(spark, normalize.pair_category("raw", "reference", align.likeness("raw", "reference")), raw=raw, reference=reference)
    assert got == "possible_unsupported_addition" and first(spark, normalize.pair_category("raw", "reference"), raw=raw, reference=reference) == "lexical_edit"


@pytest.mark.parametrize("edit, same, want", [(None, True, "c"), ("CUTOFF - T", True, "reference_truncation"), ("CUTOFF - C, CUTOFF - T", True, "reference_completion"), ("ANON CUTOFF - C", True, "anonymized_completion"), ("ANON", False, "source_mismatch")])
def test_flags_go_before_categories(spark, edit, same, want):
    assert spark.createDataFrame([(edit,)], "e string").select(normalize.flagged_category(F.lit("c"), F.col("e"), F.lit(same))).first()[0] == want


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("clr", "cooler", "abbreviation"), ("chk", "check", "abbreviation"), ("leek", "leak", "misspelling")], "key string, expansion string, kind string")


def test_two_rule_normalizers(spark, words):
    df = spark.createDataFrame([("1", "Oil CLR (new) leek & chk #2 at AB-12, 30 psi"), ("2", None), ("3", "")], "id string, t string")
    rows = {r["id"]: r for r in normalize.aligned_by_rules(df, "id", "t", words, {"oil clr": "oil cooler"}).collect()}
    assert rows["1"]["normalized"] == "oil cooler new leak and check number 2 at ab - 12, 30 psi" and rows["1"]["expansions"] == 4
    assert [(s["token"], s["target"], s["rule"]) for s in rows["1"]["steps"] if s["rule"] != "keep"][:3] == [("(", "", "drop_bracket"), (")", "", "drop_bracket"), ("leek", "leak", "misspelling")]
    assert rows["2"]["normalized"] == rows["3"]["normalized"] == ""
    upper = {r[0]: r[1] for r in df.select("id", normalize.shielded_by_rules(F.col("t"), words)).collect()}
    assert upper["1"] == "OIL COOLER (NEW) LEAK & CHECK NUMBER 2 AT AB-12, 30 psi" and upper["2"] == upper["3"] == ""


@pytest.mark.parametrize("candidate, problems", [("replace left hose ab12 at 3.5", []), ("replace right hose ab12 at 3.5", ["directions"]), ("replace left hose ab13 at 3.5", ["numbers", "identifiers"]), ("replace left hose ab12 at 3.5 two", ["number_words"]), ("", ["empty", "numbers", "identifiers", "directions", "too_short"])])
def test_rewrites_are_checked(spark, candidate, problems):
    source = "REPLACE LEFT HOSE AB12 AT 3.5"
    assert first(spark, normalize.rewrite_problems(F.col("s"), F.lower("s"), F.col("c")), s=source, c=candidate) == problems


def test_exchanged_words():
    assert align.exchanged("the crakc in cyl head".split(), "The crack in cylinder head".split()) == [("crakc", "crack"), ("cyl", "cylinder")]
    assert align.exchanged("a b".split(), "a x y b".split()) == [] and align.exchanged([], []) == []


def test_replacements_are_learned_and_applied(spark):
    pairs = spark.createDataFrame([("1", "crakc seen", "crack seen"), ("2", "crakc here", "crack here"), ("3", "crakc now", "creak now")], "ident string, raw string, reference string")
    learned = normalize.learned_replacements(pairs)
    assert {(r["source"], r["target"]) for r in learned.collect()} == {("crakc", "crack")}
    rows = {r["ident"]: r["applied"] for r in normalize.replaced(pairs, "ident", "raw", learned).collect()}
    assert rows == {"1": "crack seen", "2": "crack here", "3": "crack now"}


def test_layers_of_dictionaries(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "key string, expansion string")
    got = {tuple(r) for r in normalize.layered([("given", part(("a", "x"))), ("own", part(("a", "z"), ("b", "y")))]).collect()}
    assert got == {("a", "x", "given"), ("b", "y", "own")}


_SPAN = "struct<entity_type:string,start_pos:int,end_pos:int>"


def test_nested_spans_are_flattened(spark):
    df = spark.createDataFrame([([("A", 3, 5), ("B", 0, 2), ("C", 0, 4), ("D", 4, 9), ("E", 9, 9)],), ([],), (None,)], f"e array<{_SPAN}>")
    rows = [r[0] for r in df.select(graph.flattened("e")).collect()]
    assert [(v["entity_type"]) for v in rows[0]] == ["C", "D", "E"] and rows[1] == [] and rows[2] is None


def test_types_are_taken_out_with_their_relations(spark):
    df = spark.createDataFrame([([("A", 0, 1), ("X", 1, 2), ("B", 2, 3)], [("r", 0, 2), ("s", 1, 2), ("q", 2, 0)])], f"entities array<{_SPAN}>, relations array<struct<relation_type:string,head_pos:int,tail_pos:int>>")
    row = graph.without_types(df, ("X",)).first()
    assert [e["entity_type"] for e in row["entities"]] == ["A", "B"] and [tuple(v) for v in row["relations"]] == [("r", 0, 1), ("q", 1, 0)]


def test_character_spans_and_back(spark):
    tokens = ["oil", "cooler", "leaks"]
    df = spark.createDataFrame([(tokens, i, j) for i in range(3) for j in range(i + 1, 4)], "t array<string>, i int, j int")
    a, b = graph.character_span("t", F.col("i"), F.col("j"))
    rows = df.select("i", "j", a.alias("a"), b.alias("b"), "t")
    assert all(" ".join(tokens)[r["a"] : r["b"]] == " ".join(tokens[r["i"] : r["j"]]) for r in rows.collect())
    x, y = graph.snapped("t", F.col("a") + 1, F.col("b") - 1)
    assert all((r["x"], r["y"]) == (r["i"], r["j"]) for r in rows.select("*", x.alias("x"), y.alias("y")).collect())


def test_spans_in_the_canonical_text(spark):
    text = "  Oil\t COOLER  leaks "
    df = spark.createDataFrame([(text, text.index("COOLER"), text.index("COOLER") + 6)], "t string, a int, b int")
    assert tuple(df.select(*graph.projected(F.col("t"), F.col("a"), F.col("b"))).first()) == (4, 10, "cooler")


def test_the_tagger_learns_a_chain(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(120):
        thing, part = rng.choice(["pump", "hose", "valve"]), rng.choice(["seal", "ring"])
        rows.append((["the", thing, part, "leaks"], ["O", "B-ITEM", "I-ITEM", "B-FAULT"]) if rng.random() < 0.7 else (["seal", "cracked"], ["B-ITEM", "B-FAULT"]))
    model = tagging.fitted(spark.createDataFrame(rows, "tokens array<string>, bio array<string>"), "tokens", "bio")
    tags, margin = model.decode(["the", "valve", "seal", "leaks"])
    assert tags == ["O", "B-ITEM", "I-ITEM", "B-FAULT"] and margin > 0
    assert model.decode(["seal", "cracked"])[0] == ["B-ITEM", "B-FAULT"] and model.decode([])[0] == []
    assert len(model.decode(["unknownword", "77"])[0]) == 2
    got = spark.createDataFrame([(None,), (["seal"],)], "t array<string>").select(tagging.tagged(F.col("t"), model).alias("m")).select("m.tags").collect()
    assert got[0][0] == [] and got[1][0] == ["B-ITEM"]


def test_risk_coverage_with_ties(spark):
    rng = random.Random(8)
    rows = [(f"k{i:03}", rng.choice([0.2, 0.9, 0.9, 0.5]), rng.randrange(2)) for i in range(97)]
    got = {round(r["coverage"], 1): (r["rows"], r["accuracy"]) for r in evaluate.risk_coverage(spark.createDataFrame(rows, "k string, p double, y int").repartition(4), "k").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for i in range(1, 11):
        n = -(-97 * i // 10)
        assert got[i / 10] == (n, round(sum(r[2] for r in order[:n]) / n, 6))


def test_a_hot_element_is_divided(spark, monkeypatch):
    from hangarlake.operators import setjoin

    rng = random.Random(6)
    rows = [(f"k{i:03}", ["all", *rng.sample("abcdefgh", 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, e array<string>")
    whole = {tuple(r) for r in similar_sets(df, "k", "e", 0.6).collect()}
    monkeypatch.setattr(setjoin, "PART", 3)
    assert {tuple(r) for r in similar_sets(df, "k", "e", 0.6).collect()} == whole and whole


def test_bad_json_lines_are_named(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n{"a": 2}\n')
    bad.write_text('{"a": 3}\n{"a": \n{"a": 5}\n')
    assert {r["a"] for r in tables.read_json_lines(spark, str(good), "a long").collect()} == {1, 2}
    with pytest.raises(ValueError, match=r"b\.jsonl:2"):
        tables.read_json_lines(spark, f"{tmp_path}/*.jsonl", "a long")


def test_graph_files_and_versions(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", 'a "b" & <c>'), ("n2", None)], "id string, label string")
    edges = spark.createDataFrame([("n1", "n2", "ON")], "source string, target string, label string")
    tables.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    document = xml.dom.minidom.parse(str(tmp_path / "g.graphml"))
    assert len(document.getElementsByTagName("node")) == 2 and document.getElementsByTagName("data")[0].firstChild.data == 'a "b" & <c>'
    tables.write_versioned(nodes, str(tmp_path), "r", "run1")
    tables.write_versioned(nodes.limit(1), str(tmp_path), "r", "run2")
    assert spark.read.parquet(str(tmp_path / "r.parquet")).count() == 1 and spark.read.parquet(str(tmp_path / "archive/r__run1.parquet")).count() == 2
    with pytest.raises(Exception, match="exists"):
        tables.write_versioned(nodes, str(tmp_path), "r", "run1")


def test_representations_keep_their_ids(spark):
    df = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, t string")
    assert {r["text"] for r in tables.represented(df, "id", "t", {"lower": F.lower}, "lower").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="no representation"):
        tables.represented(df, "id", "t", {"lower": F.lower}, "upper")
    with pytest.raises(ValueError, match="other ids"):
        tables.represented(df, "id", "t", {"none": lambda c: F.when(c == "A", c)}, "none")


def test_envelopes_digests_and_safe_numbers(spark, tmp_path):
    inner = spark.createDataFrame([([(1, "a"), (2, "b")],)], "predictions array<struct<id:int,t:string>>")
    assert sorted(tuple(r) for r in tables.unwrapped(inner).collect()) == [(1, "a"), (2, "b")]
    plain = spark.createDataFrame([(1,)], "id int")
    assert tables.unwrapped(plain).columns == ["id"]
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = tables.file_digests(spark, str(tmp_path / "x.bin")).first()
    assert row["length"] == 3 and row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    numbers = spark.createDataFrame([(1.5, "a"), (float("nan"), "b"), (float("inf"), "c"), (None, "d")], "v double, k string")
    assert [r["v"] for r in tables.json_safe(numbers).orderBy("k").collect()] == [1.5, None, None, None]


def test_text_keys_and_runs(spark):
    from hangarlake.functions import text as x

    assert first(spark, align.nfkc_key("a"), a=" Oil ﬁlter, ") == "oil filter"
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(x.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], [], []]


def test_packing_deals_as_one_by_one(spark):
    from collections import Counter

    from hangarlake.operators import groups

    def one_by_one(sizes, ratios):
        filled, out = dict.fromkeys(ratios, 0), Counter()
        for size in sorted(sizes, reverse=True):
            best = min(ratios, key=lambda s: (filled[s] / ratios[s], s))
            filled[best] += size
            out[size, best] += 1
        return out

    rng = random.Random(13)
    for ratios in ({"train": 0.7, "dev": 0.15, "test": 0.15}, {"a": 0.5, "b": 0.25, "c": 0.25}):
        for _ in range(30):
            sizes = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40, 300]) for _ in range(rng.randrange(1, 400))]
            got = Counter({(size, split): b - a for size, split, a, b in groups.packing(list(Counter(sizes).items()), ratios)})
            want = one_by_one(sizes, ratios)
            fill = lambda c: sorted((s, sum(k[0] * n for k, n in c.items() if k[1] == s)) for s in ratios)  # noqa: E731,B023
            assert got == want or fill(got) == fill(want)
    rows = [(f"g{i}", rng.choice([1, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, n int").repartition(4)
    dealt = {r["g"]: r["assigned"] for r in groups.packed_split(df, "g", "n", {"train": 0.7, "dev": 0.15, "test": 0.15}).collect()}
    assert len(dealt) == 500
    total = sum(n for _, n in rows)
    for split, share in (("train", 0.7), ("dev", 0.15), ("test", 0.15)):
        assert abs(sum(n for g, n in rows if dealt[g] == split) / total - share) < 0.01
    assert groups.packed_split(df.limit(0), "g", "n", {"train": 0.7, "test": 0.3}).count() == 0


@pytest.mark.parametrize("source, candidate, kept", [("LH PUMP AB-12 30 PSI", "left pump ab-12 30 psi", True), ("LH PUMP", "right pump", False), ("ITEM AB-12", "item ab-123", False), ("CHECK #3", "check number three", True), ("CHECK", "check two", False), ("NOT OK", "notok", False), ("", "", True), (None, None, True)])
def test_rewrites_keep_what_is_protected(spark, source, candidate, kept):
    assert first(spark, normalize.guarded(F.col("s"), F.col("c")), s=source, c=candidate) is kept
