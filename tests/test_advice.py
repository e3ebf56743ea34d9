"""What round 1's advice found missing."""

import hashlib
import math
import random
from collections import Counter

import pytest

from hangarlake import plans
from hangarlake.operators import retrieval
from hangarlake.operators.radius import text_clusters, text_pairs
from hangarlake.operators.setjoin import set_members
from tests.oracle import connection, expected, rows_of

QUERIES, SQL = plans.queries(), plans.oracle_sql()
RECORDS = "record_id string, received_at timestamp, full_text string, entities array<struct<entity_id:string,text:string,entity_type:string,start_pos:int,end_pos:int,confidence:double>>, relations array<struct<relation_type:string,source_entity_id:string,target_entity_id:string>>"


def record(ident, entities, relations):
    return (ident, None, "", [(k, text, kind, 0, 1, 0.5) for k, text, kind in entities], list(relations))


@pytest.fixture(scope="module")
def graph_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    many = [(f"f{i}", f"fault {i}", "FAULT") for i in range(210)]
    item = ("m", "pump", "MAINT_ITEM")
    mixed = [("a", "replaced", "ACTION"), ("b", "checked", "ACTION"), ("f", "leak", "FAULT"), item, ("n", "seal", "MAINT_ITEM"), ("c", "climb", "OP_CTX"), ("r", "amm 71", "REFERENCE")]
    links = [("ACTION_ADDRESSES_ISSUE", "a", "f"), ("ACTION_INVESTIGATES_ISSUE", "b", "f"), ("ACTION_ON_ITEM", "a", "m"), ("ACTION_USES_ITEM", "a", "n"), ("HAS_PART", "m", "n"), ("OCCURS_UNDER_CONTEXT", "f", "c"), ("ACTION_FOLLOWS_REFERENCE", "a", "r")]
    rows = [record(f"r{j}", [*many, item], [("ISSUE_ON_ITEM", k, "m") for k, _, _ in many]) for j in range(2)] + [record(f"s{j}", mixed, links) for j in range(2)]
    rows.append(record("alone", [("a", "welded", "ACTION"), ("f", "crack", "FAULT")], [("ACTION_ADDRESSES_ISSUE", "a", "f")]))
    spark.createDataFrame(rows, RECORDS).selectExpr("record_id", "coalesce(received_at, timestamp'2026-01-01') AS received_at", "full_text", "entities", "relations").write.parquet(f"{folder}/maintenance_record.parquet")
    return str(folder)


VIEWS = {
    "kg_view_fault_actions": [("checked", "leak", "investigates", 2), ("replaced", "leak", "addresses", 2)],
    "kg_view_fault_solutions": [("checked", "leak", "", "investigates", 2), ("replaced", "leak", "pump", "addresses", 2), ("replaced", "leak", "seal", "addresses", 2)],
    "kg_view_item_parts": [("pump", "seal", 2)],
    "kg_view_fault_contexts": [("leak", "climb", 2)],
    "kg_view_action_references": [("replaced", "amm 71", 2)],
}


@pytest.mark.parametrize("name", VIEWS)
def test_planning_views(spark, graph_folder, name):
    df = QUERIES[name](spark, graph_folder)
    first = ["action", "issue"] if "issue" in df.columns and "action" in df.columns else []
    assert sorted(tuple(r) for r in df.select(*first, *[c for c in df.columns if c not in first]).collect()) == VIEWS[name]
    assert rows_of(df) == expected(connection(graph_folder), SQL[name])


def test_item_faults_has_no_row_limit(spark, graph_folder):
    df = QUERIES["kg_view_all_item_faults"](spark, graph_folder)
    assert df.count() == 210
    assert rows_of(df) == expected(connection(graph_folder), SQL["kg_view_all_item_faults"])


def cosines(texts):
    """Brute force: cosine of each two distinct texts by tf-idf over their 3- to 5-runs within words."""
    def runs(t):
        return Counter(w[i : i + n] for w in (f" {v} " for v in t.split()) for n in (3, 4, 5) for i in range(len(w) - n + 1))

    df = Counter(g for t in texts for g in runs(t))
    vectors = {t: {g: k * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in runs(t).items()} for t in set(texts)}
    length = {t: math.sqrt(sum(w * w for w in v.values())) for t, v in vectors.items()}
    return {(a, b): sum(w * vectors[b].get(g, 0) for g, w in vectors[a].items()) / length[a] / length[b] for a in vectors for b in vectors if a < b and length[a] and length[b]}


def test_cosine_radius_against_brute_force(spark):
    rng = random.Random(5)
    words = ["left", "magneto", "found", "cracked", "cylinder", "intake", "gasket", "leaking", "at", "rivet", "x", "baffle"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(4, 14))) for _ in range(60)]
    texts += [t + rng.choice([" s", " found", ""]) for t in texts] + [texts[0]] * 5 + [""]
    got = {(r["a"], r["b"]): r["likeness"] for r in text_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 0.9).collect()}
    want = {p: round(c, 6) for p, c in cosines(texts).items() if c >= 0.9 - 1e-9}
    assert len(want) > 20 and got == pytest.approx(want, abs=2e-6)


def test_clusters_of_equal_and_near_texts(spark):
    near, far = "oil pump drive gasket leaking at rear case flange and firewall", "rivet loose"
    rows = [("1", near), ("2", near), ("3", near + " s"), ("4", far), ("5", far), ("6", "")]
    got = {r["ident"]: r["label"] for r in text_clusters(spark.createDataFrame(rows, "ident string, text string"), "ident", "text", 0.9).collect()}
    label = lambda t: "normgrp-" + hashlib.sha256(t.encode()).hexdigest()[:12]
    assert got == {"1": label(near), "2": label(near), "3": label(near), "4": label(far), "5": label(far), "6": label("")}


def test_every_row_of_a_set_has_its_representative(spark):
    rows = [("1", ["a", "b"]), ("2", ["b", "a", "a"]), ("3", ["c"]), ("4", [])]
    got = {r["ident"]: r["representative"] for r in set_members(spark.createDataFrame(rows, "ident string, g array<string>"), "ident", "g").collect()}
    assert got == {"1": "1", "2": "1", "3": "3"}


def channel_rows(spark):
    queries = spark.createDataFrame([("q",)], "query_id string")
    docs = spark.createDataFrame([(f"d{i:03}",) for i in range(100)], "doc_id string")
    first = [("q", f"d{i:03}", 100.0 - i) for i in range(100)]
    second = [("q", f"d{(i * 37 + 20) % 100:03}", 100.0 - i) for i in range(80)] + [("q", "elsewhere", 500.0)]
    one = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    return retrieval.all_channels(queries, docs, {"bm25": one(first), "word": one(second)}), {d: s for _, d, s in first}, {d: s for _, d, s in second if d != "elsewhere"}


def test_fusion_ranks_every_document_in_every_channel(spark):
    rows, first, second = channel_rows(spark)
    place = lambda scores: {d: i for i, d in enumerate(sorted(first, key=lambda d: (-scores.get(d, 0), d)), 1)}
    a, b = place(first), place(second)
    got = {r["doc_id"]: r["score"] for r in retrieval.fused_full_ranks(rows, ["bm25", "word"]).collect()}
    assert got == pytest.approx({d: 1 / (60 + a[d]) + 1 / (60 + b[d]) for d in first}, abs=1e-12)
    assert any(a[d] <= 5 and b[d] > 50 for d in first)


def test_unit_scale_is_over_all_documents(spark):
    queries, docs = spark.createDataFrame([("q",)], "query_id string"), spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    scores = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 1.0)], "query_id string, doc_id string, score double")
    rows = retrieval.unit_channel(retrieval.all_channels(queries, docs, {"bm25": scores}), "bm25")
    assert {r["doc_id"]: r["bm25"] for r in rows.collect()} == {"a": 1.0, "b": 0.25, "c": 0.0}


@pytest.fixture(scope="module")
def case_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cases"))
    texts = {"MR000000100": "oil pump leaking", "MR000000101": "pump oil leak", "MR000000102": "pumps", "MR000000103": "cracked rivet"}
    spark.createDataFrame([(k, v, "") for k, v in texts.items()], "ident string, problem string, action string").write.parquet(f"{folder}/work_order.parquet")
    return folder, texts


def test_char_channel_counts_where_no_word_is_shared(spark, case_folder, monkeypatch):
    from hangarlake.plans import ranking
    from hangarlake.plans.registry import Tables

    folder, texts = case_folder
    none = spark.createDataFrame([], "query_id string, doc_id string, score double")
    monkeypatch.setattr(ranking, "struct_scores", lambda t: none)
    got = {r["doc_id"]: r for r in ranking.channels(Tables(spark, folder)).collect()}
    want = cosines(list(texts.values()))
    query = texts["MR000000100"]
    assert sorted(got) == sorted(texts) and got["MR000000102"]["word"] == 0
    assert got["MR000000102"]["char"] == pytest.approx(want[query, texts["MR000000102"]]) and got["MR000000102"]["char"] > 0


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_short_texts_in_crowded_buckets_are_linked(spark, threshold):
    from hangarlake.llm.chosenpath import similar_sets

    texts = ["a b c", "a b c d", "d e f g h"] + [f"a b c w{i}" for i in range(30)] + [f"a b c d v{i}" for i in range(30)] + [f"d e f g u{i}" for i in range(30)] + [f"d e f g h t{i}" for i in range(30)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    want = sorted((len(a & b), *sorted((len(a), len(b)))) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= threshold * len(a | b) - 1e-9)
    got = similar_sets(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 3, threshold, target_recall=0.999999, bucket=8, deep_bucket=8)
    assert sorted((r["shared"], *sorted((r["size_a"], r["size_b"]))) for r in got.collect()) == want
