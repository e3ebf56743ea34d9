"""Scores made block by block: no pair of a query and a document is a row, and results are those of all pairs."""

import os

import pytest

from hangarlake import plans
from hangarlake.operators import blocks
from tests.oracle import connection, expected, rows_of

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def checked(spark, con, monkeypatch, name, size=100):
    """The rows are those of SQL, made in several blocks and passes."""
    monkeypatch.setattr(blocks, "BLOCK", size)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    made, over = [], blocks.over_blocks

    def counted(docs, *rest):
        made.append(docs.rdd.getNumPartitions())
        return over(docs, *rest)

    monkeypatch.setattr(blocks, "over_blocks", counted)
    df = QUERIES[name](spark, FOLDER)
    assert rows_of(df) == expected(con, SQL[name])
    assert made and min(made) > 3


def test_rrf_hybrid(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "rrf_hybrid")


def test_weighted_channels(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "weighted_channels")


def test_blinded_pool(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "blinded_pool")


def test_struct_overlap(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "struct_overlap")


def test_method_table(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "method_table")


def test_reranked(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "reranked")


def test_graded_ndcg(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "graded_ndcg")


def test_narrowed_pool(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "narrowed_pool")


def test_chosen_method(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "chosen_method")


def test_norm_tfidf_topk(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "norm_tfidf_topk")


def test_anchor_coverage(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "anchor_coverage")


def test_strategy_list(spark, con, monkeypatch):
    checked(spark, con, monkeypatch, "strategy_list")


def test_bits_leave_all_similar_sets(spark):
    import random

    from hangarlake.operators.setjoin import similar_sets

    rng = random.Random(3)
    sets = [frozenset(f"e{rng.randrange(40)}" for _ in range(rng.randrange(3, 30))) for _ in range(40)]
    sets = list(dict.fromkeys(sets + [s | {f"n{i}"} for i, s in enumerate(sets)]))
    df = similar_sets(spark.createDataFrame([(f"{i:03}", sorted(s)) for i, s in enumerate(sets)], "ident string, g array<string>"), "ident", "g", 0.8)
    want = {(f"{j:03}", f"{i:03}") for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) - 1e-9}
    assert {(r["a"], r["b"]) for r in df.collect()} == want and len(want) > 20
    assert "bit_count" in df._jdf.queryExecution().optimizedPlan().toString()
