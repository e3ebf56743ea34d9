"""Queries of joins, duplicate groups, clusters, splits, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hangarlake.operators import groups as o
from hangarlake.operators import records as r
from hangarlake.plans.registry import query
from hangarlake.plans.texts import CORPUS, NEAR_SQL, corpus

_GROUPS = f"""grp AS (SELECT record_id, dataset_id, problem_text, 'ex_' || md5(coalesce(problem_text, '') || ' ||| ' || coalesce(action_text, '')) AS exact_group,
  'nr_' || md5({NEAR_SQL.format(c='problem_text')} || ' ||| ' || {NEAR_SQL.format(c='action_text')}) AS near_group FROM corpus)"""


def keyed(t, *more):
    """Corpus rows with their near group, in one pass."""
    return corpus(t, ("problem_text", "action_text")).select("record_id", *more, o.near_digest("problem_text", "action_text").alias("near_group"))


@query(f"WITH {CORPUS}, {_GROUPS} SELECT record_id, exact_group, near_group, substr(exact_group, 1, 11) AS exact_label, substr(near_group, 1, 11) AS near_label FROM grp")
def exact_near_groups(t):
    """CL1: whole digests to group by, short labels to show."""
    return o.exact_near_groups(corpus(t, ("problem_text", "action_text")), "record_id", "problem_text", "action_text")


@query(f"WITH {CORPUS}, {_GROUPS} SELECT count(*) AS records, count(DISTINCT exact_group) AS exact_groups, count(DISTINCT near_group) AS near_groups, round(1 - count(DISTINCT near_group) / count(*), 6) AS near_rate FROM grp")
def duplicate_stats(t):
    """AG16."""
    rows = o.exact_near_groups(corpus(t, ("problem_text", "action_text")), "record_id", "problem_text", "action_text")
    return rows.agg(F.count("*").alias("records"), F.count_distinct("exact_group").alias("exact_groups"), F.count_distinct("near_group").alias("near_groups"), F.round(1 - F.count_distinct("near_group") / F.count("*"), 6).alias("near_rate"))


@query(f"WITH {CORPUS}, {_GROUPS} SELECT near_group, min(record_id) AS record_id FROM grp GROUP BY 1")
def unique_pool(t):
    """WN2, XT2: the first record of each near group."""
    return keyed(t).groupBy("near_group").agg(F.min("record_id").alias("record_id"))


@query("SELECT record_id, dataset_id, split, received_at FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, dataset_id DESC NULLS LAST, split DESC NULLS LAST) AS rn FROM maintenance_record) WHERE rn = 1")
def last_delivery(t):
    """SRC16."""
    return r.keep_last(t.maintenance_record.select("record_id", "dataset_id", "split", "received_at"), ["record_id"], ["received_at"])


@query("SELECT record_id, count(*) AS rows FROM maintenance_record GROUP BY 1 HAVING count(*) > 1")
def unique_id_guard(t):
    """JN2, SRC5."""
    return r.repeated_keys(t.maintenance_record, "record_id")


@query(f"""WITH {CORPUS}, w AS (SELECT DISTINCT ident AS record_id FROM work_order), c AS (SELECT record_id FROM corpus)
SELECT record_id, CASE WHEN c.record_id IS NULL THEN 'right_only' WHEN w.record_id IS NULL THEN 'left_only' ELSE 'both' END AS merge FROM c FULL JOIN w USING (record_id)""")
def pair_outer_merge(t):
    """JN1, D18."""
    return r.merged(corpus(t, ()).select("record_id"), t.work_order.select(F.col("ident").alias("record_id")).distinct(), "record_id").select("record_id", "merge")


@query("SELECT DISTINCT ident FROM work_order WHERE ident NOT IN (SELECT ident FROM gold_annotation WHERE ident IS NOT NULL)")
def anti_annotated(t):
    """JN7, SRC10."""
    return t.work_order.select("ident").distinct().join(t.gold_annotation.select("ident"), "ident", "left_anti")


@query("SELECT DISTINCT w.ident, w.problem FROM work_order w WHERE w.ident IN (SELECT ident FROM gold_annotation)")
def semi_annotated(t):
    """JN7."""
    return t.work_order.select("ident", "problem").join(t.gold_annotation.select("ident"), "ident", "left_semi").distinct()


@query(f"WITH {CORPUS} SELECT c.dataset_id, count(*) AS records, count(s.record_id) AS with_structure, count(*) - count(s.record_id) AS without_structure FROM corpus c LEFT JOIN (SELECT DISTINCT record_id FROM structure_case) s USING (record_id) GROUP BY 1")
def join_coverage(t):
    """Records with and without a structure, by source."""
    known = t.structure_case.select("record_id").distinct().withColumn("_k", F.lit(1))
    return corpus(t, ()).join(known, "record_id", "left").groupBy("dataset_id").agg(F.count("*").alias("records"), F.count("_k").alias("with_structure")).withColumn("without_structure", F.col("records") - F.col("with_structure"))


@query("""WITH RECURSIVE hub AS (SELECT record_id, min(cluster_id) AS low FROM maintenance_record WHERE cluster_id IS NOT NULL AND record_id IS NOT NULL GROUP BY 1 HAVING min(cluster_id) < max(cluster_id)),
star AS (SELECT DISTINCT m.cluster_id AS a, hub.low AS b FROM maintenance_record m JOIN hub USING (record_id) WHERE m.cluster_id <> hub.low), edge AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a), root AS (SELECT a AS cluster_id, min(b) AS root FROM reach GROUP BY a)
SELECT DISTINCT m.cluster_id, coalesce(root, m.cluster_id) AS component FROM maintenance_record m LEFT JOIN root USING (cluster_id) WHERE m.cluster_id IS NOT NULL""")
def merge_clusters(t):
    """CL2, CL4."""
    return o.merged_clusters(t.maintenance_record, "cluster_id", "record_id")


@query(f"""WITH {CORPUS}, {_GROUPS}, p AS (SELECT record_id, near_group, ('0x' || substr(sha256('v1:' || near_group), 1, 8))::BIGINT / 4294967296.0 AS x FROM grp)
SELECT record_id, near_group, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.85 THEN 'dev' ELSE 'test' END AS assigned FROM p""")
def group_split(t):
    """CL7, ST7."""
    return o.hashed_split(keyed(t), "near_group", [("train", 0.7), ("dev", 0.85), ("test", 1.0)], "v1:").select("record_id", "near_group", "assigned")


@query()
def packed_split(t):
    """CL5, CL6: near groups packed into splits, the largest first; however many there are."""
    sizes = keyed(t).groupBy("near_group").agg(F.count("*").alias("n"))
    return o.packed_split(sizes, "near_group", "n", {"train": 0.7, "dev": 0.15, "test": 0.15})


@query(f"WITH {CORPUS} SELECT record_id, CASE WHEN lower(trim(split)) IN ('test', 'dev', 'val', 'validation') THEN lower(trim(split)) ELSE 'train' END AS frozen FROM corpus")
def frozen_split(t):
    """What was frozen stays; all else trains."""
    s = F.lower(F.trim("split"))
    return corpus(t, ()).select("record_id", F.when(s.isin("test", "dev", "val", "validation"), s).otherwise("train").alias("frozen"))


@query(f"WITH {CORPUS}, {_GROUPS} SELECT near_group, count(DISTINCT lower(trim(split))) AS splits, count(*) AS rows FROM grp JOIN corpus USING (record_id) GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1")
def leakage_check(t):
    """AG30."""
    return o.leaks(keyed(t, F.lower(F.trim("split")).alias("part")), "near_group", "part")


@query(f"""WITH {CORPUS}, {_GROUPS}, p AS (SELECT DISTINCT near_group, lower(trim(split)) AS part FROM grp JOIN corpus USING (record_id) WHERE split IS NOT NULL)
SELECT a.part AS first_part, b.part AS second_part, count(*) AS shared_groups FROM p a JOIN p b ON a.near_group = b.near_group AND a.part < b.part GROUP BY 1, 2""")
def split_overlap(t):
    """Groups that two splits share; splits are a handful, so the pairs come from each group's own set."""
    parts = keyed(t, F.lower(F.trim("split")).alias("part")).filter("part is not null").groupBy("near_group").agg(F.sort_array(F.collect_set("part")).alias("parts")).filter(F.size("parts") > 1)
    pairs = parts.select("parts", F.explode("parts").alias("first_part")).select("first_part", F.explode("parts").alias("second_part")).filter("first_part < second_part")
    return pairs.groupBy("first_part", "second_part").agg(F.count("*").alias("shared_groups"))


@query("""SELECT ident FROM work_order INTERSECT SELECT record_id FROM maintenance_record""")
def id_intersection(t):
    """ST5, ST9."""
    return t.work_order.select("ident").intersect(t.maintenance_record.select(F.col("record_id").alias("ident")))


@query("SELECT problem FROM (SELECT problem FROM work_order EXCEPT ALL SELECT problem_text FROM maintenance_record)")
def text_multiset_difference(t):
    """ST6."""
    return t.work_order.select("problem").exceptAll(t.maintenance_record.select(F.col("problem_text").alias("problem")))


@query("SELECT ident, 'problem' AS field, problem AS text FROM work_order UNION ALL SELECT ident, 'action', action FROM work_order")
def field_union(t):
    """ST3."""
    one = lambda c: t.work_order.select("ident", F.lit(c).alias("field"), F.col(c).alias("text"))
    return one("problem").unionByName(one("action"))


@query("SELECT ident, problem FROM (SELECT DISTINCT ident, problem FROM work_order) ORDER BY sha256('seed' || ident), problem LIMIT 100")
def seeded_sample(t):
    """ST7: a sample by digest; the same everywhere, of any order of the rows."""
    return t.work_order.select("ident", "problem").distinct().orderBy(F.sha2(F.concat(F.lit("seed"), "ident"), 256), "problem").limit(100)


@query("SELECT asset_id, record_id, logged_at, CAST(date_diff('second', lag(logged_at) OVER w, logged_at) AS BIGINT) AS seconds_since FROM (SELECT DISTINCT asset_id, record_id, logged_at FROM maintenance_record WHERE logged_at IS NOT NULL AND asset_id IS NOT NULL) WINDOW w AS (PARTITION BY asset_id ORDER BY logged_at, record_id)")
def time_since_last(t):
    """Time between the entries of an asset, month by month, so that an asset with very many entries is many tasks' work; a month's first entry follows the last one of the months before."""
    rows = t.maintenance_record.select("asset_id", "record_id", "logged_at").filter("logged_at is not null and asset_id is not null").distinct().withColumn("month", F.date_trunc("month", "logged_at"))
    within = F.lag("logged_at").over(Window.partitionBy("asset_id", "month").orderBy("logged_at", "record_id"))
    ends = rows.groupBy("asset_id", "month").agg(F.max("logged_at").alias("last"))
    carried = ends.select("asset_id", "month", F.lag("last").over(Window.partitionBy("asset_id").orderBy("month")).alias("carried"))
    before = F.coalesce("within", "carried")
    return rows.withColumn("within", within).join(carried, ["asset_id", "month"]).select("asset_id", "record_id", "logged_at", F.timestamp_diff("SECOND", before, F.col("logged_at")).alias("seconds_since"))


@query("""WITH g AS (SELECT source, target, n FROM (SELECT c.o_orderpriority AS source, l.l_returnflag AS target, count(*) AS n FROM orders c JOIN lineitem l ON l.l_orderkey = c.o_orderkey GROUP BY 1, 2))
SELECT source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS rn FROM g) WHERE rn = 1""")
def best_link(t):
    """WN7: the strongest link of each source."""
    counts = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("source")).join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("target")), "o_orderkey").groupBy("source", "target").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min_by(F.struct("target", "n"), F.struct(-F.col("n"), F.col("target"))).alias("b")).select("source", "b.target", "b.n")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS LAST, l_linenumber) AS step FROM lineitem")
def step_order(t):
    """WN10."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_shipdate"), "l_linenumber")).cast("long").alias("step"))
