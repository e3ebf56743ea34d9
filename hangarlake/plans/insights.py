"""Queries of frequencies, matrices and registers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hangarlake.functions import fixed
from hangarlake.functions import text as x
from hangarlake.operators import insights as o
from hangarlake.operators.records import first_per_group, quotas
from hangarlake.plans.registry import query
from hangarlake.plans.texts import CORPUS, FAMILY_SQL, ISSUE_SQL, OUTCOME_SQL, PROBLEM_NORM_SQL, corpus


def cases(t):
    """Corpus rows with families, outcome, normalized problem, first component and fault (D9)."""
    first = lambda c: F.when(F.size(c) > 0, F.coalesce(F.get(c, F.lit(0)), F.lit(o.UNSPECIFIED))).otherwise(o.UNSPECIFIED)
    structure = first_per_group(t.structure_case.select("record_id", "components", "faults", F.to_json(F.struct("components", "faults")).alias("_o")), "record_id", ["_o"])
    structure = structure.select("record_id", F.coalesce("components", F.array().cast("array<string>")).alias("components"), F.coalesce("faults", F.array().cast("array<string>")).alias("faults"))
    rows = corpus(t, ("problem_text", "action_text")).join(structure, "record_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        "record_id", "cluster_id", "dataset_id", "problem_text", "action_text", "split", x.normalized_problem("problem_text").alias("problem_norm"), F.coalesce("components", empty).alias("components"),
        F.coalesce("faults", empty).alias("faults"), x.action_family("action_text").alias("action_family"), x.issue_family("problem_text").alias("issue_family"), x.outcome("action_text").alias("outcome"),
    ).withColumn("component", first("components")).withColumn("fault", first("faults"))


CASES = f"""{CORPUS},
structure AS (SELECT record_id, components, faults FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(to_json(components)::VARCHAR, ''), coalesce(to_json(faults)::VARCHAR, '')) AS rn FROM structure_case) WHERE rn = 1),
cases AS (SELECT c.record_id, cluster_id, dataset_id, problem_text, action_text, split, {PROBLEM_NORM_SQL} AS problem_norm, coalesce(components, []) AS components, coalesce(faults, []) AS faults,
  {FAMILY_SQL} AS action_family, {ISSUE_SQL} AS issue_family, {OUTCOME_SQL} AS outcome, coalesce(coalesce(components, [])[1], '(unspecified)') AS component, coalesce(coalesce(faults, [])[1], '(unspecified)') AS fault
  FROM corpus c LEFT JOIN structure s USING (record_id))"""


def _top(column: str, n: int) -> str:
    return f"(SELECT v, count(*) AS n FROM (SELECT unnest({column}) AS v FROM cases) WHERE v IS NOT NULL AND v NOT IN ('', '(unspecified)') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n})"


@query(f"""WITH {CASES}, s AS (SELECT cluster_id, count(*) AS n FROM cases WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS work_orders, count(DISTINCT problem_norm) AS unique_problems, count(DISTINCT cluster_id) AS clusters, count(DISTINCT action_family) AS action_families,
  (SELECT count(*) FROM s WHERE n >= 5) AS recurring, round(100 * avg((outcome <> 'unknown')::INT), 6) AS recorded_outcomes_pct FROM cases""")
def kpis(t):
    """AG1, XT24."""
    rows = cases(t)
    recurring = rows.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n >= 5").agg(F.count("*").alias("recurring"))
    sums = rows.agg(
        F.count("*").alias("work_orders"), F.count_distinct("problem_norm").alias("unique_problems"), F.count_distinct("cluster_id").alias("clusters"),
        F.count_distinct("action_family").alias("action_families"), F.round(100 * F.avg((F.col("outcome") != "unknown").cast("int")), 6).alias("recorded_outcomes_pct"),
    )
    return sums.join(F.broadcast(recurring))


@query(f"WITH {CASES}, a AS {_top('components', 1000000)} SELECT v AS component, n, round(sum(n) OVER (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM a) * 100, 6) AS cumulative_pct, round(n / (SELECT sum(n) FROM a) * 100, 6) AS share_pct FROM a ORDER BY n DESC, v LIMIT 15")
def component_pareto(t):
    """AG2, AG3, WN1, ST2."""
    return o.pareto(o.exploded_counts(cases(t), "components", "component"), "component", 15)


@query(f"WITH {CASES}, a AS {_top('faults', 1000000)} SELECT v AS fault, n, round(sum(n) OVER (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM a) * 100, 6) AS cumulative_pct, round(n / (SELECT sum(n) FROM a) * 100, 6) AS share_pct FROM a ORDER BY n DESC, v LIMIT 15")
def fault_share(t):
    """AG4."""
    return o.pareto(o.exploded_counts(cases(t), "faults", "fault"), "fault", 15)


@query(f"WITH {CASES} SELECT action_family, count(*) AS n FROM cases GROUP BY 1 HAVING action_family <> 'Other'")
def family_frequency(t):
    """AG5."""
    return cases(t).groupBy("action_family").agg(F.count("*").alias("n")).filter("action_family <> 'Other'")


@query(f"""WITH {CASES}, tc AS {_top('components', 8)}, tf AS {_top('faults', 8)}, p AS (SELECT DISTINCT record_id, c, unnest(faults) AS f FROM (SELECT record_id, faults, unnest(components) AS c FROM cases))
SELECT c AS component, f AS fault, count(*) AS n FROM p WHERE c IN (SELECT v FROM tc) AND f IN (SELECT v FROM tf) GROUP BY 1, 2""")
def component_fault_matrix(t):
    """AG6, JN9, KG3: pairs named in one record, of the most frequent of each."""
    rows = cases(t)
    most = lambda c, label: F.broadcast(o.exploded_counts(rows, c, label).orderBy(F.desc("n"), label).limit(8).select(label))
    pairs = rows.select("record_id", "faults", F.explode(F.array_distinct("components")).alias("component")).select("record_id", "component", F.explode(F.array_distinct("faults")).alias("fault"))
    return pairs.join(most("components", "component"), "component", "left_semi").join(most("faults", "fault"), "fault", "left_semi").groupBy("component", "fault").agg(F.count("*").alias("n"))


@query(f"""WITH {CASES}, tc AS {_top('components', 8)} SELECT v AS component, count(*) FILTER (action_family = 'Replace') AS "Replace", count(*) FILTER (action_family = 'Inspect') AS "Inspect", count(*) FILTER (action_family = 'Adjust') AS "Adjust"
FROM tc LEFT JOIN cases ON list_contains(components, v) GROUP BY 1""")
def component_action_pivot(t):
    """AG6, AG7: a pivot over known values."""
    rows = cases(t)
    most = F.broadcast(o.exploded_counts(rows, "components", "component").orderBy(F.desc("n"), "component").limit(8).select("component"))
    pairs = rows.select("action_family", F.explode(F.array_distinct("components")).alias("component")).join(most, "component")
    names = ["Replace", "Inspect", "Adjust"]
    return pairs.groupBy("component").pivot("action_family", names).agg(F.count(F.lit(1))).select("component", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query(f"WITH {CASES} SELECT action_family, count(*) AS n FROM cases WHERE list_contains(faults, 'oil seepage') AND action_family <> 'Other' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def problem_to_action(t):
    """AG7."""
    return cases(t).filter(F.array_contains("faults", "oil seepage") & (F.col("action_family") != "Other")).groupBy("action_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action_family").limit(12)


@query(f"WITH {CASES} SELECT o.outcome, count(c.outcome) AS n FROM (VALUES ('positive'), ('unknown'), ('negative'), ('mixed')) o(outcome) LEFT JOIN cases c USING (outcome) GROUP BY 1")
def outcome_mix(t):
    """AG8: every outcome, also those that don't occur."""
    counts = cases(t).groupBy("outcome").agg(F.count("*").alias("n"))
    kinds = t.spark.createDataFrame([(k,) for k in fixed.OUTCOME_ORDER], "outcome string")
    return kinds.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def _modes(columns):
    return ", ".join(f"(SELECT {c} FROM cases x WHERE x.cluster_id = g.cluster_id GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in columns)


_REGISTER = """WITH {cases}, g AS (SELECT cluster_id, count(*) AS work_orders, arg_min(problem_text, record_id) AS problem_text, count(*) FILTER (outcome = 'positive') AS positive_outcomes,
  count(*) FILTER (outcome IN ('negative', 'mixed')) AS negative_outcomes FROM cases WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {least} ORDER BY 2 DESC, 1 LIMIT {n})
SELECT cluster_id, work_orders, (SELECT problem_text FROM cases x WHERE x.cluster_id = g.cluster_id ORDER BY record_id LIMIT 1) AS problem_text, positive_outcomes, negative_outcomes, work_orders - positive_outcomes - negative_outcomes AS outcome_unknown, {modes} FROM g"""


@query(_REGISTER.format(cases=CASES, least=2, n=40, modes=_modes(["component", "fault", "action_family"])))
def recurring_watchlist(t):
    """AG9, AG10: the register of recurring problems (the flagship query)."""
    return o.watchlist(cases(t), "cluster_id", "problem_text", "record_id", 2, 40, ["component", "fault", "action_family"])


@query(f"""WITH {CASES}, g AS (SELECT cluster_id, count(*) AS n FROM cases WHERE cluster_id IS NOT NULL GROUP BY 1)
SELECT c.cluster_id, c.record_id, c.action_text FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY cluster_id, lower(action_text) ORDER BY record_id) AS first FROM cases WHERE coalesce(action_text, '') <> '') WHERE first = 1) c JOIN g USING (cluster_id) WHERE rn <= 3 AND n >= 3""")
def example_actions(t):
    """WN16, RC5: three different actions of each larger group; the window's group limit keeps hot groups small before the exchange."""
    rows = cases(t).filter("coalesce(action_text, '') <> '' and cluster_id is not null")
    sizes = cases(t).filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n >= 3").select("cluster_id")
    different = rows.groupBy("cluster_id", F.lower("action_text").alias("_a")).agg(F.min(F.struct("record_id", "action_text")).alias("r")).select("cluster_id", "r.record_id", "r.action_text")
    ranked = different.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("record_id"))).filter("rn <= 3").drop("rn")
    return ranked.join(sizes, "cluster_id", "left_semi")


@query(f"""WITH {CASES}, g AS (SELECT dataset_id, count(*) AS n FROM cases GROUP BY 1), e AS (SELECT *, n * 100 / sum(n) OVER () AS x FROM g), f AS (SELECT *, floor(x) AS fl, 100 - sum(floor(x)) OVER () AS left_over FROM e)
SELECT dataset_id, n, (fl + (row_number() OVER (ORDER BY round(x - fl, 9) DESC, dataset_id) <= left_over)::INT)::BIGINT AS quota FROM f""")
def quota_sample(t):
    """WN13: places in proportion to the sources' sizes, by largest remainders."""
    return quotas(cases(t).groupBy("dataset_id").agg(F.count("*").alias("n")), "dataset_id", 100)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(t):
    """Time buckets over the event table."""
    return t.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def order_rollup(t):
    """Grouping sets: sums by both, by one, and in all."""
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
