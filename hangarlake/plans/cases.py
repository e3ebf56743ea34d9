"""Queries of case rows, subproblems and job cards, and of reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarlake.functions import fixed
from hangarlake.operators import cases as c
from hangarlake.operators import graph as g
from hangarlake.plans.graph import RELATIONS, annotated
from hangarlake.plans.insights import CASES, cases
from hangarlake.plans.registry import query
from hangarlake.plans.texts import CORPUS, corpus
from hangarlake.sources import tables

_BOUND = r"""bd AS (SELECT record_id, full_text, problem_text, action_text, regexp_extract_all(full_text, '\S+') AS w, regexp_replace(lower(coalesce(problem_text, '')), '[^a-z0-9]+', '', 'g') AS k FROM corpus),
pl AS (SELECT *, list_position([regexp_replace(lower(array_to_string(w[1:n], '')), '[^a-z0-9]+', '', 'g') FOR n IN range(1, greatest(1, len(w)) + 1)], k) AS place FROM bd)"""


@query(f"WITH {CORPUS}, {_BOUND} SELECT record_id, CASE WHEN k <> '' AND place > 0 THEN place END::BIGINT AS boundary, CASE WHEN k <> '' AND place > 0 THEN 'alnum_prefix' ELSE 'unresolved' END AS method FROM pl")
def problem_boundary(t):
    """CB1."""
    words = F.regexp_extract_all("full_text", F.lit(r"\S+"), F.lit(0))
    at, method = c.boundary(words, F.col("problem_text"))
    return corpus(t, ("full_text", "problem_text")).select("record_id", at.cast("long").alias("boundary"), method.alias("method"))


@query(f"""WITH {CORPUS}, e AS (SELECT record_id, unnest(entities) AS e FROM (SELECT record_id, arg_max(entities, received_at) AS entities FROM maintenance_record GROUP BY 1)),
s AS (SELECT c.record_id, e.entity_id, contains(lower(coalesce(problem_text, '')), lower(coalesce(e.text, ''))) AS a, contains(lower(coalesce(action_text, '')), lower(coalesce(e.text, ''))) AS b FROM e JOIN corpus c USING (record_id))
SELECT record_id, entity_id, CASE WHEN a AND NOT b THEN 'problem' WHEN b AND NOT a THEN 'action' ELSE 'unknown' END AS side FROM s""")
def entity_side(t):
    """CB2: by containment alone, where no boundary is used."""
    rows = annotated(t).select("record_id", F.explode("entities").alias("e")).join(corpus(t, ("problem_text", "action_text")).select("record_id", "problem_text", "action_text"), "record_id")
    nothing = F.lit(None).cast("int")
    return rows.select("record_id", "e.entity_id", c.side(F.col("e.start_pos"), F.col("e.end_pos"), F.col("e.text"), nothing, F.col("problem_text"), F.col("action_text")).alias("side"))


@query(f"WITH {RELATIONS}, p AS (SELECT DISTINCT record_id, target AS item, source AS issue FROM rel WHERE relation = 'ISSUE_ON_ITEM' AND problem IS NULL) SELECT record_id, item, issue, place FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY item, issue) AS place FROM p) WHERE place <= 4")
def subproblems(t):
    """RC7."""
    return c.subproblems(g.resolved_relations(annotated(t))).select("record_id", "item", "issue", "place")


_IMPERATIVE = "CASE " + " ".join(f"WHEN regexp_matches(step, '(?i)^{a}\\b') THEN regexp_replace(step, '(?i)^{a}\\b', '{b}')" for a, b in fixed.IMPERATIVES) + " ELSE step END"


@query(f"""WITH {CASES}, k AS (SELECT cluster_id, trim(regexp_replace(lower(action_text), '[^a-z0-9]+', ' ', 'g')) AS k, arg_min(action_text, record_id) AS step, count(*) AS records FROM cases
  WHERE outcome <> 'negative' AND coalesce(action_text, '') <> '' AND cluster_id IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, place, {_IMPERATIVE} AS step, records FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY records DESC, k) AS place FROM k) WHERE place <= 8""")
def job_cards(t):
    """RC10."""
    return c.job_cards(cases(t), "cluster_id")


@query(f"WITH {CASES} SELECT cluster_id, max_by(problem_text, struct_pack(n := length(coalesce(problem_text, '')), r := record_id)) AS problem_text, count(*) AS records FROM cases WHERE cluster_id IS NOT NULL GROUP BY 1".replace("max_by", "arg_max"))
def cluster_representative(t):
    """CB7: the longest problem of each cluster."""
    key = F.struct(F.length(F.coalesce("problem_text", F.lit(""))), F.col("record_id"))
    return cases(t).filter("cluster_id is not null").groupBy("cluster_id").agg(F.max_by("problem_text", key).alias("problem_text"), F.count("*").alias("records"))


@query(f"WITH {CASES} SELECT record_id, (len(components) > 0)::INT + (len(faults) > 0)::INT + (action_family <> 'Other')::INT + (outcome <> 'unknown')::INT AS parts, coalesce(cluster_id, 'record:' || record_id) AS cluster FROM cases")
def case_quality(t):
    """CB5: how complete a case is, and its cluster or itself."""
    parts = (F.size("components") > 0).cast("int") + (F.size("faults") > 0).cast("int") + (F.col("action_family") != "Other").cast("int") + (F.col("outcome") != "unknown").cast("int")
    return cases(t).select("record_id", parts.alias("parts"), F.coalesce("cluster_id", F.concat(F.lit("record:"), "record_id")).alias("cluster"))


@query("""SELECT ident, to_json(list_transform(entities, lambda v: v.entity_type)) AS types, array_to_string(tokens, ' ') AS text FROM (SELECT DISTINCT ident, tokens, entities FROM gold_annotation)""")
def nested_as_json(t):
    """SRC12."""
    rows = t.gold_annotation.select("ident", "tokens", "entities").distinct()
    return rows.select("ident", F.to_json(F.transform("entities", lambda v: v["entity_type"])).alias("types"), F.array_join("tokens", " ").alias("text"))


@query("SELECT term_id, kind, term, row_number() OVER (ORDER BY term_id) - 1 AS place FROM canonical_term")
def numbered_rows(t):
    """Places over partitions."""
    return tables.numbered(t.canonical_term, "term_id").withColumnRenamed("_place", "place").select("term_id", "kind", "term", "place")


@query("""SELECT record_id, length(full_text) AS chars, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(full_text, '\\S+')))) AS words FROM (SELECT DISTINCT record_id, full_text FROM maintenance_record)""")
def text_sizes(t):
    """Sizes of each text."""
    return t.maintenance_record.select("record_id", "full_text").distinct().select("record_id", F.length("full_text").cast("long").alias("chars"), F.regexp_count("full_text", F.lit(r"\S+")).cast("long").alias("words"))
