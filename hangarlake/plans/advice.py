"""Queries of evidence, strategies, case graphs and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hangarlake.functions import text as x
from hangarlake.operators import blocks
from hangarlake.operators import cases as c
from hangarlake.operators import evaluate as e
from hangarlake.operators import graph as g
from hangarlake.operators import retrieval as r
from hangarlake.plans.graph import RELATIONS, _key, annotated
from hangarlake.plans.insights import CASES, cases
from hangarlake.plans.ranking import _POISSON, _RANKED, BM25, HITS, RANKS, SCORED, TFIDF, VOTES, _queries, bm25, case_facts, documents, hits, ranks, scored, word_passes
from hangarlake.plans.registry import query
from hangarlake.session import cut

# Words by which a sentence names a family's work, a fault as a property and as a thing.
VERBS = ("Replace", "Repair", "Adjust", "Service", "Inspect", "Diagnose", "Calibrate")
FAULT_ADJECTIVES = {"leak": "leaking", "crack": "cracked", "wear": "worn", "loose": "loose", "corrosion": "corroded", "burnt": "burnt", "broken": "broken", "chafing": "chafed", "vibration": "vibrating"}
FAULT_NOUNS = {"leak": "leak", "crack": "crack", "wear": "wear", "loose": "looseness", "corrosion": "corrosion", "vibration": "vibration", "noise": "noise", "low compression": "low compression", "rough running": "rough running", "power loss": "power loss", "will not start": "no-start condition", "quit / shutdown": "shutdown", "smoke": "smoke"}
VERIFICATION = r"leak\s*(ck|check)|ops\s*(ck|check)|ground\s*(ck|check)|run\s*up|checked good|check good|ops good|functional check"


def _sql_map(values: dict) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _looked(values: dict, key):
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


@query(f"""WITH {CASES}, k AS (SELECT record_id, action_family AS family, coalesce(issue_family, '') AS fault, CASE WHEN component = '(unspecified)' THEN 'affected component' ELSE component END AS target, regexp_matches(lower(coalesce(action_text, '')), '{VERIFICATION}') AS verified FROM cases WHERE action_family IN ({', '.join(f"'{v}'" for v in VERBS)})),
s AS (SELECT *, {_sql_map(FAULT_ADJECTIVES)}[fault] AS adjective, {_sql_map(FAULT_NOUNS)}[fault] AS noun FROM k)
SELECT record_id, family || ' the ' || CASE WHEN family IN ('Replace', 'Repair', 'Service') AND adjective IS NOT NULL AND NOT contains(target, adjective) THEN adjective || ' ' ELSE '' END || target || CASE WHEN family = 'Inspect' AND noun IS NOT NULL THEN ' for evidence of ' || noun WHEN family = 'Diagnose' AND noun IS NOT NULL THEN ' to isolate the ' || noun ELSE '' END
  || CASE WHEN verified AND family IN ('Replace', 'Repair', 'Adjust', 'Service') THEN ', then perform a verification check' ELSE '' END || '.' AS sentence FROM s""")
def composed_sentences(t):
    """STR28: a sentence for each record from its family, component, fault and whether a check followed."""
    rows = cases(t).filter(F.col("action_family").isin(*VERBS))
    family, fault = F.col("action_family"), F.coalesce("issue_family", F.lit(""))
    target = F.when(F.col("component") == "(unspecified)", "affected component").otherwise(F.col("component"))
    adjective, noun = _looked(FAULT_ADJECTIVES, fault), _looked(FAULT_NOUNS, fault)
    marked = F.when(family.isin("Replace", "Repair", "Service") & adjective.isNotNull() & ~F.contains(target, adjective), F.concat(adjective, F.lit(" "))).otherwise("")
    purpose = F.when((family == "Inspect") & noun.isNotNull(), F.concat(F.lit(" for evidence of "), noun)).when((family == "Diagnose") & noun.isNotNull(), F.concat(F.lit(" to isolate the "), noun)).otherwise("")
    check = F.when(F.lower(F.coalesce("action_text", F.lit(""))).rlike(VERIFICATION) & family.isin("Replace", "Repair", "Adjust", "Service"), ", then perform a verification check").otherwise("")
    return rows.select("record_id", F.concat(family, F.lit(" the "), marked, target, purpose, check, F.lit(".")).alias("sentence"))


# Evidence


_ANCHORS = "an AS (SELECT record_id AS query_id, unnest(list_distinct(list_concat([('c:' || v) FOR v IN components IF v IS NOT NULL], [('f:' || v) FOR v IN faults IF v IS NOT NULL]))) AS anchor FROM cases), qa AS (SELECT * FROM an WHERE query_id IN (SELECT query_id FROM hit))"
_COVERAGE = f"{_ANCHORS}, fo AS (SELECT DISTINCT hit.query_id, an.anchor FROM hit JOIN an ON an.query_id = hit.doc_id), cov AS (SELECT qa.query_id, count(*) AS anchors, count(fo.anchor) AS found FROM qa LEFT JOIN fo ON fo.query_id = qa.query_id AND fo.anchor = qa.anchor GROUP BY 1)"


def _anchors(t):
    named = lambda c, k: F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.concat(F.lit(k), v))
    return cases(t).select("record_id", F.explode(F.array_distinct(F.concat(named("components", "c:"), named("faults", "f:")))).alias("anchor"))


def coverage(t, found):
    anchors = _anchors(t)
    wanted = anchors.join(found.select(F.col("query_id").alias("record_id")).distinct(), "record_id").withColumnRenamed("record_id", "query_id")
    seen = found.select("query_id", F.col("doc_id").alias("record_id")).join(anchors, "record_id").select("query_id", "anchor").distinct().withColumn("_f", F.lit(1))
    return wanted.join(seen, ["query_id", "anchor"], "left").groupBy("query_id").agg(F.count("*").alias("anchors"), F.count("_f").alias("found"))


@query(f"WITH {HITS}, {_COVERAGE} SELECT query_id, anchors, found, round(found / anchors, 6) AS coverage FROM cov")
def anchor_coverage(t):
    """RC2: the share of a query's components and faults that its ten hits have."""
    return coverage(t, cut(hits(t))).withColumn("coverage", F.round(F.col("found") / F.col("anchors"), 6))


_LEADER = "lead_ AS (SELECT v.query_id, arg_min(v.family, {'t': v.evidence < m.top, 'o': v.family <> h.family, 'r': v.rank}) AS leader, any_value(m.top) AS top FROM votes v JOIN (SELECT query_id, max(evidence) AS top FROM votes GROUP BY 1) m USING (query_id) JOIN hit h ON h.query_id = v.query_id AND h.rank = 1 GROUP BY 1)"


def leaders(found, votes):
    """(query_id, leader, top): the family with most evidence; of equal ones that of the first hit stays ahead."""
    first = found.filter("rank = 1").select("query_id", F.col("family").alias("first_family"))
    best = votes.groupBy("query_id").agg(F.max("evidence").alias("top"))
    rows = votes.join(best, "query_id").join(first, "query_id").filter("evidence = top")
    return rows.groupBy("query_id").agg(F.min_by("family", F.struct(F.col("family") != F.col("first_family"), "rank")).alias("leader"), F.first("top").alias("top"))


@query(f"WITH {VOTES}, {_LEADER} SELECT query_id, leader, top FROM lead_")
def kept_leader(t):
    """RC1: hits, their clusters' votes, and the leader by a tie rule that keeps the first hit's family."""
    found = cut(hits(t))
    return leaders(found, e.family_votes(found))


@query(f"WITH {VOTES} SELECT query_id, family, rank - 1 AS place FROM votes WHERE rank BETWEEN 2 AND 4")
def alternatives(t):
    """WN17: the families of the second to fourth place."""
    return e.family_votes(hits(t)).filter("rank between 2 and 4").select("query_id", "family", (F.col("rank") - 1).alias("place"))


_POOL = f"""{HITS}, own_ AS (SELECT record_id AS query_id, component, fault FROM cases), ht AS (SELECT h.query_id, h.doc_id, h.cluster, h.family, c.outcome, c.action_text, list_contains(c.components, o.component) AS has_c, list_contains(c.faults, o.fault) AS has_f FROM hit h JOIN cases c ON c.record_id = h.doc_id JOIN own_ o ON o.query_id = h.query_id WHERE c.outcome <> 'negative' AND h.family <> 'Other'),
nc AS (SELECT query_id, count(DISTINCT cluster) FILTER (has_c) AS c, count(DISTINCT cluster) FILTER (has_c AND has_f) AS cf, count(DISTINCT cluster) FILTER (has_f) AS f FROM ht GROUP BY 1),
pool AS (SELECT ht.*, CASE WHEN cf >= 2 THEN 'component_fault' WHEN c >= 1 THEN 'component' WHEN f >= 2 THEN 'fault' ELSE 'all' END AS scope FROM ht JOIN nc USING (query_id) WHERE CASE WHEN cf >= 2 THEN has_c AND has_f WHEN c >= 1 THEN has_c WHEN f >= 2 THEN has_f ELSE true END)"""


def pool(t):
    """Hits without a bad outcome, narrowed to the query's component and then its fault where enough clusters remain."""
    facts = cases(t).select(F.col("record_id").alias("doc_id"), "outcome", "action_text", "components", "faults")
    own = cases(t).select(F.col("record_id").alias("query_id"), "component", "fault")
    rows = hits(t).join(facts, "doc_id").join(own, "query_id").filter("outcome <> 'negative' and family <> 'Other'")
    rows = rows.select("query_id", "doc_id", "cluster", "family", "outcome", "action_text", F.array_contains("components", F.col("component")).alias("has_c"), F.array_contains("faults", F.col("fault")).alias("has_f"))
    rows = cut(rows.na.fill(False, ["has_c", "has_f"]))
    clusters = lambda cond: F.count_distinct(F.when(cond, F.col("cluster")))
    n = rows.groupBy("query_id").agg(clusters(F.col("has_c")).alias("c"), clusters(F.col("has_c") & F.col("has_f")).alias("cf"), clusters(F.col("has_f")).alias("f"))
    scope = F.when(F.col("cf") >= 2, "component_fault").when(F.col("c") >= 1, "component").when(F.col("f") >= 2, "fault").otherwise("all")
    rows = rows.join(n, "query_id").withColumn("scope", scope)
    inside = F.when(F.col("scope") == "component_fault", F.col("has_c") & F.col("has_f")).when(F.col("scope") == "component", F.col("has_c")).when(F.col("scope") == "fault", F.col("has_f")).otherwise(F.lit(True))
    return rows.filter(inside)


@query(f"WITH {_POOL} SELECT query_id, doc_id, scope FROM pool")
def narrowed_pool(t):
    """RC4."""
    return pool(t).select("query_id", "doc_id", "scope")


_STRATEGIES = f"""{_POOL}, sx AS (SELECT query_id, family, count(DISTINCT cluster) AS clusters, count(*) AS cases_, sum((outcome = 'positive')::INT)::BIGINT AS positive, sum((outcome = 'mixed')::INT)::BIGINT AS mixed, sum((outcome = 'unknown')::INT)::BIGINT AS unknown FROM pool GROUP BY 1, 2),
tr AS (SELECT *, CASE WHEN clusters >= 2 THEN 'corroborated' ELSE 'single_case' END AS tier FROM sx), ra AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY clusters DESC, cases_ DESC, family) AS place FROM tr)"""


def strategies(t):
    rows = pool(t).groupBy("query_id", "family").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("cases_"), *[F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in ("positive", "mixed", "unknown")])
    rows = rows.withColumn("tier", F.when(F.col("clusters") >= 2, "corroborated").otherwise("single_case"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc("clusters"), F.desc("cases_"), "family")))


@query(f"WITH {_STRATEGIES} SELECT query_id, family, tier, place, clusters, cases_, positive, mixed, unknown FROM ra WHERE place <= CASE WHEN tier = 'corroborated' THEN 4 ELSE 3 END")
def strategy_list(t):
    """RC5, WN9: families of action with their support and outcomes: up to four that several clusters bear out, up to three others."""
    return strategies(t).filter("place <= case when tier = 'corroborated' then 4 else 3 end").select("query_id", "family", "tier", "place", "clusters", "cases_", "positive", "mixed", "unknown")


@query(f"WITH {_STRATEGIES}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (tier <> 'corroborated'), clusters DESC, cases_ DESC, family) AS n FROM ra) SELECT query_id, family, tier FROM p WHERE n = 1")
def headline_strategy(t):
    """XT33: each query's first strategy: borne out before single, then by support, cases and name."""
    key = F.struct((F.col("tier") != "corroborated").alias("t"), (-F.col("clusters")).alias("c"), (-F.col("cases_")).alias("n"), "family")
    return strategies(t).groupBy("query_id").agg(F.min_by(F.struct("family", "tier"), key).alias("b")).select("query_id", "b.family", "b.tier")


_EXAMPLES = f"""{_POOL}, ex AS (SELECT query_id, family, lower(trim(action_text)) AS k, min(CASE outcome WHEN 'positive' THEN 0 WHEN 'unknown' THEN 1 WHEN 'mixed' THEN 2 ELSE 3 END) AS o, min(doc_id) AS doc_id FROM pool WHERE trim(coalesce(action_text, '')) <> '' GROUP BY 1, 2, 3)"""


@query(f"WITH {_EXAMPLES} SELECT query_id, family, k AS action, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, family ORDER BY o, doc_id, k) AS place FROM ex) WHERE place <= 3")
def strategy_examples(t):
    """RC5: up to three different actions of each strategy, good outcomes first."""
    order = F.when(F.col("outcome") == "positive", 0).when(F.col("outcome") == "unknown", 1).when(F.col("outcome") == "mixed", 2).otherwise(3)
    rows = pool(t).filter("trim(coalesce(action_text, '')) <> ''").groupBy("query_id", "family", F.lower(F.trim("action_text")).alias("action")).agg(F.min(order).alias("o"), F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "family").orderBy("o", "doc_id", "action"))
    return rows.withColumn("place", place).filter("place <= 3").select("query_id", "family", "action", "doc_id", "place")


_SUBSET = "len(list_filter({a}, lambda v: NOT list_contains({b}, v))) = 0"


@query(f"""WITH {HITS}, k AS (SELECT h.query_id, h.doc_id, string_split(a.component, ' ') AS a, string_split(b.component, ' ') AS b FROM hit h JOIN cases a ON a.record_id = h.query_id JOIN cases b ON b.record_id = h.doc_id)
SELECT query_id, doc_id, {_SUBSET.format(a='a', b='b')} OR {_SUBSET.format(a='b', b='a')} AS covered FROM k""")
def component_coverage(t):
    """RC6: whether a hit's component names the query's, as a part or a whole of its words."""
    words = cases(t).select("record_id", F.split("component", " ").alias("w"))
    rows = hits(t).select("query_id", "doc_id").join(words.select(F.col("record_id").alias("query_id"), F.col("w").alias("a")), "query_id").join(words.select(F.col("record_id").alias("doc_id"), F.col("w").alias("b")), "doc_id")
    return rows.select("query_id", "doc_id", ((F.size(F.array_except("a", "b")) == 0) | (F.size(F.array_except("b", "a")) == 0)).alias("covered"))


@query(f"""WITH {HITS}, j AS (SELECT h.query_id, h.doc_id, h.rank, c.outcome FROM hit h JOIN cases c ON c.record_id = h.doc_id), k AS (SELECT query_id, doc_id, 'nearest' AS kind, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM j
UNION ALL SELECT query_id, doc_id, 'negative', row_number() OVER (PARTITION BY query_id ORDER BY rank) FROM j WHERE outcome IN ('negative', 'mixed') UNION ALL SELECT query_id, doc_id, 'recommended', row_number() OVER (PARTITION BY query_id ORDER BY rank) FROM j WHERE outcome = 'positive')
SELECT query_id, doc_id, kind, place FROM k WHERE place <= CASE WHEN kind = 'nearest' THEN 8 ELSE 5 END""")
def case_outputs(t):
    """RC9: each query's eight nearest cases, five that went badly and five that went well, one of each cluster."""
    rows = hits(t).join(cases(t).select(F.col("record_id").alias("doc_id"), "outcome"), "doc_id")
    kinds = F.filter(F.array(F.lit("nearest"), F.when(F.col("outcome").isin("negative", "mixed"), "negative"), F.when(F.col("outcome") == "positive", "recommended")), lambda v: v.isNotNull())
    rows = rows.select("query_id", "doc_id", "rank", F.explode(kinds).alias("kind"))
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank"))
    return rows.withColumn("place", place).filter("place <= case when kind = 'nearest' then 8 else 5 end").select("query_id", "doc_id", "kind", "place")


_ADVICE = f"""{VOTES}, {_COVERAGE}, {_LEADER}, mg AS (SELECT query_id, max(evidence) FILTER (rank = 1) AS one, coalesce(max(evidence) FILTER (rank = 2), 0) AS two, sum(evidence) AS total FROM votes GROUP BY 1),
ad AS (SELECT l.query_id, l.leader, v.support, round((one - two) / total, 6) AS margin, round(coalesce(found / anchors, 0), 6) AS coverage FROM lead_ l JOIN votes v ON v.query_id = l.query_id AND v.family = l.leader JOIN mg ON mg.query_id = l.query_id LEFT JOIN cov ON cov.query_id = l.query_id)"""


@query(f"""WITH {_ADVICE} SELECT query_id, leader, support, margin, coverage, CASE WHEN support >= 3 AND margin >= 0.08 AND coverage >= 0.75 THEN 'strong' WHEN support >= 2 AND margin >= 0.03 AND coverage >= 0.5 THEN 'moderate' WHEN support = 1 THEN 'limited' ELSE 'exploratory' END AS tier FROM ad""")
def recommendations(t):
    """RC11, RC3: each query's leading family with support, margin, coverage of its anchors, and the grade that follows."""
    found = cut(hits(t))
    votes = cut(e.family_votes(found))
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("evidence"))), F.lit(0.0))
    margin = votes.groupBy("query_id").agg(F.round((at(1) - at(2)) / F.sum("evidence"), 6).alias("margin"))
    rows = leaders(found, votes).join(votes.select("query_id", F.col("family").alias("leader"), "support"), ["query_id", "leader"]).join(margin, "query_id").join(coverage(t, found), "query_id", "left")
    rows = rows.withColumn("coverage", F.round(F.coalesce(F.col("found") / F.col("anchors"), F.lit(0.0)), 6))
    return rows.select("query_id", "leader", "support", "margin", "coverage", e.evidence_tier(F.col("support"), F.col("margin"), F.col("coverage")).alias("tier"))


@query(f"WITH {HITS}, {_ANCHORS}, s AS (SELECT hit.query_id, count(DISTINCT hit.cluster) FILTER (q.component <> '(unspecified)' AND list_contains(d.components, q.component)) AS c, count(DISTINCT hit.cluster) FILTER (q.fault <> '(unspecified)' AND list_contains(d.faults, q.fault)) AS f, any_value(q.component) AS component, any_value(q.fault) AS fault FROM hit JOIN cases q ON q.record_id = hit.query_id JOIN cases d ON d.record_id = hit.doc_id GROUP BY 1) SELECT query_id, CASE WHEN component <> '(unspecified)' THEN c WHEN fault <> '(unspecified)' THEN f ELSE 0 END AS support FROM s")
def scoped_support(t):
    """AG32: the clusters that stand behind a query's component, else its fault, else none."""
    facts = cases(t)
    rows = hits(t).select("query_id", "doc_id", "cluster").join(facts.select(F.col("record_id").alias("query_id"), "component", "fault"), "query_id").join(facts.select(F.col("record_id").alias("doc_id"), "components", "faults"), "doc_id")
    inside = F.when(F.col("component") != "(unspecified)", F.array_contains("components", F.col("component"))).when(F.col("fault") != "(unspecified)", F.array_contains("faults", F.col("fault"))).otherwise(F.lit(False))
    return rows.groupBy("query_id").agg(F.count_distinct(F.when(inside, F.col("cluster"))).alias("support"))


# Case graphs


@query(f"WITH {RELATIONS} SELECT type, count(DISTINCT label) AS nodes, count(*) AS mentions, count(DISTINCT record_id) AS records FROM ent GROUP BY 1")
def kg_type_summary(t):
    """KG5: nodes, mentions and records by type."""
    return g.mentions(annotated(t)).groupBy("type").agg(F.count_distinct("label").alias("nodes"), F.count("*").alias("mentions"), F.count_distinct("record_id").alias("records"))


_BY_ID = "CAST(substr(record_id, 3) AS BIGINT) % 100 = 0"


@query(f"""WITH {RELATIONS}, e AS (SELECT DISTINCT record_id, type || ':' || label AS node FROM ent WHERE {_BY_ID}), r AS (SELECT DISTINCT record_id, source_type || ':' || source AS source, target_type || ':' || target AS target, relation FROM rel WHERE problem IS NULL AND {_BY_ID})
SELECT record_id, node, NULL::VARCHAR AS relation, NULL::VARCHAR AS target FROM e UNION ALL SELECT record_id, source, relation, target FROM r""")
def query_graphs(t):
    """KG4: the graph of each query record: one node for each type and text, and its relations."""
    rows = annotated(t).filter(_BY_ID)
    nodes = g.mentions(rows).select("record_id", F.concat_ws(":", "type", "label").alias("node"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("target")).distinct()
    edges = g.resolved_relations(rows).filter("problem is null").select("record_id", F.concat_ws(":", "source_type", "source").alias("node"), "relation", F.concat_ws(":", "target_type", "target").alias("target")).distinct()
    return nodes.unionByName(edges)


@query(f"""WITH {CASES}, f AS (SELECT DISTINCT record_id, component, v AS fault, action_family FROM (SELECT record_id, component, action_family, unnest(faults) AS v FROM cases) WHERE component <> '(unspecified)' AND v IS NOT NULL AND v <> ''),
a AS (SELECT component, fault, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT fault, action_family, count(*) AS n FROM f JOIN a USING (component, fault) WHERE action_family <> 'Other' GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT component AS source, fault AS target, 'component_fault' AS kind, a.n FROM a UNION ALL SELECT fault, action_family, 'fault_action', n FROM b""")
def corpus_graph(t):
    """KG3: components, their faults and the families of action that follow them, each edge with a least number of records; actions only of faults that have a component."""
    rows = cases(t).select("record_id", "component", "action_family", F.explode("faults").alias("fault")).filter("component <> '(unspecified)' and fault <> ''").distinct()
    first = rows.groupBy("component", "fault").agg(F.count("*").alias("n")).filter("n >= 3")
    used = rows.join(first.select("component", "fault"), ["component", "fault"], "left_semi").filter("action_family <> 'Other'")
    second = used.groupBy("fault", "action_family").agg(F.count("*").alias("n")).filter("n >= 3")
    return first.select(F.col("component").alias("source"), F.col("fault").alias("target"), F.lit("component_fault").alias("kind"), "n").unionByName(second.select(F.col("fault").alias("source"), F.col("action_family").alias("target"), F.lit("fault_action").alias("kind"), "n"))


_STEPS = f"""{RELATIONS}, pos AS (SELECT record_id, e.entity_id AS id, e.start_pos AS start_pos, {_key('e.text')} AS action FROM (SELECT record_id, unnest(entities) AS e FROM rec) WHERE e.entity_type = 'ACTION'),
rr AS (SELECT raw.record_id, r.source_entity_id AS id, list_distinct(list(r.relation_type)) AS kinds FROM raw JOIN ent a ON a.record_id = raw.record_id AND a.entity_id = r.source_entity_id JOIN ent b ON b.record_id = raw.record_id AND b.entity_id = r.target_entity_id WHERE r.relation_type || '|' || a.type || '|' || b.type IN (SELECT DISTINCT relation || '|' || source_type || '|' || target_type FROM rel WHERE problem IS NULL) GROUP BY 1, 2),
steps AS (SELECT p.record_id, p.id, p.action, row_number() OVER (PARTITION BY p.record_id ORDER BY coalesce(start_pos, 1000000000), p.id) AS place, coalesce(kinds, []) AS kinds FROM pos p LEFT JOIN rr USING (record_id, id)),
roles AS (SELECT record_id, place, action, CASE WHEN list_contains(kinds, 'ACTION_ADDRESSES_ISSUE') THEN 'corrective' WHEN list_contains(kinds, 'ACTION_RESULTS_IN_OUTCOME') THEN 'verification' WHEN list_contains(kinds, 'ACTION_INVESTIGATES_ISSUE') THEN 'diagnostic'
  WHEN list_contains(kinds, 'ACTION_ON_ITEM') AND regexp_matches(action, '^(?:{'|'.join(c.ENABLING)})(?: |$)') THEN 'enabling' ELSE 'unresolved' END AS role FROM steps)"""


@query(f"WITH {_STEPS} SELECT record_id, place, action, role FROM roles")
def procedure_steps(t):
    """CB4, CB5: a record's actions in the order of their places, with the role that their relations give them."""
    return c.procedure_steps(annotated(t))


@query(f"WITH {_STEPS} SELECT role, count(*) AS steps, count(DISTINCT record_id) AS records FROM roles GROUP BY 1")
def role_counts(t):
    """AG25: steps by role."""
    return c.procedure_steps(annotated(t)).groupBy("role").agg(F.count("*").alias("steps"), F.count_distinct("record_id").alias("records"))


@query(f"""WITH {CASES}, k AS (SELECT record_id, cluster_id, trim(regexp_replace(lower(coalesce(problem_text, '')), '[^a-z0-9]+', ' ', 'g')) AS p, trim(regexp_replace(lower(coalesce(action_text, '')), '[^a-z0-9]+', ' ', 'g')) AS a FROM cases)
SELECT record_id, coalesce(cluster_id, 'PX-' || substr(sha256(p), 1, 16)) AS cluster, CASE WHEN cluster_id IS NULL THEN 'exact_normalized_problem_hash' ELSE 'raw_cluster_column' END AS method, 'EX-' || substr(sha256(p || '||' || a), 1, 16) AS exact_group, a <> '' AS complete FROM k""")
def case_identity(t):
    """CB5: a case's cluster, or a digest of its problem where none is given; its exact group; whether it has a solution."""
    p, a = x.fingerprint("problem_text"), x.fingerprint("action_text")
    method = F.when(F.col("cluster_id").isNull(), "exact_normalized_problem_hash").otherwise("raw_cluster_column")
    return cases(t).select("record_id", F.coalesce("cluster_id", x.stable_hash("PX-", p)).alias("cluster"), method.alias("method"), x.stable_hash("EX-", F.concat(p, F.lit("||"), a)).alias("exact_group"), (a != "").alias("complete"))


@query(f"""WITH {_STEPS}, {CASES}, s AS (SELECT DISTINCT record_id FROM roles), q AS (SELECT DISTINCT record_id FROM rel WHERE problem IS NOT NULL)
SELECT count(*) AS cases, count(s.record_id) AS with_steps, count(*) FILTER (cases.cluster_id IS NULL) AS without_cluster, count(*) FILTER (coalesce(trim(action_text), '') = '') AS incomplete, count(q.record_id) AS quarantined FROM cases LEFT JOIN s ON s.record_id = cases.record_id LEFT JOIN q ON q.record_id = cases.record_id""")
def case_report(t):
    """CB6: what a build of the cases has to report."""
    records = annotated(t)
    steps = c.procedure_steps(records).select("record_id").distinct().withColumn("_s", F.lit(1))
    bad = g.resolved_relations(records).filter("problem is not null").select("record_id").distinct().withColumn("_q", F.lit(1))
    rows = cases(t).join(steps, "record_id", "left").join(bad, "record_id", "left")
    return rows.agg(F.count("*").alias("cases"), F.count("_s").alias("with_steps"), F.count_if(F.col("cluster_id").isNull()).alias("without_cluster"), F.count_if(F.coalesce(F.trim("action_text"), F.lit("")) == "").alias("incomplete"), F.count("_q").alias("quarantined"))


@query(f"""WITH {RELATIONS}, i AS (SELECT DISTINCT record_id, source AS issue, source_type AS issue_type, target AS item FROM rel WHERE relation = 'ISSUE_ON_ITEM' AND problem IS NULL)
SELECT record_id, list_sort(list_distinct(list(issue_type || ':' || issue))) AS issues, list_sort(list_distinct(list('MAINT_ITEM:' || item))) AS items, count(*) AS pairs FROM i GROUP BY 1""")
def reconstructed_graphs(t):
    """CB8: a problem's graph built again from its stored pairs: distinct nodes by type and text, and the pairs that join them."""
    pairs = g.resolved_relations(annotated(t)).filter("relation = 'ISSUE_ON_ITEM' and problem is null").select("record_id", F.concat_ws(":", "source_type", "source").alias("issue"), F.concat(F.lit("MAINT_ITEM:"), "target").alias("item")).distinct()
    return pairs.groupBy("record_id").agg(F.sort_array(F.collect_set("issue")).alias("issues"), F.sort_array(F.collect_set("item")).alias("items"), F.count("*").alias("pairs"))


_LINKED = "l AS (SELECT record_id, r.relation_type AS relation, r.source_entity_id AS source, r.target_entity_id AS target, coalesce(r.confidence, 0) AS score FROM (SELECT record_id, unnest(relations) AS r FROM rec))"


@query(f"WITH {RELATIONS}, {_LINKED} SELECT record_id, source AS issue, arg_min(target, {{'s': -score, 't': target}}) AS item, max(score) AS score FROM l WHERE relation = 'ISSUE_ON_ITEM' GROUP BY 1, 2")
def best_item_link(t):
    """WN7: the surest item of each issue's mention; of equal ones the first."""
    rows = annotated(t).select("record_id", F.explode("relations").alias("r")).filter("r.relation_type = 'ISSUE_ON_ITEM'")
    rows = rows.select("record_id", F.col("r.source_entity_id").alias("issue"), F.col("r.target_entity_id").alias("item"), F.coalesce("r.confidence", F.lit(0.0)).alias("score"))
    return rows.groupBy("record_id", "issue").agg(F.min_by("item", F.struct(-F.col("score"), "item")).alias("item"), F.max("score").alias("score"))


@query(f"""WITH {RELATIONS}, it AS (SELECT DISTINCT record_id, label AS item FROM ent WHERE type = 'MAINT_ITEM' AND label <> ''), lo AS (SELECT record_id, min(label) AS lone FROM ent WHERE type = 'LOC' AND label <> '' GROUP BY 1 HAVING count(DISTINCT label) = 1),
hl AS (SELECT record_id, source AS item, min(target) AS place FROM rel WHERE relation = 'HAS_LOCATION' AND source_type = 'MAINT_ITEM' AND problem IS NULL AND target <> '' GROUP BY 1, 2) SELECT record_id, item, coalesce(place, lone) AS location, CASE WHEN place IS NOT NULL THEN 'relation' WHEN lone IS NOT NULL THEN 'only_one' ELSE 'none' END AS method FROM it LEFT JOIN hl USING (record_id, item) LEFT JOIN lo USING (record_id)""")
def bound_locations(t):
    """RC8: an item's location by its relation, else the record's only one; where there are several, none is guessed."""
    records = annotated(t)
    named = g.mentions(records).filter("label <> ''")
    items = named.filter("type = 'MAINT_ITEM'").select("record_id", F.col("label").alias("item")).distinct()
    lone = named.filter("type = 'LOC'").groupBy("record_id").agg(F.min("label").alias("lone"), F.max("label").alias("_m")).filter("lone = _m").drop("_m")
    own = g.resolved_relations(records).filter("relation = 'HAS_LOCATION' and source_type = 'MAINT_ITEM' and problem is null and target <> ''").groupBy("record_id", F.col("source").alias("item")).agg(F.min("target").alias("place"))
    method = F.when(F.col("place").isNotNull(), "relation").when(F.col("lone").isNotNull(), "only_one").otherwise("none")
    return items.join(own, ["record_id", "item"], "left").join(lone, "record_id", "left").select("record_id", "item", F.coalesce("place", "lone").alias("location"), method.alias("method"))


# Evaluation


_AT = "round(avg((coalesce(rank, 1000000) <= {k})::INT), 6)"


@query(f"WITH {RANKS} SELECT count(*) AS queries, {_AT.format(k=1)} AS top_1, {_AT.format(k=3)} AS top_3, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_3, (SELECT round(avg(n), 6) FROM (SELECT query_id, count(DISTINCT family) FILTER (family <> 'Other') AS n FROM hit GROUP BY 1)) AS diversity FROM ranks WHERE true_family <> 'Other'")
def partition_metrics(t):
    """EV2: agreement among the first, nDCG of three, and how many families ten hits have."""
    found = cut(hits(t))
    rows = found.select("query_id", "true_family").distinct().filter("true_family <> 'Other'").join(e.family_votes(found).select("query_id", F.col("family").alias("true_family"), "rank"), ["query_id", "true_family"], "left")
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(1_000_000)) <= k).cast("int")), 6)
    sums = rows.agg(F.count("*").alias("queries"), at(1).alias("top_1"), at(3).alias("top_3"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("rank") <= 3, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias("ndcg_3"))
    spread = found.groupBy("query_id").agg(F.count_distinct(F.when(F.col("family") != "Other", F.col("family"))).alias("n")).agg(F.round(F.avg("n"), 6).alias("diversity"))
    return sums.join(F.broadcast(spread))


_METHODS = f"""{TFIDF}, {CASES}, al AS (SELECT 'bm25' AS method, * FROM bm UNION ALL SELECT 'tfidf', * FROM tf), tp AS (SELECT a.method, a.query_id, a.doc_id, row_number() OVER (PARTITION BY a.method, a.query_id ORDER BY round(a.score, 6) DESC, a.doc_id) AS rank, d.action_family AS family, q.action_family AS true_family
  FROM al a JOIN cases d ON d.record_id = a.doc_id JOIN cases q ON q.record_id = a.query_id WHERE a.doc_id <> a.query_id AND coalesce(d.cluster_id, a.doc_id) <> coalesce(q.cluster_id, a.query_id)),
fr AS (SELECT method, query_id, any_value(true_family) AS true_family, min(rank) FILTER (family = true_family) AS first FROM tp GROUP BY 1, 2), fm AS (SELECT method, avg(r) AS macro FROM (SELECT method, true_family, avg((coalesce(first, 0) = 1)::INT) AS r FROM fr GROUP BY 1, 2) GROUP BY 1),
ms AS (SELECT method, count(*) AS queries, round(any_value(macro), 6) AS macro_recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg((coalesce(first, 0) = 1)::INT), 6) AS hit_1 FROM fr JOIN fm USING (method) GROUP BY 1)"""


def method_metrics(t):
    """Each retrieval method's recall over families, reciprocal rank and hits, on the same queries, without the query's own cluster."""
    first = cut(r.first_right(*word_passes(t, case_facts(t), ("bm25", "tfidf"))))
    right = (F.coalesce("first", F.lit(0)) == 1).cast("int")
    macro = first.groupBy("method", "true_family").agg(F.avg(right).alias("r")).groupBy("method").agg(F.round(F.avg("r"), 6).alias("macro_recall"))
    sums = first.groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(right), 6).alias("hit_1"))
    return sums.join(macro, "method").select("method", "queries", "macro_recall", "mrr", "hit_1")


@query(f"WITH {_METHODS} SELECT method, queries, macro_recall, mrr, hit_1 FROM ms")
def method_table(t):
    """XT30, AG28: methods side by side on the same queries."""
    return method_metrics(t)


@query(f"WITH {_METHODS} SELECT arg_max(method, {{'a': macro_recall, 'b': mrr, 'c': hit_1, 'd': method}}) AS method FROM ms")
def chosen_method(t):
    """EV3: the method with the most recall over families, then reciprocal rank, then hits."""
    return method_metrics(t).agg(F.max_by("method", F.struct("macro_recall", "mrr", "hit_1", "method")).alias("method"))


@query(f"""WITH {RANKS}, m AS (SELECT true_family AS family, avg((coalesce(rank, 0) = 1)::INT) AS r, count(*) AS n FROM ranks GROUP BY 1), t AS (SELECT arg_max(family, {{'n': n, 'f': family}}) AS family, max(n) AS n FROM m) SELECT round(avg(m.r), 6) AS macro_recall, any_value(t.family) AS majority, round(any_value(t.n) / sum(m.n), 6) AS majority_rate FROM m, t""")
def macro_recall(t):
    """AG28, EV7: recall averaged over families, beside what the most frequent family alone would reach; the query's cluster is left out of its hits."""
    by = ranks(t).groupBy(F.col("true_family").alias("family")).agg(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("int")).alias("r"), F.count("*").alias("n"))
    return by.agg(F.round(F.avg("r"), 6).alias("macro_recall"), F.max_by("family", F.struct("n", "family")).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("majority_rate"))


@query(f"WITH {HITS} SELECT query_id, family, round(sum(score), 6) AS total, count(DISTINCT cluster) AS clusters FROM hit GROUP BY 1, 2")
def summed_families(t):
    """AG29: families by the sum of their hits' scores, with the clusters behind them."""
    return hits(t).groupBy("query_id", "family").agg(F.round(F.sum("score"), 6).alias("total"), F.count_distinct("cluster").alias("clusters"))


@query(f"""WITH {HITS}, sx AS (SELECT h.query_id, h.rank, list_has_any(d.components, q.components) AS right_ FROM hit h JOIN cases q ON q.record_id = h.query_id JOIN cases d ON d.record_id = h.doc_id), f AS (SELECT query_id, min(rank) FILTER (right_) AS first, count(*) AS n FROM sx GROUP BY 1)
SELECT count(*) AS queries, {_AT.format(k=1).replace('rank', 'first')} AS recall_1, {_AT.format(k=3).replace('rank', 'first')} AS recall_3, {_AT.format(k=5).replace('rank', 'first')} AS recall_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg((first IS NOT NULL)::INT), 6) AS coverage FROM f""")
def procedure_metrics(t):
    """EV4: how far down the first hit stands that works on one of the query's components."""
    facts = cases(t).select("record_id", "components")
    rows = hits(t).join(facts.select(F.col("record_id").alias("doc_id"), F.col("components").alias("d")), "doc_id").join(facts.select(F.col("record_id").alias("query_id"), F.col("components").alias("q")), "query_id")
    first = rows.groupBy("query_id").agg(F.min(F.when(F.arrays_overlap("d", "q"), F.col("rank"))).alias("first"))
    at = lambda k: F.round(F.avg((F.coalesce("first", F.lit(1_000_000)) <= k).cast("int")), 6)
    return first.agg(F.count("*").alias("queries"), at(1).alias("recall_1"), at(3).alias("recall_3"), at(5).alias("recall_5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("coverage"))


@query(f"WITH {HITS}, p AS (SELECT 'P-' || substr(sha256(query_id || '|' || doc_id), 1, 12) AS pair_id, query_id, doc_id FROM hit WHERE rank <= 5) SELECT pair_id, substr(sha256('blind:' || query_id), 1, 8) AS query_code, c.problem_text AS candidate_problem, row_number() OVER (ORDER BY sha256('order:' || pair_id)) AS place FROM p JOIN cases c ON c.record_id = doc_id")
def blinded_pool(t):
    """EV6: five hits of each query to be judged, under digests, in an order that tells nothing; scores, ranks and families stay hidden."""
    from hangarlake.sources import tables

    pairs = hits(t).filter("rank <= 5").join(cases(t).select(F.col("record_id").alias("doc_id"), F.col("problem_text").alias("candidate_problem")), "doc_id")
    pair_id = x.stable_hash("P-", F.concat_ws("|", "query_id", "doc_id"), 12)
    rows = pairs.select(pair_id.alias("pair_id"), F.substring(F.sha2(F.concat(F.lit("blind:"), "query_id"), 256), 1, 8).alias("query_code"), "candidate_problem")
    rows = tables.numbered(rows.withColumn("_o", F.sha2(F.concat(F.lit("order:"), "pair_id"), 256)), "_o")
    return rows.select("pair_id", "query_code", "candidate_problem", (F.col("_place") + 1).alias("place"))


_CUT = "regexp_extract_all(array_to_string(regexp_extract_all(coalesce(problem, ''), '\\S+')[1:4], ' ').lower(), '[a-z0-9#]+')"
_SHORT = BM25.replace("SELECT DISTINCT query_id, unnest(words) AS term FROM q", f"SELECT DISTINCT doc_id AS query_id, unnest({_CUT}) AS term FROM docs WHERE CAST(substr(doc_id, 3) AS BIGINT) % 100 = 0")


@query(f"""WITH full_ AS (WITH {BM25} {_RANKED.format(src='bm', k=5)}), short_ AS (WITH {_SHORT} {_RANKED.format(src='bm', k=5)}), o AS (SELECT f.query_id, count(s.doc_id) / count(*) AS kept FROM full_ f LEFT JOIN short_ s ON s.query_id = f.query_id AND s.doc_id = f.doc_id GROUP BY 1)
SELECT count(*) AS queries, round(avg(kept), 6) AS kept, round(1 - avg(kept), 6) AS dropped FROM o""")
def robustness(t):
    """EV9: how many of a query's five best documents stay when only its first four words are left."""
    docs = documents(t)
    words = F.regexp_extract_all(F.coalesce("problem", F.lit("")), F.lit(r"\S+"), F.lit(0))
    short = _queries(docs).withColumn("words", x.tokens(F.array_join(F.slice(words, 1, 4), " "), "[a-z0-9#]+"))
    few = r.top_k(r.bm25(short, docs.select("doc_id", "words")), 5).select("query_id", "doc_id", F.lit(1).alias("_s"))
    kept = r.top_k(bm25(t), 5).join(few, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("_s") / F.count("*")).alias("kept"))
    return kept.agg(F.count("*").alias("queries"), F.round(F.avg("kept"), 6).alias("kept"), F.round(1 - F.avg("kept"), 6).alias("dropped"))


@query(f"""WITH {TFIDF}, a AS (SELECT query_id, doc_id, round(score, 6) AS score FROM bm), top_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM a) WHERE rn <= 20), j AS (SELECT top_.query_id, top_.doc_id, top_.score, coalesce(tf.score, 0) AS other FROM top_ LEFT JOIN tf USING (query_id, doc_id)),
u AS (SELECT query_id, doc_id, CASE WHEN max(other) OVER w - min(other) OVER w > 1e-12 THEN (other - min(other) OVER w) / (max(other) OVER w - min(other) OVER w) ELSE 0 END AS o, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM j WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, doc_id, 0.4 * o + 0.6 * s AS score FROM u) {_RANKED.format(src='b', k=5)}""")
def reranked(t):
    """SM13: the twenty best documents in a new order, by a blend of their scores with a second judge's, each scaled within the query."""
    rows = r.top_k(r.near(*word_passes(t, channels=("bm25", "tfidf")), 20, blocks.first_best), 20).select("query_id", "doc_id", "score", "other")
    rows = r.unit_channel(r.unit_channel(rows, "other"), "score")
    return r.top_k(rows.select("query_id", "doc_id", (0.4 * F.col("other") + 0.6 * F.col("score")).alias("score")), 5)


@query(f"""WITH {SCORED}, m AS (SELECT seed, avg(((p >= 0.7)::INT = y)::INT) AS a FROM (SELECT p, y, ('0x' || substr(md5(k), 1, 8))::BIGINT % 5 AS seed FROM sc) GROUP BY 1) SELECT count(*) AS seeds, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS deviation FROM m""")
def seed_spread(t):
    """AG31: a measure over several draws: its mean and how far it spreads."""
    seed = F.pmod(F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("long"), F.lit(5))
    by = scored(t).groupBy(seed.alias("seed")).agg(F.avg(((F.col("p") >= 0.7).cast("int") == F.col("y")).cast("int")).alias("a"))
    return by.agg(F.count("*").alias("seeds"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("deviation"))


_CUTS = (0.5, 0.6, 0.7, 0.8)


@query(f"""WITH {SCORED}, w AS (SELECT round, p, y, {_POISSON} AS w FROM (SELECT round, p, y, ('0x' || substr(md5(round || ':' || k), 1, 8))::BIGINT / 4294967296.0 AS u FROM sc, (SELECT unnest(generate_series(1, 50)) AS round))),
m AS (SELECT round, {', '.join(f'sum(w * ((p >= {v})::INT = y)::INT) / sum(w) AS a{i}' for i, v in enumerate(_CUTS))} FROM w GROUP BY 1), d AS ({' UNION ALL '.join(f"SELECT 'a{i}' AS first, 'a{j}' AS second, a{i} - a{j} AS d FROM m" for i in range(4) for j in range(i + 1, 4))}),
q AS (SELECT first, second, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d GROUP BY 1, 2) SELECT first, second, low, high, CASE WHEN low > 0 THEN 'first' WHEN high < 0 THEN 'second' ELSE 'neither' END AS verdict FROM q""")
def pairwise_verdicts(t):
    """XT18: every two of several models, on the same resampled rows, and which one is better."""
    right = lambda v: ((F.col("p") >= v).cast("int") == F.col("y")).cast("int")
    b = e.bootstrap(scored(t), "k", 50, n=F.lit(1), **{f"a{i}": right(v) for i, v in enumerate(_CUTS)})
    pairs = [F.struct(F.lit(f"a{i}").alias("first"), F.lit(f"a{j}").alias("second"), ((F.col(f"a{i}") / F.col("n")) - (F.col(f"a{j}") / F.col("n"))).alias("d")) for i in range(4) for j in range(i + 1, 4)]
    rows = b.select(F.explode(F.array(*pairs)).alias("v")).select("v.*").groupBy("first", "second").agg(F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"))
    return rows.withColumn("verdict", F.when(F.col("low") > 0, "first").when(F.col("high") < 0, "second").otherwise("neither"))


_LOCATED = f"""{RELATIONS}, lo AS (SELECT record_id, min(label) AS lone FROM ent WHERE type = 'LOC' AND label <> '' GROUP BY 1 HAVING count(DISTINCT label) = 1), hl AS (SELECT record_id, source AS item, min(target) AS place FROM rel WHERE relation = 'HAS_LOCATION' AND source_type = 'MAINT_ITEM' AND problem IS NULL AND target <> '' GROUP BY 1, 2),
su AS (SELECT DISTINCT record_id, target AS item, source AS issue FROM rel WHERE relation = 'ISSUE_ON_ITEM' AND problem IS NULL)"""


@query(f"WITH {_LOCATED} SELECT record_id, item, issue, location, place FROM (SELECT record_id, item, issue, coalesce(hl.place, lone) AS location, row_number() OVER (PARTITION BY record_id ORDER BY item, issue) AS place FROM su LEFT JOIN hl USING (record_id, item) LEFT JOIN lo USING (record_id)) WHERE place <= 4")
def located_subproblems(t):
    """RC7: a compound problem as up to four pairs of an issue and its item, each with the item's location."""
    records = annotated(t)
    relations = cut(g.resolved_relations(records).filter("problem is null"))
    own = relations.filter("relation = 'HAS_LOCATION' and source_type = 'MAINT_ITEM' and target <> ''").groupBy("record_id", F.col("source").alias("item")).agg(F.min("target").alias("_own"))
    lone = g.mentions(records).filter("type = 'LOC' and label <> ''").groupBy("record_id").agg(F.min("label").alias("_lone"), F.max("label").alias("_m")).filter("_lone = _m").drop("_m")
    rows = c.subproblems(relations).join(own, ["record_id", "item"], "left").join(lone, "record_id", "left")
    return rows.select("record_id", "item", "issue", F.coalesce("_own", "_lone").alias("location"), "place")


@query(f"""WITH {CASES}, o AS (SELECT * FROM cases WHERE outcome <> 'negative' AND cluster_id IS NOT NULL), m AS (SELECT cluster_id, count(*) AS records FROM o GROUP BY 1),
i AS (SELECT cluster_id, list(record_id ORDER BY record_id) AS sources FROM (SELECT cluster_id, record_id, row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) AS rn FROM o) WHERE rn <= 25 GROUP BY 1) SELECT cluster_id, records, sources FROM m JOIN i USING (cluster_id)""")
def job_card_sources(t):
    """RC10: the records without a bad outcome behind each card, the first 25 by id; job_cards has its steps."""
    rows = cases(t).filter("outcome <> 'negative' and cluster_id is not null").select("cluster_id", "record_id")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("record_id"))).filter("_n <= 25")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("records")).join(few.groupBy("cluster_id").agg(F.sort_array(F.collect_list("record_id")).alias("sources")), "cluster_id")


@query(f"WITH {CASES}, n AS (SELECT cluster_id, action_family, count(*) AS n FROM cases WHERE outcome <> 'negative' AND cluster_id IS NOT NULL GROUP BY 1, 2) SELECT cluster_id, action_family AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, action_family) AS rn FROM n) WHERE rn = 1")
def dominant_actions(t):
    """RC10: the family that most of a card's records have."""
    n = cases(t).filter("outcome <> 'negative' and cluster_id is not null").groupBy("cluster_id", "action_family").agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.min_by(F.struct("action_family", "n"), F.struct(-F.col("n"), "action_family")).alias("b")).select("cluster_id", F.col("b.action_family").alias("dominant"), "b.n")


_TOPS = {"component": "component", "fault": "fault", "family": "action_family", "outcome": "outcome"}


@query(f"WITH {CASES}, u AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {c} AS name FROM cases" for k, c in _TOPS.items())}), n AS (SELECT kind, name, count(*) AS n FROM u WHERE name NOT IN ('', '(unspecified)', 'Other') GROUP BY 1, 2) SELECT kind, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM n) WHERE place <= 8")
def overview(t):
    """XT24: the eight most frequent components, faults, families and outcomes, from one pass over the cases."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(col).alias("name")) for k, col in _TOPS.items()])).alias("v")
    n = cases(t).select(kinds).select("v.*").filter(~F.col("name").isin("", "(unspecified)", "Other")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))).filter("place <= 8")


_FOUR = {"c": ("components", 0.4), "f": ("faults", 0.3), "e": ("entity_types", 0.15), "r": ("relation_types", 0.15)}
_FOUR_SQL = f"""{CASES}, ty AS (SELECT record_id, list_distinct(list_transform(e, lambda v: v.entity_type)) AS entity_types, list_distinct(list_transform(r, lambda v: v.relation_type)) AS relation_types FROM (SELECT record_id, arg_max(entities, received_at) AS e, arg_max(relations, received_at) AS r FROM maintenance_record GROUP BY 1)),
al AS (SELECT c.record_id, list_distinct(components) AS components, list_distinct(faults) AS faults, coalesce(entity_types, []) AS entity_types, coalesce(relation_types, []) AS relation_types FROM cases c LEFT JOIN ty USING (record_id)),
qs AS (SELECT *, {' + '.join(f'(CASE WHEN len({c}) > 0 THEN {w} ELSE 0 END)' for c, w in _FOUR.values())} AS total FROM al WHERE CAST(substr(record_id, 3) AS BIGINT) % 100 = 0),
pt AS ({' UNION ALL '.join(f'SELECT q.record_id AS query_id, d.record_id AS doc_id, {w} / len(q.{c}) / q.total AS s FROM (SELECT *, unnest({c}) AS v FROM qs) q JOIN (SELECT record_id, unnest({c}) AS v FROM al) d USING (v)' for c, w in _FOUR.values())}),
fo AS (SELECT query_id, doc_id, sum(s) AS score FROM pt GROUP BY 1, 2)"""


@query(f"WITH {_FOUR_SQL} {_RANKED.format(src='fo', k=5)}")
def structure_topk(t):
    """SM9: the share of a query's components, faults, entity types and relation types that a document has, by weight, over the sets that the query has."""
    types = annotated(t).select("record_id", F.array_distinct(F.transform("entities", lambda v: v["entity_type"])).alias("entity_types"), F.array_distinct(F.transform("relations", lambda v: v["relation_type"])).alias("relation_types"))
    empty = F.array().cast("array<string>")
    rows = cases(t).select("record_id", "components", "faults").join(types, "record_id", "left").select(F.col("record_id").alias("doc_id"), "components", "faults", F.coalesce("entity_types", empty).alias("entity_types"), F.coalesce("relation_types", empty).alias("relation_types"))
    return r.top_k(r.structural(_queries(rows), rows, [col for col, _ in _FOUR.values()]), 5)
