"""Queries of extraction, validation and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarlake.functions import align, fixed
from hangarlake.operators import graph as g
from hangarlake.operators import normalize as n
from hangarlake.plans.registry import query


def annotated(t):
    rows = t.maintenance_record.groupBy("record_id").agg(F.max_by(F.struct("full_text", "entities", "relations"), "received_at").alias("r"))
    return rows.select("record_id", "r.*")


ANNOTATED = "rec AS (SELECT record_id, r.full_text AS full_text, r.entities AS entities, r.relations AS relations FROM (SELECT record_id, arg_max({'full_text': full_text, 'entities': entities, 'relations': relations}, received_at) AS r FROM maintenance_record GROUP BY 1))"


def _key(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({c}), '\s+', ' ', 'g'), '^[ .,;:-]+|[ .,;:-]+$', '', 'g')"


_ALLOWED = ", ".join(f"'{r}|{h}|{t}'" for r, hs, ts in fixed.SIGNATURES for h in hs for t in ts)
RELATIONS = f"""{ANNOTATED}, ent AS (SELECT record_id, e.entity_id, {_key('e.text')} AS label, e.entity_type AS type FROM (SELECT record_id, unnest(entities) AS e FROM rec)),
raw AS (SELECT record_id, r FROM (SELECT record_id, unnest(relations) AS r FROM rec)),
rel AS (SELECT raw.record_id, r.relation_type AS relation, a.label AS source, a.type AS source_type, b.label AS target, b.type AS target_type,
  CASE WHEN a.entity_id IS NULL OR b.entity_id IS NULL THEN 'endpoint_missing' WHEN r.relation_type || '|' || a.type || '|' || b.type NOT IN ({_ALLOWED}) THEN 'signature' END AS problem
  FROM raw LEFT JOIN ent a ON a.record_id = raw.record_id AND a.entity_id = r.source_entity_id LEFT JOIN ent b ON b.record_id = raw.record_id AND b.entity_id = r.target_entity_id)"""
_EDGE = "source, source_type, relation, target, target_type"


@query(f"WITH {ANNOTATED}, e AS (SELECT record_id, unnest(entities) AS e FROM rec) SELECT {_key('e.text')} AS label, e.entity_type AS type, count(*) AS mention_count, count(DISTINCT record_id) AS record_count FROM e GROUP BY 1, 2")
def kg_nodes(t):
    """AG11, KG1, D11."""
    return g.nodes(annotated(t))


@query(f"WITH {RELATIONS} SELECT {_EDGE}, count(DISTINCT record_id) AS record_count FROM rel WHERE problem IS NULL GROUP BY ALL")
def kg_edges(t):
    """AG12, KG1, KG2."""
    return g.edges(annotated(t))


@query(f"WITH {RELATIONS} SELECT DISTINCT {_EDGE}, record_id FROM rel WHERE problem IS NULL")
def kg_edge_evidence(t):
    """AG13."""
    return g.edge_evidence(annotated(t))


@query(f"WITH {RELATIONS} SELECT relation, problem, count(*) AS n, count(DISTINCT record_id) AS records FROM rel WHERE problem IS NOT NULL GROUP BY 1, 2")
def kg_quarantine(t):
    """CB3, KG1: relations whose ends or types don't fit."""
    bad = g.resolved_relations(annotated(t)).filter("problem is not null")
    return bad.groupBy("relation", "problem").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


#: Records that support an edge of a planning view at least.
MIN_WEIGHT = 2


def _view_sql(columns: str, *relations: str) -> str:
    names = ", ".join(f"'{x}'" for x in relations)
    return f"WITH {RELATIONS}, e AS (SELECT {_EDGE}, count(DISTINCT record_id) AS n FROM rel WHERE problem IS NULL GROUP BY ALL) SELECT {columns}, n AS record_count FROM e WHERE relation IN ({names}) AND n >= {MIN_WEIGHT}"


def _view(t, columns: dict, *relations: str):
    return g.view(annotated(t), MIN_WEIGHT, *relations).select(*[F.col(c).alias(name) for name, c in columns.items()], "record_count")


@query(_view_sql("target AS item, source AS issue, source_type AS issue_type", "ISSUE_ON_ITEM"))
def kg_view_all_item_faults(t):
    """AG14, ST1: the first of six planning views, in order."""
    return _view(t, {"item": "target", "issue": "source", "issue_type": "source_type"}, "ISSUE_ON_ITEM").orderBy(F.desc("record_count"), "item", "issue", "issue_type")


@query(_view_sql("target AS issue, source AS action, CASE relation WHEN 'ACTION_ADDRESSES_ISSUE' THEN 'addresses' ELSE 'investigates' END AS kind", *g.ISSUE_KINDS))
def kg_view_fault_actions(t):
    """AG14."""
    return g.view(annotated(t), MIN_WEIGHT, *g.ISSUE_KINDS).select(F.col("target").alias("issue"), F.col("source").alias("action"), g.issue_kind().alias("kind"), "record_count")


@query(f"""WITH {RELATIONS}, v AS (SELECT raw.record_id, r.source_entity_id AS head, r.relation_type AS relation, a.label AS source, b.label AS target FROM raw JOIN ent a ON a.record_id = raw.record_id AND a.entity_id = r.source_entity_id JOIN ent b ON b.record_id = raw.record_id AND b.entity_id = r.target_entity_id WHERE r.relation_type || '|' || a.type || '|' || b.type IN ({_ALLOWED})),
i AS (SELECT record_id, head, target AS item FROM v WHERE relation IN ('ACTION_ON_ITEM', 'ACTION_USES_ITEM')), s AS (SELECT record_id, head, target AS issue, source AS action, CASE relation WHEN 'ACTION_ADDRESSES_ISSUE' THEN 'addresses' ELSE 'investigates' END AS kind FROM v WHERE relation IN ('ACTION_ADDRESSES_ISSUE', 'ACTION_INVESTIGATES_ISSUE'))
SELECT issue, action, coalesce(item, '') AS item, kind, count(DISTINCT record_id) AS record_count FROM s LEFT JOIN i USING (record_id, head) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT record_id) >= {MIN_WEIGHT}""")
def kg_view_fault_solutions(t):
    """AG14, JN10: actions, issues and items joined through the same mention of an action."""
    return g.solutions(annotated(t), MIN_WEIGHT)


@query(_view_sql("source AS whole, target AS part", "HAS_PART"))
def kg_view_item_parts(t):
    """AG14."""
    return _view(t, {"whole": "source", "part": "target"}, "HAS_PART")


@query(_view_sql("source AS issue, target AS context", "OCCURS_UNDER_CONTEXT"))
def kg_view_fault_contexts(t):
    """AG14."""
    return _view(t, {"issue": "source", "context": "target"}, "OCCURS_UNDER_CONTEXT")


@query(_view_sql("source AS action, target AS reference", "ACTION_FOLLOWS_REFERENCE"))
def kg_view_action_references(t):
    """AG14."""
    return _view(t, {"action": "source", "reference": "target"}, "ACTION_FOLLOWS_REFERENCE")


@query(f"""WITH {RELATIONS}, a AS (SELECT relation, count(*) AS relations, count(DISTINCT record_id) AS records FROM rel WHERE problem IS NULL GROUP BY 1), e AS (SELECT relation, count(DISTINCT (source, source_type, target, target_type)) AS edges FROM rel WHERE problem IS NULL GROUP BY 1) SELECT relation, relations, records, edges FROM a JOIN e USING (relation)""")
def kg_summary(t):
    """KG5: by relation."""
    valid = g.resolved_relations(annotated(t)).filter("problem is null")
    return valid.groupBy("relation").agg(F.count("*").alias("relations"), F.count_distinct("record_id").alias("records"), F.count_distinct("source", "source_type", "target", "target_type").alias("edges"))


@query(f"""WITH {RELATIONS}, e AS (SELECT {_EDGE}, count(DISTINCT record_id) AS n FROM rel WHERE problem IS NULL GROUP BY ALL), f AS (SELECT * FROM e WHERE n >= 2)
SELECT DISTINCT * FROM (SELECT source AS label, source_type AS type, 1 AS distance FROM f WHERE target = 'pitot heat relay' UNION ALL SELECT target, target_type, 1 FROM f WHERE source = 'pitot heat relay' UNION ALL SELECT 'pitot heat relay', 'MAINT_ITEM', 0)""")
def kg_focus_graph(t):
    """KG3: a component's neighbours."""
    e = g.edges(annotated(t)).filter("record_count >= 2")
    near = e.filter("target = 'pitot heat relay'").select(F.col("source").alias("label"), F.col("source_type").alias("type")).unionByName(e.filter("source = 'pitot heat relay'").select(F.col("target").alias("label"), F.col("target_type").alias("type")))
    center = t.spark.createDataFrame([("pitot heat relay", "MAINT_ITEM", 0)], "label string, type string, distance int")
    return near.withColumn("distance", F.lit(1)).unionByName(center).distinct()


@query(f"""WITH {RELATIONS}, p AS (SELECT a.record_id, a.label AS head, b.label AS tail, a.type AS head_type, b.type AS tail_type FROM ent a JOIN ent b ON a.record_id = b.record_id AND a.entity_id <> b.entity_id)
SELECT head_type, tail_type, count(*) AS candidates, count(DISTINCT record_id) AS records FROM p WHERE EXISTS (SELECT 1 FROM (VALUES {", ".join(f"('{h}', '{x}')" for _, hs, ts in fixed.SIGNATURES for h in hs for x in ts)}) s(h, x) WHERE s.h = head_type AND s.x = tail_type) GROUP BY 1, 2""")
def entity_pair_candidates(t):
    """JN8, IE4: ordered pairs within a record that a relation may join, from its own array."""
    allowed = sorted({f"{h}|{x}" for _, hs, ts in fixed.SIGNATURES for h in hs for x in ts})
    pairs = annotated(t).select("record_id", "entities", F.explode("entities").alias("a")).select("record_id", "a", F.explode("entities").alias("b")).filter("a.entity_id <> b.entity_id")
    pairs = pairs.select("record_id", F.col("a.entity_type").alias("head_type"), F.col("b.entity_type").alias("tail_type")).filter(F.concat_ws("|", "head_type", "tail_type").isin(*allowed))
    return pairs.groupBy("head_type", "tail_type").agg(F.count("*").alias("candidates"), F.count_distinct("record_id").alias("records"))


@query(f"""WITH {ANNOTATED}, f AS (SELECT record_id, unnest(list_filter([
  CASE WHEN len(list_filter(entities, lambda v: v.start_pos < 0 OR v.end_pos > length(full_text) OR v.start_pos >= v.end_pos)) > 0 THEN 'span_outside_text' END,
  CASE WHEN len(list_filter(entities, lambda v: substring(full_text, v.start_pos + 1, v.end_pos - v.start_pos) <> v.text)) > 0 THEN 'span_text_differs' END,
  CASE WHEN len(list_distinct(list_transform(entities, lambda v: v.entity_id))) < len(entities) THEN 'repeated_entity_id' END,
  CASE WHEN len(list_filter(relations, lambda r: NOT list_contains(list_transform(entities, lambda v: v.entity_id), r.source_entity_id) OR NOT list_contains(list_transform(entities, lambda v: v.entity_id), r.target_entity_id))) > 0 THEN 'endpoint_missing' END,
  CASE WHEN len(entities) = 0 THEN 'no_entities' END], lambda v: v IS NOT NULL)) AS flag FROM rec)
SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def record_validation(t):
    """IE15, IE16: structural errors."""
    return g.flags(annotated(t)).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"WITH {ANNOTATED}, e AS (SELECT record_id, unnest(entities) AS e FROM rec) SELECT a.record_id, a.e.entity_id AS first_id, b.e.entity_id AS second_id FROM e a JOIN e b ON a.record_id = b.record_id AND a.e.entity_id < b.e.entity_id WHERE a.e.start_pos < b.e.end_pos AND b.e.start_pos < a.e.end_pos")
def span_overlap_pairs(t):
    """JN12."""
    pairs = annotated(t).select("record_id", "entities", F.explode("entities").alias("a")).select("record_id", "a", F.explode("entities").alias("b"))
    both = pairs.filter("a.entity_id < b.entity_id and a.start_pos < b.end_pos and b.start_pos < a.end_pos")
    return both.select("record_id", F.col("a.entity_id").alias("first_id"), F.col("b.entity_id").alias("second_id"))


@query(f"WITH {ANNOTATED}, e AS (SELECT record_id, entities[i] AS e, i FROM (SELECT record_id, entities, unnest(generate_series(1, len(entities))) AS i FROM rec)), k AS (SELECT record_id, {_key('e.text')} AS label, min(i) AS i FROM e GROUP BY 1, 2) SELECT record_id, string_agg(label, '; ' ORDER BY i) AS labels FROM k GROUP BY 1")
def record_labels(t):
    """AG15, ST4: a record's distinct labels in order, from its own array."""
    rows = annotated(t).filter(F.size("entities") > 0)
    return rows.select("record_id", F.array_join(F.array_distinct(F.transform("entities", lambda v: g.label_key(v["text"]))), "; ").alias("labels"))


_GOLD = "gold AS (SELECT DISTINCT ident, tokens, bio FROM gold_annotation)"
_ISLANDS = """tok AS (SELECT ident, i, tags[i] AS tag, CASE WHEN i > 1 THEN tags[i - 1] ELSE 'O' END AS prev FROM (SELECT ident, tags, unnest(generate_series(1, len(tags))) AS i FROM {src})),
st AS (SELECT *, CASE WHEN tag <> 'O' AND (tag LIKE 'B-%' OR prev = 'O' OR substr(prev, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END AS b FROM tok),
isl AS (SELECT *, sum(b) OVER (PARTITION BY ident ORDER BY i) AS k FROM st),
{out} AS (SELECT ident, substr(any_value(tag), 3) AS type, min(i) - 1 AS begin, max(i)::BIGINT AS "end" FROM isl WHERE tag <> 'O' GROUP BY ident, k)"""


def gold(t):
    return t.gold_annotation.select("ident", "tokens", "bio").distinct()


@query(f"WITH {_GOLD}, src AS (SELECT ident, bio AS tags FROM gold), " + _ISLANDS.format(src="src", out="span") + ' SELECT ident, type, begin, "end" FROM span')
def bio_to_spans(t):
    """IE2."""
    return g.spans_of_bio(gold(t), ["ident"])


@query("""WITH a AS (SELECT DISTINCT ident, tokens, bio, entities FROM gold_annotation), p AS (SELECT ident, bio, entities, i - 1 AS i FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM a)),
q AS (SELECT ident, i, bio[i + 1] AS was, list_filter(entities, lambda v: v.start_pos <= i AND i < v.end_pos)[1] AS e FROM p)
SELECT ident, i AS pos, CASE WHEN e IS NULL THEN 'O' WHEN e.start_pos = i THEN 'B-' || e.entity_type ELSE 'I-' || e.entity_type END AS tag, was FROM q""")
def spans_to_bio(t):
    """IE3, SRC17: tags made of the spans, beside the given ones."""
    rows = t.gold_annotation.select("ident", "tokens", "bio", "entities").distinct().withColumn("tags", g.bio_of_spans("tokens", "entities"))
    return rows.select("ident", "bio", F.posexplode("tags").alias("pos", "tag")).select("ident", F.col("pos").cast("long").alias("pos"), "tag", F.get("bio", F.col("pos")).alias("was"))


@query("SELECT ident, list_transform(list_filter(entities, lambda v: v.entity_type <> 'REFERENCE'), lambda v: v.entity_type || ':' || v.start_pos || ':' || v.end_pos) AS entities, md5(array_to_string(list_transform(tokens, lambda w: lower(w)), '␟')) AS group_key FROM (SELECT DISTINCT ident, tokens, entities FROM gold_annotation)")
def schema_view(t):
    """CL9: the core labels alone."""
    rows = t.gold_annotation.select("ident", "tokens", "entities").distinct()
    return rows.select("ident", F.transform(F.filter("entities", lambda v: v["entity_type"] != "REFERENCE"), lambda v: F.concat_ws(":", v["entity_type"], v["start_pos"].cast("string"), v["end_pos"].cast("string"))).alias("entities"), F.md5(F.array_join(F.transform("tokens", F.lower), "␟")).alias("group_key"))


@query("""WITH e AS (SELECT annotation_batch, unnest(entities).entity_type AS label, 'entity' AS kind FROM gold_annotation), r AS (SELECT annotation_batch, unnest(relations).relation_type AS label, 'relation' AS kind FROM gold_annotation)
SELECT annotation_batch, kind, label, count(*) AS n, count(*) < 50 AS low FROM (SELECT * FROM e UNION ALL SELECT * FROM r) GROUP BY 1, 2, 3""")
def annotation_support(t):
    """XT1: entities and relations by batch, with a mark of the rare ones."""
    one = lambda c, f, kind: t.gold_annotation.select("annotation_batch", F.explode(F.transform(c, lambda v: v[f])).alias("label"), F.lit(kind).alias("kind"))
    return one("entities", "entity_type", "entity").unionByName(one("relations", "relation_type", "relation")).groupBy("annotation_batch", "kind", "label").agg(F.count("*").alias("n")).withColumn("low", F.col("n") < 50)


@query()
def weak_annotation(t):
    """IE1, WN11: spans of lexicon names and patterns, the longest first, without overlaps."""
    terms = [(kind, name) for kind in ("component", "fault") for name in n.names(t.canonical_term, kind)]
    return t.work_order.select("ident", align.lexicon_spans(terms, [("location", fixed.LOCATION)], F.col("problem")).alias("spans"))


_TRAIN = "annotation_batch = 'round1'"
_MEMO = f"""w AS (SELECT lower(unnest(tokens)) AS w, unnest(bio) AS tag FROM gold_annotation WHERE {_TRAIN}), m AS (SELECT w, tag FROM (SELECT w, tag, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, tag) AS rn FROM w GROUP BY 1, 2) WHERE rn = 1),
ev AS (SELECT DISTINCT ident, tokens, bio FROM gold_annotation WHERE coalesce(annotation_batch, '') <> 'round1'),
et AS (SELECT ident, i, lower(tokens[i]) AS w, bio[i] AS gold FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM ev)), pt AS (SELECT et.*, coalesce(m.tag, 'O') AS pred, m.w IS NULL AS unseen FROM et LEFT JOIN m USING (w))"""


def memorized(t):
    """Each evaluation token with its gold tag and the tag that its word mostly has in the training batch."""
    train = t.gold_annotation.filter(_TRAIN).select(F.explode(F.arrays_zip("tokens", "bio")).alias("z")).groupBy(F.lower("z.tokens").alias("w"), F.col("z.bio").alias("tag")).agg(F.count("*").alias("n"))
    best = train.groupBy("w").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("pred"))
    held = t.gold_annotation.filter("coalesce(annotation_batch, '') <> 'round1'").select("ident", "tokens", "bio").distinct()
    rows = held.select("ident", F.posexplode(F.arrays_zip("tokens", "bio")).alias("i", "z")).select("ident", "i", F.lower("z.tokens").alias("w"), F.col("z.bio").alias("gold"))
    return rows.join(best, "w", "left").select("ident", "i", "w", "gold", F.coalesce("pred", F.lit("O")).alias("pred"), F.col("pred").isNull().alias("unseen"))


@query(f"WITH {_MEMO} SELECT count(*) AS tokens, round(avg((gold = pred)::INT), 6) AS accuracy, round(count(DISTINCT CASE WHEN unseen THEN w END) / count(DISTINCT w), 6) AS oov_types FROM pt")
def memorization_baseline(t):
    """AG21."""
    rows = memorized(t)
    return rows.agg(F.count("*").alias("tokens"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.round(F.count_distinct(F.when(F.col("unseen"), F.col("w"))) / F.count_distinct("w"), 6).alias("oov_types"))


@query(f"WITH {_MEMO} SELECT regexp_replace(gold, '^[BI]-', '') AS gold, regexp_replace(pred, '^[BI]-', '') AS pred, count(*) AS n FROM pt GROUP BY 1, 2")
def token_confusion(t):
    """AG20."""
    bare = lambda c: F.regexp_replace(c, "^[BI]-", "").alias(c)
    return memorized(t).select(bare("gold"), bare("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"))


_SPANS = f"""{_MEMO}, gs AS (SELECT ident, list(gold ORDER BY i) AS tags FROM pt GROUP BY 1), ps AS (SELECT ident, list(pred ORDER BY i) AS tags FROM pt GROUP BY 1), {_ISLANDS.format(src='gs', out='gspan')}, {_ISLANDS.format(src='ps', out='pspan').replace('tok AS', 'tok2 AS').replace('FROM tok)', 'FROM tok2)').replace('st AS (SELECT *', 'st2 AS (SELECT *').replace('FROM st)', 'FROM st2)').replace('isl AS', 'isl2 AS').replace('FROM isl ', 'FROM isl2 ')},
k AS (SELECT type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM
  (SELECT coalesce(a.type, b.type) AS type, a.ident IS NOT NULL AS g, b.ident IS NOT NULL AS p FROM gspan a FULL JOIN pspan b ON a.ident = b.ident AND a.type = b.type AND a.begin = b.begin AND a."end" = b."end") GROUP BY 1)"""


def span_counts(t):
    rows = memorized(t)
    tags = rows.groupBy("ident").agg(F.sort_array(F.collect_list(F.struct("i", "gold", "pred"))).alias("z"))
    make = lambda c: g.spans_of_bio(tags.select("ident", F.transform("z", lambda v: v[c]).alias("bio")), ["ident"])
    both = make("gold").withColumn("g", F.lit(1)).join(make("pred").withColumn("p", F.lit(1)), ["ident", "type", "begin", "end"], "full_outer")
    return both.groupBy("type").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@query(f"WITH {_SPANS} SELECT type, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM k")
def entity_prf(t):
    """AG18, ST5, XT5: spans against spans, by type."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return span_counts(t).select("type", "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"""WITH {_SPANS} SELECT 'micro' AS average, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM k
UNION ALL SELECT 'macro', round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) FROM k UNION ALL SELECT 'macro_gold', round(avg(2 * tp / (2 * tp + fp + fn)), 6) FROM k WHERE tp + fn > 0""")
def averaged_f1(t):
    """AG18: micro, macro over all labels, macro over gold labels."""
    k = span_counts(t).withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    one = lambda name, df: df.select(F.lit(name).alias("average"), "f1")
    micro = k.agg(F.round(2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 6).alias("f1"))
    macro = k.agg(F.round(F.avg("f1"), 6).alias("f1"))
    return one("micro", micro).unionByName(one("macro", macro)).unionByName(one("macro_gold", k.filter("tp + fn > 0").agg(F.round(F.avg("f1"), 6).alias("f1"))))


@query()
def kg_canonical_labels(t):
    """STR7: labels under their compatible, case-folded key, with how many spellings each has; only different spellings go through Python."""
    spellings = annotated(t).select(F.explode("entities").alias("e")).groupBy(F.col("e.text").alias("text"), F.col("e.entity_type").alias("type")).agg(F.count("*").alias("n"))
    return spellings.withColumn("label", align.nfkc_key("text")).groupBy("label", "type").agg(F.count("*").alias("spellings"), F.sum("n").alias("mentions"))


@query(f"WITH {RELATIONS}, v AS (SELECT * FROM rel WHERE problem IS NULL) SELECT 'records' AS measure, count(*) AS n FROM rec UNION ALL SELECT 'nodes', count(*) FROM (SELECT DISTINCT label, type FROM ent) UNION ALL SELECT 'mentions', count(*) FROM ent UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT {_EDGE} FROM v) UNION ALL SELECT 'support', count(*) FROM (SELECT DISTINCT {_EDGE}, record_id FROM v) UNION ALL SELECT 'quarantined', count(*) FROM rel WHERE problem IS NOT NULL")
def kg_manifest(t):
    """KG5, XT25: what a build of the graph consists of; sources.tables.content_digest freezes its tables."""
    records = annotated(t)
    parts = {
        "records": records, "nodes": g.mentions(records).select("label", "type").distinct(), "mentions": g.mentions(records), "edges": g.edges(records), "support": g.edge_evidence(records),
        "quarantined": g.resolved_relations(records).filter("problem is not null"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("measure"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
