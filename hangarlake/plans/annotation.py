"""Queries of annotated rows: audits, schema views, features, exports and what a labelling round needs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hangarlake.functions import text as x
from hangarlake.operators import graph as g
from hangarlake.operators import tagging
from hangarlake.plans.graph import _GOLD, _ISLANDS, _MEMO, ANNOTATED, annotated, gold, memorized
from hangarlake.plans.registry import query
from hangarlake.plans.texts import CORPUS, corpus
from hangarlake.sources import tables

_ROWS = "rows_ AS (SELECT DISTINCT ident, tokens, bio, entities, relations, exact_group_id, annotation_batch, sampling_population FROM gold_annotation)"
_KEY = "md5(array_to_string(list_transform(tokens, lambda w: lower(w)), '␟'))"


def _rows(t):
    return t.gold_annotation.select("ident", "tokens", "bio", "entities", "relations", "exact_group_id", "annotation_batch", "sampling_population").distinct()


def _group(tokens="tokens"):
    return F.md5(F.array_join(F.transform(tokens, F.lower), "␟"))


_PART = "CASE WHEN ('0x' || substr(md5(ident), 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END"


def _part():
    return F.when(F.conv(F.substring(F.md5("ident"), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) < 0.8, "train").otherwise("test")


@query(f"""WITH {_ROWS}, p AS (SELECT *, {_PART} AS part FROM rows_ WHERE ident IS NOT NULL)
SELECT part, coalesce(annotation_batch, '') AS batch, coalesce(sampling_population, '') AS population, count(*) AS rows, sum(len(entities))::BIGINT AS entities, sum(len(relations))::BIGINT AS relations FROM p GROUP BY 1, 2, 3""")
def split_audit(t):
    """AG22: what each split has of every batch and population; split_overlap has the groups that two share."""
    rows = _rows(t).filter("ident is not null").withColumn("part", _part())
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.groupBy("part", empty("annotation_batch").alias("batch"), empty("sampling_population").alias("population")).agg(F.count("*").alias("rows"), F.sum(F.size("entities")).cast("long").alias("entities"), F.sum(F.size("relations")).cast("long").alias("relations"))


_HARMONY = f"""{_ROWS}, k AS (SELECT {_KEY} AS g, ident, list_distinct(list_transform(relations, lambda r: r.relation_type || ':' || r.head_pos || ':' || r.tail_pos)) AS rel FROM rows_),
top AS (SELECT g, arg_max(rel, {{'n': len(rel), 'i': ident}}) AS most, count(*) AS rows FROM k GROUP BY 1)"""


@query(f"WITH {_HARMONY} SELECT ident, rows, len(rel) AS relations, len(most) AS harmonized, len(list_filter(rel, lambda v: NOT list_contains(most, v))) = 0 AS within FROM k JOIN top USING (g) WHERE rows > 1")
def group_harmony(t):
    """AG23: rows of equal tokens beside their group's fullest set of relations, and whether their own are a part of it."""
    own = F.array_distinct(F.transform("relations", lambda r: F.concat_ws(":", r["relation_type"], r["head_pos"].cast("string"), r["tail_pos"].cast("string"))))
    rows = _rows(t).select(_group().alias("g"), "ident", own.alias("rel"))
    top = rows.groupBy("g").agg(F.max_by("rel", F.struct(F.size("rel"), "ident")).alias("most"), F.count("*").alias("rows")).filter("rows > 1")
    return rows.join(top, "g").select("ident", "rows", F.size("rel").cast("long").alias("relations"), F.size("most").cast("long").alias("harmonized"), (F.size(F.array_except("rel", "most")) == 0).alias("within"))


@query()
def flattened_spans(t):
    """WN12: of nested or overlapping spans the earliest stays, of those that begin together the longest."""
    return annotated(t).select("record_id", F.explode(g.flattened("entities")).alias("s")).select("record_id", "s.entity_type", "s.start_pos", "s.end_pos")


@query()
def span_ceiling(t):
    """AG26: by type the share of the spans that a flat tag sequence can hold, so the most that a tagger of such sequences can find."""
    rows = annotated(t).select("entities", g.flattened("entities").alias("flat"))
    every = rows.select(F.explode("entities").alias("s")).groupBy(F.col("s.entity_type").alias("type")).agg(F.count("*").alias("spans"))
    kept = rows.select(F.explode("flat").alias("s")).groupBy(F.col("s.entity_type").alias("type")).agg(F.count("*").alias("kept"))
    return every.join(kept, "type", "left").select("type", "spans", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.coalesce("kept", F.lit(0)) / F.col("spans"), 6).alias("ceiling"))


@query(f"WITH {ANNOTATED}, e AS (SELECT record_id, unnest(entities) AS e FROM rec), p AS (SELECT DISTINCT a.record_id, a.e.entity_id AS id, a.e.entity_type AS type, b.e.entity_id IS NOT NULL AS nested FROM e a LEFT JOIN e b ON a.record_id = b.record_id AND a.e.entity_id <> b.e.entity_id AND b.e.start_pos <= a.e.start_pos AND a.e.end_pos <= b.e.end_pos) SELECT type, count(*) AS spans, sum(nested::INT)::BIGINT AS nested FROM p GROUP BY 1")
def nested_spans(t):
    """EV10: spans that lie within another one, by type; from the record's own array."""
    rows = annotated(t).select("entities", F.explode("entities").alias("a"))
    inside = F.exists("entities", lambda v: (v["entity_id"] != F.col("a.entity_id")) & (v["start_pos"] <= F.col("a.start_pos")) & (F.col("a.end_pos") <= v["end_pos"]))
    return rows.groupBy(F.col("a.entity_type").alias("type")).agg(F.count("*").alias("spans"), F.sum(inside.cast("long")).alias("nested"))


@query(f"""WITH {_ROWS}, k AS (SELECT ident, tokens, entities, relations, [i FOR i IN range(1, len(entities) + 1) IF entities[i].entity_type <> 'REFERENCE'] AS keep FROM rows_)
SELECT ident, [entities[i].entity_type || ':' || entities[i].start_pos || ':' || entities[i].end_pos FOR i IN keep] AS entities,
  [r.relation_type || ':' || (list_position(keep, r.head_pos + 1) - 1) || ':' || (list_position(keep, r.tail_pos + 1) - 1) FOR r IN relations IF list_contains(keep, r.head_pos + 1) AND list_contains(keep, r.tail_pos + 1)] AS relations FROM k""")
def core_schema(t):
    """CL11, KG2: a schema without one type: its spans and their relations go, and the others' ends are counted anew."""
    rows = g.without_types(_rows(t), ("REFERENCE",))
    spans = F.transform("entities", lambda v: F.concat_ws(":", v["entity_type"], v["start_pos"].cast("string"), v["end_pos"].cast("string")))
    return rows.select("ident", spans.alias("entities"), F.transform("relations", lambda r: F.concat_ws(":", r["relation_type"], r["head_pos"].cast("string"), r["tail_pos"].cast("string"))).alias("relations"))


@query(f"""WITH {_ROWS}, r AS (SELECT ident, tokens, entities[r.head_pos + 1] AS h, entities[r.tail_pos + 1] AS l, r.relation_type AS relation FROM (SELECT ident, tokens, entities, unnest(relations) AS r FROM rows_))
SELECT ident, relation, h.entity_type || '>' || l.entity_type AS types, h.start_pos < l.start_pos AS forward, greatest(0, greatest(h.start_pos, l.start_pos) - least(h.end_pos, l.end_pos))::BIGINT AS distance,
  list_sort(list_distinct(list_transform(tokens[least(h.end_pos, l.end_pos) + 1:greatest(h.start_pos, l.start_pos)], lambda w: lower(w)))) AS between_words FROM r WHERE h IS NOT NULL AND l IS NOT NULL""")
def relation_features(t):
    """IE6: types, order, distance and the words between the ends of each relation."""
    rows = _rows(t).select("ident", "tokens", "entities", F.explode("relations").alias("r"))
    rows = rows.select("ident", "tokens", "r.relation_type", F.get("entities", F.col("r.head_pos")).alias("h"), F.get("entities", F.col("r.tail_pos")).alias("l")).filter("h is not null and l is not null")
    low, high = F.least("h.end_pos", "l.end_pos"), F.greatest("h.start_pos", "l.start_pos")
    between = F.when(high > low, F.slice("tokens", low + 1, high - low)).otherwise(F.array().cast("array<string>"))
    return rows.select("ident", F.col("relation_type").alias("relation"), F.concat_ws(">", "h.entity_type", "l.entity_type").alias("types"), (F.col("h.start_pos") < F.col("l.start_pos")).alias("forward"), F.greatest(F.lit(0), high - low).cast("long").alias("distance"), F.sort_array(F.array_distinct(F.transform(between, F.lower))).alias("between_words"))


@query(f"""WITH {_GOLD}, v AS (SELECT kind, w FROM (SELECT kind, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) AS w FROM canonical_term) GROUP BY 1, 2),
k AS (SELECT ident, i - 1 AS pos, lower(tokens[i]) AS w FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM gold))
SELECT ident, pos, w, w IN (SELECT w FROM v WHERE kind = 'component') AS in_components, w IN (SELECT w FROM v WHERE kind = 'fault') AS in_faults FROM k""")
def gazetteer_features(t):
    """IE5: whether each token is a word of a known name, by kind of name."""
    words = t.canonical_term.select("kind", F.explode(x.tokens("term", "[a-z0-9]+")).alias("w")).groupBy("w").agg(F.max((F.col("kind") == "component").cast("int")).alias("c"), F.max((F.col("kind") == "fault").cast("int")).alias("f"))
    rows = gold(t).select("ident", F.posexplode(F.transform("tokens", F.lower)).alias("pos", "w")).join(words, "w", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return rows.select("ident", F.col("pos").cast("long").alias("pos"), "w", has("c").alias("in_components"), has("f").alias("in_faults"))


@query(f"""WITH {_GOLD}, n AS (SELECT ident, len(tokens) AS n FROM gold WHERE len(tokens) > 0), w AS (SELECT ident, n, unnest(generate_series(1, least(10, n))) AS width FROM n) SELECT width, sum(n - width + 1)::BIGINT AS spans, count(*) AS rows FROM w GROUP BY 1""")
def span_candidates(t):
    """IE10: all spans of up to ten tokens that a span model would judge, by width."""
    rows = g.enumerated_spans(gold(t).select("ident", "tokens"), "tokens", 10)
    return rows.groupBy((F.col("end") - F.col("begin")).cast("long").alias("width")).agg(F.count("*").alias("spans"), F.count_distinct("ident").alias("rows"))


_TYPES = {"components": "MAINT_ITEM", "faults": "FAULT", "locations": "LOC", "actions": "ACTION"}


def _typed_sql(kind: str) -> str:
    from hangarlake.plans.graph import _key

    labels = f"[{_key('e.text')} FOR e IN coalesce(entities, []) IF e.entity_type = '{kind}']"
    return f"[v FOR v, i IN {labels} IF v <> '' AND list_position({labels}, v) = i]"


@query(f"WITH {ANNOTATED} SELECT record_id, {', '.join(f'{_typed_sql(k)} AS {c}' for c, k in _TYPES.items())}, len(list_filter(coalesce(relations, []), lambda r: list_contains(list_transform(entities, lambda v: v.entity_id), r.source_entity_id) AND list_contains(list_transform(entities, lambda v: v.entity_id), r.target_entity_id))) AS relations FROM rec")
def prediction_structure(t):
    """IE13: a prediction as lists of distinct labels in order, and how many of its relations have both ends; broken ones are left out."""
    ids = F.transform("entities", lambda v: v["entity_id"])
    labels = lambda kind: F.array_distinct(F.filter(F.transform(F.filter(F.coalesce("entities", F.array()), lambda v: v["entity_type"] == kind), lambda v: g.label_key(v["text"])), lambda v: v != ""))
    good = F.filter("relations", lambda r: F.array_contains(ids, r["source_entity_id"]) & F.array_contains(ids, r["target_entity_id"]))
    return annotated(t).select("record_id", *[labels(k).alias(c) for c, k in _TYPES.items()], F.coalesce(F.when(F.col("relations").isNotNull(), F.size(good)), F.lit(0)).cast("long").alias("relations"))


RARE = ("OP_CTX", "OUTCOME", "ABN_PROC", "TECH_OBS")
_RARE = ", ".join(f"'{r}'" for r in RARE)


@query(f"""WITH {ANNOTATED}, s AS (SELECT record_id, len([e FOR e IN entities IF e.entity_type IN ({_RARE})]) AS rare, 1 - list_avg([e.confidence FOR e IN entities IF e.confidence IS NOT NULL]) AS u FROM rec WHERE record_id NOT IN (SELECT ident FROM gold_annotation WHERE ident IS NOT NULL)),
k AS (SELECT record_id, rare, round(coalesce(u, 0), 6) AS uncertainty, round(2 * least(rare, 3) + coalesce(u, 0), 6) AS score FROM s) SELECT record_id, rare, uncertainty, score FROM k ORDER BY score DESC, record_id LIMIT 50""")
def labelling_round(t):
    """IE14, XT4: the 50 records to label next: rare types and little confidence, none that was labelled before."""
    rows = annotated(t).join(t.gold_annotation.select(F.col("ident").alias("record_id")), "record_id", "left_anti")
    rare = F.size(F.filter("entities", lambda v: v["entity_type"].isin(*RARE)))
    sure = F.filter(F.transform("entities", lambda v: v["confidence"]), lambda v: v.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, v: a + v) / F.size(sure))
    scored = rows.select("record_id", F.coalesce(rare, F.lit(0)).cast("long").alias("rare"), F.round(F.coalesce(1 - mean, F.lit(0.0)), 6).alias("uncertainty"), F.round(2 * F.least(rare, F.lit(3)) + F.coalesce(1 - mean, F.lit(0.0)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "record_id").limit(50)


_LINKS = (("ACTION", "MAINT_ITEM", "ACTION_ON_ITEM"), ("FAULT", "MAINT_ITEM", "ISSUE_ON_ITEM"), ("LOC", "MAINT_ITEM", "HAS_LOCATION"))


@query(f"""WITH {_ROWS}, k AS (SELECT ident, tokens, [e.entity_type FOR e IN entities] AS et, [r.relation_type FOR r IN relations] AS rt, entities FROM rows_),
f AS (SELECT ident, unnest(list_filter([{', '.join(f"CASE WHEN list_contains(et, '{a}') AND list_contains(et, '{b}') AND NOT list_contains(rt, '{r}') THEN 'no_{r.lower()}' END" for a, b, r in _LINKS)},
  CASE WHEN len([i FOR i IN range(1, len(tokens) + 1) IF lower(tokens[i]) IN ('replaced', 'installed', 'inspected', 'adjusted') AND len([e FOR e IN entities IF e.start_pos < i AND i <= e.end_pos]) = 0]) > 0 THEN 'untagged_action' END], lambda v: v IS NOT NULL)) AS flag FROM k) SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def quality_flags(t):
    """IE15: links that the types of a row lead to expect, and cues of an action that nothing marks."""
    et, rt = F.transform("entities", lambda v: v["entity_type"]), F.transform("relations", lambda v: v["relation_type"])
    under = [F.when(F.array_contains(et, a) & F.array_contains(et, b) & ~F.array_contains(rt, r), F.lit(f"no_{r.lower()}")) for a, b, r in _LINKS]
    place = F.transform("tokens", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    cue = F.exists(place, lambda p: F.lower(p["w"]).isin("replaced", "installed", "inspected", "adjusted") & ~F.exists("entities", lambda v: (v["start_pos"] <= p["i"]) & (p["i"] < v["end_pos"])))
    found = F.filter(F.array(*under, F.when(cue, F.lit("untagged_action"))), lambda v: v.isNotNull())
    return _rows(t).select(F.explode(found).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT ident, tokens, bio, entities FROM gold_annotation), p AS (SELECT ident, bio, [(list_filter(entities, lambda v: v.start_pos < i AND i <= v.end_pos))[1] FOR i IN range(1, len(tokens) + 1)] AS e, tokens FROM a),
q AS (SELECT ident, bio, [CASE WHEN e[i] IS NULL THEN 'O' WHEN e[i].start_pos = i - 1 THEN 'B-' || e[i].entity_type ELSE 'I-' || e[i].entity_type END FOR i IN range(1, len(tokens) + 1)] AS tags FROM p)
SELECT count(*) AS rows, sum((len(bio) = len(tags))::INT)::BIGINT AS same_length, sum((bio = tags)::INT)::BIGINT AS agreeing FROM q""")
def tag_agreement(t):
    """IE16: whether the tags and the spans of a row say the same."""
    rows = t.gold_annotation.select("ident", "tokens", "bio", "entities").distinct().withColumn("tags", g.bio_of_spans("tokens", "entities"))
    return rows.agg(F.count("*").alias("rows"), F.sum((F.size("bio") == F.size("tags")).cast("long")).alias("same_length"), F.sum((F.col("bio") == F.col("tags")).cast("long")).alias("agreeing"))


@query(rf"""WITH {CORPUS}, {_GOLD}, c AS (SELECT record_id AS ident, regexp_extract_all(lower(full_text), '[a-z0-9]+') AS w FROM corpus), j AS (SELECT g.ident, array_to_string([lower(v) FOR v IN g.tokens IF regexp_matches(lower(v), '[a-z0-9]')], ' ') AS a, c.w FROM gold g LEFT JOIN c USING (ident))
SELECT count(*) AS rows, sum((w IS NULL)::INT)::BIGINT AS without_text, sum((len(regexp_extract_all(a, '[a-z0-9]+')) = len(w))::INT)::BIGINT AS same_count, sum((regexp_extract_all(a, '[a-z0-9]+') = w)::INT)::BIGINT AS same_words FROM j""")
def token_parity(t):
    """IE17, IE19, XT26: whether the tokens of the labelled rows are those of the records' texts."""
    words = corpus(t, ("full_text",)).select(F.col("record_id").alias("ident"), x.tokens("full_text", "[a-z0-9]+").alias("w"), F.col("full_text").isNotNull().alias("_t"))
    rows = gold(t).join(words.filter("_t"), "ident", "left")
    own = F.regexp_extract_all(F.array_join(F.filter(F.transform("tokens", F.lower), lambda v: v.rlike("[a-z0-9]")), " "), F.lit("[a-z0-9]+"), F.lit(0))
    count = lambda c: F.sum(c.cast("long"))
    return rows.agg(F.count("*").alias("rows"), count(F.col("w").isNull()).alias("without_text"), count(F.size(own) == F.when(F.col("w").isNotNull(), F.size("w"))).alias("same_count"), count(own == F.col("w")).alias("same_words"))


_PREDICTED = f"""{_MEMO}, ps AS (SELECT ident, list(pred ORDER BY i) AS tags FROM pt GROUP BY 1), {_ISLANDS.format(src='ps', out='pspan')}"""


@query(f"""WITH {_PREDICTED}, n AS (SELECT ident, max(len(tokens)) AS n FROM ev GROUP BY 1) SELECT 'rows' AS measure, count(DISTINCT ident) AS n FROM pspan UNION ALL SELECT 'spans', count(*) FROM pspan UNION ALL SELECT 'outside', count(*) FROM pspan JOIN n USING (ident) WHERE begin < 0 OR "end" > n.n OR begin >= "end"
UNION ALL SELECT 'unknown_rows', count(*) FROM pspan WHERE ident NOT IN (SELECT ident FROM ev WHERE ident IS NOT NULL)""")
def prediction_checks(t):
    """IE18, XT7: a tagger's spans held against the rows they were made for: outside and unknown_rows must be 0."""
    tags = memorized(t).groupBy("ident").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "pred"))), lambda v: v["pred"]).alias("bio"))
    spans = g.spans_of_bio(tags, ["ident"])
    sizes = t.gold_annotation.filter("coalesce(annotation_batch, '') <> 'round1'").groupBy("ident").agg(F.max(F.size("tokens")).alias("n"))
    rows = spans.join(sizes, "ident", "left")
    outside = F.col("n").isNotNull() & ((F.col("begin") < 0) | (F.col("end") > F.col("n")) | (F.col("begin") >= F.col("end")))
    sums = rows.agg(F.count_distinct("ident").alias("rows"), F.count("*").alias("spans"), F.coalesce(F.sum(outside.cast("long")), F.lit(0)).alias("outside"), F.coalesce(F.sum(F.col("n").isNull().cast("long")), F.lit(0)).alias("unknown_rows"))
    return sums.select(F.explode(F.create_map(*[v for c in ("rows", "spans", "outside", "unknown_rows") for v in (F.lit(c), F.col(c))])).alias("measure", "n"))


@query(f"""WITH {_ROWS} SELECT ident AS orig_id, tokens, [{{'type': e.entity_type, 'start': e.start_pos, 'end': e.end_pos}} FOR e IN entities] AS entities, [{{'type': r.relation_type, 'head': r.head_pos, 'tail': r.tail_pos}} FOR r IN relations] AS relations FROM rows_""")
def model_export(t):
    """SRC18: rows in the shape that a span model reads, nested; sources.tables.write_table writes them as JSON lines."""
    spans = F.transform("entities", lambda v: F.struct(v["entity_type"].alias("type"), v["start_pos"].alias("start"), v["end_pos"].alias("end")))
    return _rows(t).select(F.col("ident").alias("orig_id"), "tokens", spans.alias("entities"), F.transform("relations", lambda v: F.struct(v["relation_type"].alias("type"), v["head_pos"].alias("head"), v["tail_pos"].alias("tail"))).alias("relations"))


@query(f"""WITH {_ROWS}, e AS (SELECT ident, tokens, unnest(entities) AS e FROM rows_) SELECT ident, e.entity_type AS type, e.start_pos AS first_token, e.end_pos AS end_token,
  (CASE WHEN e.start_pos = 0 THEN 0 ELSE length(array_to_string(tokens[1:e.start_pos], ' ')) + 1 END)::BIGINT AS begin_char, length(array_to_string(tokens[1:e.end_pos], ' '))::BIGINT AS end_char FROM e""")
def character_spans(t):
    """SRC17: token spans as places in the tokens' text; graph.snapped leads back."""
    rows = _rows(t).select("ident", "tokens", F.explode("entities").alias("e"))
    begin, end = g.character_span("tokens", F.col("e.start_pos"), F.col("e.end_pos"))
    return rows.select("ident", F.col("e.entity_type").alias("type"), F.col("e.start_pos").alias("first_token"), F.col("e.end_pos").alias("end_token"), begin.cast("long").alias("begin_char"), end.cast("long").alias("end_char"))


@query("SELECT ident, floor((row_number() OVER (ORDER BY ident) - 1) / 50)::BIGINT AS batch FROM (SELECT DISTINCT ident FROM gold_annotation WHERE ident IS NOT NULL)")
def batches(t):
    """SRC19: rows in batches of 50 in order of their ids; places come from partition offsets."""
    rows = tables.numbered(t.gold_annotation.filter("ident is not null").select("ident").distinct(), "ident")
    return rows.select("ident", F.floor(F.col("_place") / 50).alias("batch"))


@query("""WITH k AS (SELECT ident, row_number() OVER (ORDER BY ident) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT ident FROM gold_annotation WHERE ident IS NOT NULL)), s AS (SELECT ident, CASE WHEN place < floor(0.8 * n) THEN 'train' WHEN place < floor(0.9 * n) THEN 'dev' ELSE 'test' END AS part FROM k),
e AS (SELECT DISTINCT ident, e FROM (SELECT ident, unnest(entities) AS e FROM gold_annotation)) SELECT part, split_part(e.entity_type, '_', 1) AS coarse, count(*) AS n FROM e JOIN s USING (ident) GROUP BY 1, 2""")
def coarse_types(t):
    """SRC20: types by their first part, in a split by order of the rows."""
    ids = tables.numbered(t.gold_annotation.filter("ident is not null").select("ident").distinct(), "ident")
    n = ids.agg(F.count("*").alias("n"))
    part = F.when(F.col("_place") < F.floor(0.8 * F.col("n")), "train").when(F.col("_place") < F.floor(0.9 * F.col("n")), "dev").otherwise("test")
    rows = ids.join(F.broadcast(n)).select("ident", part.alias("part"))
    spans = t.gold_annotation.select("ident", F.explode("entities").alias("e")).distinct()
    return spans.join(rows, "ident").groupBy("part", F.split_part("e.entity_type", F.lit("_"), F.lit(1)).alias("coarse")).agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS} SELECT record_id, lower({'problem_text'}) AS text, 'lower' AS representation FROM corpus WHERE problem_text IS NOT NULL")
def representation_view(t):
    """SRC9: the corpus in a chosen representation; its ids must be those of the raw one."""
    return tables.represented(corpus(t, ("problem_text",)).filter("problem_text is not null"), "record_id", "problem_text", {"raw": lambda c: c, "lower": F.lower}, "lower")


@query("""WITH g AS (SELECT DISTINCT md5(array_to_string(list_transform(tokens, lambda w: lower(w)), '␟')) AS g FROM gold_annotation WHERE sampling_population IS NOT NULL), f AS (SELECT g, row_number() OVER (ORDER BY sha256('freeze:' || g)) AS place FROM g),
k AS (SELECT DISTINCT md5(array_to_string(list_transform(tokens, lambda w: lower(w)), '␟')) AS g FROM gold_annotation) SELECT k.g AS group_key, CASE WHEN place <= 20 THEN 'test' WHEN place <= 30 THEN 'dev' ELSE 'train' END AS frozen FROM k LEFT JOIN f USING (g)""")
def first_freeze(t):
    """CL8, XT3: the first freeze fills test, then dev, from the groups of the sampled rows, in order of their digests; all that comes later trains."""
    groups = t.gold_annotation.select(_group().alias("group_key"), "sampling_population")
    first = groups.filter("sampling_population is not null").select("group_key").distinct().withColumn("_o", F.sha2(F.concat(F.lit("freeze:"), "group_key"), 256)).orderBy("_o").limit(30)
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_o")))
    frozen = F.when(F.col("_place") <= 20, "test").when(F.col("_place") <= 30, "dev").otherwise("train")
    return groups.select("group_key").distinct().join(F.broadcast(placed), "group_key", "left").select("group_key", frozen.alias("frozen"))


@query("""WITH k AS (SELECT DISTINCT ident, ('0x' || substr(sha256('gold:' || ident), 1, 8))::BIGINT / 4294967296.0 AS x FROM gold_annotation WHERE ident IS NOT NULL) SELECT ident, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'dev' ELSE 'test' END AS assigned FROM k""")
def gold_split(t):
    """CL12: a disjoint three-way split of ids; groups.leaks must find nothing in it."""
    from hangarlake.operators.groups import hashed_split

    return hashed_split(t.gold_annotation.filter("ident is not null").select("ident").distinct(), "ident", [("train", 0.8), ("dev", 0.9), ("test", 1.0)], "gold:")


_FIXED = ("MAINT_ITEM", "FAULT", "ACTION", "LOC", "OUTCOME", "ABN_PROC")


@query(f"""WITH {_PREDICTED}, gs AS (SELECT ident, list(gold ORDER BY i) AS tags FROM pt GROUP BY 1), {_ISLANDS.format(src='gs', out='gspan').replace('tok AS', 'tok2 AS').replace('FROM tok)', 'FROM tok2)').replace('st AS (SELECT *', 'st2 AS (SELECT *').replace('FROM st)', 'FROM st2)').replace('isl AS', 'isl2 AS').replace('FROM isl ', 'FROM isl2 ')},
k AS (SELECT type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT coalesce(a.type, b.type) AS type, a.ident IS NOT NULL AS g, b.ident IS NOT NULL AS p FROM gspan a FULL JOIN pspan b ON a.ident = b.ident AND a.type = b.type AND a.begin = b.begin AND a."end" = b."end") GROUP BY 1)
SELECT round(avg(CASE WHEN 2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0) > 0 THEN 2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0)) ELSE 0 END), 6) AS macro_f1, count(*) AS types FROM (SELECT unnest([{', '.join(f"'{v}'" for v in _FIXED)}]) AS type) LEFT JOIN k USING (type)""")
def fixed_macro(t):
    """XT23: a mean over a fixed list of types, so one that nobody found counts as 0."""
    from hangarlake.plans.graph import span_counts

    listed = t.spark.createDataFrame([(v,) for v in _FIXED], "type string")
    rows = listed.join(span_counts(t), "type", "left").na.fill(0)
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return rows.agg(F.round(F.avg(F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0)), 6).alias("macro_f1"), F.count("*").alias("types"))


@query(f"""WITH {_MEMO}, v AS (SELECT 'memorized' AS variant, gold, pred FROM pt UNION ALL SELECT 'nothing', gold, 'O' FROM pt) SELECT variant, count(*) AS tokens, round(avg((gold = pred)::INT), 6) AS accuracy, sum((gold <> 'O' AND gold = pred)::INT)::BIGINT AS tagged_right FROM v GROUP BY 1""")
def variant_metrics(t):
    """XT8, IE20: the same measures for every variant, in one aggregation."""
    rows = memorized(t).select("gold", F.explode(F.create_map(F.lit("memorized"), F.col("pred"), F.lit("nothing"), F.lit("O"))).alias("variant", "pred"))
    return rows.groupBy("variant").agg(F.count("*").alias("tokens"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.sum(((F.col("gold") != "O") & (F.col("gold") == F.col("pred"))).cast("long")).alias("tagged_right"))


_MULTI = f"""{ANNOTATED}, p AS (SELECT record_id, e.entity_type AS type, lower(e.text) AS label, count(*) AS n FROM (SELECT record_id, unnest(entities) AS e FROM rec) GROUP BY 1, 2, 3),
q AS (SELECT record_id, e.entity_type AS type, lower(e.text) AS label, count(*) AS n FROM (SELECT record_id, unnest(entities) AS e FROM rec) WHERE coalesce(e.confidence, 1) >= 0.7 GROUP BY 1, 2, 3)"""


@query(f"WITH {_MULTI} SELECT type, sum(least(p.n, coalesce(q.n, 0)))::BIGINT AS tp, sum(greatest(p.n - coalesce(q.n, 0), 0))::BIGINT AS fn, sum(greatest(coalesce(q.n, 0) - p.n, 0))::BIGINT AS fp FROM p LEFT JOIN q USING (record_id, type, label) GROUP BY 1")
def multiset_counts(t):
    """AG19, XT22: labels as multisets, the sure ones against all; repeats count."""
    spans = annotated(t).select("record_id", F.explode("entities").alias("e")).select("record_id", F.col("e.entity_type").alias("type"), F.lower("e.text").alias("label"), F.when(F.coalesce("e.confidence", F.lit(1.0)) >= 0.7, 1).otherwise(0).alias("sure"))
    counts = spans.groupBy("record_id", "type", "label").agg(F.count("*").alias("gold"), F.sum("sure").alias("found"))
    return counts.groupBy("type").agg(F.sum(F.least("gold", "found")).alias("tp"), F.sum(F.greatest(F.col("gold") - F.col("found"), F.lit(0))).alias("fn"), F.sum(F.greatest(F.col("found") - F.col("gold"), F.lit(0))).alias("fp"))


def _tagged(t, train_filter: str = "annotation_batch = 'round1'"):
    rows = t.gold_annotation.select("ident", "tokens", "bio", "annotation_batch").distinct()
    model = tagging.fitted(rows.filter(train_filter), "tokens", "bio")
    held = rows.filter("coalesce(annotation_batch, '') <> 'round1'").select("ident", "tokens", "bio").distinct()
    return held.select("ident", "tokens", "bio", tagging.tagged(F.col("tokens"), model).alias("m")).select("ident", "tokens", "bio", "m.tags", F.round("m.margin", 4).alias("margin"))


@query()
def sequence_tagger(t):
    """IE7: tags by a chain model that was fitted on one batch, with a margin that tells how sure they are; on all other rows."""
    return _tagged(t).select("ident", "tags", "bio", "margin")


@query()
def learning_curve(t):
    """XT9: the tagger's accuracy on the same rows with a quarter, half and all of its training rows, by digest."""
    out = None
    for part in (1, 2, 4):
        rows = _tagged(t, f"annotation_batch = 'round1' and pmod(crc32(encode(coalesce(ident, ''), 'UTF-8')), 4) < {part}")
        same = F.size(F.filter(F.arrays_zip("tags", "bio"), lambda z: z["tags"] == z["bio"]))
        one = rows.agg(F.lit(part / 4).alias("share"), F.round(F.sum(same) / F.sum(F.size("bio")), 4).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_MEMO}, a AS (SELECT 'memorized' AS model, round(avg((gold = pred)::INT), 6) AS accuracy FROM pt), b AS (SELECT 'nothing' AS model, round(avg((gold = 'O')::INT), 6) AS accuracy FROM pt UNION ALL SELECT 'memorized', 0.0)
SELECT model, accuracy, 'report' AS origin FROM a UNION ALL SELECT model, accuracy, 'fallback' FROM b WHERE model NOT IN (SELECT model FROM a)""")
def recovered_metrics(t):
    """XT10: each model's measure from the first of several sources that has it."""
    from hangarlake.operators.normalize import layered

    rows = memorized(t)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    report = rows.agg(rate(F.col("gold") == F.col("pred")).alias("expansion")).select(F.lit("memorized").alias("key"), "expansion")
    other = rows.agg(rate(F.col("gold") == "O").alias("expansion")).select(F.lit("nothing").alias("key"), "expansion").unionByName(t.spark.createDataFrame([("memorized", 0.0)], "key string, expansion double"))
    return layered([("report", report), ("fallback", other)]).select(F.col("key").alias("model"), F.col("expansion").alias("accuracy"), "origin")
