"""Queries that compare normalization systems, and of joins that are held to guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarlake.functions import align, fixed
from hangarlake.functions import text as x
from hangarlake.operators import normalize as n
from hangarlake.operators import records as r
from hangarlake.plans.registry import query
from hangarlake.plans.texts import _WORDS, CLEAN_SQL, CORPUS, PAIRS_SQL, _pairs, corpus

_KEPT = """(len(list_filter([regexp_replace(v, '[./-]+$', '') FOR v IN list_concat(<guards>)], lambda v: NOT regexp_matches(upper(coalesce(<c>, '')), '(^|[^A-Z0-9])' || regexp_escape(v) || '($|[^A-Z0-9])')
  AND NOT regexp_matches(upper(coalesce(<c>, '')), '(^|[^A-Z0-9])' || regexp_escape(coalesce(map {'LH': 'LEFT', 'RH': 'RIGHT', 'L/H': 'LEFT', 'R/H': 'RIGHT'}[v], v)) || '($|[^A-Z0-9])'))) = 0
  AND len(list_filter(<numbers c>, lambda d: NOT list_contains(<numbers s>, d))) = 0)"""
_NUMBERS = "list_concat(regexp_extract_all(coalesce(<t>, ''), '[0-9]+(?:\\.[0-9]+)?'), [<map>[w] FOR w IN regexp_extract_all(lower(coalesce(<t>, '')), '\\b(<words>)\\b', 1)])"
_NUMBERS = _NUMBERS.replace("<words>", "|".join(n.NUMBER_WORDS)).replace("<map>", "map {" + ", ".join(f"'{k}': '{v}'" for k, v in n.NUMBER_WORDS.items()) + "}")
_KEPT = _KEPT.replace("<numbers c>", _NUMBERS.replace("<t>", "<c>")).replace("<numbers s>", _NUMBERS.replace("<t>", "<s>"))
_KEPT = _KEPT.replace("<guards>", ", ".join(f"regexp_extract_all(upper(coalesce(<s>, '')), '(?i){p}')" for p in fixed.PROTECTED))


def _kept(source: str, candidate: str) -> str:
    """SQL of operators.normalize.guarded: a rewriting keeps every protected value and adds no number."""
    return _KEPT.replace("<s>", source).replace("<c>", candidate)


_APPLY = "array_to_string([coalesce(d.d[w], CASE WHEN w = '&' THEN 'and' ELSE w END) FOR w IN regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+|&')], ' ')"
SYSTEMS = ("raw", "lower", "dictionary")
_ORDERS = f"""orders_text AS (SELECT DISTINCT ident, problem AS raw FROM work_order WHERE ident IS NOT NULL AND problem IS NOT NULL),
sys AS (SELECT ident, raw, 'raw' AS system, raw AS prediction FROM orders_text UNION ALL SELECT ident, raw, 'lower', lower(raw) FROM orders_text UNION ALL SELECT ident, raw, 'dictionary', {_APPLY.format(c='raw')} FROM orders_text, d)"""


def outputs(df, raw: str, words):
    """One row for each text and system: as it is, in lower case, and with its words expanded."""
    known = n.expanded(raw, words)
    each = F.array(*[F.struct(F.lit(s).alias("system"), c.alias("prediction")) for s, c in (("raw", F.col(raw)), ("lower", F.lower(raw)), ("dictionary", known))])
    return df.select("*", F.explode(each).alias("_s")).select(*df.columns, "_s.system", "_s.prediction")


def _order_texts(t):
    return t.work_order.filter("ident is not null and problem is not null").select("ident", F.col("problem").alias("raw")).distinct()


@query(f"WITH {_WORDS}, {_ORDERS} SELECT ident, system, prediction, prediction <> raw AS changed, {_kept('raw', 'prediction')} AS kept FROM sys")
def system_predictions(t):
    """NRM13, NRM16 (the systems without a model): every system's text, whether it differs, and whether what is protected stays."""
    rows = outputs(_order_texts(t), "raw", n.dictionary(t.abbreviation, t.misspelling))
    return rows.select("ident", "system", "prediction", (F.col("prediction") != F.col("raw")).alias("changed"), n.guarded(F.col("raw"), F.col("prediction")).alias("kept"))


@query(f"WITH {_WORDS}, {_ORDERS} SELECT system, count(*) AS texts, round(avg((prediction <> raw)::INT), 6) AS changed, round(avg(({_kept('raw', 'prediction')})::INT), 6) AS kept, sum(len(regexp_extract_all(prediction, '\\S+')))::BIGINT AS words FROM sys GROUP BY 1")
def system_report(t):
    """AG24: what each system does to the texts, without a reference."""
    rows = outputs(_order_texts(t), "raw", n.dictionary(t.abbreviation, t.misspelling))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.groupBy("system").agg(F.count("*").alias("texts"), rate(F.col("prediction") != F.col("raw")).alias("changed"), rate(n.guarded(F.col("raw"), F.col("prediction"))).alias("kept"), F.sum(F.regexp_count("prediction", F.lit(r"\S+"))).cast("long").alias("words"))


_SCORED = f"""{PAIRS_SQL}, ps AS (SELECT ident, raw, reference, 'raw' AS system, raw AS prediction FROM pairs UNION ALL SELECT ident, raw, reference, 'lower', lower(raw) FROM pairs UNION ALL SELECT ident, raw, reference, 'dictionary', {_APPLY.format(c='raw')} FROM pairs, d),
er AS (SELECT system, count(*) AS pairs, sum(levenshtein(prediction, reference)) / sum(length(reference)) AS cer, avg((prediction = reference)::INT) AS exact FROM ps GROUP BY 1)"""


def error_rates(t):
    rows = outputs(_pairs(t), "raw", n.dictionary(t.abbreviation, t.misspelling))
    return rows.groupBy("system").agg(F.count("*").alias("pairs"), (F.sum(F.levenshtein("prediction", "reference")) / F.sum(F.length("reference"))).alias("cer"), F.avg((F.col("prediction") == F.col("reference")).cast("int")).alias("exact"))


@query(f"WITH {_WORDS}, {_SCORED} SELECT system, pairs, round(cer, 6) AS cer, round(exact, 6) AS exact, round(1 - cer / (SELECT cer FROM er WHERE system = 'raw'), 6) AS reduction FROM er")
def error_reduction(t):
    """SM3, XT12: error rates against a reference, and by how much each system lowers the raw text's."""
    rows = error_rates(t)
    base = rows.filter("system = 'raw'").select(F.col("cer").alias("base"))
    return rows.join(F.broadcast(base)).select("system", "pairs", F.round("cer", 6).alias("cer"), F.round("exact", 6).alias("exact"), F.round(1 - F.col("cer") / F.col("base"), 6).alias("reduction"))


@query(f"WITH {_WORDS}, {_SCORED}, m AS (SELECT system, 'cer' AS metric, cer AS value FROM er UNION ALL SELECT system, 'exact', exact FROM er) SELECT m.system, m.metric, round(m.value, 6) AS value, round(m.value - b.value, 6) AS difference FROM m JOIN m b ON b.metric = m.metric AND b.system = 'raw'")
def metric_differences(t):
    """EV12: each variant's metrics less those of the raw text."""
    rows = error_rates(t).select("system", F.explode(F.create_map(F.lit("cer"), F.col("cer"), F.lit("exact"), F.col("exact"))).alias("metric", "value"))
    base = rows.filter("system = 'raw'").select("metric", F.col("value").alias("base"))
    return rows.join(F.broadcast(base), "metric").select("system", "metric", F.round("value", 6).alias("value"), F.round(F.col("value") - F.col("base"), 6).alias("difference"))


@query(f"WITH {_WORDS}, {_SCORED} SELECT arg_min(system, {{'a': cer, 'b': -exact, 'c': system}}) AS system, count(*) AS candidates FROM er WHERE cer <= (SELECT cer FROM er WHERE system = 'raw')")
def chosen_system(t):
    """EV11, EV3: of the systems that are no worse than the raw text the one with the least error, then the most exact, then by name."""
    rows = error_rates(t)
    base = rows.filter("system = 'raw'").select(F.col("cer").alias("base"))
    return rows.join(F.broadcast(base)).filter("cer <= base").agg(F.min_by("system", F.struct("cer", -F.col("exact"), "system")).alias("system"), F.count("*").alias("candidates"))


@query(f"""WITH {_WORDS}, w AS (SELECT DISTINCT ident, problem, action FROM work_order), s AS (SELECT ident, problem, action, {_APPLY.format(c='problem')} AS p, {_APPLY.format(c='action')} AS a FROM w, d),
k AS (SELECT *, {_kept('problem', 'p')} AND {_kept('action', 'a')} AS safe FROM s) SELECT ident, safe, CASE WHEN safe THEN p ELSE coalesce(problem, '') END AS problem, CASE WHEN safe THEN a ELSE coalesce(action, '') END AS action FROM k""")
def safe_export(t):
    """NRM17, XT17: both fields rewritten, or neither where one of them would lose something protected."""
    words = n.dictionary(t.abbreviation, t.misspelling)
    rows = t.work_order.select("ident", "problem", "action", n.expanded("problem", words).alias("p"), n.expanded("action", words).alias("a")).distinct()
    safe = n.guarded(F.col("problem"), F.col("p")) & n.guarded(F.col("action"), F.col("a"))
    rows = rows.withColumn("safe", F.coalesce(safe, F.lit(True)))
    return rows.select("ident", "safe", *[F.when(F.col("safe"), F.col(new)).otherwise(F.coalesce(old, F.lit(""))).alias(old) for new, old in (("p", "problem"), ("a", "action"))])


@query(f"""WITH {CORPUS}, {_WORDS}, c AS (SELECT record_id, split, {CLEAN_SQL.format(c='problem_text')} AS p, {CLEAN_SQL.format(c='action_text')} AS a FROM corpus)
SELECT record_id, split, p AS problem_raw, a AS action_raw, trim(p || ' ' || a) AS combined_raw, {_APPLY.format(c='p')} AS problem_normalized, {_APPLY.format(c='a')} AS action_normalized, trim({_APPLY.format(c='p')} || ' ' || {_APPLY.format(c='a')}) AS combined_normalized, 'dictionary' AS system FROM c, d""")
def corpus_predictions(t):
    """NRM14: the whole corpus field by field, raw and normalized, and both fields together."""
    words = n.dictionary(t.abbreviation, t.misspelling)
    rows = corpus(t, ("problem_text", "action_text")).select("record_id", "split", x.clean("problem_text").alias("problem_raw"), x.clean("action_text").alias("action_raw"))
    rows = rows.select("*", n.expanded("problem_raw", words).alias("problem_normalized"), n.expanded("action_raw", words).alias("action_normalized"))
    both = lambda k: F.trim(F.concat(f"problem_{k}", F.lit(" "), f"action_{k}")).alias(f"combined_{k}")
    return rows.select("*", both("raw"), both("normalized"), F.lit("dictionary").alias("system"))


@query(f"""WITH {CORPUS}, {_WORDS}, k AS (SELECT dataset_id, 'raw' AS system, unnest(regexp_extract_all(lower(coalesce(problem_text, '')), '[a-z]+')) AS w FROM corpus UNION ALL SELECT dataset_id, 'dictionary', unnest(regexp_extract_all({_APPLY.format(c='problem_text')}, '[a-z]+')) FROM corpus, d),
n AS (SELECT dataset_id, count(DISTINCT w) FILTER (system = 'raw') AS raw_types, count(DISTINCT w) FILTER (system = 'dictionary') AS types FROM k GROUP BY 1) SELECT dataset_id, raw_types, types, round(1 - types / raw_types, 6) AS reduction FROM n""")
def vocabulary_reduction(t):
    """AG17: how many different words a normalization saves, by source."""
    words = n.dictionary(t.abbreviation, t.misspelling)
    both = corpus(t, ("problem_text",)).select("dataset_id", F.explode(F.array(F.struct(F.lit(0).alias("s"), x.tokens("problem_text", "[a-z]+").alias("w")), F.struct(F.lit(1).alias("s"), F.regexp_extract_all(n.expanded("problem_text", words), F.lit("[a-z]+"), F.lit(0)).alias("w")))).alias("z"))
    types = both.select("dataset_id", "z.s", F.explode("z.w").alias("w")).groupBy("dataset_id", "w").agg(F.max((F.col("s") == 0).cast("long")).alias("a"), F.max((F.col("s") == 1).cast("long")).alias("b"))
    return types.groupBy("dataset_id").agg(F.sum("a").alias("raw_types"), F.sum("b").alias("types")).withColumn("reduction", F.round(1 - F.col("types") / F.col("raw_types"), 6))


@query(f"WITH {_WORDS}, {_ORDERS}, ids AS (SELECT DISTINCT ident FROM orders_text) SELECT s.system, count(*) AS ids, count(*) - count(p.ident) AS missing FROM (SELECT DISTINCT system FROM sys) s CROSS JOIN ids LEFT JOIN (SELECT DISTINCT system, ident FROM sys) p ON p.system = s.system AND p.ident = ids.ident GROUP BY 1")
def variant_completeness(t):
    """XT20, XT21: whether every variant has the same ids; missing must be 0."""
    texts = _order_texts(t)
    have = outputs(texts, "raw", n.dictionary(t.abbreviation, t.misspelling)).select("system", "ident").distinct().withColumn("_h", F.lit(1))
    wanted = texts.select("ident").distinct().withColumn("system", F.explode(F.array(*map(F.lit, SYSTEMS))))
    return wanted.join(have, ["system", "ident"], "left").groupBy("system").agg(F.count("*").alias("ids"), (F.count("*") - F.count("_h")).alias("missing"))


@query(f"""WITH {CORPUS}, w AS (SELECT DISTINCT ident, {CLEAN_SQL.format(c='problem')} AS p FROM work_order), k AS (SELECT dataset_id, lower({CLEAN_SQL.format(c='problem_text')}) = lower(p) AS same FROM w JOIN corpus ON record_id = ident)
SELECT dataset_id, count(*) AS pairs, sum(same::INT)::BIGINT AS agreeing FROM k GROUP BY 1""")
def source_agreement(t):
    """JN15: whether the raw rows have the text that the records give as theirs, but for case."""
    raw = t.work_order.select(F.col("ident").alias("record_id"), x.clean("problem").alias("p")).distinct()
    rows = raw.join(corpus(t, ("problem_text",)).select("record_id", "dataset_id", x.clean("problem_text").alias("q")), "record_id")
    return rows.groupBy("dataset_id").agg(F.count("*").alias("pairs"), F.sum((F.lower("p") == F.lower("q")).cast("long")).alias("agreeing"))


@query()
def pair_audit(t):
    """STR23, STR24: how two versions of a text differ, under an editor's flags; the likeness is asked for only where words were added."""
    raw = t.work_order.select(F.col("ident").alias("record_id"), x.clean("action").alias("raw"), F.col("problem").alias("_p")).distinct()
    rows = raw.join(corpus(t, ("full_text", "problem_text")).select("record_id", x.clean("full_text").alias("reference"), "problem_text"), "record_id")
    edit = F.when(F.col("raw") == "", "ANON").when(F.length("raw") >= 55, "CUTOFF - T").when(F.length("reference") >= 115, "CUTOFF - C")
    category = n.pair_category("raw", "reference", align.likeness("raw", "reference"))
    return rows.select("record_id", category.alias("category"), n.flagged_category(category, edit, F.lower(x.clean("_p")) == F.lower(x.clean("problem_text"))).alias("flagged"))


_FIELDS = "f AS (SELECT ident, 'problem' AS field, problem AS text FROM work_order UNION ALL SELECT ident, 'action', action FROM work_order), st AS (SELECT DISTINCT ident, field, text, CASE WHEN trim(coalesce(text, '')) = '' THEN 'rejected' WHEN length(text) >= 55 THEN 'needs_review' ELSE 'approved' END AS status FROM f)"


@query(f"WITH {_FIELDS} SELECT ident, field, text, 'normalize ' || field || ': ' || text AS prompt FROM st WHERE status IN ('approved', 'corrected')")
def approved_prompts(t):
    """STR31: texts whose review lets them pass, with their prompt."""
    rows = t.work_order.select("ident", F.explode(F.create_map(F.lit("problem"), F.col("problem"), F.lit("action"), F.col("action"))).alias("field", "text")).distinct()
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "rejected").when(F.length("text") >= 55, "needs_review").otherwise("approved")
    return rows.filter(status.isin("approved", "corrected")).select("ident", "field", "text", F.concat(F.lit("normalize "), "field", F.lit(": "), "text").alias("prompt"))


@query(f"WITH {_FIELDS} SELECT status, count(*) AS n FROM st GROUP BY 1")
def review_population(t):
    """NRM18: the sizes of the review's populations; records.exact_count holds one to a number."""
    rows = t.work_order.select("ident", F.explode(F.create_map(F.lit("problem"), F.col("problem"), F.lit("action"), F.col("action"))).alias("field", "text")).distinct()
    return rows.groupBy(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "rejected").when(F.length("text") >= 55, "needs_review").otherwise("approved").alias("status")).agg(F.count("*").alias("n"))


@query()
def replacements_applied(t):
    """NRM6, JN5: replacements learned from half of the pairs, by digest, and applied to the others, beside their references."""
    half = _pairs(t).withColumn("_h", F.pmod(F.crc32(F.encode("ident", "UTF-8")), F.lit(2)))
    learned = n.learned_replacements(half.filter("_h = 0").drop("_h"))
    return n.replaced(half.filter("_h = 1").drop("_h"), "ident", "raw", learned)


@query("""WITH b AS (SELECT 'chk' AS key, 'check' AS expansion UNION ALL SELECT 'gov', 'government'), g AS (SELECT lower(abbrev) AS key, min(expansion) AS expansion FROM abbreviation GROUP BY 1 HAVING count(DISTINCT expansion) = 1)
SELECT key, expansion, 'table' AS origin FROM g UNION ALL SELECT key, expansion, 'built_in' FROM b WHERE key NOT IN (SELECT key FROM g)""")
def dictionary_layers(t):
    """XT32: a directory's entries go before the built-in ones."""
    built_in = t.spark.createDataFrame([("chk", "check"), ("gov", "government")], "key string, expansion string")
    given = n.dictionary(t.abbreviation, t.misspelling).filter("kind = 'abbreviation'").select("key", "expansion")
    return n.layered([("table", given), ("built_in", built_in)])


@query(f"WITH {CORPUS}, w AS (SELECT DISTINCT ident FROM work_order WHERE ident IS NOT NULL) SELECT ident, dataset_id, split, 'id' AS method FROM w JOIN corpus ON record_id = ident")
def guarded_join(t):
    """JN3: rows joined by id, or by place where no ids agree and the counts do; the method is recorded."""
    left = t.work_order.filter("ident is not null").select("ident").distinct()
    return r.joined_or_zipped(left, corpus(t, ()).select(F.col("record_id").alias("ident"), "dataset_id", "split"), "ident")


@query("WITH w AS (SELECT DISTINCT ident FROM work_order WHERE ident IS NOT NULL), g AS (SELECT ident, max(len(entities)) AS entities FROM gold_annotation WHERE ident IS NOT NULL GROUP BY 1) SELECT w.ident, coalesce(g.entities, 0) AS entities FROM w LEFT JOIN g USING (ident)")
def validated_merge(t):
    """JN4: a left join of unique keys on both sides; what is missing counts as 0."""
    left = t.work_order.filter("ident is not null").select("ident").distinct()
    right = t.gold_annotation.filter("ident is not null").groupBy("ident").agg(F.max(F.size("entities")).cast("long").alias("entities"))
    return r.one_to_one(left, right, "ident").select("ident", F.coalesce("entities", F.lit(0)).alias("entities"))


@query(f"WITH {CORPUS}, w AS (SELECT DISTINCT ident FROM work_order WHERE ident IS NOT NULL) SELECT ident, lower(trim(split)) AS part FROM w JOIN corpus ON record_id = ident WHERE split IS NOT NULL")
def split_lookup(t):
    """JN6, XT37: each row's split from the frozen map; records.covered refuses a null."""
    known = corpus(t, ()).filter("split is not null").select(F.col("record_id").alias("ident"), F.lower(F.trim("split")).alias("part"))
    return r.covered(t.work_order.select("ident").distinct().join(known, "ident"), "part")


@query("SELECT record_id, count(DISTINCT cluster_id) AS clusters, min(cluster_id) AS first_cluster FROM maintenance_record WHERE record_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1")
def cluster_conflicts(t):
    """JN16: records that several clusters claim."""
    rows = t.maintenance_record.filter("record_id is not null").groupBy("record_id")
    return rows.agg(F.count_distinct("cluster_id").alias("clusters"), F.min("cluster_id").alias("first_cluster")).filter("clusters > 1")


@query()
def aligned_rules(t):
    """NRM2, XT13: the rule normalizer in lower case, phrases first, with every token's place, what it became and why."""
    rows = t.work_order.filter("ident is not null").select("ident", "problem").distinct()
    return n.aligned_by_rules(rows, "ident", "problem", n.dictionary(t.abbreviation, t.misspelling), {"work order": "order", "out of limits": "beyond limits"})


@query()
def shielded_rules(t):
    """NRM4, NRM3: the rule normalizer in upper case that leaves protected values letter for letter."""
    return t.work_order.filter("ident is not null").select("ident", n.shielded_by_rules(F.col("problem"), n.dictionary(t.abbreviation, t.misspelling)).alias("normalized")).distinct()


@query()
def rewrite_checks(t):
    """NRM11: the rewritings of one system held against its source, by what speaks against them."""
    words = n.dictionary(t.abbreviation, t.misspelling)
    rows = _order_texts(t).withColumn("candidate", n.expanded("raw", words))
    found = rows.select(F.explode(n.rewrite_problems(F.col("raw"), F.lower("raw"), F.col("candidate"))).alias("problem"))
    return found.groupBy("problem").agg(F.count("*").alias("n"))


@query(rf"""WITH {CORPUS}, e AS (SELECT record_id, full_text, unnest(entities) AS e FROM (SELECT record_id, any_value(full_text) AS full_text, arg_max(entities, received_at) AS entities FROM maintenance_record GROUP BY 1)),
p AS (SELECT record_id, e.entity_id, lower(trim(regexp_replace(full_text, '[\s\p{{Z}}]+', ' ', 'g'))) AS canon, length(regexp_replace(regexp_replace(substr(full_text, 1, e.start_pos), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+', ' ', 'g')) AS a, length(regexp_replace(regexp_replace(substr(full_text, 1, e.end_pos), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+', ' ', 'g')) AS b FROM e)
SELECT record_id, entity_id, a AS begin_char, b AS end_char, substr(canon, a::BIGINT + 1, b - a) AS text FROM p""")
def projected_spans(t):
    """SM6, XT19: spans of a text as places in its canonical form; each border goes where the text before it ends there."""
    from hangarlake.operators.graph import projected

    rows = t.maintenance_record.groupBy("record_id").agg(F.max_by(F.struct("full_text", "entities"), "received_at").alias("r")).select("record_id", "r.full_text", F.explode("r.entities").alias("e"))
    a, b, text = projected(F.col("full_text"), F.col("e.start_pos"), F.col("e.end_pos"))
    return rows.select("record_id", "e.entity_id", a.cast("long").alias("begin_char"), b.cast("long").alias("end_char"), text.alias("text"))


@query("SELECT ident, [CASE WHEN length(w) - 3 < 0 OR length(w) - 3 >= 8 THEN 0 ELSE length(w) - 3 END FOR w IN tokens] AS ids FROM (SELECT DISTINCT ident, tokens FROM gold_annotation)")
def sane_token_ids(t):
    """XT31: ids outside the vocabulary as padding."""
    ids = F.transform("tokens", lambda w: (F.length(w) - 3).cast("long"))
    return t.gold_annotation.select("ident", "tokens").distinct().select("ident", F.transform(ids, lambda v: F.when((v < 0) | (v >= 8), F.lit(0).cast("long")).otherwise(v)).alias("ids"))


@query(f"""WITH {CORPUS}, g AS (SELECT min(record_id) AS record_id, dataset_id, count(*) AS copies FROM corpus WHERE record_id NOT IN (SELECT ident FROM gold_annotation WHERE ident IS NOT NULL) AND coalesce(problem_text, '') <> '' GROUP BY trim(regexp_replace(lower(problem_text), '[^a-z0-9]+', ' ', 'g')), dataset_id),
s AS (SELECT * FROM g ORDER BY sha256('pilot' || record_id), record_id LIMIT 100) SELECT dataset_id, count(*) AS records, sum(copies)::BIGINT AS copies FROM s GROUP BY 1""")
def pilot_composition(t):
    """XT2: the first labelling sample: one of each text that wasn't labelled, a hundred of them by digest, and what it is made of."""
    rows = corpus(t, ("problem_text",)).filter("coalesce(problem_text, '') <> ''").join(t.gold_annotation.select(F.col("ident").alias("record_id")), "record_id", "left_anti")
    one = rows.groupBy(x.fingerprint("problem_text").alias("k"), "dataset_id").agg(F.min("record_id").alias("record_id"), F.count("*").alias("copies"))
    sample = one.orderBy(F.sha2(F.concat(F.lit("pilot"), "record_id"), 256), "record_id").limit(100)
    return sample.groupBy("dataset_id").agg(F.count("*").alias("records"), F.sum("copies").alias("copies"))


@query("""WITH RECURSIVE hub AS (SELECT record_id, min(cluster_id) AS low FROM maintenance_record WHERE cluster_id IS NOT NULL AND record_id IS NOT NULL GROUP BY 1 HAVING min(cluster_id) < max(cluster_id)),
star AS (SELECT DISTINCT m.cluster_id AS a, hub.low AS b FROM maintenance_record m JOIN hub USING (record_id) WHERE m.cluster_id <> hub.low), edge AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a), root AS (SELECT a AS cluster_id, min(b) AS root FROM reach GROUP BY a)
SELECT DISTINCT m.cluster_id, 'EC-' || substr(sha256(m.cluster_id), 1, 12) AS evidence_cluster, 'LG-' || substr(sha256(coalesce(root, m.cluster_id)), 1, 12) AS leakage_group FROM maintenance_record m LEFT JOIN root USING (cluster_id) WHERE m.cluster_id IS NOT NULL""")
def leakage_groups(t):
    """CL10: each cluster's own name and that of all clusters it is linked with."""
    from hangarlake.operators.groups import merged_clusters

    rows = merged_clusters(t.maintenance_record, "cluster_id", "record_id")
    return rows.select("cluster_id", x.stable_hash("EC-", F.col("cluster_id"), 12).alias("evidence_cluster"), x.stable_hash("LG-", F.col("component"), 12).alias("leakage_group"))


@query(f"WITH {CORPUS}, {_WORDS}, g AS (SELECT DISTINCT ident FROM work_order WHERE ident IS NOT NULL), gold AS (SELECT ident, min(problem) AS target FROM work_order WHERE coalesce(problem, '') <> '' GROUP BY 1) SELECT record_id, problem_text AS input, coalesce(gold.target, {_APPLY.format(c='problem_text')}) AS target, CASE WHEN gold.target IS NULL THEN 'silver' ELSE 'gold' END AS origin FROM corpus LEFT JOIN gold ON gold.ident = record_id, d WHERE coalesce(problem_text, '') <> ''")
def training_pairs(t):
    """XT15: each text with its reference where one is given, else with what the rules make of it."""
    known = t.work_order.filter("coalesce(problem, '') <> ''").groupBy(F.col("ident").alias("record_id")).agg(F.min("problem").alias("_gold"))
    rows = corpus(t, ("problem_text",)).filter("coalesce(problem_text, '') <> ''").select("record_id", F.col("problem_text").alias("input")).join(known, "record_id", "left")
    return rows.select("record_id", "input", F.coalesce("_gold", n.expanded("input", n.dictionary(t.abbreviation, t.misspelling))).alias("target"), F.when(F.col("_gold").isNull(), "silver").otherwise("gold").alias("origin"))


_FP = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH a AS (SELECT DISTINCT {_FP.format(c='problem')} AS k FROM work_order), b AS (SELECT DISTINCT {_FP.format(c='problem_text')} AS k FROM maintenance_record) SELECT 'first' AS part, count(*) AS n FROM a UNION ALL SELECT 'second', count(*) FROM b UNION ALL SELECT 'both', count(*) FROM a JOIN b USING (k) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def pool_overlap(t):
    """ST9: the distinct texts of two sets of rows, of both and of either; one aggregation instead of four joins."""
    one = lambda df, c, side: df.select(x.fingerprint(c).alias("k"), F.lit(side).alias("side")).distinct()
    keys = one(t.work_order, "problem", 1).unionByName(one(t.maintenance_record, "problem_text", 2)).groupBy("k").agg(F.sum("side").alias("s"))
    sums = keys.agg(F.count_if(F.col("s") != 2).alias("first"), F.count_if(F.col("s") != 1).alias("second"), F.count_if(F.col("s") == 3).alias("both"), F.count("*").alias("either"))
    return sums.select(F.explode(F.create_map(*[v for c in ("first", "second", "both", "either") for v in (F.lit(c), F.col(c))])).alias("part", "n"))
