"""Queries of text scalars, normalization and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hangarlake.functions import align, fixed
from hangarlake.functions import text as x
from hangarlake.operators import normalize as n
from hangarlake.operators.records import keep_last
from hangarlake.plans.registry import Tables, query


TEXTS = ("full_text", "problem_text", "action_text")


def corpus(t: Tables, texts: tuple[str, ...] = TEXTS):
    """One row for each record: the last delivery. Only the texts that are asked for are exchanged; a record's deliveries agree in them."""
    columns = ["record_id", "received_at", "dataset_id", *[c for c in TEXTS if c in texts], "split", "cluster_id", "asset_id"]
    return keep_last(t.maintenance_record.select(*columns), ["record_id"], ["received_at"])


#: The same in SQL: nulls first, as Spark orders the fields of a struct.
CORPUS = """corpus AS (SELECT * EXCLUDE rn FROM (SELECT record_id, received_at, dataset_id, full_text, problem_text, action_text, split, cluster_id, asset_id,
  row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, dataset_id DESC NULLS LAST, full_text DESC NULLS LAST, problem_text DESC NULLS LAST,
    action_text DESC NULLS LAST, split DESC NULLS LAST, cluster_id DESC NULLS LAST, asset_id DESC NULLS LAST) AS rn FROM maintenance_record) WHERE rn = 1)"""


def _escaped(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_families(column: str, families, otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({column}), '{_escaped('|'.join(f'(?:{p})' for p in patterns))}') THEN '{name}'" for name, patterns in families)
    return f"CASE {whens} ELSE {otherwise} END"


FAMILY_SQL = sql_families("coalesce(action_text, '')", fixed.ACTION_FAMILIES, "'Other'")
ISSUE_SQL = sql_families("coalesce(problem_text, '')", fixed.ISSUE_FAMILIES, "NULL")
_GOOD, _BAD = (f"regexp_matches(lower(coalesce(action_text, '')), '{_escaped('|'.join(f'(?:{p})' for p in ps))}')" for ps in (fixed.GOOD_OUTCOME, fixed.BAD_OUTCOME))
OUTCOME_SQL = f"CASE WHEN {_GOOD} AND {_BAD} THEN 'mixed' WHEN {_BAD} THEN 'negative' WHEN {_GOOD} THEN 'positive' ELSE 'unknown' END"
NEAR_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '#\s?[0-9]+[a-z]?', ' ', 'g'),
  '\bnumber [0-9]+\b', ' ', 'g'), '[0-9]+', ' ', 'g'), '[^a-z ]', ' ', 'g'), '\s+', ' ', 'g'))"""
PROBLEM_NORM_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(problem_text, '')), '[^A-Za-z0-9_\s#]', ' ', 'g'), '\s+', ' ', 'g'))"
CLEAN_SQL = r"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"""SELECT ident, {CLEAN_SQL.format(c='problem')} AS problem_clean, {CLEAN_SQL.format(c='action')} AS action_clean, regexp_replace(trim(ident), '^([0-9]+)\\.0$', '\\1') AS id FROM work_order""")
def clean_text(t):
    """STR1, STR2."""
    return t.work_order.select("ident", x.clean("problem").alias("problem_clean"), x.clean("action").alias("action_clean"), x.canonical_id("ident").alias("id"))


@query(f"""WITH {CORPUS} SELECT record_id, trim(regexp_replace(lower(full_text), '[^a-z0-9]+', ' ', 'g')) AS fingerprint,
  'normgrp-' || substr(sha256(trim(regexp_replace(lower(full_text), '[^a-z0-9]+', ' ', 'g'))), 1, 16) AS group_key, replace(trim(regexp_replace(lower(full_text), '[^a-z0-9]+', ' ', 'g')), ' ', '') AS characters FROM corpus""")
def fingerprint_key(t):
    """STR3, STR4."""
    key = x.fingerprint("full_text")
    return corpus(t, ("full_text",)).select("record_id", key.alias("fingerprint"), x.stable_hash("normgrp-", key).alias("group_key"), F.replace(key, F.lit(" "), F.lit("")).alias("characters"))


@query(f"WITH {CORPUS} SELECT record_id, {NEAR_SQL.format(c='problem_text')} AS near_key, {PROBLEM_NORM_SQL} AS problem_norm FROM corpus")
def near_dup_key(t):
    """STR5, STR6."""
    return corpus(t, ("problem_text",)).select("record_id", x.near_key("problem_text").alias("near_key"), x.normalized_problem("problem_text").alias("problem_norm"))


@query("""SELECT ident, regexp_extract_all(lower(coalesce(problem, '')), '[a-z0-9#]+') AS retrieval, regexp_extract_all(lower(coalesce(problem, '')), '[a-z]+(?:''[a-z]+)?|[0-9]+') AS simple,
  regexp_extract_all(lower(coalesce(problem, '')), '[a-z0-9]+(?:[./-][a-z0-9]+)*|[^a-z0-9\\s]') AS operational, regexp_extract_all(lower(coalesce(problem, '')), '[a-z0-9]+(?:[./#-][a-z0-9]+)*') AS projected FROM work_order""")
def tokenizers(t):
    """STR11, STR13, STR14, STR15."""
    return t.work_order.select(
        "ident", x.tokens("problem", "[a-z0-9#]+").alias("retrieval"), x.tokens("problem", "[a-z]+(?:'[a-z]+)?|[0-9]+").alias("simple"),
        x.tokens("problem", r"[a-z0-9]+(?:[./-][a-z0-9]+)*|[^a-z0-9\s]").alias("operational"), x.tokens("problem", "[a-z0-9]+(?:[./#-][a-z0-9]+)*").alias("projected"),
    )


@query()
def master_tokens(t):
    """STR8, STR9, STR10, NRM15: typed tokens with places, and the text rendered again."""
    return align.with_tokens(t.work_order, "ident", "problem")


@query(r"""WITH k AS (SELECT ident, regexp_extract_all(coalesce(problem, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS w, coalesce(problem, '') AS p FROM work_order)
SELECT ident, i - 1 AS pos, w[i] AS token FROM (SELECT ident, w, unnest(generate_series(1, len(w))) AS i FROM k)""")
def offset_tokens(t):
    """STR12: tokens with their places."""
    words = F.regexp_extract_all(F.coalesce("problem", F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0))
    return t.work_order.select("ident", F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {CORPUS}, f AS (SELECT record_id, {FAMILY_SQL} AS action_family, {ISSUE_SQL} AS issue_family, {OUTCOME_SQL} AS outcome FROM corpus)
SELECT *, CASE WHEN action_family IN ('Inspect', 'Diagnose') THEN 'diagnostic' ELSE 'corrective' END AS action_role FROM f""")
def family_classify(t):
    """STR19, STR20, STR21, STR22, IE12."""
    rows = corpus(t, ("problem_text", "action_text")).select("record_id", x.action_family("action_text").alias("action_family"), x.issue_family("problem_text").alias("issue_family"), x.outcome("action_text").alias("outcome"))
    return rows.withColumn("action_role", x.action_role("action_family"))


_LOC = _escaped(fixed.LOCATION)
_FORMS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.LOCATION_FORMS.items()) + "}"
_ORDERED = "[v FOR v, i IN {l} IF list_position({l}, v) = i]"


@query(rf"""WITH {CORPUS}, l AS (SELECT record_id, [regexp_replace(trim(v), '\s+', ' ', 'g') FOR v IN regexp_extract_all(lower(coalesce(full_text, '')), '{_LOC}', 1)] AS l FROM corpus),
k AS (SELECT record_id, [regexp_replace(coalesce({_FORMS}[replace(v, ' ', '')], v), '^(?:no\.?|number)\s*([0-9])', '#\1') FOR v IN l] AS l FROM l) SELECT record_id, {_ORDERED.format(l='l')} AS locations FROM k""")
def ordered_locations(t):
    """STR18."""
    return corpus(t, ("full_text",)).select("record_id", x.locations("full_text").alias("locations"))


@query(f"""WITH {CORPUS}, p AS (SELECT '\\b(' || string_agg(regexp_escape(lower(term)), '|' ORDER BY length(term) DESC, lower(term)) || ')\\b' AS p FROM canonical_term WHERE kind = 'component'),
k AS (SELECT record_id, regexp_extract_all(lower(coalesce(full_text, '')), p, 1) AS l FROM corpus, p) SELECT record_id, {_ORDERED.format(l='l')} AS components FROM k""")
def ordered_components(t):
    """STR17: names found in the text, longest first."""
    return n.named_components(corpus(t, ("full_text",)), t.canonical_term, "record_id", "full_text")


_WORDS = """d AS (SELECT map_from_entries(list(struct_pack(k := key, v := expansion))) AS d FROM (SELECT lower(abbrev) AS key, min(expansion) AS expansion FROM abbreviation GROUP BY 1 HAVING count(DISTINCT expansion) = 1
  UNION ALL SELECT lower(misspelling), min(correction) FROM misspelling WHERE length(misspelling) >= 4 AND lower(misspelling) NOT IN (SELECT lower(abbrev) FROM abbreviation) GROUP BY 1 HAVING count(DISTINCT correction) = 1))"""


@query(f"""WITH {CORPUS}, {_WORDS}, p AS (SELECT '\\b(' || string_agg(regexp_escape(lower(term)), '|' ORDER BY length(term) DESC, lower(term)) || ')\\b' AS p FROM canonical_term WHERE kind = 'component'),
k AS (SELECT record_id, regexp_extract_all(array_to_string([coalesce(d.d[w], w) FOR w IN regexp_extract_all(lower(coalesce(full_text, '')), '[a-z0-9]+|[^a-z0-9]+')], ''), p, 1) AS l FROM corpus, p, d) SELECT record_id, {_ORDERED.format(l='l')} AS components FROM k""")
def canonical_components(t):
    """STR16: names found in any known spelling of their words, as their canonical entry."""
    return n.named_components(corpus(t, ("full_text",)), t.canonical_term, "record_id", "full_text", synonyms=n.dictionary(t.abbreviation, t.misspelling))


@query(r"""WITH c AS (SELECT ident, trim(regexp_replace(coalesce(problem, ''), '[\s\p{Z}]+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(action, ''), '[\s\p{Z}]+', ' ', 'g')) AS b FROM work_order)
SELECT ident, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN regexp_matches(a, '[.!?]$') THEN a || ' ' || b ELSE a || '. ' || b END AS text,
  translate(b, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper_action FROM c""")
def combined_text(t):
    """STR26, STR30."""
    return t.work_order.select("ident", x.combined("problem", "action").alias("text"), x.ascii_upper(x.clean("action")).alias("upper_action"))


@query("""SELECT ident, CASE """ + " ".join(f"WHEN regexp_matches(action, '(?i)^{a}\\b') THEN regexp_replace(action, '(?i)^{a}\\b', '{b}')" for a, b in fixed.IMPERATIVES) + """ ELSE action END AS step,
  regexp_matches(lower(coalesce(action, '')), 'check|run ?up|leak|ops|inspect') AS verified FROM work_order""")
def imperative_steps(t):
    """STR27, STR29."""
    return t.work_order.select("ident", x.imperative("action").alias("step"), F.lower(F.coalesce("action", F.lit(""))).rlike("check|run ?up|leak|ops|inspect").alias("verified"))


@query(r"""WITH w AS (SELECT ident, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM gold_annotation)
SELECT ident, pos - 1 AS pos, token, regexp_replace(regexp_replace(regexp_replace(token, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g') AS shape, left(lower(token), 3) AS prefix, right(lower(token), 3) AS suffix,
  regexp_matches(token, '[0-9]') AS digit, contains(token, '/') AS slash, lag(lower(token)) OVER g AS before, lead(lower(token)) OVER g AS after FROM w WINDOW g AS (PARTITION BY ident ORDER BY pos)""")
def token_features(t):
    """STR32, WN6: shape, affixes and neighbours, from the array itself, without an exchange."""
    w, i = F.col("tokens"), F.col("pos")
    rows = t.gold_annotation.select("ident", "tokens", F.posexplode("tokens").alias("pos", "token"))
    near = lambda j: F.when((j >= 0) & (j < F.size(w)), F.lower(F.get(w, j)))
    return rows.select(
        "ident", i.cast("long").alias("pos"), "token", x.word_shape("token").alias("shape"), F.left(F.lower("token"), F.lit(3)).alias("prefix"), F.right(F.lower("token"), F.lit(3)).alias("suffix"),
        F.col("token").rlike("[0-9]").alias("digit"), F.contains("token", F.lit("/")).alias("slash"), near(i - 1).alias("before"), near(i + 1).alias("after"),
    )


@query(r"""SELECT ident, problem, trim(regexp_replace(problem, '\([^)]*\)', ' ', 'g')) AS without_notes FROM work_order WHERE regexp_matches(ident, '^MR[0-9]+$')""")
def valid_ids(t):
    """STR33."""
    return t.work_order.filter(F.col("ident").rlike("^MR[0-9]+$")).select("ident", "problem", F.trim(F.regexp_replace("problem", r"\([^)]*\)", " ")).alias("without_notes"))


PAIRS_SQL = r"""pairs AS (SELECT DISTINCT record_id AS ident, trim(regexp_replace(coalesce(fault_surfaces[i], ''), '[\s\p{Z}]+', ' ', 'g')) AS raw, trim(regexp_replace(coalesce(faults[i], ''), '[\s\p{Z}]+', ' ', 'g')) AS reference
  FROM (SELECT record_id, fault_surfaces, faults, unnest(generate_series(1, least(len(fault_surfaces), len(faults)))) AS i FROM structure_case))"""


def _pairs(t):
    """Free-entered fault names with the faults that stand for them."""
    rows = t.structure_case.select("record_id", F.posexplode(F.slice(F.arrays_zip("fault_surfaces", "faults"), 1, F.least(F.size("fault_surfaces"), F.size("faults")))).alias("pos", "z"))
    return rows.select(F.col("record_id").alias("ident"), x.clean("z.fault_surfaces").alias("raw"), x.clean("z.faults").alias("reference")).distinct()


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT *, regexp_extract_all(lower(raw), '[a-z0-9]+') AS a, regexp_extract_all(lower(reference), '[a-z0-9]+') AS b FROM pairs)
SELECT ident, raw, CASE WHEN raw = '' OR reference = '' THEN 'unmatched_or_empty' WHEN raw = reference THEN 'unchanged' WHEN lower(raw) = lower(reference) THEN 'formatting_only'
  WHEN len(a) > 0 AND len(b) > 0 AND starts_with(b[-1], a[-1]) AND length(b[-1]) >= length(a[-1]) + 2 AND NOT regexp_matches(raw, '[.!?]$') THEN 'possible_truncation_reconstruction'
  WHEN greatest(0, len(b) - len(a)) / greatest(1, len(a)) > 0.35 THEN 'possible_unsupported_addition'
  WHEN len(list_filter([i FOR i IN range(1, least(len(a), len(b)) + 1)], lambda i: length(a[i]) <= 5 AND length(b[i]) > 5)) > 0 THEN 'possible_abbreviation_expansion' ELSE 'lexical_edit' END AS category FROM k""")
def pair_categories(t):
    """How two versions of a text differ, without the likeness, which SQL lacks; pair_audit has it."""
    return _pairs(t).select("ident", "raw", n.pair_category("raw", "reference").alias("category"))


@query(r"""SELECT ident, len(regexp_extract_all(lower(coalesce(action, '')), '\b(?:replaced|removed|installed|inspected|checked|cleaned|tightened|adjusted|drained|ordered)\b')) AS n_actions,
  regexp_matches(lower(coalesce(problem, '')), 'leak|crack|loose|worn|broken|seep|weep') AS has_fault_cue, length(coalesce(problem, '')) >= 60 AS at_width FROM work_order""")
def text_predicates(t):
    """STR25."""
    actions = x.tokens("action", r"\b(?:replaced|removed|installed|inspected|checked|cleaned|tightened|adjusted|drained|ordered)\b")
    problem = F.coalesce("problem", F.lit(""))
    return t.work_order.select("ident", F.size(actions).cast("long").alias("n_actions"), F.lower(problem).rlike("leak|crack|loose|worn|broken|seep|weep").alias("has_fault_cue"), (F.length(problem) >= 60).alias("at_width"))


@query("""WITH g AS (SELECT lower(abbrev) AS key, count(DISTINCT expansion) AS n, min(expansion) AS expansion FROM abbreviation GROUP BY 1),
m AS (SELECT lower(misspelling) AS key, min(correction) AS expansion FROM misspelling WHERE length(misspelling) >= 4 GROUP BY 1 HAVING count(DISTINCT correction) = 1)
SELECT key, expansion, 'abbreviation' AS kind FROM g WHERE n = 1 UNION ALL SELECT key, expansion, 'misspelling' FROM m WHERE key NOT IN (SELECT key FROM g)""")
def dictionary_build(t):
    """NRM1: unambiguous entries; abbreviations before misspellings."""
    return n.dictionary(t.abbreviation, t.misspelling)


@query("""WITH g AS (SELECT lower(abbrev) AS key, min(expansion) AS expansion FROM abbreviation GROUP BY 1 HAVING count(DISTINCT expansion) = 1),
m AS (SELECT lower(misspelling) AS key, min(correction) AS expansion FROM misspelling WHERE length(misspelling) >= 4 GROUP BY 1 HAVING count(DISTINCT correction) = 1),
d AS (SELECT map_from_entries(list(struct_pack(k := key, v := expansion))) AS d FROM (SELECT * FROM g UNION ALL SELECT * FROM m WHERE key NOT IN (SELECT key FROM g)))
SELECT ident, array_to_string([coalesce(d.d[w], CASE WHEN w = '&' THEN 'and' ELSE w END) FOR w IN regexp_extract_all(lower(coalesce(problem, '')), '[a-z0-9]+|&')], ' ') AS normalized FROM work_order, d""")
def dictionary_apply(t):
    """NRM5, NRM16 (the control system), XT17: word by word through a map, no exchange."""
    return t.work_order.select("ident", n.expanded("problem", n.dictionary(t.abbreviation, t.misspelling)).alias("normalized"))


@query()
def rules_normalizer(t):
    """NRM2, NRM9: phrases, numbers, symbols; protected values stay."""
    return n.normalized_by_rules(t.work_order, "ident", "problem", n.dictionary(t.abbreviation, t.misspelling))


@query(f"""SELECT ident, list_concat(regexp_extract_all(coalesce(problem, ''), '(?i){fixed.PROTECTED[0]}'), regexp_extract_all(coalesce(problem, ''), '(?i){fixed.PROTECTED[1]}'), regexp_extract_all(coalesce(problem, ''), '(?i){fixed.PROTECTED[2]}')) AS protected FROM work_order""")
def protected_tokens(t):
    """NRM9."""
    return t.work_order.select("ident", x.protected("problem").alias("protected"))


@query()
def selective_fallback(t):
    """NRM10, NRM12: the candidate, else the rules' text, else the raw one; whichever keeps what is protected."""
    rules = n.normalized_by_rules(t.work_order, "ident", "problem", n.dictionary(t.abbreviation, t.misspelling))
    return n.safest(rules.withColumn("candidate", n.expanded("raw", n.dictionary(t.abbreviation, t.misspelling))))


@query()
def number_words(t):
    """NRM7, NRM8, XT14: number words to digits and back."""
    return n.numbers(t.work_order, "ident", "problem")


@query()
def most_frequent_replacement(t):
    """NRM6: replacements learned from aligned pairs, the most frequent for each word."""
    return n.learned_replacements(_pairs(t))


@query(f"""WITH {PAIRS_SQL} SELECT count(*) AS pairs, sum(levenshtein(raw, reference))::BIGINT AS edits, sum(length(reference))::BIGINT AS units,
  round(sum(levenshtein(raw, reference)) / sum(length(reference)), 6) AS cer, round(avg((raw = reference)::INT), 6) AS exact FROM pairs""")
def character_error_rate(t):
    """SM1, SM2, SM3, XT12."""
    edits = F.levenshtein("raw", "reference")
    return _pairs(t).agg(
        F.count("*").alias("pairs"), F.sum(edits).alias("edits"), F.sum(F.length("reference")).alias("units"),
        F.round(F.sum(edits) / F.sum(F.length("reference")), 6).alias("cer"), F.round(F.avg((F.col("raw") == F.col("reference")).cast("int")), 6).alias("exact"),
    )


@query()
def word_error_rate(t):
    """SM1, SM2, SM4, SM5: additive statistics of each pair, added up: edits by word, changes found and missed."""
    return align.pair_statistics(_pairs(t).withColumn("hypothesis", n.expanded("raw", n.dictionary(t.abbreviation, t.misspelling))))


@query(f"""WITH {CORPUS}, w AS (SELECT dataset_id, unnest(regexp_extract_all(lower(coalesce(full_text, '')), '[a-z]+')) AS w FROM corpus),
v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(term), '[a-z]+')) AS w FROM canonical_term)
SELECT dataset_id, count(*) AS tokens, count(DISTINCT w) AS types, round(avg((w NOT IN (SELECT w FROM v))::INT), 6) AS oov_rate FROM w GROUP BY 1""")
def oov_report(t):
    """AG17: tokens, types and the share outside a vocabulary, by source."""
    words = corpus(t, ("full_text",)).select("dataset_id", F.explode(x.tokens("full_text", "[a-z]+")).alias("w"))
    known = t.canonical_term.select(F.explode(x.tokens("term", "[a-z]+")).alias("w")).distinct().withColumn("_k", F.lit(1))
    counts = words.groupBy("dataset_id", "w").agg(F.count("*").alias("n")).join(known, "w", "left")
    return counts.groupBy("dataset_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("oov_rate"))


@query(f"""WITH {CORPUS} SELECT record_id, 'silver_rules' AS label, problem_text AS raw, 'normalize problem: ' || problem_text AS prompt FROM corpus
WHERE trim(coalesce(problem_text, '')) <> '' AND record_id NOT IN (SELECT ident FROM gold_annotation WHERE ident IS NOT NULL)""")
def silver_set(t):
    """NRM15, JN7, XT15: records outside the held-out ones, labelled."""
    held = t.gold_annotation.select(F.col("ident").alias("record_id"))
    rows = corpus(t, ("problem_text",)).filter("trim(coalesce(problem_text, '')) <> ''").join(held, "record_id", "left_anti")
    return rows.select("record_id", F.lit("silver_rules").alias("label"), F.col("problem_text").alias("raw"), F.concat(F.lit("normalize problem: "), "problem_text").alias("prompt"))
