"""Queries of retrieval, fusion, evidence, evaluation and calibration.

Queries are the work orders whose number is divisible by 100, documents all work orders.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hangarlake.functions import fixed
from hangarlake.functions import text as x
from hangarlake.operators import blocks
from hangarlake.operators import evaluate as e
from hangarlake.operators import retrieval as r
from hangarlake.operators.radius import text_clusters, text_pairs
from hangarlake.operators.setjoin import set_members, similar_sets
from hangarlake.plans.insights import CASES, cases
from hangarlake.plans.registry import query
from hangarlake.session import cut

_IS_QUERY = "CAST(substr({c}, 3) AS BIGINT) % 100 = 0"


def documents(t):
    rows = t.work_order.filter("ident is not null").groupBy(F.col("ident").alias("doc_id")).agg(F.min("problem").alias("problem"))
    return rows.select("doc_id", "problem", x.tokens("problem", "[a-z0-9#]+").alias("words"))


def _queries(docs):
    return docs.filter(_IS_QUERY.format(c="doc_id")).withColumnRenamed("doc_id", "query_id")


def char_weights_sql(texts: str) -> str:
    """SQL of cw(id, gram, w), of ``texts``(id, m, text); like operators.radius.char_weights."""
    return f"""cg AS (SELECT id, m, unnest([substr(w, i, n) FOR i IN range(1, length(w) - n + 2)]) AS gram FROM (SELECT id, m, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> '')) || ' ' AS w FROM {texts}), (SELECT unnest([3, 4, 5]) AS n)),
ctf AS (SELECT id, m, gram, count(*) AS tf FROM cg GROUP BY 1, 2, 3), cdf AS (SELECT gram, ln((1 + (SELECT sum(m) FROM {texts})) / (1 + sum(m))) + 1 AS idf FROM ctf GROUP BY 1), cr AS (SELECT id, gram, tf * idf AS w FROM ctf JOIN cdf USING (gram)),
cw AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM cr)"""


DOCS = "docs AS (SELECT ident AS doc_id, min(problem) AS problem, regexp_extract_all(lower(coalesce(min(problem), '')), '[a-z0-9#]+') AS words FROM work_order WHERE ident IS NOT NULL GROUP BY 1), q AS (SELECT doc_id AS query_id, words FROM docs WHERE CAST(substr(doc_id, 3) AS BIGINT) % 100 = 0)"
BM25 = f"""{DOCS}, post AS (SELECT doc_id, w AS term, size, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS w, len(words) AS size FROM docs) GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), qt AS (SELECT DISTINCT query_id, unnest(words) AS term FROM q),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2)"""
_RANKED = "SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}"


def bm25(t):
    docs = documents(t)
    return r.bm25(_queries(docs), docs.select("doc_id", "words"))


@query(f"WITH {BM25} {_RANKED.format(src='bm', k=5)}")
def bm25_topk(t):
    """SM7, STR14, D13."""
    return r.top_k(bm25(t), 5)


TFIDF = f"""{BM25}, idf AS (SELECT term, ln((1 + (SELECT n FROM st)) / (1 + df)) + 1 AS idf FROM dfs), wd AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN idf USING (term)), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM wd GROUP BY 1),
tf AS (SELECT a.doc_id AS query_id, b.doc_id, sum(a.w * b.w) / (any_value(x.nd) * any_value(y.nd)) AS score FROM wd a JOIN q ON q.query_id = a.doc_id JOIN wd b USING (term) JOIN nd x ON x.doc_id = a.doc_id JOIN nd y ON y.doc_id = b.doc_id GROUP BY 1, 2)"""


def tfidf(t):
    docs = documents(t)
    return r.tfidf(_queries(docs), docs.select("doc_id", "words"))


@query(f"WITH {TFIDF} {_RANKED.format(src='tf', k=5)}")
def tfidf_topk(t):
    """Single words only, as the SQL has it; norm_tfidf_topk is SM8."""
    return r.top_k(tfidf(t), 5)


STRUCT = f"""{CASES}, sq AS (SELECT record_id AS query_id, list_distinct(components) AS c, list_distinct(faults) AS f, (CASE WHEN len(components) > 0 THEN 0.4 ELSE 0 END) + (CASE WHEN len(faults) > 0 THEN 0.3 ELSE 0 END) AS total FROM cases WHERE CAST(substr(record_id, 3) AS BIGINT) % 100 = 0),
sp AS (SELECT query_id, record_id AS doc_id, 0.4 / len(c) / total AS s FROM (SELECT *, unnest(c) AS v FROM sq) JOIN (SELECT record_id, unnest(list_distinct(components)) AS v FROM cases) USING (v)
UNION ALL SELECT query_id, record_id, 0.3 / len(f) / total FROM (SELECT *, unnest(f) AS v FROM sq) JOIN (SELECT record_id, unnest(list_distinct(faults)) AS v FROM cases) USING (v)),
stru AS (SELECT query_id, doc_id, sum(s) AS score FROM sp GROUP BY 1, 2)"""


def struct_scores(t):
    rows = cases(t).select(F.col("record_id").alias("doc_id"), "components", "faults")
    return r.structural(_queries(rows), rows, ["components", "faults"])


@query(f"WITH {STRUCT} {_RANKED.format(src='stru', k=5)}")
def struct_overlap(t):
    """SM9: equal sets have equal scores, so each pair of different sets is scored once, against the first five documents of each."""
    sets = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("components", "faults")]
    rows = cut(cases(t).select(F.col("record_id").alias("doc_id"), *sets))
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("components", "faults").orderBy("doc_id"))).filter("_n <= 5")
    docs = blocks.blocks_of(few.select("doc_id", r.marks("components", "faults").alias("marks")).filter("size(marks) > 0"))
    members = cut(_queries(rows).withColumn("first", F.min("query_id").over(Window.partitionBy("components", "faults"))))
    queries = members.filter("query_id = first")
    weights = cut(r.structural_weights(queries, ["components", "faults"]))
    passes = [{"ids": ids.to_pylist(), "channels": {"struct": blocks.channel(ids, blocks.within(weights, ids))}} for ids in blocks.passes(queries)]
    best = r.top_k(r.weighted_best(docs, passes, 5, {"struct": 1.0}).filter("score > 0").drop("text_score"), 5)
    return members.select("query_id", "first").join(best.withColumnRenamed("query_id", "first"), "first").drop("first")


@query(f"""WITH {TFIDF}, u AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS score FROM bm WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, score * {fixed.MIX_WEIGHTS['bm25']} AS s FROM u UNION ALL SELECT query_id, doc_id, score * {fixed.MIX_WEIGHTS['word']} FROM tf) GROUP BY 1, 2) {_RANKED.format(src='h', k=5)}""")
def weighted_hybrid(t):
    """Two of four channels with their weights, as the SQL has it; weighted_channels has all."""
    return r.top_k(r.mixed({"bm25": r.unit_scaled(bm25(t)), "word": tfidf(t)}, fixed.MIX_WEIGHTS), 5)


_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce(problem, '')), '[^A-Za-z0-9_\s#]', ' ', 'g'), '\s+', ' ', 'g'))"
_MANY = r"""nd0 AS (SELECT doc_id, {norm} AS text, regexp_extract_all({norm}, '[a-z0-9_][a-z0-9_]+') AS u FROM docs),
wp AS (SELECT doc_id AS id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(u, [u[i] || ' ' || u[i + 1] FOR i IN range(1, len(u))])) AS w FROM nd0) GROUP BY 1, 2), wi AS (SELECT term, ln((1 + (SELECT n FROM st)) / (1 + count(*))) + 1 AS idf FROM wp GROUP BY 1),
wr AS (SELECT id, term, tf * idf AS w FROM wp JOIN wi USING (term)), ww AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wr), ctext AS (SELECT doc_id AS id, 1 AS m, text FROM nd0)""".replace("{norm}", _NORM)
CHANNELS = f"""{BM25}, {_MANY}, {char_weights_sql('ctext')}, {STRUCT},
wc AS (SELECT query_id, b.id AS doc_id, sum(a.w * b.w) AS score FROM q JOIN ww a ON a.id = query_id JOIN ww b USING (term) GROUP BY 1, 2), cc AS (SELECT query_id, b.id AS doc_id, sum(a.w * b.w) AS score FROM q JOIN cw a ON a.id = query_id JOIN cw b USING (gram) GROUP BY 1, 2),
ch AS (SELECT q.query_id, docs.doc_id, coalesce(bm.score, 0) AS bm25, coalesce(wc.score, 0) AS word, coalesce(cc.score, 0) AS char, coalesce(stru.score, 0) AS struct FROM q CROSS JOIN docs
  LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = docs.doc_id LEFT JOIN wc ON wc.query_id = q.query_id AND wc.doc_id = docs.doc_id LEFT JOIN cc ON cc.query_id = q.query_id AND cc.doc_id = docs.doc_id LEFT JOIN stru ON stru.query_id = q.query_id AND stru.doc_id = docs.doc_id)"""


def channels(t):
    """(query_id, doc_id, bm25, word, char, struct) of every query and every document; 0 where they share nothing."""
    docs = documents(t)
    norm = docs.select("doc_id", x.normalized_problem("problem").alias("text"))
    two = x.tokens("text", "[a-z0-9_][a-z0-9_]+")
    terms = lambda c: norm.select("doc_id", c.alias("words"))
    word, char = terms(F.concat(two, x.ngrams(two, 2))), terms(x.char_grams("text"))
    scores = {"bm25": r.bm25(_queries(docs), docs.select("doc_id", "words")), "word": r.tfidf(_queries(word), word), "char": r.tfidf(_queries(char), char), "struct": struct_scores(t)}
    return r.all_channels(_queries(docs).select("query_id"), docs.select("doc_id"), scores)


def channel_passes(t, names):
    """(documents in blocks, what is sent of each pass's queries), for scores of the named channels."""
    structure = cases(t).select(F.col("record_id").alias("doc_id"), "components", "faults")
    norm = documents(t).withColumn("text", x.normalized_problem("problem"))
    two = x.tokens("text", "[a-z0-9_][a-z0-9_]+")
    columns = {"bm25": ["words"], "word": [F.concat(two, x.ngrams(two, 2)).alias("terms")], "char": ["text", F.filter(F.split("text", " "), lambda w: w != "").alias("runs")], "struct": ["components", "faults"]}
    docs = blocks.blocks_of((norm.join(structure, "doc_id", "left") if "struct" in names else norm).select("doc_id", *[c for n in names for c in columns[n]]))
    queries, weights, shared = _queries(docs), {}, {}
    if "bm25" in names:
        weights["bm25"], shared["mean"] = r.bm25_weights(queries, docs)
    for name, column, words in (("word", "terms", F.col("terms")), ("char", "runs", x.char_grams("text") if "char" in names else None)):
        if name in names:
            terms = docs.select("doc_id", words.alias("words"))
            weights[name], norms = r.tfidf_weights(_queries(terms), terms)
            docs = docs.join(norms.withColumnRenamed("norm", f"norm_{column}"), "doc_id", "left")
    if "struct" in names:
        weights["struct"] = r.structural_weights(queries, ["components", "faults"])
        docs = docs.withColumn("marks", F.coalesce(r.marks("components", "faults"), F.array().cast("array<string>")))
    docs = blocks.blocks_of(docs.drop("text", "components", "faults"))
    kept = {name: cut(w) for name, w in weights.items()}
    found = blocks.passes(queries)
    return docs, [shared | {"ids": ids.to_pylist(), "channels": {n: blocks.channel(ids, blocks.within(kept[n], ids)) for n in names}} for ids in found]


@query(f"""WITH {CHANNELS}, f AS (SELECT query_id, doc_id, {' + '.join(f'1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round({c}, 9) DESC, doc_id))' for c in ('bm25', 'word', 'char', 'struct'))} AS score FROM ch)
SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f) WHERE rank <= 5""")
def rrf_hybrid(t):
    """SM10, WN4: the full ranks of four channels, fused."""
    return r.top_k(r.fused(*channel_passes(t, blocks.FUSED)), 5, 12)


_UNIT = "CASE WHEN max(bm25) OVER w - min(bm25) OVER w > 1e-12 THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 0 END"
_UNITS = f"{CHANNELS}, un AS (SELECT query_id, doc_id, {_UNIT} AS bm25, word, char, struct FROM ch WINDOW w AS (PARTITION BY query_id))"


@query(f"""WITH {_UNITS}, m AS (SELECT query_id, doc_id, {' + '.join(f'{w} * {c}' for c, w in fixed.MIX_WEIGHTS.items())} AS score, round(0.5 * bm25 + 0.3 * word + 0.2 * char, 6) AS text_score FROM un)
SELECT query_id, doc_id, score, text_score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, text_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM m) WHERE rank <= 5""")
def weighted_channels(t):
    """SM10, SM11, WN5: four channels with their weights, and the text score beside them."""
    rows = r.weighted_best(*channel_passes(t, list(fixed.MIX_WEIGHTS)), 5, fixed.MIX_WEIGHTS, fixed.TEXT_WEIGHTS)
    return r.top_k(rows.withColumn("text_score", F.round("text_score", 6)), 5)


@query(f"WITH {CHANNELS}, m AS (SELECT query_id, doc_id, 0.65 * word + 0.35 * char AS score FROM ch) {_RANKED.format(src='m', k=5)}")
def norm_tfidf_topk(t):
    """SM8, SM10: words and pairs of words, and 3- to 5-runs of characters."""
    return r.top_k(r.weighted_best(*channel_passes(t, ["word", "char"]), 5, {"word": 0.65, "char": 0.35}).drop("text_score"), 5)


HITS = f"""{BM25}, {CASES}, joined AS (SELECT query_id, b.doc_id, round(score, 6) AS score, coalesce(c.cluster_id, b.doc_id) AS cluster, c.action_family AS family, coalesce(qc.cluster_id, query_id) AS own, qc.action_family AS true_family
  FROM bm b JOIN cases c ON c.record_id = b.doc_id JOIN cases qc ON qc.record_id = query_id WHERE b.doc_id <> query_id AND coalesce(c.cluster_id, b.doc_id) <> coalesce(qc.cluster_id, query_id)),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cluster ORDER BY score DESC, doc_id) AS rn FROM joined) WHERE rn = 1) WHERE rank <= 10)"""


def word_passes(t, facts=None, channels=("bm25",)):
    """(documents in blocks, what is sent of each pass's queries), for bm25 and tfidf over words; with ``facts`` only documents that have any, with their cluster and family."""
    docs = blocks.blocks_of(documents(t).select("doc_id", "words"))
    queries = _queries(docs)
    weights, mean = r.bm25_weights(queries, docs)
    kept, kept_docs = {"bm25": cut(weights)}, docs
    if "tfidf" in channels:
        weights, norms = r.tfidf_weights(queries, docs)
        kept["tfidf"], kept_docs = cut(weights), docs.join(norms.withColumnRenamed("norm", "norm_words"), "doc_id", "left")
    own = {}
    if facts is not None:
        kept_docs = kept_docs.join(facts.withColumnRenamed("record_id", "doc_id"), "doc_id")
        own = {q: (c, f) for q, c, f in _queries(facts.withColumnRenamed("record_id", "doc_id")).join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "cluster", "family").collect()}
    kept_docs = blocks.blocks_of(kept_docs) if kept_docs is not docs else docs
    return kept_docs, [{"ids": ids.to_pylist(), "mean": mean, "facts": own, "channels": {n: blocks.channel(ids, blocks.within(w, ids)) for n, w in kept.items()}} for ids in blocks.passes(queries)]


def case_facts(t):
    """(record_id, cluster, family) of every case."""
    return cut(cases(t).select("record_id", F.coalesce("cluster_id", "record_id").alias("cluster"), F.col("action_family").alias("family")))


def hits(t, k: int = 10):
    """The best document of each of the k best clusters, without the query's own cluster."""
    facts = case_facts(t)
    # Of each block of documents only those that can be among a query's hits go on.
    scores = r.near(*word_passes(t, facts), k).withColumn("score", F.round("score", 6)).filter("doc_id <> query_id")
    joined = scores.join(facts.withColumnRenamed("record_id", "doc_id"), "doc_id").join(facts.select(F.col("record_id").alias("query_id"), F.col("cluster").alias("own"), F.col("family").alias("true_family")), "query_id").filter("cluster <> own")
    # The best document of a cluster carries its family along, so nothing is joined back.
    best = joined.groupBy("query_id", "cluster", "true_family").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id", "family")).alias("b"))
    rows = best.select("query_id", "cluster", "true_family", "b.doc_id", "b.family", (-F.col("b.s")).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)


@query(f"WITH {HITS} SELECT query_id, doc_id, cluster, score, rank FROM hit")
def diversified_hits(t):
    """WN3, JN13."""
    return hits(t).select("query_id", "doc_id", "cluster", "score", "rank")


@query(f"WITH {HITS} SELECT query_id, record_id AS doc_id, max(score) AS score FROM hit JOIN cases ON coalesce(cases.cluster_id, record_id) = hit.cluster GROUP BY 1, 2")
def cluster_expansion(t):
    """JN14: all records of the clusters that were hit."""
    members = cases(t).select(F.col("record_id").alias("member"), F.coalesce("cluster_id", "record_id").alias("cluster"))
    return hits(t).select("query_id", "cluster", "score").join(members, "cluster").groupBy("query_id", F.col("member").alias("doc_id")).agg(F.max("score").alias("score"))


VOTES = f"""{HITS}, votes AS (SELECT query_id, family, evidence, support, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, family) AS rank FROM
  (SELECT query_id, family, round(sum(s), 6) AS evidence, count(*) AS support FROM (SELECT query_id, family, cluster, max(score) AS s FROM hit GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


@query(f"WITH {VOTES} SELECT query_id, family, evidence, support, rank FROM votes")
def family_evidence(t):
    """AG27: votes of the hits by family."""
    return e.family_votes(hits(t))


@query(f"WITH {VOTES} SELECT query_id, max(evidence) FILTER (rank = 1) AS top, coalesce(max(evidence) FILTER (rank = 2), 0) AS second, round(max(evidence) FILTER (rank = 1) - coalesce(max(evidence) FILTER (rank = 2), 0), 6) AS margin FROM votes GROUP BY 1")
def top_margin(t):
    """WN8."""
    v = e.family_votes(hits(t)).filter("rank <= 2")
    first, second = F.max(F.when(F.col("rank") == 1, F.col("evidence"))), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("evidence"))), F.lit(0.0))
    return v.groupBy("query_id").agg(first.alias("top"), second.alias("second"), F.round(first - second, 6).alias("margin"))


@query(f"""WITH {VOTES}, m AS (SELECT query_id, max(support) FILTER (rank = 1) AS support, max(evidence) FILTER (rank = 1) AS top, coalesce(max(evidence) FILTER (rank = 2), 0) AS second, sum(evidence) AS total FROM votes GROUP BY 1)
SELECT query_id, CASE WHEN support >= 3 AND (top - second) / total >= 0.08 AND top / total >= 0.75 THEN 'strong' WHEN support >= 2 AND (top - second) / total >= 0.03 AND top / total >= 0.5 THEN 'moderate' WHEN support = 1 THEN 'limited' ELSE 'exploratory' END AS tier FROM m""")
def evidence_tiers(t):
    """RC3."""
    v = e.family_votes(hits(t))
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    m = v.groupBy("query_id").agg(at(1, "support").alias("support"), at(1, "evidence").alias("top"), F.coalesce(at(2, "evidence"), F.lit(0.0)).alias("second"), F.sum("evidence").alias("total"))
    return m.select("query_id", e.evidence_tier(F.col("support"), (F.col("top") - F.col("second")) / F.col("total"), F.col("top") / F.col("total")).alias("tier"))


RANKS = f"{VOTES}, truth AS (SELECT DISTINCT query_id, true_family FROM hit), ranks AS (SELECT query_id, true_family, v.rank FROM truth LEFT JOIN votes v ON v.query_id = truth.query_id AND v.family = true_family)".replace("SELECT query_id, true_family, v.rank", "SELECT truth.query_id, true_family, v.rank")


def ranks(t):
    found = cut(hits(t))
    truth = found.select("query_id", "true_family").distinct()
    votes = e.family_votes(found).select("query_id", F.col("family").alias("true_family"), "rank")
    return truth.join(votes, ["query_id", "true_family"], "left")


@query(f"WITH {RANKS} SELECT count(*) AS queries, round(avg((coalesce(rank, 1000000) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(rank, 1000000) <= 3)::INT), 6) AS hit_3, round(avg((coalesce(rank, 1000000) <= 5)::INT), 6) AS hit_5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_5 FROM ranks")
def rank_metrics(t):
    """EV1."""
    return e.rank_metrics(ranks(t))


@query(f"WITH {RANKS} SELECT true_family AS family, count(*) AS queries, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS recall FROM ranks GROUP BY 1")
def family_recall(t):
    """Recall by family."""
    return ranks(t).groupBy(F.col("true_family").alias("family")).agg(F.count("*").alias("queries"), F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("int")), 6).alias("recall"))


@query(f"""WITH {HITS}, gr AS (SELECT query_id, rank, (CASE WHEN family = true_family THEN 2 WHEN family <> 'Other' THEN 1 ELSE 0 END) AS grade FROM hit), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM gr),
s AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN (pow(2, grade) - 1) / log2(best + 1) ELSE 0 END) AS ideal FROM i GROUP BY 1) SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg_5 FROM s""")
def graded_ndcg(t):
    """EV5."""
    grade = F.when(F.col("family") == F.col("true_family"), 2).when(F.col("family") != "Other", 1).otherwise(0)
    rows = hits(t).withColumn("grade", grade).withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    gain = lambda c: F.sum(F.when(F.col(c) <= 5, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(c) + 1)).otherwise(0.0))
    s = rows.groupBy("query_id").agg(gain("rank").alias("dcg"), gain("best").alias("ideal"))
    return s.select("query_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg_5"))


SCORED = "sc AS (SELECT record_id || ':' || e.entity_id AS k, e.confidence AS p, (e.entity_type = 'FAULT')::INT AS y FROM (SELECT record_id, unnest(entities) AS e FROM (SELECT record_id, arg_max(entities, received_at) AS entities FROM maintenance_record GROUP BY 1)) WHERE e.confidence IS NOT NULL)"


def scored(t):
    """Confidences of entities beside a label of each."""
    rows = t.maintenance_record.groupBy("record_id").agg(F.max_by("entities", "received_at").alias("entities")).select("record_id", F.explode("entities").alias("e")).filter("e.confidence is not null")
    return rows.select(F.concat_ws(":", "record_id", "e.entity_id").alias("k"), F.col("e.confidence").alias("p"), (F.col("e.entity_type") == "FAULT").cast("int").alias("y"))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS s FROM sc GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS brier FROM b")
def calibration_error(t):
    """CA2, CA3."""
    return e.calibration_error(scored(t))


@query(f"WITH {SCORED} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM sc GROUP BY 1")
def confidence_bins(t):
    """CA3."""
    return e.calibration_table(scored(t))


@query(f"WITH {SCORED}, o AS (SELECT y, row_number() OVER (ORDER BY p DESC, k) AS rn, count(*) OVER () AS n FROM sc) SELECT c / 10.0 AS coverage, any_value(ceil(n * c / 10))::BIGINT AS rows, round(avg(y), 6) AS accuracy FROM o JOIN (SELECT unnest(generate_series(1, 10)) AS c) ON rn <= ceil(n * c / 10) GROUP BY c")
def risk_coverage(t):
    """CA4, WN15."""
    return e.risk_coverage(scored(t), "k")


_POISSON = " + ".join(f"(u >= {s})::INT" for s in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917))
_BOOT = f"boot AS (SELECT round, sum(w * y)::BIGINT AS hits, sum(w)::BIGINT AS rows FROM (SELECT round, y, {_POISSON} AS w FROM (SELECT round, y, ('0x' || substr(md5(round || ':' || k), 1, 8))::BIGINT / 4294967296.0 AS u FROM sc, (SELECT unnest(generate_series(1, 100)) AS round))) GROUP BY 1)"


@query(f"WITH {SCORED}, {_BOOT} SELECT round(quantile_cont(hits / rows, 0.025), 6) AS low, round(quantile_cont(hits / rows, 0.975), 6) AS high, count(*) AS rounds FROM boot")
def bootstrap_interval(t):
    """ST8, SM5, WN14."""
    b = e.bootstrap(scored(t), "k", 100, hits=F.col("y"), rows=F.lit(1)).withColumn("rate", F.col("hits") / F.col("rows"))
    return b.agg(F.round(F.percentile("rate", 0.025), 6).alias("low"), F.round(F.percentile("rate", 0.975), 6).alias("high"), F.count("*").alias("rounds"))


@query(f"WITH {SCORED}, b AS (SELECT round, sum(w * ((p >= 0.8)::INT = y)::INT) / sum(w) AS first, sum(w * ((p >= 0.6)::INT = y)::INT) / sum(w) AS second FROM (SELECT round, p, y, {_POISSON} AS w FROM (SELECT round, p, y, ('0x' || substr(md5(round || ':' || k), 1, 8))::BIGINT / 4294967296.0 AS u FROM sc, (SELECT unnest(generate_series(1, 100)) AS round))) GROUP BY 1) SELECT round(avg(first - second), 6) AS difference, round(avg((first - second <= 0)::INT), 6) AS p_value FROM b")
def paired_bootstrap(t):
    """EV8."""
    right = lambda cut: ((F.col("p") >= cut).cast("int") == F.col("y")).cast("int")
    b = e.bootstrap(scored(t), "k", 100, a=right(0.8), b=right(0.6), n=F.lit(1)).withColumn("d", F.col("a") / F.col("n") - F.col("b") / F.col("n"))
    return b.agg(F.round(F.avg("d"), 6).alias("difference"), F.round(F.avg((F.col("d") <= 0).cast("int")), 6).alias("p_value"))


@query()
def calibration_model(t):
    """CA1: how likely a query's leading family is right, from its evidence, margin and support; fitted on half of the queries by digest, applied to the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = cut(hits(t))
    votes = e.family_votes(found)
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("rank") == k, F.col(c))), F.lit(0.0))
    best = votes.groupBy("query_id").agg(at(1, "evidence").alias("top"), (at(1, "evidence") - at(2, "evidence")).alias("margin"), F.max(F.when(F.col("rank") == 1, F.col("support"))).cast("double").alias("support"), F.max(F.when(F.col("rank") == 1, F.col("family"))).alias("family"))
    rows = best.join(found.select("query_id", "true_family").distinct(), "query_id").withColumn("y", (F.col("family") == F.col("true_family")).cast("int"))
    rows = cut(VectorAssembler(inputCols=["top", "margin", "support"], outputCol="raw").transform(rows).withColumn("half", F.pmod(F.xxhash64("query_id"), F.lit(2))))
    dev = rows.filter("half = 0")
    if dev.isEmpty():
        return rows.select("query_id", "top", "margin", "support", F.lit(None).cast("double").alias("calibrated"), "y")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(dev)
    model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50).fit(scaler.transform(dev))
    return model.transform(scaler.transform(rows.filter("half = 1"))).select("query_id", "top", "margin", "support", F.round(vector_to_array("probability")[1], 4).alias("calibrated"), "y")


@query()
def relation_model(t):
    """IE8: whether a pair of entities is related, from their types, order and distance, with balanced weights; fitted on half of the records, scored on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    rows = t.maintenance_record.groupBy("record_id").agg(F.max_by(F.struct("full_text", "entities", "relations"), "received_at").alias("r")).select("record_id", "r.*")
    pairs = rows.select("record_id", "full_text", "relations", "entities", F.explode("entities").alias("a")).select("record_id", "full_text", "relations", "a", F.explode("entities").alias("b")).filter("a.entity_id <> b.entity_id")
    related = F.exists("relations", lambda v: (v["source_entity_id"] == F.col("a.entity_id")) & (v["target_entity_id"] == F.col("b.entity_id")))
    low, high = F.least("a.end_pos", "b.end_pos"), F.greatest("a.start_pos", "b.start_pos")
    between = F.array_join(F.slice(x.tokens(F.substring("full_text", low + 1, F.greatest(high - low, F.lit(0))), "[a-z]+"), 1, 2), " ")
    data = pairs.select("record_id", F.concat_ws(">", "a.entity_type", "b.entity_type").alias("types"), (F.col("a.start_pos") < F.col("b.start_pos")).cast("string").alias("order"), F.least(F.lit(10), F.floor(F.abs(F.col("a.start_pos") - F.col("b.start_pos")) / 10)).cast("string").alias("distance"), F.coalesce(between, F.lit("")).alias("between"), F.coalesce(related, F.lit(False)).cast("int").alias("y"))
    data = FeatureHasher(inputCols=["types", "order", "distance", "between"], outputCol="features", numFeatures=1024).transform(data).withColumn("half", F.pmod(F.xxhash64("record_id"), F.lit(2)))
    fit = data.filter("half = 0")
    share = fit.agg(F.avg("y")).first()[0] or 0.5
    weighted = fit.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    model = LogisticRegression(labelCol="y", weightCol="w", maxIter=30, regParam=0.001).fit(weighted)
    return model.transform(data.filter("half = 1")).groupBy("types", "y", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT ident, trim(regexp_replace(lower(problem), '[^a-z0-9]+', ' ', 'g')) AS p FROM work_order WHERE problem IS NOT NULL), s AS (SELECT min(ident) AS k, s FROM (SELECT ident, list_sort(list_distinct([substr(p, i, 3) FOR i IN range(1, length(p) - 1)])) AS s FROM k WHERE length(p) >= 3) GROUP BY s),
v AS (SELECT k, unnest(s) AS e, len(s) AS n FROM s), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM v a JOIN v b ON a.e = b.e AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, round(c / (na + nb - c), 6) AS likeness FROM p WHERE c / (na + nb - c) >= 0.8 - 1e-9""")
def similarity_radius_join(t):
    """Problems alike by their sets of runs of three letters, one row for each pair of sets; similarity_radius_members has their rows."""
    return similar_sets(_gram_sets(t), "ident", "g", 0.8)


def _gram_sets(t):
    p = x.fingerprint("problem")
    grams = F.when(F.length(p) >= 3, F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return t.work_order.filter("problem is not null and ident is not null").select("ident", grams.alias("g"))


@query("""WITH k AS (SELECT ident, trim(regexp_replace(lower(problem), '[^a-z0-9]+', ' ', 'g')) AS p FROM work_order WHERE problem IS NOT NULL AND ident IS NOT NULL), s AS (SELECT DISTINCT ident, list_sort(list_distinct([substr(p, i, 3) FOR i IN range(1, length(p) - 1)])) AS s FROM k WHERE length(p) >= 3)
SELECT ident, min(ident) OVER (PARTITION BY s) AS representative FROM s""")
def similarity_radius_members(t):
    """The representative, in similarity_radius_join, of every work order's set of runs."""
    return set_members(_gram_sets(t), "ident", "g")


_TEXTS = "fp AS (SELECT ident, trim(regexp_replace(lower(problem), '[^a-z0-9]+', ' ', 'g')) AS text FROM work_order WHERE problem IS NOT NULL AND ident IS NOT NULL), texts AS (SELECT text AS id, text, count(*) AS m FROM fp GROUP BY 1)"
RADIUS = f"{_TEXTS}, {char_weights_sql('texts')}, near AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS likeness FROM cw a JOIN cw b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {{radius}} - 1e-9)"


def _fingerprints(t):
    return t.work_order.filter("problem is not null and ident is not null").select("ident", x.fingerprint("problem").alias("text"))


@query(f"WITH {RADIUS.format(radius=0.9)} SELECT a, b, likeness FROM near")
def cosine_radius_join(t):
    """JN11: fingerprints with a cosine of 0.90 or more over tf-idf weights of 3- to 5-runs within words."""
    return text_pairs(_fingerprints(t), "text", 0.9)


@query(f"WITH {RADIUS.format(radius=0.87)} SELECT a, b, likeness FROM near")
def cosine_radius_protocol(t):
    """JN11: the same at 0.87, the radius of the protocol."""
    return text_pairs(_fingerprints(t), "text", 0.87)


@query(f"""WITH RECURSIVE {RADIUS.format(radius=0.9)}, edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a), root AS (SELECT a AS text, min(b) AS root FROM reach GROUP BY a)
SELECT DISTINCT ident, text, 'normgrp-' || substr(sha256(coalesce(root, text)), 1, 12) AS label FROM fp LEFT JOIN root USING (text)""")
def normalized_clusters(t):
    """CL3: every work order's cluster by equal fingerprints and the edges of cosine_radius_join; named by its smallest fingerprint."""
    return text_clusters(_fingerprints(t), "ident", "text", 0.9)


@query(f"""WITH {CASES}, f AS (SELECT record_id, unnest(list_distinct(faults)) AS fault FROM cases), c AS (SELECT fault, count(*) AS n FROM f GROUP BY 1) SELECT record_id, c.fault AS anchor, c.n AS support FROM f JOIN c USING (fault) WHERE c.n >= 20""")
def anchor_support(t):
    """How many records stand behind each record's faults; counts are pre-aggregated before the join."""
    faults = cases(t).select("record_id", F.explode(F.array_distinct("faults")).alias("anchor"))
    return faults.join(faults.groupBy("anchor").agg(F.count("*").alias("support")).filter("support >= 20"), "anchor")


@query(r"""SELECT ident, array_to_string(regexp_extract_all(coalesce(problem, ''), '\S+')[1:4], ' ') AS truncated, [x for x in regexp_extract_all(lower(coalesce(problem, '')), '[a-z0-9]+') if substr(md5(ident || ':' || x), 1, 1) <> '0'] AS dropped FROM work_order""")
def perturbations(t):
    """EV9: truncated texts, and texts that lost words by digest."""
    words = F.regexp_extract_all(F.coalesce("problem", F.lit("")), F.lit(r"\S+"), F.lit(0))
    kept = F.filter(x.tokens("problem", "[a-z0-9]+"), lambda w: F.substring(F.md5(F.concat_ws(":", "ident", w)), 1, 1) != "0")
    return t.work_order.select("ident", F.array_join(F.slice(words, 1, 4), " ").alias("truncated"), kept.alias("dropped"))
