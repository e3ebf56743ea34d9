"""DuckDB SQL of the subpackage's queries, run over whole tables."""

from __future__ import annotations

#: Letters and digits of both orders of a record's parts, one row for each record.
_FORMS = """
WITH r AS (
  SELECT DISTINCT record_id,
         regexp_replace(lower(full_text), '[^a-z0-9]+', '', 'g') AS s,
         regexp_replace(lower(problem_text), '[^a-z0-9]+', '', 'g') AS a,
         regexp_replace(lower(action_text), '[^a-z0-9]+', '', 'g') AS b
  FROM maintenance_record WHERE full_text IS NOT NULL AND record_id IS NOT NULL
), cut_at AS (
  SELECT record_id, s, CASE
    WHEN s = a || b THEN length(a) WHEN s = b || a THEN length(b)
    WHEN starts_with(s, a) AND a <> '' THEN length(a) WHEN ends_with(s, b) AND b <> '' THEN length(s) - length(b)
    WHEN ends_with(s, a) AND a <> '' THEN length(s) - length(a) WHEN starts_with(s, b) AND b <> '' THEN length(b)
    ELSE 0 END AS n
  FROM r WHERE s <> ''
), k AS (SELECT DISTINCT record_id, least(s, substr(s, n + 1) || substr(s, 1, n)) AS k FROM cut_at),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS keep_id FROM k)
"""




def _sets(rows: str, k: int) -> str:
    """CTEs: rec(id, s) with the set of runs of k words of each text, u(u, s) the distinct sets, v(u, x, n) their elements."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
txt AS (SELECT DISTINCT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM ({rows}) WHERE id IS NOT NULL AND t IS NOT NULL),
rec AS (SELECT id, list_sort(list_distinct([{run} FOR i IN range(1, greatest(1, len(w) - {k - 2}))])) AS s FROM txt WHERE len(w) >= {k}),
u AS (SELECT row_number() OVER () AS u, s FROM (SELECT DISTINCT s FROM rec)),
v AS (SELECT u, unnest(s) AS x, len(s) AS n FROM u),
links AS (
  SELECT a.u AS a, b.u AS b FROM v a JOIN v b ON a.x = b.x AND a.u <> b.u
  GROUP BY a.u, b.u, a.n, b.n HAVING count(*) >= {{t}} * (a.n + b.n - count(*)) - 1e-9
)"""


def _groups(text: str, k: int, t: float) -> str:
    return f"""
WITH RECURSIVE {_sets(f"SELECT record_id AS id, {text} AS t FROM maintenance_record", k).format(t=t)},
reach AS (SELECT u AS a, u AS b FROM u UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS u, min(b) AS root FROM reach GROUP BY a),
labelled AS (SELECT rec.id, root.root FROM rec JOIN u ON rec.s = u.s JOIN root ON root.u = u.u),
g AS (SELECT DISTINCT id, min(id) OVER (PARTITION BY root) AS group_id, max(id) OVER (PARTITION BY root) AS last FROM labelled)
SELECT group_id, id AS record_id FROM g WHERE group_id <> last"""


_PART = "CASE WHEN trim(lower(split)) IN ('dev', 'val', 'validation') THEN 'validation' ELSE trim(lower(split)) END"
_CROSS = f"""
WITH {_sets("SELECT record_id AS id, problem_text AS t FROM maintenance_record", 3).format(t=0.5)},
part AS (SELECT DISTINCT record_id AS id, dataset_id, {_PART} AS part FROM maintenance_record),
m AS (SELECT rec.id, u.u, part.part = 'train' AS train FROM rec JOIN u ON rec.s = u.s JOIN part ON part.id = rec.id WHERE part.part IN ('train', 'validation', 'test')),
near AS (SELECT a, b FROM links UNION ALL SELECT u, u FROM u),
pairs AS (
  SELECT DISTINCT least(x.id, y.id) AS record_id_a, greatest(x.id, y.id) AS record_id_b
  FROM m x JOIN near ON near.a = x.u JOIN m y ON y.u = near.b WHERE x.train AND NOT y.train AND x.id <> y.id
)"""


_LINKED = f"""
WITH RECURSIVE hub AS (SELECT record_id, min(cluster_id) AS low FROM maintenance_record WHERE cluster_id IS NOT NULL AND record_id IS NOT NULL GROUP BY 1 HAVING min(cluster_id) < max(cluster_id)),
star AS (SELECT DISTINCT m.cluster_id AS a, hub.low AS b FROM maintenance_record m JOIN hub USING (record_id) WHERE m.cluster_id <> hub.low),
edge AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
root AS (SELECT a AS cluster_id, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT DISTINCT m.cluster_id, coalesce(root.root, m.cluster_id) AS label FROM maintenance_record m LEFT JOIN root USING (cluster_id) WHERE m.cluster_id IS NOT NULL)"""

_ASSIGNED = _LINKED + """,
rec AS (SELECT record_id, min(cluster_id) AS cluster_id FROM maintenance_record WHERE record_id IS NOT NULL GROUP BY 1),
place AS (SELECT record_id, ('0x' || substr(md5(coalesce('unit:' || lab.label, 'record:' || record_id)), 1, 8))::BIGINT / 4294967296.0 AS x FROM rec LEFT JOIN lab USING (cluster_id)),
range AS (SELECT split, sum(target_share) OVER (ORDER BY split) / sum(target_share) OVER () AS upper FROM split_target WHERE target_share > 0),
assigned AS (SELECT record_id, arg_min(split, upper) AS split FROM place JOIN range ON x < upper GROUP BY 1)"""


#: Runs of twelve words of items and documents.
_LEAKS = """
WITH w AS (SELECT item_id AS id, true AS item, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_item WHERE item_id IS NOT NULL
  UNION ALL SELECT doc_id, false, regexp_extract_all(lower(text), '[a-z0-9]+') FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT id, item, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, item, w, unnest(range(1, len(w) - 10)) AS i FROM w))
SELECT DISTINCT a.id AS item_id, b.id AS doc_id FROM g a JOIN g b ON a.g = b.g WHERE a.item AND NOT b.item"""

#: Every stretch of 400 characters, by its digest.
_SHARED = """
WITH t AS (SELECT text, list(DISTINCT doc_id) AS ids FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400 GROUP BY 1),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) AS n, text, ids FROM t),
s AS (SELECT DISTINCT n, md5_number(v) AS h FROM (SELECT n, substr(text, i, 400) AS v FROM (SELECT n, text, unnest(range(1, length(text) - 398)) AS i FROM n))),
many AS (SELECT h, list(n) AS l FROM s GROUP BY 1 HAVING count(*) > 1),
pairs AS (SELECT DISTINCT a.n AS a, b.n AS b FROM (SELECT h, unnest(l) AS n FROM many) a JOIN (SELECT h, unnest(l) AS n FROM many) b ON a.h = b.h UNION SELECT n, n FROM n WHERE len(ids) > 1)
SELECT DISTINCT least(x, y) AS doc_id_a, greatest(x, y) AS doc_id_b FROM (SELECT x, unnest(m.ids) AS y FROM (SELECT p.b, unnest(n.ids) AS x FROM pairs p JOIN n ON n.n = p.a) q JOIN n m ON m.n = q.b) WHERE x <> y"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _LEAKS,
        "p9_found": _SHARED,
        "p1_found": _FORMS + "SELECT keep_id, record_id AS copy_id FROM g WHERE record_id <> keep_id",
        "p1_copy_counts": _FORMS + "SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
        "p4_found": _LINKED
        + f""", named AS (SELECT DISTINCT m.cluster_id, nullif({_PART}, '') AS part FROM maintenance_record m),
bad AS (SELECT label FROM lab JOIN named USING (cluster_id) GROUP BY 1 HAVING count(DISTINCT part) > 1)
SELECT cluster_id FROM lab WHERE label IN (SELECT label FROM bad)""",
        "p4_assign": _ASSIGNED + "SELECT record_id, split FROM assigned",
        "p4_shares": _ASSIGNED
        + """SELECT t.split, t.target_share, coalesce(n, 0) AS records, coalesce(n, 0) / (SELECT count(*) FROM assigned) AS share
FROM split_target t LEFT JOIN (SELECT split, count(*) AS n FROM assigned GROUP BY 1) USING (split)""",
        "p5_found": f"SELECT * FROM ({_groups('full_text', 3, 0.5)}) WHERE group_id <> record_id",
        "p5_problem_groups": _groups("problem_text", 5, 0.8),
        "p6_found": _CROSS + "SELECT * FROM pairs",
        "p6_report": _CROSS
        + """, hit AS (
  SELECT record_id_a AS id, record_id_b AS other FROM pairs UNION SELECT record_id_b, record_id_a FROM pairs
)
SELECT p.part AS split, p.dataset_id AS source, count(*) AS records,
       sum(CASE WHEN p.id IN (SELECT h.id FROM hit h JOIN part q ON q.id = h.other AND q.part = 'train') THEN 1 ELSE 0 END)::BIGINT AS overlapping
FROM part p WHERE p.part IN ('validation', 'test') AND p.id IS NOT NULL GROUP BY p.part, p.dataset_id""",
    }
