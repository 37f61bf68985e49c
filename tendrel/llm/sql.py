"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

_RECORDS = """
r AS (SELECT DISTINCT ON (tab, rec_id) tab, rec_id, tokens FROM (
  SELECT 'chunks' AS tab, chunk_ix AS rec_id, tokens FROM chunks UNION ALL SELECT 'requirements', req_key, tokens FROM requirements)
  WHERE rec_id IS NOT NULL),
t AS (SELECT tab, rec_id, lower(trim(u.tok, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term FROM r, unnest(r.tokens) AS u(tok)),
c AS (SELECT tab, rec_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
n AS (SELECT tab, count(DISTINCT rec_id) AS n FROM c GROUP BY tab),
d AS (SELECT tab, term, count(*) AS df FROM c GROUP BY ALL)"""

_SIZE = "length(text) + CASE WHEN length(heading) > 0 THEN length(heading) + 1 ELSE 0 END"


#: q: all pairs of sections alike at the limit or more.
_PAIRS = """w AS (SELECT chunk_ix, list_distinct(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) AS s
  FROM (SELECT DISTINCT chunk_ix, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM chunks WHERE chunk_ix IS NOT NULL AND text IS NOT NULL)),
e AS (SELECT chunk_ix, unnest(s) AS g, len(s) AS n FROM w),
p AS (SELECT a.chunk_ix AS chunk_a, b.chunk_ix AS chunk_b, count(*) AS same, any_value(a.n) + any_value(b.n) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.chunk_ix < b.chunk_ix GROUP BY 1, 2),
q AS (SELECT chunk_a, chunk_b FROM p WHERE same >= (SELECT amount FROM size_limits WHERE limit_name = 'near_duplicate_min') * (n - same))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_RECORDS}
SELECT tab, rec_id, term FROM (
  SELECT c.tab, c.rec_id, c.term, row_number() OVER (PARTITION BY c.tab, c.rec_id ORDER BY round(c.tf * ln(n.n / d.df), 6) DESC, c.term) AS k
  FROM c JOIN d USING (tab, term) JOIN n USING (tab) WHERE d.df > 1) WHERE k = 1""",
        "p5_found": f"SELECT DISTINCT chunk_ix FROM chunks WHERE chunk_ix IS NOT NULL AND {_SIZE} > (SELECT amount FROM size_limits WHERE limit_name = 'item_max')",
        # what must hold of results that SQL can't make
        "p5_cover": f"""SELECT DISTINCT chunk_ix, (CASE WHEN length(heading) + 1 > l.amount // 2 THEN length(heading) + 1 ELSE 0 END + length(text))::BIGINT AS covered, true AS fits, true AS overlaps, true AS gapless
FROM chunks, (SELECT amount FROM size_limits WHERE limit_name = 'item_max') l WHERE chunk_ix IS NOT NULL AND {_SIZE} > l.amount""",
        "p7_once": "SELECT DISTINCT doc_id, true AS once, true AS fits FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
        "p8_caps": "SELECT DISTINCT source, true AS capped, true AS shared FROM doc_sources WHERE source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL",
        "p6_found": f"WITH {_PAIRS} SELECT chunk_a, chunk_b FROM q",
        "p6_members": """WITH c AS (SELECT DISTINCT chunk_ix, text FROM chunks WHERE chunk_ix IS NOT NULL AND text IS NOT NULL)
SELECT chunk_ix, min(chunk_ix) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS copies FROM c""",
        "p6_groups": f"""WITH RECURSIVE {_PAIRS},
c AS (SELECT DISTINCT chunk_ix, text FROM chunks WHERE chunk_ix IS NOT NULL AND text IS NOT NULL), m AS (SELECT chunk_ix, min(chunk_ix) OVER (PARTITION BY text) AS rep FROM c),
l AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM q JOIN m a ON a.chunk_ix = q.chunk_a JOIN m b ON b.chunk_ix = q.chunk_b WHERE a.rep <> b.rep),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
g AS (SELECT rep AS v, rep AS root FROM m UNION SELECT b.y, g.root FROM g JOIN b ON b.x = g.v),
r AS (SELECT v, min(root) AS group_id FROM g GROUP BY v), n AS (SELECT x, count(*) AS links FROM b GROUP BY x)
SELECT m.chunk_ix, r.group_id, coalesce(n.links, 0) AS links FROM m JOIN r ON r.v = m.rep LEFT JOIN n ON n.x = m.rep""",
    }
