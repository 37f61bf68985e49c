"""The core queries in DuckDB's SQL, composed from named parts."""

from __future__ import annotations

from types import SimpleNamespace

from tendrel.operators.drafting import TEMPLATES
from tendrel.plans import fixtures
from tendrel.plans.sql_values import ANSWERED_AT, EVIDENCED_AT, WEAK_AT, rules
from tendrel.plans.sql_values import text as T


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {w}[:-4] WHEN {w} LIKE '%ed' AND length({w}) > 5 THEN {w}[:-3] WHEN {w} LIKE '%ies' AND length({w}) > 5 THEN {w}[:-4] || 'y' "
        f"WHEN {w} LIKE '%es' AND length({w}) > 5 THEN {w}[:-3] WHEN {w} LIKE '%s' AND length({w}) > 4 THEN {w}[:-2] ELSE {w} END"
    )


def _tokens(text: str) -> str:
    stop = ", ".join(_q(w) for w in T.STOPWORDS)
    return (
        f"list_transform(list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z][a-z0-9+#.-]*'), lambda w: trim(w, '.-')), lambda w: length(w) >= 2 AND NOT list_contains([{stop}], w)), lambda w: {_stem('w')})"
    )


def _words(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE len(string_split({text}, ' ')) END"


def _ref(line: str, pattern: str) -> str:
    return f"regexp_extract({line}, {_q(pattern)}, 1)"


def _rest(line: str, pattern: str) -> str:
    return f"CASE WHEN regexp_extract({line}, {_q(pattern)}, 0) <> '' THEN trim(regexp_replace(regexp_replace({line}, {_q(pattern)}, ''), '^[| ]+', '')) ELSE {line} END"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, {_q(f'^{T.BLANKS}|{T.BLANKS}$')}, '', 'g')"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


_LINES = f"""l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {_q(T.LINE_BREAK)}), lambda s: trim(regexp_replace(s, {_q(T.BLANKS)}, ' ', 'g'))), lambda s: s <> '') AS x FROM documents WHERE text IS NOT NULL))"""


def _kind(profile: SimpleNamespace) -> str:
    asks = f"len(list_filter(string_split(line, '|'), lambda c: trim(c) LIKE '%?' OR {_has('trim(c)', profile.asks)})) > 0 OR {_has('line', profile.row_anywhere)}"
    inside = " OR " + _has("text", r"\?\s") if profile.question_inside else ""
    grant = profile is rules.GRANT
    tail = (
        f"WHEN {_has('text', rules.PROMPT)} THEN 'narrative' WHEN {_has('text', rules.BUDGET)} THEN 'budget'" if grant
        else f"WHEN {_has('text', rules.REQUEST)} THEN 'question' WHEN {_has('text', rules.BINDING)} OR {_has('text', rules.ADVISORY)} THEN 'clause'"
    )
    return f"CASE WHEN contains(line, ' | ') THEN CASE WHEN ({asks}) AND words >= 4 THEN '{profile.row_kind}' END WHEN (text LIKE '%?'{inside}) AND words >= 4 THEN 'question' WHEN words < 5 THEN NULL {tail} END"


def _classified(profile: SimpleNamespace) -> str:
    return f"""{_LINES},
c AS (SELECT doc_id, line_no, line, {_ref('line', profile.ref)} AS ref, {_rest('line', profile.ref)} AS text FROM l
  WHERE length(line) >= 15 AND NOT {_has('line', rules.CONTENTS_DOTS)} AND NOT {_has('line', rules.PAGE_NUMBER)} AND NOT ({_has('line', rules.CAPITALS)} AND NOT {_has('line', profile.keeps_capitals)})),
k AS (SELECT *, {_kind(profile)} AS kind FROM (SELECT *, {_words('text')} AS words FROM c))"""


def _extracted(profile: SimpleNamespace) -> str:
    letter = profile.id_format[0]
    return f"""{_classified(profile)},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY line_no) AS first FROM k WHERE kind IS NOT NULL),
x AS (SELECT doc_id, format('{letter}-{{:03d}}', row_number() OVER (PARTITION BY doc_id ORDER BY line_no)) AS id, text, ref, kind, line, {_has('text', rules.BINDING)} AS binding, line_no FROM f WHERE first = 1)"""


_CHUNKS = f"""ch AS (SELECT DISTINCT ON (chunk_ix) chunk_ix, doc, heading, text FROM chunks WHERE chunk_ix IS NOT NULL AND text IS NOT NULL),
ct AS (SELECT chunk_ix, doc, heading, text, {_tokens("concat_ws(' ', heading, text)")} AS tokens FROM ch),
st AS (SELECT count(*) AS n, coalesce(sum(len(tokens)) / count(*), 0.0::DOUBLE)::DOUBLE AS avg_len FROM ct),
un AS (SELECT n, avg_len, CASE WHEN n > 0 THEN ln(1 + (n::DOUBLE - 0.5::DOUBLE) / 1.5::DOUBLE) ELSE 1.0::DOUBLE END AS unseen_idf FROM st),
po AS (SELECT term, chunk_ix, count(*) AS tf FROM (SELECT chunk_ix, unnest(tokens) AS term FROM ct) GROUP BY ALL),
ts AS (SELECT term, count(*) AS df, ln(1 + (max(n)::DOUBLE - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM po, st GROUP BY term)"""

_ASKED = f"""rq AS (SELECT DISTINCT ON (req_key) req_key AS key, tender_id, id, text, ref, kind, binding, line_no FROM requirements WHERE req_key IS NOT NULL),
qs AS (SELECT *, {_tokens("coalesce(text, '')")} AS tokens FROM rq)"""

#: From qs (key, tokens): rk (key, chunk_ix, score, rank) and cov (key, coverage, relevance, evidence, others).
_SCORED = """qt AS (SELECT key, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS term FROM qs),
ln_ AS (SELECT chunk_ix, len(tokens)::DOUBLE AS size FROM ct),
bm AS (SELECT q.key, p.chunk_ix, list_reduce(list((t.idf * (p.tf * 2.5::DOUBLE)) / (p.tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * s.size / st.avg_len)) ORDER BY q.pos), lambda a, b: a + b) AS score
  FROM qt q JOIN po p USING (term) JOIN ts t USING (term) JOIN ln_ s ON s.chunk_ix = p.chunk_ix, st GROUP BY 1, 2),
rk AS (SELECT * FROM (SELECT key, chunk_ix, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, chunk_ix DESC) AS rank FROM bm WHERE score > 0) WHERE rank <= 3),
hd AS (SELECT DISTINCT r.key, p.term FROM rk r JOIN po p USING (chunk_ix)),
qd AS (SELECT DISTINCT key, term FROM qt),
ww AS (SELECT q.key, list(pow(coalesce(t.idf, u.unseen_idf), 2) ORDER BY q.term) AS ws, list(pow(coalesce(t.idf, u.unseen_idf), 2) ORDER BY q.term) FILTER (WHERE h.term IS NOT NULL) AS hs
  FROM qd q LEFT JOIN ts t USING (term) LEFT JOIN hd h ON h.key = q.key AND h.term = q.term, un u GROUP BY q.key),
ev AS (SELECT key, max(chunk_ix) FILTER (WHERE rank = 1) AS evidence, max(score) FILTER (WHERE rank = 1) AS relevance, count(*) - 1 AS others FROM rk GROUP BY key),
cov AS (SELECT qs.*, CASE WHEN ev.key IS NOT NULL AND hs IS NOT NULL THEN list_reduce(hs, lambda a, b: a + b) / list_reduce(ws, lambda a, b: a + b) ELSE 0.0::DOUBLE END AS coverage,
  coalesce(ev.relevance, 0.0::DOUBLE) AS relevance, ev.evidence, coalesce(ev.others, 0) AS others FROM qs LEFT JOIN ww USING (key) LEFT JOIN ev USING (key))"""

_VERDICT = f"CASE WHEN coverage >= {ANSWERED_AT} THEN 'ANSWERED' WHEN coverage >= {WEAK_AT} THEN 'WEAK' ELSE 'GAP' END"
_CITE = "CASE WHEN coalesce(c.heading, '') = '' THEN c.doc ELSE c.doc || ' → ' || c.heading END"
_ASSESSED = f"""{_ASKED}, {_CHUNKS}, {_SCORED},
v AS (SELECT cov.*, {_VERDICT} AS verdict, {_VERDICT} = 'GAP' AND binding AS critical,
  CASE WHEN evidence IS NULL THEN '— no matching evidence —' ELSE {_CITE} || CASE WHEN others > 0 THEN ' (+' || others || ' more)' ELSE '' END END AS citation FROM cov LEFT JOIN ct c ON c.chunk_ix = cov.evidence)"""


def _found_queries(profile: SimpleNamespace) -> str:
    """Extracted requirements of documents as queries, keyed in document order."""
    return f"""{_extracted(profile)}, qs AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS key, *, {_tokens('text')} AS tokens FROM x), {_CHUNKS}, {_SCORED}"""


def _question_type() -> str:
    whens = " ".join(f"WHEN {_has('text', p)} THEN '{n}'" for n, p in rules.QUESTION_TYPES)
    return f"CASE WHEN kind = 'budget' THEN 'budget' {whens} ELSE 'default' END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _local_drafts(topic: str, limit: str) -> str:
    """Drafts from own material and templates; the templates themselves are the library's."""
    templates = ", ".join(f"({_q(k)}, {_list(paragraphs)}, {_list(fill)})" for k, (paragraphs, fill) in TEMPLATES.items())
    count = lambda parts: _words(f"trim(regexp_replace(array_to_string({parts}, ' '), {_q(T.BLANKS)}, ' ', 'g'))")
    more = "['[PLACEHOLDER: figures, dates and commitments for this call]']"
    return f"""WITH {_found_queries(rules.GRANT)}, tp(question_type, paragraphs, fill) AS (VALUES {templates}),
tg AS (SELECT *, CASE WHEN coverage >= {EVIDENCED_AT} THEN 'EVIDENCED' ELSE 'GENERATED' END AS source_tag, {_question_type()} AS question_type, coalesce(nullif({topic}, ''), 'this area') AS topic, {limit} AS word_limit,
  {_has('text', rules.NEEDS_SPECIFICS)} AS specific, CASE WHEN length(text) > 100 THEN rtrim(left(text, 99)) || '...' ELSE text END AS question FROM cov),
ex AS (SELECT r.key, row_number() OVER (PARTITION BY r.key ORDER BY r.rank) AS place, c.text AS held, qs.tokens FROM rk r JOIN ct c USING (chunk_ix) JOIN qs ON qs.key = r.key
  WHERE r.rank = 1 OR len(list_intersect(list_distinct(c.tokens), list_distinct(qs.tokens))) >= 2),
sp AS (SELECT key, place, tokens, string_split(regexp_replace(held, '([.!?]){T.BLANKS[:-1]}+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM ex),
sn AS (SELECT key, place, tokens, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS nth FROM sp),
sc AS (SELECT key, place, s, nth, len(list_distinct(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(tokens, w)))) AS n FROM sn),
sb AS (SELECT *, row_number() OVER (PARTITION BY key, place ORDER BY n DESC, nth) AS k FROM sc WHERE n >= 2),
pa AS (SELECT key, place, string_agg(trim(s), ' ' ORDER BY k) AS para FROM sb WHERE k <= 4 GROUP BY 1, 2),
qo AS (SELECT key, list_prepend('Earlier work on file answers this as follows.', coalesce(list(para ORDER BY place) FILTER (WHERE para <> ''), [])) AS own FROM (SELECT DISTINCT key, place FROM ex) LEFT JOIN pa USING (key, place) GROUP BY key),
al AS (SELECT tg.*, qo.own, tp.fill, list_transform(tp.paragraphs, lambda p: replace(replace(p, '{{topic}}', tg.topic), '{{question}}', tg.question)) AS filled, source_tag = 'EVIDENCED' AND qo.own IS NOT NULL AS evidenced
  FROM tg JOIN tp USING (question_type) LEFT JOIN qo ON qo.key = tg.key),
an AS (SELECT *, CASE WHEN {count('own')} > word_limit THEN own[1:3] ELSE own END AS capped, CASE WHEN question_type <> 'budget' AND {count('filled')} < word_limit * 0.5 THEN list_append(filled, '[PLACEHOLDER: expand to about ' || word_limit || ' words]') ELSE filled END AS template FROM al)
SELECT doc_id, id, source_tag, question_type,
  array_to_string(CASE WHEN evidenced THEN CASE WHEN specific THEN list_concat(capped, {more}) ELSE capped END ELSE template END, chr(10) || chr(10)) AS answer,
  coalesce(array_to_string(CASE WHEN evidenced THEN CASE WHEN specific THEN {more} ELSE [] END ELSE fill END, '; '), '') AS placeholders,
  CASE WHEN evidenced THEN 'From past material; check and adapt.' ELSE 'A template; fill in every placeholder.' END AS note FROM an"""


def _rows(columns: str, rows: list[tuple]) -> str:
    """Literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else _q(v) for v in r) + ')' for r in rows)}) AS t({columns})"


def oracle_sql() -> dict[str, str]:
    t, g = rules.TENDER, rules.GRANT
    limit = lambda p: f"TRY_CAST(nullif(regexp_extract(line, {_q(p)}, 1), '') AS BIGINT)"
    topic_stop = ", ".join(_q(w) for w in T.NO_TOPIC)
    bare = f"regexp_replace(regexp_replace(text, {_q('(?i)' + chr(92) + '(max ' + chr(92) + 'd+ words.*?' + chr(92) + ')')}, '', 'g'), {_q('(?i)' + chr(92) + '(worth ' + chr(92) + 'd+ marks.*?' + chr(92) + ')')}, '', 'g')"
    topic = f"coalesce(array_to_string(list_filter(string_split(trim(regexp_replace(lower({bare}), {_q(T.BLANKS)}, ' ', 'g')), ' '), lambda w: NOT list_contains([{topic_stop}], w) AND length(w) > 2)[1:5], ' '), '')"
    heading = f"(line LIKE '#%' OR (({_words('line')}) <= 8 AND right(line, 1) NOT IN ('.', ';', ':', '?') AND regexp_matches(line, '^\\p{{Lu}}')))"
    return {
        "normalise_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l",
        "clause_ref_split": f"WITH {_LINES} SELECT doc_id, line_no, {_ref('line', t.ref)} AS ref, {_rest('line', t.ref)} AS text FROM l",
        "section_ref_split": f"WITH {_LINES} SELECT doc_id, line_no, {_ref('line', g.ref)} AS ref, {_rest('line', g.ref)} AS text FROM l",
        "classify_tender": f"WITH {_classified(t)} SELECT doc_id, line_no, kind FROM k WHERE kind IS NOT NULL",
        "classify_grant": f"WITH {_classified(g)} SELECT doc_id, line_no, kind FROM k WHERE kind IS NOT NULL",
        "extract_requirements": f"WITH {_extracted(t)} SELECT doc_id, id, text, ref, kind, binding, line_no FROM x",
        "extract_questions": f"""WITH {_extracted(g)} SELECT doc_id, id, text, ref, kind, {limit(T.WORD_LIMIT)} AS word_limit, {limit(T.PAGE_LIMIT)} AS page_limit, line_no,
  coalesce(nullif(regexp_extract(line, {_q(T.SCORE_WEIGHT)}, 0), ''), nullif(regexp_extract(line, {_q(T.SCORE_WEIGHT_AFTER)}, 0), ''), '') AS score_weight FROM x""",
        "extract_summary": f"WITH {_extracted(t)} SELECT count(*) AS total, count(*) FILTER (WHERE binding) AS binding, count(*) FILTER (WHERE NOT binding) AS advisory, count(*) FILTER (WHERE kind = 'question') AS questions FROM x",
        "grant_summary": f"""WITH {_extracted(g)} SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'narrative') AS narrative, count(*) FILTER (WHERE kind = 'question') AS questions, count(*) FILTER (WHERE kind = 'checklist') AS checklist,
  count(*) FILTER (WHERE kind = 'budget') AS budget, count(*) FILTER (WHERE {limit(T.WORD_LIMIT)} > 0) AS with_word_limit,
  count(*) FILTER (WHERE regexp_extract(line, {_q(T.SCORE_WEIGHT)}, 0) <> '' OR regexp_extract(line, {_q(T.SCORE_WEIGHT_AFTER)}, 0) <> '') AS with_score_weight FROM x""",
        "dedupe_first": "SELECT tender_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS same, min(line_no)::BIGINT AS line_no FROM requirements WHERE text IS NOT NULL GROUP BY 1, 2",
        "tokenise": f"WITH {_ASKED} SELECT key, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token FROM qs",
        "heading_segments": f"""WITH {_LINES}, h AS (SELECT *, {heading} AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h),
b AS (SELECT doc_id, section::BIGINT AS section, coalesce(max(trim(regexp_replace(line, '^[# ]+', ''))) FILTER (WHERE head), '') AS heading, coalesce(trim(string_agg(line, ' ' ORDER BY line_no) FILTER (WHERE NOT head)), '') AS text FROM s GROUP BY 1, 2)
SELECT * FROM b WHERE length(text) >= 40""",
        "postings_tf": f"WITH {_CHUNKS} SELECT term, chunk_ix, tf FROM po",
        "term_stats_idf": f"WITH {_CHUNKS} SELECT term, df, round(idf, 6) AS idf FROM ts",
        "corpus_stats": f"WITH {_CHUNKS} SELECT n, round(avg_len, 6) AS avg_len, round(unseen_idf, 6) AS unseen_idf FROM un",
        "top3_evidence": f"WITH {_ASKED}, {_CHUNKS}, {_SCORED} SELECT key, chunk_ix, rank, round(score, 6) AS score FROM rk",
        "coverage": f"WITH {_ASSESSED} SELECT key, round(coverage, 6) AS coverage, round(relevance, 6) AS relevance, evidence, verdict, critical, citation FROM v",
        "tally": f"WITH {_ASSESSED} SELECT count(*) FILTER (WHERE verdict = 'ANSWERED') AS answered, count(*) FILTER (WHERE verdict = 'WEAK') AS weak, count(*) FILTER (WHERE verdict = 'GAP') AS gap, count(*) FILTER (WHERE critical) AS critical FROM v",
        "coverage_matrix": f"WITH {_ASSESSED} SELECT tender_id, id, ref, CASE WHEN binding THEN 'BINDING' ELSE 'ADVISORY' END AS obligation, verdict, critical, round(coverage, 6) AS coverage, text, citation, line_no::BIGINT AS line_no FROM v",
        "documents_coverage": f"WITH {_found_queries(t)} SELECT doc_id, id, ref, kind, binding, round(coverage, 6) AS coverage, {_VERDICT} AS verdict, {_VERDICT} = 'GAP' AND binding AS critical, evidence, line_no FROM cov",
        "grant_source_tags": f"WITH {_found_queries(g)} SELECT doc_id, id, kind, round(coverage, 6) AS coverage, CASE WHEN coverage >= {EVIDENCED_AT} THEN 'EVIDENCED' ELSE 'GENERATED' END AS source_tag FROM cov",
        "draftable": f"WITH {_ASSESSED} SELECT key, verdict, evidence FROM v WHERE verdict IN ('ANSWERED', 'WEAK') AND evidence IS NOT NULL",
        "draft_batches": f"WITH {_ASKED} SELECT tender_id, id, (row_number() OVER (PARTITION BY tender_id ORDER BY line_no, id) - 1) // 5 AS batch FROM qs",
        "draft_parse_left_join": f"""WITH {_ASKED}, d AS (SELECT DISTINCT ON (draft_id) * FROM tender_drafts WHERE draft_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY tender_id, requirement_id ORDER BY draft_id DESC) AS k FROM d)
SELECT q.tender_id, q.id AS requirement_id, {_strip("coalesce(n.answer, '')")} AS answer, coalesce(n.evidence_sufficient, false) AS evidence_sufficient,
  CASE WHEN n.draft_id IS NULL THEN 'The response holds no draft for this requirement.' ELSE {_strip("coalesce(n.note, '')")} END AS note
FROM qs q LEFT JOIN n ON n.tender_id = q.tender_id AND n.requirement_id = q.id AND n.k = 1""",
        "drafts_on_gaps": f"""WITH {_ASSESSED}, d AS (SELECT DISTINCT ON (draft_id) * FROM tender_drafts WHERE draft_id IS NOT NULL)
SELECT v.verdict, coalesce(d.evidence_sufficient, false) AS sufficient, count(*) AS drafts FROM d JOIN v ON v.tender_id = d.tender_id AND v.id = d.requirement_id GROUP BY 1, 2""",
        "question_type": f"WITH {_extracted(g)} SELECT doc_id, id, {_question_type()} AS question_type, {_has('text', rules.NEEDS_SPECIFICS)} AS needs_specifics FROM x",
        "topic_phrase": f"WITH {_extracted(g)} SELECT doc_id, id, {topic} AS topic FROM x",
        "local_drafts": _local_drafts(topic, limit(T.WORD_LIMIT)),
        # letters, the blanks of Unicode one by one, and eight signs
        "garble_gate": r"""WITH h AS (SELECT doc_id, left(text, 4000) AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^\p{L}\t\n\v\f\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,;:()/-]', '', 'g')) AS k FROM h)
SELECT doc_id, n < 40 OR k / nullif(n, 0) < 0.75 AS garbled, round(k / nullif(n, 0), 6) AS readable FROM c""",
        "key_sentences": f"""WITH {_ASSESSED}, s AS (SELECT v.key, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS nth, tokens FROM (
  SELECT v.key, v.tokens, string_split(regexp_replace(c.text, '([.!?]){T.BLANKS[:-1]}+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM v JOIN ct c ON c.chunk_ix = v.evidence) AS v),
n AS (SELECT key, nth, s, len(list_distinct(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(tokens, w)))) AS n FROM s),
r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY n DESC, nth) - 1 AS place, trim(s) AS sentence FROM n WHERE n >= 2)
SELECT * FROM r WHERE place < 4""",
        "prompt_preview": f"""WITH {_ASSESSED}, d AS (SELECT *, (row_number() OVER (PARTITION BY tender_id ORDER BY line_no, id) - 1) // 5 AS batch FROM v WHERE verdict IN ('ANSWERED', 'WEAK') AND evidence IS NOT NULL),
e AS (SELECT d.tender_id, d.batch, d.key, d.line_no, d.id, d.ref, d.text, row_number() OVER (PARTITION BY d.key ORDER BY r.rank) AS place, {_CITE} AS citation, c.text AS held
  FROM d JOIN rk r ON r.key = d.key JOIN ct c ON c.chunk_ix = r.chunk_ix WHERE r.rank = 1 OR len(list_intersect(list_distinct(c.tokens), list_distinct(d.tokens))) >= 2),
b AS (SELECT tender_id, batch, line_no, id, '### ' || id || CASE WHEN coalesce(any_value(ref), '') <> '' THEN ' (clause ' || any_value(ref) || ')' ELSE '' END || chr(10) || 'Requirement: ' || any_value(text) || chr(10) || chr(10) || 'Extracts on file:' || chr(10) ||
  string_agg('[Extract ' || place || ' - ' || citation || ']' || chr(10) || held, chr(10) || chr(10) ORDER BY place) AS block FROM e GROUP BY tender_id, batch, line_no, id, key)
SELECT tender_id, batch, 'tender' AS kind, string_agg(id, ', ' ORDER BY line_no, id) AS ids, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY line_no, id) AS prompt FROM b GROUP BY 1, 2""",
        "citations": f"WITH {_CHUNKS} SELECT chunk_ix, {_CITE} AS citation FROM ct c",
        "reader_files": _rows("name, text, error_kind", [(n, *r) for n, r in fixtures.FILES_READ.items()]),
        "rules_at_edges": _rows("rule, input, result", fixtures.edges_expected()),
        "skipped_reasons": "SELECT lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS suffix, coalesce(reason, '(none)') AS reason, count(*) AS files FROM skipped WHERE name IS NOT NULL GROUP BY 1, 2",
        "report_slugs": """SELECT tender_id, CASE WHEN s = '' THEN 'report' ELSE s END AS slug, CASE WHEN length(e) > 40 THEN rtrim(left(e, 39)) || '…' ELSE e END AS cell FROM (
  SELECT tender_id, lower(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g')) AS s, replace(title, '|', '\\|') AS e FROM tenders WHERE title IS NOT NULL)""",
        "eval_metrics": f"""WITH {_ASSESSED}, lb AS (SELECT tender_id, ref, max(upper(label)) AS label FROM coverage_labels WHERE label IS NOT NULL GROUP BY 1, 2),
p AS (SELECT tender_id, ref, min(verdict) AS verdict FROM v GROUP BY 1, 2), b AS (SELECT lb.*, p.verdict FROM lb LEFT JOIN p ON p.tender_id = lb.tender_id AND p.ref = lb.ref)
SELECT count(*) FILTER (WHERE label = 'GAP' AND verdict IS NOT NULL) AS gaps, count(*) FILTER (WHERE label = 'GAP' AND verdict = 'GAP') AS gaps_found, count(*) FILTER (WHERE label = 'COVERED' AND verdict IS NOT NULL) AS covered,
  count(*) FILTER (WHERE label = 'COVERED' AND verdict <> 'GAP') AS covered_found, count(*) FILTER (WHERE label IN ('GAP', 'PARTIAL') AND verdict = 'ANSWERED') AS false_confidence,
  count(*) FILTER (WHERE label = 'COVERED' AND verdict = 'GAP') AS false_gaps, count(*) FILTER (WHERE verdict IS NULL) AS unmatched FROM b""",
    }
