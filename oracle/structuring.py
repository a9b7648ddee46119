"""SQL twins of the structuring, entity and scope queries."""

from oracle.common import DOCS, LINES, fold, word_set, words

MARKDOWN = """
md AS (SELECT conv_id * 1000 + turn AS doc_id,
  '# Conversation ' || conv_id || e'\\n\\n## ' || role || e'\\n\\n' || text || e'\\n\\n#### Turn ' || turn || e'\\n\\nSummary of turn\\n-------\\n\\nNotes:\\n\\n- role '
  || role || e'\\n- turn ' || turn || e'\\n\\n```\\n# not a heading\\n\\ncode\\n```\\n\\n1. First part\\nclosing text\\n\\n| ignored\\n---\\n\\nlast line' AS text
  FROM conversations)"""

VETO = r"(?i)[。；;!?！？]|(?:RMB\s*\d|\d\s*(?:V\b|kg\b|g\b|元|天|小时))|[:：]\s*\d"
NUMBERED = r"^((?:[IVX]{1,6}|[A-Z]|\d{1,2}(?:\.\d{1,2})*)[.、)]|第[一二三四五六七八九十\d]+章)\s+(.{2,160})\s*$"
ATX = r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
UNDER = r"^\s*(?:={3,}|-{3,})\s*$"
STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"

MARKED = MARKDOWN + f""",
raw AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md), unnest(range(1, len(l) + 1)) AS t(i)),
off AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  regexp_matches(line, '^\\s*(?:```|~~~)') AS fence, {STRIP % 'line'} AS s, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM raw),
fen AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM off),
cou AS (SELECT *, NOT fenced AND s <> '' AND length(s) <= 160 AND NOT fence AND NOT contains(line, '|') AND coalesce(regexp_matches(nxt, '{UNDER}'), false) AS could FROM fen),
sets AS (SELECT *, could AND (line_no - coalesce(max(CASE WHEN NOT could THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1) % 2 = 0 AS setext FROM cou),
und AS (SELECT *, coalesce(lag(setext) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS underline FROM sets),
kin AS (SELECT *, NOT fenced AND NOT underline AND NOT setext AND regexp_matches(line, '{ATX}') AS atx FROM und),
num AS (SELECT *, NOT fenced AND NOT underline AND NOT setext AND NOT atx AND regexp_matches(line, '{NUMBERED}')
  AND NOT regexp_matches(regexp_extract(line, '{NUMBERED}', 2), '{VETO}') AS numbered FROM kin),
marked AS (SELECT *, CASE WHEN setext THEN CASE WHEN contains(nxt, '=') THEN 1 ELSE 2 END WHEN atx THEN length(regexp_extract(line, '{ATX}', 1))
  WHEN numbered THEN CASE WHEN regexp_matches(line, '^(?:[IVX]|第)') THEN 1 ELSE 1 + length(regexp_extract(line, '{NUMBERED}', 1)) - length(replace(regexp_extract(line, '{NUMBERED}', 1), '.', '')) END END AS depth,
  CASE WHEN atx THEN regexp_extract(line, '{ATX}', 2) WHEN setext OR numbered THEN s END AS title FROM num)"""

LEVELS = MARKED + """,
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM marked WHERE depth IS NOT NULL),
lev AS (SELECT *, t + least(0, min(depth - t) OVER (PARTITION BY doc_id ORDER BY line_no)) AS level FROM h),
paths AS (SELECT a.doc_id, a.line_no, a.depth, a.level, string_agg(b.title, ' / ' ORDER BY b.line_no) AS path
  FROM lev a JOIN lev b ON a.doc_id = b.doc_id AND b.line_no <= a.line_no
  WHERE NOT EXISTS (SELECT 1 FROM lev c WHERE c.doc_id = a.doc_id AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level)
  GROUP BY ALL)"""

BLOCKS = LEVELS + f""",
p1 AS (SELECT *, depth IS NOT NULL OR underline AS head, s = '' AND NOT fenced AS blank FROM marked),
p2 AS (SELECT *, last_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER b AS prev_s, last_value(CASE WHEN s <> '' THEN head END IGNORE NULLS) OVER b AS prev_head,
  first_value(CASE WHEN s <> '' THEN line END IGNORE NULLS) OVER a AS next_line FROM p1
  WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p3 AS (SELECT *, head OR (blank AND NOT (coalesce(NOT prev_head AND regexp_matches(prev_s, '[:：]$'), false) AND coalesce(regexp_matches(next_line, '^\\s*(?:[-*+]\\s|\\d+[.)]\\s)'), false))) AS breaks FROM p2),
p4 AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM p3),
p5 AS (SELECT p4.*, (SELECT arg_max(path, q.line_no) FROM paths q WHERE q.doc_id = p4.doc_id AND q.line_no <= p4.line_no) AS path FROM p4),
b1 AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY line_no) AS raw, min(start) AS raw_start, arg_min(path, line_no) AS path FROM p5 WHERE NOT breaks GROUP BY ALL),
b2 AS (SELECT *, {STRIP % 'raw'} AS text FROM b1),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS block_no, raw_start + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start,
  text, coalesce(path, '') AS path FROM b2 WHERE text <> '')"""

PIPES = """
pl AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) AS l FROM documents WHERE contains(text, '|')),
prow AS (SELECT doc_id, i AS row_index, l[i] AS row_text FROM pl, unnest(range(1, len(l) + 1)) AS t(i))"""

CATALOG = """
bw AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
bp AS (SELECT w[i] AS word, w[i + 1] AS nxt FROM bw, unnest(range(1, len(w) + 1)) AS t(i) WHERE length(w[i]) >= 8),
cat AS (SELECT word AS entity_id, word AS surface FROM bp UNION SELECT word, word || ' ' || nxt FROM bp WHERE nxt IS NOT NULL)"""

MENTIONS = LINES + "," + CATALOG + """,
ft AS (SELECT chunk_id, source_text, unnest(list_distinct(regexp_extract_all(lower(source_text), '[\\p{L}\\p{N}_]+'))) AS token FROM chunks),
cand AS (SELECT chunk_id, lower(source_text) AS body, entity_id, surface FROM ft JOIN cat ON token = string_split(surface, ' ')[1] WHERE contains(lower(source_text), surface)),
pos AS (SELECT chunk_id, entity_id, surface, body, p FROM cand, unnest(range(1, length(body) - length(surface) + 2)) AS t(p) WHERE substr(body, p, length(surface)) = surface),
found AS (SELECT DISTINCT chunk_id, entity_id, p - 1 AS start, p - 1 + length(surface) AS "end" FROM pos
  WHERE (p = 1 OR NOT regexp_matches(substr(body, p - 1, 1), '[\\p{L}\\p{N}_-]')) AND NOT regexp_matches(substr(body, p + length(surface), 1), '[\\p{L}\\p{N}_-]'))"""

PART_TEXT = """
pt AS (SELECT p.p_partkey AS chunk_id, p.p_name, p.p_type, CASE p.p_type
  WHEN 'ECONOMY' THEN p.p_name || ' weight ' || p.p_size || ' kg.' WHEN 'STANDARD' THEN 'Note: the ' || p.p_name || ' ships with care.'
  WHEN 'PROMO' THEN p.p_name || ' compared with ' || coalesce(n.p_name, 'others') || ' costs ' || CAST(trunc(p.p_retailprice) AS INT)
  WHEN 'MEDIUM' THEN 'This kit contains ' || p.p_name || ' and ' || coalesce(n.p_name, 'more') ELSE 'Disclaimer for size ' || p.p_size END AS body
  FROM part p LEFT JOIN part n ON n.p_partkey = p.p_partkey + 1),
names AS (SELECT DISTINCT p_name AS name FROM part),
pm AS (SELECT chunk_id, body, list(name ORDER BY name) AS m, list(name ORDER BY name) FILTER (starts_with(body, name) AND regexp_matches(substr(body, length(name) + 1, 60), '(?i)\\b(?:voltage|weight|price|shelf life|storage|capacity|power|dimensions?|rated|ingredients?|allergens?|delivery)\\b')) AS ex
  FROM pt LEFT JOIN names ON contains(' ' || replace(replace(body, '.', ' '), ':', ' ') || ' ', ' ' || name || ' ') GROUP BY ALL)"""

ORACLES = {
    "quality_gate": """SELECT doc_id, code IS NULL AS ok, code AS error_code FROM (SELECT doc_id, CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 'empty_content'
  WHEN (length(text) - length(replace(text, '�', ''))) / greatest(length(text), 1) > 0.01 THEN 'replacement_character_ratio_high' END AS code FROM documents)""",
    "detect_markup": f"""WITH {MARKDOWN}, t AS (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'page', html FROM pages UNION ALL SELECT 'turn', text FROM md)
SELECT kind, len(regexp_extract_all(text, '(?m)^ {{0,3}}#{{1,6}}\\s+\\S')) >= 2 OR regexp_matches(text, '(?m)^#{{1,6}}\\s+.+\\n\\s*\\n') OR regexp_matches(text, '(?m)^[^\\n|]{{1,160}}\\n(?:={{3,}}|-{{3,}})\\s*$') AS markdown,
  count(*) AS texts FROM t GROUP BY ALL""",
    "headings": f"""WITH {MARKED} SELECT doc_id, line_no, depth, title, start + instr(line, title) - 1 AS start, start + instr(line, title) - 1 + length(title) AS "end" FROM marked WHERE depth IS NOT NULL""",
    "heading_limit": f"WITH {LEVELS} SELECT doc_id, line_no, 'heading_depth_limit' AS code FROM paths WHERE level > 1",
    "title_path": f"WITH {LEVELS} SELECT doc_id, line_no, depth, level, path FROM paths",
    "blocks": f"""WITH {BLOCKS} SELECT doc_id, block_no, start, start + length(text) AS "end", md5(text) AS digest, path,
  CASE WHEN regexp_matches(text, '^\\s*(?:```|~~~)') THEN 'code' WHEN regexp_matches(text, '^\\s*\\[\\^[^\\]]+\\]:') THEN 'footnote'
       WHEN regexp_matches(text, '^\\s*(?:[·•*+\\-]\\s|\\d+[.)]\\s)') THEN 'list' ELSE 'paragraph' END AS kind FROM blocks""",
    "fact_limit": f"WITH {LINES} SELECT kb_id AS version_id, count(*) AS facts FROM chunks GROUP BY 1 HAVING count(*) > 400",
    "pipe_table_cells": f"""WITH {PIPES}, c AS (SELECT doc_id, row_index, regexp_extract_all(row_text, '(?:\\\\.|[^|])+') AS a FROM prow)
SELECT doc_id, row_index, i - 1 AS column_index, CASE WHEN i = 1 THEN 'table_row_label' ELSE 'table_cell' END AS label, a[i] AS text
FROM c, unnest(range(1, len(a) + 1)) AS t(i) WHERE {STRIP % 'a[i]'} <> ''""",
    "product_columns": """WITH p AS (SELECT p_type, p_size, p_brand, CAST(trunc(max(p_retailprice)) AS INT) AS price FROM part GROUP BY ALL),
s AS (SELECT p_type, min(p_brand) AS a, max(p_brand) AS b FROM p GROUP BY 1),
r AS (SELECT p_type, a, b, p_size, max(price) FILTER (p_brand = a) AS pa, max(price) FILTER (p_brand = b) AS pb FROM s JOIN p USING (p_type) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size) AS row_index FROM r)
SELECT p_type, row_index, a AS entity_id, a || ' | size ' || p_size || ' | ' || pa AS text FROM n WHERE pa IS NOT NULL AND pb IS NOT NULL
UNION ALL SELECT p_type, row_index, b, b || ' | size ' || p_size || ' | ' || pb FROM n WHERE pa IS NOT NULL AND pb IS NOT NULL
UNION ALL SELECT p_type, row_index, '', 'table_alignment_missing' FROM n WHERE pa IS NULL OR pb IS NULL""",
    "list_clause_split": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents)
SELECT doc_id, len(a) AS facts, sum(length(x))::BIGINT + 3 * len(a) - 1 AS chars FROM l, unnest(a) AS t(x) GROUP BY doc_id, a""",
    "sections": f"""WITH {BLOCKS},
c AS (SELECT doc_id, block_no - 1 AS ordinal, text, CASE WHEN path = '' THEN [] ELSE string_split(path, ' / ') END AS p FROM blocks),
l AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY ordinal), []) AS q FROM c),
m AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(p), len(q)) + 1), lambda k: p[1:k] = q[1:k])), 0) AS common FROM l),
lv AS (SELECT doc_id, ordinal, p, common, k AS level FROM m, unnest(range(1, len(p) + 1)) AS t(k)),
own AS (SELECT *, max(CASE WHEN common < level THEN ordinal END) OVER (PARTITION BY doc_id, level ORDER BY ordinal) AS opened FROM lv),
deep AS (SELECT doc_id, ordinal, arg_max(opened, level) AS opened, max(level) AS level FROM own GROUP BY ALL),
txt AS (SELECT c.doc_id, coalesce(d.opened, -1) AS opened, coalesce(d.level, 0) AS level, sum(length(text)) + 2 * (count(*) - 1) AS chars FROM c LEFT JOIN deep d USING (doc_id, ordinal) GROUP BY ALL),
secs AS (SELECT doc_id, opened, level, p[1:level] AS path FROM own WHERE opened = ordinal UNION ALL SELECT DISTINCT doc_id, -1, 0, [] FROM c)
SELECT '00000000-0000-5000-8000-' || lpad(doc_id::VARCHAR, 12, '0') AS version_id, row_number() OVER (PARTITION BY doc_id ORDER BY opened, level) - 1 AS ordinal, level,
  array_to_string(path, ' / ') AS path, coalesce(chars, 0)::BIGINT AS chars, level = 0 AS is_root FROM secs LEFT JOIN txt USING (doc_id, opened, level)""",
    "entity_mentions": f'WITH {MENTIONS} SELECT chunk_id, entity_id, start, "end" FROM found',
    "classify_facts": f"""WITH {PART_TEXT},
k AS (SELECT *, list_filter(m, lambda x: x IS NOT NULL) AS mm, coalesce(ex, []) AS ee,
  regexp_matches(body, '(?i)\\b(?:bundle|kit)\\b') AS bw, regexp_matches(body, '(?i)\\bcontains?\\b') AS bc, regexp_matches(body, '(?i)\\b(?:versus|compared|unlike|whereas|than)\\b') AS cw,
  regexp_matches(body, '(?i)\\b(?:voltage|weight|price|shelf life|storage|capacity|power|dimensions?|rated|ingredients?|allergens?|delivery)\\b') AS pw FROM pm),
f AS (SELECT *, len(mm) AS n, CASE WHEN bw AND (len(mm) > 1 OR bc) THEN 'bundle' WHEN len(mm) > 1 AND cw THEN 'comparison' WHEN pw THEN 'specification' ELSE 'statement' END AS kind,
  list_filter(mm, lambda x: ends_with(x, 'ring')) AS rings FROM k),
g AS (SELECT *, kind = 'bundle' AS b, kind = 'bundle' AND len(rings) = 1 AS ob, len(ee) = 1 AND n = 1 AND kind <> 'bundle' AS single FROM f),
r AS (SELECT *, CASE WHEN ob THEN 'resolved' WHEN b THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN single THEN 'resolved' ELSE 'unknown' END AS st,
  CASE WHEN ob THEN rings WHEN b THEN [] WHEN n > 1 THEN mm[1:8] WHEN single THEN ee ELSE [] END AS own FROM g),
z AS (SELECT *, n > 0 AND len(ee) = 0 AND st = 'resolved' AND NOT list_has_all(own, mm) AS foreign_owner, n = 0 AND st = 'unknown' AND regexp_matches(body, '(?i)^(?:note\\b|disclaimer\\b|glossary\\b)') AND (NOT b OR NOT ob) AS general FROM r)
SELECT chunk_id, CASE WHEN general THEN 'general' ELSE kind END AS fact_kind, st AS scope_status, array_to_string(own, ',') AS subjects,
  CASE WHEN st = 'ambiguous' OR foreign_owner THEN 'pending' WHEN general OR ob OR (single AND n = 1) THEN 'rule_confirmed' ELSE 'pending' END AS review_state,
  CASE WHEN general THEN 'explicit_general_section' WHEN foreign_owner THEN 'scope_conflict' WHEN ob THEN 'bundle_identity' WHEN b THEN 'bundle_identity_missing' WHEN n > 1 THEN 'mixed_subjects'
       WHEN single THEN 'explicit_subject_attribute' END AS review_reason FROM z""",
    "resolve_scope": """WITH p AS (SELECT DISTINCT source, lang FROM documents),
d AS (SELECT doc_id, source, lang, length(string_split(text, chr(10))[1]) < 60 AS short FROM documents),
x AS (SELECT d.*, d.lang IN ('en', 'de') AS bound, EXISTS (SELECT 1 FROM p WHERE p.source = d.source AND p.lang = 'en' AND p.source < 'src15') AS has_default FROM d),
y AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN bound THEN lang END, CASE WHEN short THEN lang END, CASE WHEN has_default THEN 'en' END], lambda v: v IS NOT NULL))) AS s,
  CASE WHEN bound OR short THEN CASE WHEN has_default AND lang <> 'en' THEN [lang, 'en'] ELSE [lang] END WHEN has_default THEN ['en'] ELSE [] END AS o FROM x)
SELECT doc_id AS chunk_id, CASE WHEN len(s) = 0 THEN 'unknown' WHEN len(s) > 1 THEN 'ambiguous' ELSE 'resolved' END AS scope_status, array_to_string(o, ',') AS subjects,
  CASE WHEN bound THEN 'bound' ELSE '' END AS conditions, CASE WHEN len(s) = 0 THEN 'no_reviewed_match' WHEN len(s) > 1 THEN 'scope_conflict' ELSE '' END AS reasons FROM y""",
    "scope_filter": "SELECT source AS kb_id, count(*) AS chunks FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1",
    "scope_compatible_pairs": f"WITH {LINES} SELECT a.chunk_id AS hit_id, count(*) AS candidates FROM chunks a JOIN chunks b USING (document_id) WHERE a.ordinal = 0 GROUP BY 1",
    "reference_binding": """WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS chunk_id FROM conversations)
SELECT a.chunk_id, coalesce(b.chunk_id::VARCHAR, '') AS target, CASE WHEN b.chunk_id IS NULL THEN 'unmatched_reference' ELSE 'condition' END AS role
FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""",
    "link_validation": f"""WITH {LINES}, first AS (SELECT document_id FROM chunks WHERE ordinal = 0), third AS (SELECT document_id FROM chunks WHERE ordinal = 3),
v AS (SELECT chunk_id, 'context_self_link' AS code FROM chunks WHERE ordinal = 1
  UNION SELECT chunk_id, 'context_target_missing' FROM chunks WHERE ordinal = 2 AND document_id NOT IN (SELECT document_id FROM third)
  UNION SELECT chunk_id, 'context_target_missing' FROM chunks WHERE ordinal = 3 AND document_id NOT IN (SELECT document_id FROM chunks WHERE ordinal = 2)
  UNION SELECT chunk_id, 'context_target_missing' FROM chunks WHERE ordinal > 0 AND document_id NOT IN (SELECT document_id FROM first)
  UNION SELECT a.chunk_id, 'context_reference_cycle' FROM chunks a JOIN chunks b USING (document_id) WHERE (a.ordinal = 2 AND b.ordinal = 3) OR (a.ordinal = 3 AND b.ordinal = 2))
SELECT code, count(*) AS n FROM v GROUP BY 1""",
    "continuation_star": f"""WITH {LINES}, o AS (SELECT document_id, min(chunk_id) AS target_id, count(*) AS n FROM chunks WHERE length(source_text) > 200 GROUP BY 1)
SELECT target_id, n - 1 AS pieces FROM o WHERE n >= 2""",
    "curated_dependencies": """WITH c AS (SELECT conv_id, max((turn = 1)::INT) AS has1, max((turn = 2)::INT) AS has2 FROM conversations GROUP BY 1)
SELECT conv_id AS binding_id, CASE WHEN has1 = 1 AND has2 = 1 THEN (conv_id * 1000 + 2)::VARCHAR ELSE 'dependency_selector_not_found' END AS result FROM c""",
    "ambiguous_aliases": f"""SELECT kb_id, name, count(DISTINCT e) AS entities FROM (SELECT p_type AS kb_id, p_partkey AS e, {fold('p_name')} AS name FROM part
  UNION ALL SELECT p_type, p_partkey, {fold('p_brand')} FROM part) GROUP BY ALL HAVING count(DISTINCT e) > 1""",
    "unmatched_bindings": """SELECT source || ':' || l AS binding_id FROM (SELECT DISTINCT source FROM documents), unnest(['en', 'fr', 'de', 'es', 'zh']) AS t(l)
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = source AND false) AND (source, l) NOT IN (SELECT (source, lang) FROM documents)""",
    "relocate_selectors": """WITH m AS (SELECT l_returnflag AS v, l_suppkey AS s, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE l_linenumber::VARCHAR END) AS n, min(l_linenumber) AS one FROM lineitem GROUP BY ALL)
SELECT v || ':' || s AS binding_id, CASE WHEN s % 2 = 0 THEN 'unit-' || s WHEN n = 1 THEN 'unit-' || s || '-' || one ELSE s::VARCHAR END AS source_unit_id, n > 1 AS requires_reprocess FROM m""",
    "identifier_terms": f"""WITH {DOCS} SELECT chunk_id AS doc_id, unnest(list_filter({word_set('source_text')}, lambda w:
  regexp_full_match(w, '(?:[a-z][a-z0-9]*(?:[-_./:][a-z0-9]+)+|[a-z]{{1,12}}[0-9]{{2,}})') AND regexp_matches(w, '[0-9]'))) AS identifier FROM chunks""",
}
