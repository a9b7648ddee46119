"""SQL twins of the tree, review, version and stream queries."""

from oracle.common import LINES
from oracle.structuring import BLOCKS, PIPES

CLOSE = """rf AS (SELECT d.doc_id AS chunk_id, source, lang, n_chars, text, CASE WHEN quality IS NULL THEN 'excluded' WHEN toxic = 1 THEN 'pending' ELSE 'rule_confirmed' END AS state
  FROM documents d LEFT JOIN labels USING (doc_id)),
bl AS (SELECT *, state <> 'excluded' AND (state = 'pending' OR n_chars > 20000 OR lang NOT IN ('en', 'fr') ) AS blocking FROM rf)"""

SEP = "chr(1)"
PIECE = "('0x' || substr(h, {0}, 15))::BIGINT::HUGEINT"


def digest(expr):
    sums = " || ':' || ".join(f"sum(('0x' || substr({expr}, {i}, 15))::BIGINT)::VARCHAR" for i in (1, 16, 31, 46))
    return f"sha256(count(*)::VARCHAR || ':' || {sums})"


def kind(*names):
    return "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in zip(("signup", "click", "view", "purchase"), names)) + f" ELSE '{names[4]}' END"


TREE = """
t AS (SELECT conv_id AS doc_id, 't' || turn AS node_key, CASE WHEN turn > 0 THEN 't' || (turn - 1) ELSE 'root' END AS parent_key, 'paragraph' AS kind, text FROM conversations),
n AS (SELECT DISTINCT conv_id AS doc_id, 'root' AS node_key, NULL AS parent_key, 'document' AS kind, '' AS text FROM conversations UNION ALL SELECT * FROM t)"""

VERSIONS = """v AS (SELECT o_custkey AS document_id, o_orderkey AS version_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'published' ELSE 'uploaded' END AS status FROM orders),
act AS (SELECT document_id, max(version_id) AS active_version_id FROM v WHERE status = 'published' GROUP BY 1)"""

ORACLES = {
    "document_nodes": f"""WITH {BLOCKS},
c AS (SELECT doc_id, block_no, text, CASE WHEN path = '' THEN [] ELSE string_split(path, ' / ') END AS p FROM blocks),
l AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY block_no), []) AS q FROM c),
m AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(p), len(q)) + 1), lambda k: p[1:k] = q[1:k])), 0) AS common FROM l),
lv AS (SELECT doc_id, block_no, common, k AS level FROM m, unnest(range(1, len(p) + 1)) AS t(k)),
own AS (SELECT *, max(CASE WHEN common < level THEN block_no END) OVER (PARTITION BY doc_id, level ORDER BY block_no) AS opened FROM lv),
par AS (SELECT doc_id, block_no, arg_max(opened, level) || ':' || max(level) AS parent FROM own GROUP BY ALL),
k AS (SELECT doc_id, block_no, CASE WHEN regexp_matches(text, '^\\s*(?:```|~~~)') THEN 'code' WHEN regexp_matches(text, '^\\s*(?:[·•*+\\-]\\s|\\d+[.)]\\s)') THEN 'list' ELSE 'paragraph' END AS kind FROM blocks),
sec AS (SELECT count(*) AS n FROM own WHERE opened = block_no), docs AS (SELECT count(DISTINCT doc_id) AS n FROM blocks), bs AS (SELECT count(*) AS n FROM blocks),
groups AS (SELECT count(*) AS n FROM (SELECT DISTINCT b.doc_id, coalesce(parent, 'root') FROM blocks b LEFT JOIN par USING (doc_id, block_no)))
SELECT 'node' AS item, kind, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'node', 'section', n FROM sec UNION ALL SELECT 'node', 'document', n FROM docs
UNION ALL SELECT 'edge', 'parent_of', (SELECT n FROM sec) + (SELECT n FROM bs) UNION ALL SELECT 'edge', 'next_in_structure', (SELECT n FROM bs) - (SELECT n FROM groups)""",
    "header_edges": f"""WITH {PIPES}, c AS (SELECT doc_id, row_index, regexp_extract_all(row_text, '(?:\\\\.|[^|])+') AS a FROM prow),
h AS (SELECT doc_id, a FROM c WHERE row_index = 1)
SELECT c.doc_id, i - 1 AS column_index, count(*) AS cells, max(trim(h.a[i])) AS header_text FROM c JOIN h USING (doc_id), unnest(range(1, len(c.a) + 1)) AS t(i)
WHERE i <= len(h.a) AND regexp_replace(c.a[i], '\\s+', '', 'g') <> '' GROUP BY ALL""",
    "list_nesting": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents),
x AS (SELECT doc_id, i - 1 AS item_no, 2 * least(3, length(a[i]) // 100) AS indent FROM l, unnest(range(1, len(a) + 1)) AS t(i))
SELECT a.doc_id, a.item_no, a.indent, (SELECT max(b.item_no) FROM x b WHERE b.doc_id = a.doc_id AND b.item_no < a.item_no AND b.indent < a.indent) AS parent_no FROM x a""",
    "footnotes": """WITH f AS (SELECT source, lang, count(*) AS n, min(doc_id::VARCHAR) AS k FROM documents WHERE n_chars > 5000 GROUP BY ALL)
SELECT d.source AS doc_id, d.doc_id::VARCHAR AS node_key, CASE WHEN n = 1 THEN k ELSE 'unresolved_footnote' END AS result FROM documents d LEFT JOIN f USING (source, lang) WHERE n_chars <= 5000""",
    "graph_check": """WITH s AS (SELECT count(*) AS n FROM conversations WHERE role = 'system'), z AS (SELECT count(*) AS n FROM conversations WHERE turn = 0)
SELECT 'invalid_document_tree_parent_or_duplicate' AS code, n FROM s WHERE n > 0 UNION ALL SELECT 'document_edge_endpoint_invalid', n FROM z""",
    "graph_digest": f"""WITH {TREE}, h AS (
  SELECT doc_id, sha256('n' || {SEP} || node_key || {SEP} || coalesce(parent_key, chr(2)) || {SEP} || kind || {SEP} || text) AS h FROM n
  UNION ALL SELECT doc_id, sha256('e' || {SEP} || parent_key || {SEP} || node_key || {SEP} || 'parent_of') FROM t)
SELECT doc_id, {digest('h')} AS digest FROM h GROUP BY 1""",
    "required_closure": """WITH s AS (SELECT conv_id, max((role = 'system')::INT) = 1 AS loop FROM conversations GROUP BY 1),
m AS (SELECT c.conv_id AS doc_id, turn AS main, loop FROM conversations c JOIN s USING (conv_id) WHERE turn > 0 OR loop)
SELECT doc_id, main, CASE WHEN main = 0 THEN '1' ELSE array_to_string(range(greatest(0, main - 3), main), ',') END AS nodes,
  CASE WHEN loop AND main <= 3 THEN 'dependency_cycle' WHEN main > 3 THEN 'dependency_closure_limit' END AS issue FROM m""",
    "unit_binding": """WITH c AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id || ':t' || turn AS chunk_id, CASE WHEN length(text) > 150 THEN 't' || turn ELSE (
  SELECT CASE WHEN count(*) = 1 THEN min('t' || b.turn) END FROM c b WHERE b.conv_id = a.conv_id AND contains(b.text, a.text)) END AS node_key FROM c a""",
    "dependency_edges": """SELECT CASE a.turn WHEN 1 THEN 'exception_to' WHEN 2 THEN 'continuation_of' ELSE 'governed_by' END AS type, count(*) AS n
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 GROUP BY 1""",
    "chunk_rows": f"""WITH {LINES},
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1 AS pos, '000000000000500080' || lpad(document_id::VARCHAR, 14, '0') AS ns FROM chunks),
h AS (SELECT *, sha1(unhex(ns) || encode(pos::VARCHAR)) AS r, kb_id || chr(10) || lang || CASE WHEN lang = 'en' THEN chr(10) || lang || chr(10) || 'bound' ELSE '' END AS context FROM o)
SELECT document_id, pos AS ordinal, substr(r, 1, 8) || '-' || substr(r, 9, 4) || '-5' || substr(r, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(r, 17, 1))::INT + 1, 1) || substr(r, 18, 3) || '-' || substr(r, 21, 12) AS chunk_id,
  greatest(0, length(source_text) - (400 - length(context) - 1))::BIGINT AS search_cut, md5(context || chr(10) || substr(source_text, 1, 400 - length(context) - 1)) AS search_digest FROM h""",
    "publish_blockers": f"WITH {CLOSE} SELECT source AS version_id, chunk_id FROM bl WHERE blocking",
    "review_summary": f"""WITH {CLOSE}, r AS (SELECT *, CASE WHEN n_chars > 20000 THEN 'dependency_unresolved' ELSE 'scope_not_identified' END AS reason FROM bl)
SELECT source AS plan_id, count(*) AS total, count(*) FILTER (blocking) AS blocking, count(*) FILTER (lang = 'fr' AND state = 'rule_confirmed') AS confirmed_general, count(DISTINCT lang) AS sections,
  bool_or(state <> 'excluded') AND count(*) FILTER (blocking) = 0 AS publish_eligible,
  (SELECT string_agg(state || '=' || n, ',' ORDER BY state) FROM (SELECT state, count(*) AS n FROM r x WHERE x.source = r.source GROUP BY 1)) AS counts,
  (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM r x WHERE x.source = r.source AND blocking GROUP BY 1)) AS reason_counts
FROM r GROUP BY source""",
    "review_page": f"WITH {CLOSE} SELECT chunk_id, chunk_id AS ordinal FROM bl WHERE blocking ORDER BY 1 LIMIT 25 OFFSET 50",
    "processing_stats": """SELECT source AS version_id, 'total' AS measure, count(*) AS n FROM documents GROUP BY 1
UNION ALL SELECT source, 'unknown', count(*) FILTER (lang <> 'en') FROM documents GROUP BY 1
UNION ALL SELECT source, r, count(*) FROM documents, unnest(CASE WHEN lang = 'es' THEN ['structure_missing', 'no_reviewed_match'] WHEN lang <> 'en' THEN ['missing_binding'] ELSE [] END) AS t(r) GROUP BY ALL""",
    "review_options": """WITH f AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'specification' WHEN 'de' THEN 'bundle' WHEN 'es' THEN 'comparison' ELSE 'general' END AS k, coalesce(quality, 0) AS q,
  coalesce(quality, 0) + coalesce(toxic, 0) AS m, source = 'src1' AS dep, n_chars > 3000 AS sep,
  regexp_matches(text, '(?i)\\b(?:voltage|weight|price|shelf life|storage|capacity|power|dimensions?|rated|ingredients?|allergens?|delivery)\\b') AS prop,
  regexp_matches(text, '(?i)\\b(?:versus|compared|unlike|whereas|than)\\b') AS cmp, len(regexp_extract_all(text, '[^;；\\n]+(?:[;；]|\\n|$)')) AS pieces FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT *, k = 'bundle' AS b, k = 'comparison' OR (m > 1 AND cmp) AS c, m = 2 AS o, m = 0 AND k = 'general' AS pub FROM f),
h AS (SELECT *, NOT b AND NOT c AND NOT o AND NOT sep AS plain, regexp_matches(text, '(?s)^[^;；\\n]+$') AS one_piece, regexp_matches(text, '[;；]') AS semi FROM g),
a AS (SELECT *, CASE WHEN dep THEN 'dependency' WHEN b THEN 'bundle' WHEN c THEN 'comparison' WHEN o THEN 'catalog_collision' WHEN sep THEN 'separate_specifications' WHEN pub THEN 'general' WHEN m > 1 THEN 'shared_scope' ELSE 'product_scope' END AS category,
  CASE WHEN dep THEN 'dependency' WHEN b OR (o AND NOT c) THEN 'assign' WHEN c THEN 'comparison' WHEN sep THEN 'split' WHEN pub THEN 'general' WHEN m > 1 THEN 'shared' ELSE 'assign' END AS advice,
  list_filter(['exclude', 'defer', 'reset', CASE WHEN NOT b AND NOT (m > 0 AND prop) THEN 'general' END, CASE WHEN b OR (NOT c AND o) OR (plain AND m <= 1) THEN 'assign' END,
    CASE WHEN c AND NOT b THEN 'comparison' END, CASE WHEN (NOT b AND NOT c AND o) OR plain THEN 'shared' END, CASE WHEN false THEN 'split' END, CASE WHEN dep OR q = 1 THEN 'dependency' END], lambda x: x IS NOT NULL) AS actions FROM h)
SELECT doc_id AS chunk_id, category, array_to_string(actions, ',') AS actions, CASE WHEN list_contains(actions, advice) THEN advice ELSE 'defer' END AS recommended_action FROM a""",
    "decision_replay": """SELECT DISTINCT user_id AS plan_id, user_id || ':' || event_type AS fact_id,
  CASE event_type WHEN 'signup' THEN 'excluded' WHEN 'click' THEN 'deferred' WHEN 'view' THEN 'human_confirmed' ELSE 'pending' END AS result, CASE event_type WHEN 'view' THEN 'general' ELSE 'statement' END AS detail FROM events
UNION ALL SELECT user_id, 'rejects', 'review_requires_product_choice', count(*)::VARCHAR FROM events WHERE event_type = 'error' GROUP BY 1""",
    "dependency_candidates": """WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id FROM conversations)
SELECT a.id AS chunk_id, b.id AS target_id FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.id <> b.id WHERE a.turn > 0
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.turn, b.id) <= 5""",
    "frozen_selection": f"WITH {CLOSE}, h AS (SELECT source, sha256(chunk_id::VARCHAR) AS h FROM rf WHERE state = 'pending') SELECT source AS plan_id, count(*) AS total, {digest('h')} AS digest FROM h GROUP BY 1",
    "document_summary": f"""WITH {VERSIONS}, l AS (SELECT document_id, count(*) AS n, arg_max(version_id, (created_at, version_id)) AS latest, arg_max(status, (created_at, version_id)) AS st FROM v GROUP BY 1)
SELECT c_custkey AS document_id, coalesce(n, 0) AS version_count, latest AS latest_version_id, st AS latest_status, active_version_id FROM customer LEFT JOIN l ON l.document_id = c_custkey LEFT JOIN act ON act.document_id = c_custkey""",
    "publish_pointer": f"""WITH {VERSIONS}, f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS kept, count(*) FILTER (l_quantity > 45) AS b, bool_or(l_discount = 0.1) AS dr FROM lineitem GROUP BY 1),
g AS (SELECT v.*, CASE WHEN status = 'uploaded' THEN 'version_not_ready' WHEN status = 'ready' AND coalesce(dr, false) THEN 'review_changes_not_applied' WHEN coalesce(n, 0) = 0 OR b > 0 OR kept = 0 THEN 'review_required_before_publish' END AS code
  FROM v LEFT JOIN f ON l_orderkey = version_id)
SELECT document_id, arg_max(version_id, (created_at, version_id))::VARCHAR AS result FROM g WHERE code IS NULL GROUP BY 1
UNION ALL SELECT -1, code || ':' || count(*) FROM g WHERE code IS NOT NULL GROUP BY code""",
    "idempotent_ingest": """WITH r AS (SELECT *, year(o_orderdate) AS p, row_number() OVER w AS n, first_value(year(o_orderdate)) OVER w AS fp FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey)),
e AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM r WHERE n = 1 AND o_orderstatus <> 'P' GROUP BY ALL)
SELECT o_orderkey AS request_id, CASE WHEN n > 1 AND p = fp THEN 'replay' WHEN n > 1 THEN 'idempotency_key_payload_mismatch' WHEN o_orderstatus <> 'P' AND o_orderkey > k THEN 'duplicate_document_version' ELSE 'first' END AS outcome
FROM r LEFT JOIN e USING (o_custkey, o_orderpriority)""",
    "access_filter": """SELECT c_custkey AS request_id, c_acctbal < 9000 AND (c_mktsegment = 'MACHINERY' OR ((c_acctbal > 0 AND n_regionkey <> 0 OR n_regionkey = 0) AND (c_acctbal > 5000 OR (n_regionkey = 0 AND c_acctbal > 0)))) AS allowed
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "visible_documents": f"""WITH {VERSIONS}, live AS (SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0), x AS (SELECT v.* FROM lineitem JOIN v ON l_orderkey = version_id JOIN live ON c_custkey = document_id)
SELECT document_id, count(*) AS n, 'visible' AS kind FROM x JOIN act USING (document_id) WHERE version_id = active_version_id GROUP BY 1 UNION ALL SELECT document_id, count(*), 'rebuild' FROM x WHERE status <> 'uploaded' GROUP BY 1""",
    "profile_inventory": "SELECT lang AS processing_profile, count(*) AS chunks FROM documents GROUP BY 1",
    "revision_check": """SELECT user_id AS kb_id, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 0::BIGINT END AS left_revision, count(*) FILTER (event_type = 'error') AS right_revision FROM events GROUP BY 1
HAVING count(*) FILTER (event_type = 'error') > 0 OR count(*) FILTER (event_type <> 'error') = 0""",
    "evidence_snapshot": """WITH r AS (SELECT DISTINCT l_orderkey AS request_id, l_partkey, l_suppkey FROM lineitem),
c AS (SELECT request_id, count(*) AS asked, count(*) FILTER (p_size < 48) AS chunks, count(DISTINCT p_brand) FILTER (p_size < 48) AS nodes,
  string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS chunk_list, string_agg(l_partkey || ':' || p_brand, ',' ORDER BY l_partkey) AS node_list FROM (SELECT DISTINCT request_id, l_partkey FROM r) JOIN part ON p_partkey = l_partkey GROUP BY 1),
e AS (SELECT request_id, count(*) AS asked, count(*) FILTER (s_acctbal > 0) AS entities, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS entity_list FROM (SELECT DISTINCT request_id, l_suppkey FROM r) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
f AS (SELECT *, CASE WHEN entities < e.asked THEN 'context_binding_not_found_in_authorized_scope' WHEN chunks < c.asked THEN 'evidence_snapshot_changed' END AS failure FROM c JOIN e USING (request_id))
SELECT request_id, chunks, entities, nodes, failure, CASE WHEN failure IS NULL THEN chunk_list END AS chunk_list, CASE WHEN failure IS NULL THEN node_list END AS node_list, CASE WHEN failure IS NULL THEN entity_list END AS entity_list,
  CASE WHEN failure IS NULL THEN 'tpch:' || (SELECT count(*) FROM lineitem) || ':1' END AS revisions FROM f""",
    "generation_state": f"""WITH e AS (SELECT user_id, event_id, {kind('queued', 'building', 'ready', 'active', 'failed')} AS ev FROM events),
g AS (SELECT user_id, arg_max(ev, event_id) AS ev, max(event_id) AS seq, count(*) FILTER (ev = 'building') AS attempts, max(event_id) FILTER (ev = 'active') AS act FROM e GROUP BY 1)
SELECT user_id AS generation_id, CASE WHEN ev = 'active' AND act < (SELECT max(event_id) FROM e WHERE ev = 'active') THEN 'retired' WHEN ev = 'failed' AND attempts < 15 THEN 'queued' ELSE ev END AS status, attempts, seq FROM g""",
    "projection_verify": "SELECT doc_id AS chunk_id, CASE lang WHEN 'es' THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE lang IN ('es', 'en')",
    "tombstone_delete": "SELECT source AS document_id, lang AS version_id, count(*) AS n FROM documents WHERE source <> 'src1' AND NOT (lang = 'de' AND source < 'src15') GROUP BY ALL",
    "publication_state": f"""WITH e AS (SELECT user_id, event_id, {kind('publish', 'publish', 'switch', 'publish', 'delete')} AS k FROM events)
SELECT user_id AS document_id, arg_max(k, event_id) AS kind, CASE WHEN arg_max(k, event_id) <> 'delete' THEN max(event_id) END AS active_version_id, max(event_id) AS seq FROM e GROUP BY 1""",
    "job_state": f"""WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y%m%d%H') AS job_id, event_id, ts, {kind('queued', 'claimed', 'succeeded', 'claimed', 'error')} AS k FROM events),
d AS (SELECT * FROM e QUALIFY event_id <= coalesce(min(event_id) FILTER (k = 'succeeded') OVER (PARTITION BY job_id), event_id)),
g AS (SELECT job_id, count(*) FILTER (k = 'claimed') AS a, arg_max(k, event_id) AS k, arg_max(ts, event_id) AS ts, bool_or(k = 'succeeded') AS done FROM d GROUP BY 1)
SELECT job_id, CASE WHEN done THEN 'succeeded' WHEN k = 'claimed' THEN 'running' WHEN k = 'error' AND a >= 3 THEN 'failed' ELSE 'queued' END AS status, a AS attempts,
  CASE WHEN NOT done AND k = 'error' AND a < 3 THEN strftime(ts + to_seconds(least(60, 2 ** a)::INT), '%Y-%m-%d %H:%M:%S') END AS next_attempt FROM g""",
    "stale_versions": """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS k FROM events GROUP BY 1)
SELECT user_id AS document_id, NULL::BIGINT AS version_id FROM l WHERE k = 'signup' UNION ALL SELECT user_id, o_orderkey FROM l JOIN orders ON o_custkey = user_id WHERE k = 'click' AND o_orderstatus = 'P'""",
    "check_requests": """WITH b AS (SELECT item_id AS request_id, text, length(text) AS n FROM benchmark)
SELECT request_id, 'kb_ids_must_not_contain_duplicates' AS code FROM b WHERE starts_with(text, 'T')
UNION ALL SELECT request_id, 'product_entity_filters_are_mutually_exclusive' FROM b WHERE n > 250
UNION ALL SELECT request_id, 'selection_inputs_require_adaptive_mode' FROM b WHERE NOT contains(text, 'the')
UNION ALL SELECT request_id, 'facet_text_must_match_question_span' FROM b WHERE n > 150
UNION ALL SELECT request_id, 'context_binding_conflicts_with_product_filter' FROM b WHERE n > 200""",
    "profile_names": "SELECT count(*) AS documents FROM (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY 1) GROUP BY l",
}
