"""SQL twins of the decision, association and evaluation queries."""

from oracle.common import DOCS, GOLD, HYBRID, STOP_LIST, bm25, fold, logtf, word_set, words

FACET_STOP = "['long','much','many','should','want','know','give','tell','please']"
CONCEPTS = (("concept:storage", ["store", "stored", "storage", "refrigerate", "refrigerated", "refrigeration"], ["stor", "refrigerat", "refrigerate"]),
            ("concept:shipping", ["ship", "shipped", "shipping", "deliver", "delivered", "delivery", "courier"], ["ship", "shipp", "shipe", "deliver"]))


def sql_list(values):
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def stem(n):
    base = f"left(w, length(w) - {n})"
    cut = f"CASE WHEN length(w) - {n} > 3 AND right({base}, 1) = left(right({base}, 2), 1) THEN left(w, length(w) - {n + 1}) ELSE {base} END"
    return f"[{cut}, {cut} || 'e']"


def lexemes(x):
    plain = "regexp_full_match(w, '[a-z]+') AND length(w) > 4"
    base = f"""list_distinct(flatten(list_transform({word_set(x)}, lambda w: flatten([[w],
  CASE WHEN {plain} AND ends_with(w, 'ies') THEN [left(w, length(w) - 3) || 'y'] ELSE [] END, CASE WHEN {plain} AND ends_with(w, 'ing') THEN {stem(3)} ELSE [] END,
  CASE WHEN {plain} AND ends_with(w, 'ed') THEN {stem(2)} ELSE [] END, CASE WHEN {plain} AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN [left(w, length(w) - 1)] ELSE [] END]))))"""
    return base


def collapse(source, name, concept):
    label, members, stems = concept
    return (f"{name} AS (SELECT doc_id, CASE WHEN list_has_any(l, {sql_list(members)}) THEN list_append(list_filter(l, lambda z: NOT list_contains({sql_list(members + stems)}, z)), '{label}') "
            f"ELSE l END AS l FROM {source})")


def except_(a, b):
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


FACETS = f"""
fc AS (SELECT item_id AS request_id, i AS facet_no, 'f' || i AS facet_id, p[i] AS facet FROM (
  SELECT item_id, CASE WHEN len(p) > 8 THEN [text] ELSE p END AS p FROM (SELECT item_id, text, list_filter(string_split(text, '. '), lambda x: length(trim(x)) > 0) AS p FROM benchmark)), unnest(range(1, len(p) + 1)) AS t(i)),
ft AS (SELECT request_id, facet_no, facet_id, {except_(lexemes('facet'), FACET_STOP)} AS terms FROM fc),
cd AS (SELECT bm.request_id, bm.chunk_id, bm.rank, lang, {lexemes("source_text || chr(10) || kb_id")} AS terms, {lexemes('lang')} AS subject_terms FROM bm JOIN chunks USING (chunk_id)),
mt AS (SELECT f.request_id, f.facet_no, f.facet_id, c.chunk_id, c.rank, c.lang, {except_('f.terms', 'c.subject_terms')} AS need, c.terms AS have FROM ft f JOIN cd c USING (request_id)),
mw AS (SELECT *, CASE WHEN lang = 'es' THEN 'partial' WHEN lang = 'en' AND len(list_intersect(need, have)) = len(need) THEN 'direct' ELSE 'partial' END AS way
  FROM mt WHERE len(need) > 0 AND len(list_intersect(need, have)) > 0),
sp AS (SELECT f.request_id, f.facet_no, f.facet_id, CASE WHEN count(*) FILTER (way = 'direct') > 0 THEN 'direct' WHEN count(m.chunk_id) > 0 THEN 'unassessed' ELSE 'absent' END AS support
  FROM ft f LEFT JOIN mw m USING (request_id, facet_id) GROUP BY ALL)"""

DECIDE = f"WITH {DOCS},{bm25(k=20)},{FACETS}"

CLAIMS = """
pp AS (SELECT p.p_partkey AS chunk_id, p.p_type, p.p_name AS a, n.p_name AS b FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1),
cl AS (SELECT chunk_id, a AS subject, b AS object,
  CASE p_type WHEN 'STANDARD' THEN 'compatible_with' WHEN 'PROMO' THEN 'supports_capability' ELSE 'depends_on' END AS predicate, CASE p_type WHEN 'PROMO' THEN 'negative' ELSE 'positive' END AS polarity,
  CASE WHEN p_type = 'MEDIUM' OR (p_type = 'PROMO' AND NOT ends_with(b, 'ring')) THEN 'unresolved' ELSE 'source_verified' END AS state, CASE p_type WHEN 'STANDARD' THEN 1 ELSE 0 END AS conditions,
  CASE p_type WHEN 'PROMO' THEN 7 ELSE 0 END AS start,
  CASE p_type WHEN 'ECONOMY' THEN a || ' requires ' || b WHEN 'STANDARD' THEN a || ' is compatible with ' || b || ' only with ' || b || ' firmware 2.1 or later' WHEN 'PROMO' THEN a || ' does not support ' || b
    ELSE a || ' depends on ' || b || ' in most rooms' END AS sentence
  FROM pp WHERE a <> b AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'MEDIUM'))"""

SCORES = f"""WITH {DOCS},{bm25(k=8)},{logtf(k=8)},{GOLD},
r AS (SELECT 'H' AS variant, request_id, chunk_id, rank FROM bm UNION ALL SELECT 'L', request_id, chunk_id, rank FROM lt),
c AS (SELECT item_id AS query_id, EXISTS (SELECT 1 FROM gold g WHERE g.request_id = item_id) AS answerable FROM benchmark),
s AS (SELECT v.variant, c.query_id, c.answerable, count(r.chunk_id) AS returned, coalesce(bool_or(g.chunk_id IS NOT NULL), false) AS hit,
  coalesce(bool_or(g.chunk_id IS NOT NULL AND g.chunk_id = (SELECT min(chunk_id) FROM gold x WHERE x.request_id = c.query_id)), false) AS doc_hit
  FROM c CROSS JOIN (SELECT unnest(['H', 'L']) AS variant) v LEFT JOIN r ON r.variant = v.variant AND r.request_id = c.query_id LEFT JOIN gold g ON g.request_id = c.query_id AND g.chunk_id = r.chunk_id GROUP BY ALL),
q AS (SELECT variant, query_id, CASE WHEN answerable THEN 'simple' ELSE 'unanswerable' END AS category, CASE WHEN answerable THEN hit::INT / 8.0 END AS precision, CASE WHEN answerable THEN hit::INT::DOUBLE END AS recall,
  CASE WHEN answerable THEN hit AND doc_hit END AS complete, returned FROM s)"""

WILSON = "1.959963984540054"


def wilson(c, n, sign):
    z = WILSON
    return (f"(({c} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) {sign} {z} * sqrt(({c} / {n}) * (1 - {c} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))")


QUAL = r"(?i)\\b(?:if|when|unless|except|only|provided|after|before)\\b".replace("\\\\", "\\")
DQUAL = r"(?i)\b(?:if|when|unless|except|only|provided|after|before|sealed|opened|opening)\b"
STRIPPED = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
SENTS = f"list_sort(list_transform(list_filter(regexp_split_to_array(text, '[\\n.!?。！？]'), lambda p: regexp_matches(p, '{QUAL}')), lambda p: {STRIPPED % fold('p')}))"

ORACLES = {
    "facet_split": """WITH q AS (SELECT a.item_id AS request_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT request_id, 'f1' AS facet_id, 0 AS start, length(x) + 1 AS "end", md5(x || '?') AS digest FROM q
UNION ALL SELECT request_id, 'f2', length(x) + 2, length(x) + length(y) + 3, md5(y || ';') FROM q""",
    "values_qualifiers": f"""SELECT doc_id, len({SENTS}) AS qualifiers, md5(array_to_string({SENTS}, '|')) AS qualifier_digest,
  len(list_filter(string_split(regexp_replace(text, '([.!?。！？])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda p: {STRIPPED % 'p'} <> '' AND regexp_matches(p, '{DQUAL}'))) AS clauses FROM documents""",
    "document_lexemes": f"""WITH l0 AS (SELECT doc_id, {lexemes('text')} AS l FROM documents),
{collapse('l0', 'l1', CONCEPTS[0])},
{collapse('l1', 'l2', CONCEPTS[1])}
SELECT doc_id, len(l) AS lexemes, md5(array_to_string(list_sort(l), ' ')) AS digest FROM l2""",
    "facet_support": f"{DECIDE} SELECT request_id, facet_id, support FROM sp",
    "decide": f"""{DECIDE} SELECT request_id, CASE WHEN bool_and(support = 'direct') THEN 'answer' WHEN bool_or(support = 'direct') THEN 'partial_answer' ELSE 'insufficient' END AS decision,
  coalesce(string_agg(facet_id, ',' ORDER BY facet_no) FILTER (support <> 'direct'), '') AS missing FROM sp GROUP BY 1""",
    "conflicts": """WITH m AS (SELECT l_orderkey AS request_id, l_partkey * 10 + l_linenumber AS k, min(l_returnflag) AS f, min(l_linestatus) AS s, CAST(trunc(min(l_quantity)) AS INT) AS q FROM lineitem GROUP BY ALL),
p AS (SELECT a.request_id, a.k AS i, b.k AS j, CASE WHEN (a.s = 'F') <> (b.s = 'F') THEN 'opposite_polarity' ELSE 'incompatible_values' END AS reason FROM m a JOIN m b ON a.request_id = b.request_id AND a.f = b.f AND a.k < b.k
  WHERE (a.s = 'F') <> (b.s = 'F') OR a.q <> b.q)
SELECT request_id, 'f1' AS facet_id, arg_min(reason, (i, j)) AS reason FROM p GROUP BY 1""",
    "package_status": "SELECT event_id AS package_id, CASE WHEN TIMESTAMP '2024-01-15' >= ts + INTERVAL 30 SECOND OR event_type IN ('click', 'error') THEN 'stale' ELSE 'valid' END AS status FROM events",
    "changed_hits": f"WITH {DOCS},{bm25(k=20)} SELECT request_id, chunk_id FROM bm JOIN chunks USING (chunk_id) WHERE lang IN ('fr', 'de')",
    "decision_integrity": """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN f = 'A' THEN 1 ELSE n END AS g FROM r WHERE s = 'O'),
v AS (SELECT k, 'supported_facet_requires_evidence' AS code FROM r WHERE f = 'N' AND s <> 'O' UNION SELECT k, 'unsupported_facet_must_not_reference_evidence' FROM r WHERE f <> 'N' AND s = 'O'
  UNION SELECT k, 'facet_and_group_support_must_match' FROM o WHERE g <> n UNION SELECT k, 'sources_must_match_selected_evidence' FROM o WHERE f = 'R'
  UNION SELECT k, 'answer_requires_all_facets_supported' FROM r JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'F' AND f <> 'N')
SELECT code, count(*) AS n FROM v GROUP BY 1""",
    "discover_links": f"""WITH g AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN 'See ' ELSE '' END || lang || '-guide. ' || coalesce(text, '') AS text FROM documents),
v AS MATERIALIZED (SELECT doc_id, source, lang, text, {words('text')} AS w, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM g LEFT JOIN embeddings ON vec_id = doc_id),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(w) AS term FROM v) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT source, count(*) AS n, avg(len(w)) AS a FROM v GROUP BY 1),
bm AS (SELECT q.doc_id AS s, t.doc_id AS t, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(v.w) / greatest(1, a)))) AS score
  FROM tf q JOIN tf t USING (source, term) JOIN df USING (source, term) JOIN st USING (source) JOIN v ON v.doc_id = t.doc_id GROUP BY ALL),
top AS (SELECT s, t FROM bm QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(score, 6) DESC, t) <= 20),
near AS (SELECT a.doc_id AS s, b.doc_id AS t FROM v a JOIN v b USING (source) WHERE a.e IS NOT NULL AND b.e IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.doc_id) <= 20),
p AS (SELECT s, t, CASE WHEN a.e IS NOT NULL AND b.e IS NOT NULL THEN list_cosine_similarity(a.e, b.e) END AS c, a.text = b.text AS dup, s % 7 = 0 AND a.lang = b.lang AS ref,
  len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS x, len(list_distinct(list_concat(a.w, b.w))) AS u
  FROM (SELECT s, t FROM top UNION SELECT s, t FROM near) JOIN v a ON a.doc_id = s JOIN v b ON b.doc_id = t WHERE s <> t),
q AS (SELECT *, CASE WHEN ref THEN 'explicit_reference' WHEN dup THEN 'near_duplicate' ELSE 'semantic_neighbor' END AS kind,
  0.5 * greatest(0, coalesce(c, 0)) + 0.3 * x / greatest(1, u) + CASE WHEN ref THEN 0.2 ELSE 0 END AS score FROM p WHERE ref OR dup OR coalesce(c, -2) >= 0),
n AS (SELECT *, row_number() OVER (PARTITION BY s, kind ORDER BY round(score, 9) DESC, t) AS k FROM q)
SELECT s AS source, t AS target, kind, round(score, 4) AS score FROM n WHERE kind <> 'semantic_neighbor' OR k <= 4 QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, t) <= 8""",
    "extract_claims": f'WITH {CLAIMS} SELECT chunk_id, subject, predicate, object, polarity, state, conditions, start, start + length(sentence) AS "end" FROM cl',
    "merge_claims": f"""WITH {CLAIMS} SELECT subject, predicate, object, polarity, state, least(3, count(*)) AS proofs, greatest(0, count(*) - 3) AS truncated, min(chunk_id) AS first_chunk
FROM cl GROUP BY subject, predicate, object, polarity, state""",
    "condition_match": """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'unknown' WHEN event_type = 'click' THEN CASE WHEN k = 45 THEN 'match' ELSE 'mismatch' END WHEN k >= 45 THEN 'match' ELSE 'mismatch' END AS result FROM e""",
    "seed_pick": f"""{HYBRID}, x AS (SELECT f.request_id, f.chunk_id, position, kb_id FROM fused f JOIN chunks USING (chunk_id) WHERE position <= 50
  QUALIFY row_number() OVER (PARTITION BY f.request_id, kb_id ORDER BY position) <= 2)
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY position) AS seed_no FROM x QUALIFY seed_no <= 4""",
    "association_fusion": f"""WITH {DOCS},{bm25()},{logtf(k=10)},{GOLD},
b AS (SELECT request_id, chunk_id, 1.0 / (60 + rank) AS v, 1.0 / (60 + rank) AS d FROM bm UNION ALL SELECT request_id, chunk_id, 0.25 / (60 + rank), NULL FROM lt UNION ALL SELECT request_id, chunk_id, 0.5 / (60 + rank), NULL FROM gold),
s AS (SELECT request_id, chunk_id, sum(v) AS score, max(d) AS d FROM b GROUP BY ALL),
p AS (SELECT *, d IS NOT NULL AND row_number() OVER (PARTITION BY request_id ORDER BY round(d, 12) DESC NULLS LAST, chunk_id) <= 4 AS protected FROM s),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY protected DESC, round(score, 12) DESC, chunk_id) <= 8)
SELECT request_id, chunk_id, round(score, 8) AS score, protected, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12) DESC, chunk_id) AS position FROM k""",
    "variant_runs": """WITH b AS (SELECT regexp_matches(text, '(?i)\\b(?:compatible|requires?|depend|compare|limitations?)\\b') AS g,
  regexp_matches(trim(text), '^(?:[A-Za-z][A-Za-z0-9_.:/+-]*[0-9][A-Za-z0-9_.:/+-]*|[A-Z][A-Z0-9_./:-]{2,})$') AS ex FROM benchmark),
v AS (SELECT * FROM (VALUES ('H', 50, false), ('H+A', 50, true), ('H+B', 50, true), ('H+C', 50, true), ('H-wide', 62, false)) AS t(variant, candidates, asks))
SELECT variant, candidates, asks AND g AND NOT ex AS expands, CASE WHEN ex THEN 'exact_path' WHEN NOT asks THEN 'association_off' WHEN NOT g THEN 'gate_not_triggered' END AS gate_reason, count(*) AS requests FROM b, v GROUP BY ALL""",
    "proof_validity": "SELECT doc_id AS claim_id FROM documents WHERE lang NOT IN ('es', 'de') AND length(text) >= 4",
    "query_scores": f"{SCORES} SELECT variant, query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, complete, returned FROM q",
    "macro_summary": f"""{SCORES} SELECT variant, category, count(*) AS queries, round(avg(precision), 6) AS precision_mean, count(precision) AS precision_n, round(avg(recall), 6) AS recall_mean
FROM q GROUP BY GROUPING SETS ((variant), (variant, category))""",
    "retrieval_metrics": f"""{HYBRID}, h AS (SELECT request_id, position AS rank, chunk_id, lang, strlen(source_text) AS b FROM fused JOIN chunks USING (chunk_id) WHERE position <= 8),
x AS (SELECT item_id AS query_id, EXISTS (SELECT 1 FROM gold g WHERE g.request_id = item_id) AS ans, count(h.chunk_id) AS returned, coalesce(sum(h.b), 0)::BIGINT AS hits_bytes, min(h.rank) FILTER (g.chunk_id IS NOT NULL) AS first,
  coalesce(bool_or(g.chunk_id IS NOT NULL AND h.lang <> 'es'), false) AS safe FROM benchmark LEFT JOIN h ON h.request_id = item_id LEFT JOIN gold g ON g.request_id = item_id AND g.chunk_id = h.chunk_id GROUP BY ALL)
SELECT query_id, CASE WHEN ans THEN (first IS NOT NULL)::INT::DOUBLE END AS recall, CASE WHEN ans THEN safe END AS complete, CASE WHEN ans THEN round(coalesce(1.0 / first, 0.0), 6) END AS reciprocal_rank,
  CASE WHEN ans THEN CASE WHEN returned > 0 THEN round((first IS NOT NULL)::INT / returned, 6) ELSE 0.0 END END AS precision_returned, CASE WHEN NOT ans THEN returned > 0 END AS no_answer_false_positive,
  CASE WHEN ans THEN returned = 0 END AS answerable_empty, returned, hits_bytes FROM x""",
    "percentiles": """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
  quantile_disc(l_extendedprice, 0.5) AS nearest50, quantile_disc(l_extendedprice, 0.95) AS nearest95, quantile_disc(l_extendedprice, 0.99) AS nearest99 FROM lineitem GROUP BY 1""",
    "wilson": f"""WITH r AS (SELECT source, sum(quality)::DOUBLE AS c, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, round(greatest(0.0, {wilson('c', 'n', '-')}), 6) AS low, round(least(1.0, {wilson('c', 'n', '+')}), 6) AS high FROM r""",
    "association_scores": f"""WITH {CLAIMS}, p AS (SELECT DISTINCT chunk_id FROM cl WHERE state = 'source_verified'), l AS (SELECT p_partkey, p_size > 5 AS ok FROM part WHERE p_size <= 40),
b AS (SELECT count(*) FILTER (chunk_id IS NOT NULL AND ok) AS c, count(*) FILTER (chunk_id IS NOT NULL AND ok IS NOT NULL) AS n, count(*) FILTER (chunk_id IS NOT NULL AND ok IS NULL) AS u, count(*) FILTER (ok) AS e FROM p FULL JOIN l ON chunk_id = p_partkey),
t AS (SELECT DISTINCT event_type AS variant, user_id, json_extract_string(props, '$.k') AS k FROM events),
w AS (SELECT variant, count(*) FILTER (k < '50' AND NOT k > '20') AS c, count(*) FILTER (k < '50') AS n, count(*) FILTER (NOT k < '50') AS u FROM t GROUP BY 1)
SELECT 'accuracy' AS measure, NULL AS variant, round(c / n, 6) AS measured, c AS correct, n, u AS unlabelled, round(greatest(0.0, {wilson('c', 'n', '-')}), 6) AS low, round(least(1.0, {wilson('c', 'n', '+')}), 6) AS high FROM b
UNION ALL SELECT 'recall', NULL, round(c / e, 6), c, e, 0, NULL, NULL FROM b
UNION ALL SELECT 'wrong_paths', variant, round(c / n, 6), c, n, u, round(greatest(0.0, {wilson('c', 'n', '-')}), 6), round(least(1.0, {wilson('c', 'n', '+')}), 6) FROM w""",
    "run_summary": """SELECT count(*) AS requests, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms, round(avg((value > 30)::INT), 6) AS complete_evidence_rate,
  round(avg(user_id), 4) AS mean_returned, count(*) AS expected_status_checked, count(*) FILTER (event_type = 'view') AS expected_status_matched FROM events""",
    "gold_check": """WITH f AS (SELECT (o_orderstatus <> 'F')::INT + (o_orderpriority <> '5-LOW')::INT + (o_custkey IN (1, 2))::INT + (CAST(trunc(o_totalprice / 1000) AS INT) > 400)::INT AS n FROM orders)
SELECT n = 0 AS passed, n AS failures, count(*) AS cases FROM f GROUP BY ALL""",
}
