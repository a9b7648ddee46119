"""SQL twins of the lifecycle and association queries."""

from oracle.common import DOCS, bm25


LINE_ID = "(l_orderkey * 10 + l_linenumber)"
NAMESPACE = "'000000000000500080' || lpad(l_orderkey::VARCHAR, 14, '0')"

ORACLES = {
    "restored_lines": f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'),
h AS (SELECT l_orderkey, l_linenumber, {LINE_ID} AS id, {NAMESPACE} AS ns FROM l),
u AS (SELECT l_orderkey, l_linenumber, id, sha1(unhex(ns) || encode(id::VARCHAR)) AS r FROM h),
n AS (SELECT l_orderkey, l_linenumber, id, substr(r, 1, 8) || '-' || substr(r, 9, 4) || '-5' || substr(r, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(r, 17, 1))::INT + 1, 1) || substr(r, 18, 3) || '-' || substr(r, 21, 12) AS chunk_id FROM u)
SELECT a.l_orderkey AS order_key, a.l_linenumber AS ordinal, a.chunk_id, b.chunk_id AS target_id FROM n a LEFT JOIN n b ON a.l_linenumber > 1 AND b.id = a.id - 1""",
    "generation_freshness": """WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'purchase') AS b FROM events GROUP BY 1)
SELECT count(*) FILTER (n <> b) = 0 AS fresh, count(*) FILTER (n <> b) AS moved FROM m""",
    "catalog_upsert": """WITH t AS (SELECT p_partkey AS entity_id, p_brand AS name, p_size::BIGINT AS size FROM part)
SELECT entity_id, CASE WHEN size > 45 THEN upper(name || '-large') ELSE name END AS name, size FROM t UNION ALL SELECT entity_id + 10000000, name, size * 2 FROM t WHERE size > 45""",
    "catalog_delete": """SELECT 'catalog' AS part, count(*) AS n FROM supplier WHERE s_acctbal >= 0 UNION ALL
SELECT 'mentions', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'refused', count(*) FROM supplier WHERE s_nationkey <> 7""",
    "review_choices": """WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN 1000000 ELSE l_linenumber % 4 END AS level, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'),
b AS (SELECT DISTINCT l_orderkey AS chunk_id, l_suppkey AS entity_id FROM f QUALIFY level = max(level) OVER (PARTITION BY l_orderkey))
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY entity_id) <= 5""",
    "opened_reviews": """SELECT l_orderkey AS version_id, sha256(l_orderkey || ':scope-rules-1') AS plan_id, l_linenumber AS fact_id, l_returnflag AS original, l_returnflag AS current
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 3 <> 0""",
    "scope_states": """SELECT source AS version_id, CASE lang WHEN 'de' THEN 'not_applicable' WHEN 'en' THEN 'known' WHEN 'fr' THEN 'ambiguous' ELSE 'unknown' END AS status, count(*) AS n FROM documents GROUP BY ALL""",
    "promoted_states": """WITH t AS (SELECT DISTINCT doc_id + 1 AS id FROM documents WHERE n_chars > 1000 AND lang = 'en' AND n_chars % 2 = 0),
d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bundle' ELSE 'product' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'excluded' ELSE 'pending' END AS state, lang <> 'es' AS free, t.id IS NOT NULL AND doc_id % 2 = 0 AND lang <> 'es' AS by_link,
  source IN ('src3', 'src4') AND doc_id % 3 <> 0 AND lang <> 'es' AND doc_id % 5 <> 0 AND lang <> 'fr' AS by_doc FROM documents LEFT JOIN t ON t.id = doc_id)
SELECT doc_id AS chunk_id, CASE WHEN by_link OR by_doc THEN 'general' ELSE kind END AS fact_kind, CASE WHEN by_link OR by_doc THEN 'rule_confirmed' ELSE state END AS review_state,
  CASE WHEN by_doc THEN 'declared_non_product_document' WHEN by_link THEN 'audited_required_condition' ELSE '' END AS review_reason FROM d""",
    "cue_search": f"""WITH {DOCS},{bm25(k=4)},
names AS (SELECT DISTINCT request_id, lang FROM bm JOIN chunks USING (chunk_id)),
cues AS (SELECT request_id || ':' || row_number() OVER (PARTITION BY request_id ORDER BY lang) AS request_id, text || ' ' || lang AS query FROM names JOIN benchmark ON item_id = request_id
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY lang) <= 2),
{bm25(name='cue', k=12, queries='cues')} SELECT request_id, chunk_id, rank FROM cue""",
    "claim_coverage": """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem), d AS (SELECT DISTINCT l_orderkey, l_partkey FROM p JOIN part ON p_partkey = l_partkey WHERE p_size < 25),
c AS (SELECT p.l_orderkey AS request_id, p.l_suppkey AS claim_id, count(*) AS proofs, count(d.l_partkey) AS delivered FROM p LEFT JOIN d USING (l_orderkey, l_partkey) GROUP BY ALL)
SELECT *, CASE WHEN delivered = proofs THEN 'covered' ELSE 'partial' END AS coverage FROM c WHERE delivered > 0""",
    "held_paths": """WITH known AS (SELECT p_partkey AS id FROM part UNION SELECT s_suppkey FROM supplier), gone AS (SELECT p_partkey AS id FROM part WHERE p_size % 4 = 0),
held AS (SELECT id FROM known WHERE id NOT IN (SELECT id FROM gone)), ok AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_partkey AS source, count(*) AS paths FROM lineitem WHERE l_partkey IN (SELECT id FROM held) AND l_suppkey IN (SELECT id FROM held) AND (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM ok) GROUP BY 1""",
    "artifact_check": """WITH l AS (SELECT DISTINCT l_partkey, l_partkey || '-' || l_suppkey AS id FROM lineitem), c AS (SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem)
SELECT 'duplicate_association_id' AS code WHERE EXISTS (SELECT id FROM (SELECT id FROM l UNION ALL SELECT id FROM c) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'artifact_neighbor_limit_exceeded' WHERE EXISTS (SELECT l_partkey FROM l GROUP BY 1 HAVING count(*) > 8)
UNION ALL SELECT 'artifact_capacity_exceeded' WHERE (SELECT count(*) FROM l) > 24000 OR (SELECT count(*) FROM c) > 60000""",
}
