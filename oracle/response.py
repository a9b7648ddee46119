"""SQL twins of the response path."""

from oracle.common import DOCS, HYBRID, bm25, logtf, word_set
from oracle.retrieval import RELATIONS

LENGTH = "(length(source_text) % 97)::DOUBLE"
TEXTS = f"{HYBRID},\nft AS (SELECT f.*, c.source_text, c.lang FROM fused f JOIN chunks c USING (chunk_id) WHERE position <= 50)"

ORACLES = {
    "request_filter": """SELECT item_id AS request_id, count(*) AS allowed, sum(doc_id)::BIGINT AS id_sum FROM benchmark, documents
WHERE n_chars >= 300 AND (item_id % 3 <> 0 OR source IN ('src1', 'src7')) AND (item_id % 2 <> 0 OR lang = 'en') GROUP BY 1""",
    "relation_ranking": f"""WITH {RELATIONS},
found AS (SELECT request_id, relation_id, chunk_id FROM seeds s JOIN rel r ON s.entity_id = r.subject_id WHERE valid_from <= TIMESTAMP '2000-01-01' AND valid_until > TIMESTAMP '2000-01-01'
          QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY relation_id, chunk_id) <= 30),
o AS (SELECT request_id, chunk_id, relation_id, len(list_intersect({word_set("'1-URGENT order in state F'")}, {word_set("o_orderpriority || ' ' || o_orderstatus")})) AS overlap FROM found JOIN orders ON o_orderkey = chunk_id),
b AS (SELECT request_id, chunk_id, arg_min(overlap, (-overlap, relation_id)) AS overlap, arg_min(relation_id, (-overlap, relation_id)) AS relation_id FROM o GROUP BY ALL)
SELECT request_id, chunk_id, overlap, row_number() OVER (PARTITION BY request_id ORDER BY -overlap, relation_id, chunk_id) AS rank FROM b""",
    "rerank_order": f"""{TEXTS}, n AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM ft)
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN n > 1 THEN -{LENGTH} END, CASE WHEN n = 1 THEN position END, chunk_id) AS position,
  CASE WHEN n > 1 THEN {LENGTH} END AS rerank_score FROM n WHERE n = 1 OR position <= 30""",
    "refill_cutoff": f"""{TEXTS}, c AS (SELECT request_id, count(*) FILTER (lang = 'es') AS filtered, count(*) FILTER (lang <> 'es' AND position <= 12) AS kept FROM ft GROUP BY 1),
r AS (SELECT request_id, (filtered > 0 AND kept < 8) OR request_id % 4 = 0 AS refilled FROM c) SELECT request_id, refilled, CASE WHEN refilled THEN 100 ELSE 50 END AS "limit" FROM r""",
    "final_revalidation": f"""{TEXTS}, again AS (SELECT request_id, chunk_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT request_id, chunk_id, rank FROM bm UNION ALL SELECT request_id, chunk_id, rank FROM lt) GROUP BY ALL),
k AS (SELECT request_id, chunk_id, CASE WHEN request_id % 2 = 0 THEN {LENGTH} END AS rr, CASE WHEN request_id % 2 = 0 THEN score ELSE s END AS score FROM ft JOIN again USING (request_id, chunk_id) WHERE position <= 20 AND lang <> 'fr')
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY rr DESC NULLS LAST, round(score, 12) DESC, chunk_id) AS position, round(score, 8) AS score FROM k""",
    "delivered_hits": f"""{HYBRID} SELECT f.request_id, f.chunk_id, position AS hit_rank, sources, coalesce(bm.rank, -1)::DOUBLE AS keyword_rank, CASE WHEN f.request_id % 2 = 0 THEN 'rerank' ELSE 'rrf' END AS score_type,
  round(CASE WHEN f.request_id % 2 = 0 THEN position / 10.0 ELSE f.score END::DOUBLE, 8) AS score, CASE WHEN f.chunk_id % 3 = 0 THEN 'complete' ELSE 'disabled' END AS context_state, md5(source_text) AS text_digest
FROM fused f JOIN chunks USING (chunk_id) LEFT JOIN bm ON bm.request_id = f.request_id AND bm.chunk_id = f.chunk_id WHERE position <= 8""",
    "response_diagnostics": f"""{HYBRID}, s AS (SELECT request_id, count(*) FILTER (source = 'keyword') AS keyword, count(*) FILTER (source = 'vector') AS vector, count(*) FILTER (source = 'relation') AS relation,
  count(DISTINCT chunk_id) AS "union" FROM lists GROUP BY 1),
h AS (SELECT request_id, count(*) AS returned, sum(length(source_text))::BIGINT AS source_text_chars, sum(strlen(source_text))::BIGINT AS source_text_bytes,
  sum(CASE WHEN chunk_id % 2 = 0 THEN length(lang) ELSE 0 END)::BIGINT AS context_chars FROM fused JOIN chunks USING (chunk_id) WHERE position <= 8 GROUP BY 1)
SELECT s.*, 0 AS reranked, returned, source_text_chars, source_text_bytes, context_chars, context_chars AS context_bytes FROM s JOIN h USING (request_id)""",
    "response_status": f"""WITH {DOCS},{bm25(k=8)},{logtf(k=8)}, h AS (SELECT request_id, count(*) AS hits FROM (SELECT request_id FROM bm UNION ALL SELECT request_id FROM lt) GROUP BY 1),
a AS (SELECT item_id AS i, coalesce(hits, 0) AS hits FROM benchmark LEFT JOIN h ON request_id = item_id)
SELECT i AS request_id, CASE WHEN i % 7 = 0 THEN 'degraded' WHEN hits > 0 THEN 'ok' ELSE 'not_found' END AS retrieval_status,
  CASE WHEN i % 2 = 0 THEN 'rrf_then_rerank' WHEN i % 5 = 1 AND i % 4 = 1 THEN 'rrf_related' WHEN i % 5 = 0 OR i % 3 = 0 THEN 'keyword_rrf' ELSE 'rrf' END AS ranking_method FROM a""",
}
