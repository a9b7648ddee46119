"""SQL twins of the retrieval queries."""

from oracle.common import DOCS, HYBRID, LINES, SELECTION, bm25, fold, logtf, token_line, word_set, words

IDENTIFIERS = f"list_filter({word_set('source_text')}, lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]'))"
IDENTIFIER_REQUESTS = f"""
asked AS (
  SELECT DISTINCT unnest({IDENTIFIERS}) AS request_id, NULL AS phrase FROM chunks
  UNION ALL SELECT 'item-' || item_id, lower(trim(text)) FROM benchmark)"""

RELATIONS = """
rel AS (
  SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS relation_id,
         l_suppkey AS subject_id, l_partkey AS object_id, l_orderkey AS chunk_id, l_shipdate AS valid_from, l_shipdate + INTERVAL 365 DAY AS valid_until
  FROM lineitem),
seeds AS (SELECT s_nationkey AS request_id, s_suppkey AS entity_id FROM supplier
          QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 20)"""


def expand(condition):
    return f"""WITH {RELATIONS},
pairs AS (SELECT DISTINCT request_id, relation_id, subject_id, object_id, chunk_id FROM seeds s JOIN rel r ON {condition}
          WHERE valid_from <= TIMESTAMP '2000-01-01' AND valid_until > TIMESTAMP '2000-01-01')
SELECT request_id, relation_id, subject_id, object_id, chunk_id FROM pairs
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY relation_id, chunk_id) <= 30"""


CALIBRATION = f"""
scored AS (
  SELECT l.doc_id AS sample_id, source AS family, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'calibration' ELSE 'test' END AS split,
         'lexical' AS channel, round(len(list_distinct({words('text')})) / greatest(len({words('text')}), 1), 3) AS score, quality = 1 AS relevant
  FROM labels l JOIN documents d USING (doc_id)),
cal AS (SELECT * FROM scored WHERE split = 'calibration'),
tot AS (SELECT channel, count(*) FILTER (relevant) AS positives, count(*) FILTER (NOT relevant) AS negatives, count(DISTINCT family) AS families FROM cal GROUP BY 1),
opt AS (SELECT t.channel, t.score AS threshold, positives, negatives, families,
        (SELECT count(*) FROM cal c WHERE c.channel = t.channel AND c.relevant AND c.score >= t.score) / positives AS recall,
        (SELECT count(*) FROM cal c WHERE c.channel = t.channel AND NOT c.relevant AND c.score >= t.score) / negatives AS fpr
        FROM (SELECT DISTINCT channel, score FROM cal) t JOIN tot USING (channel)),
fit AS (SELECT * FROM opt WHERE fpr <= 0.4 AND recall > 0 AND positives >= 5 AND negatives >= 5 AND families >= 2
        QUALIFY row_number() OVER (PARTITION BY channel ORDER BY recall DESC, fpr, threshold DESC) = 1)"""

ORACLES = {
    "bm25_topk": f"WITH {LINES},{bm25()} SELECT request_id, chunk_id, rank, round(score, 4) AS score FROM bm",
    "bm25_fields_topk": f"""WITH {DOCS},
fields AS (SELECT chunk_id, 'source_text' AS field, source_text AS body, 3.0 AS boost FROM chunks
  UNION ALL SELECT chunk_id, 'title', string_split(source_text, chr(10))[1], 1.0 FROM chunks
  UNION ALL SELECT chunk_id, 'scope', lang, 1.5 FROM chunks
  UNION ALL SELECT chunk_id, 'table_labels', array_to_string(list_filter(string_split(source_text, chr(10)), lambda x: contains(x, '|')), ' '), 1.0 FROM chunks
  UNION ALL SELECT chunk_id, 'document_name', kb_id, 0.25 FROM chunks),
{bm25(k=20, fields='fields')} SELECT request_id, chunk_id, rank, round(score, 4) AS score FROM bm""",
    "keyword_logtf_topk": f"WITH {DOCS},{logtf()} SELECT request_id, chunk_id, rank, round(score, 4) AS score FROM lt",
    "exact_identifier_search": f"""WITH {DOCS},{IDENTIFIER_REQUESTS},
body AS MATERIALIZED (SELECT chunk_id, {token_line('source_text')} AS line FROM chunks),
wanted AS MATERIALIZED (SELECT request_id, {token_line('phrase')} AS line FROM asked WHERE phrase IS NOT NULL),
found AS (
  SELECT term AS request_id, chunk_id FROM (SELECT chunk_id, unnest({IDENTIFIERS}) AS term FROM chunks)
  UNION ALL SELECT request_id, chunk_id FROM wanted w JOIN body b ON length(w.line) > 2 AND contains(b.line, w.line))
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY chunk_id) AS rank, 1.0::DOUBLE AS score FROM found QUALIFY rank <= 50""",
    "query_route": f"""WITH {DOCS},{IDENTIFIER_REQUESTS},
r AS (SELECT coalesce(phrase, request_id) AS q, (SELECT trim(text) FROM benchmark b WHERE 'item-' || b.item_id = a.request_id) AS original FROM asked a),
p AS (SELECT regexp_matches(coalesce(original, q), '^(?:[A-Za-z][A-Za-z0-9_.:/+-]*[0-9][A-Za-z0-9_.:/+-]*|[A-Z][A-Z0-9_./:-]{{2,}})$') AS exact FROM r)
SELECT CASE WHEN exact THEN 'exact' ELSE 'hybrid' END AS path, CASE WHEN exact THEN 'auto_exact_identifier' ELSE 'auto_natural_language' END AS route_reason,
       count(*) AS requests FROM p GROUP BY ALL""",
    "knn_cosine_topk": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (
  SELECT label, i, avg(v[i]) AS x FROM e, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY 1),
s AS (SELECT c.label AS request_id, e.vec_id, list_cosine_similarity(c.v, e.v) AS score FROM c, e)
SELECT request_id, vec_id, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, vec_id) AS rank, round(score, 4) AS score
FROM s QUALIFY rank <= 20""",
    "knn_recall": """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label::VARCHAR AS kb_id, count(*) AS requests, sum(least(n, 20))::BIGINT AS neighbours, true AS reached, 0::BIGINT AS wrong FROM embeddings JOIN n USING (label) WHERE vec_id % 20 = 0 GROUP BY 1""",
    "rrf_hybrid": f"""WITH {DOCS},{bm25()},{logtf()},
f AS (SELECT request_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM (
  SELECT request_id, chunk_id, rank FROM bm UNION ALL SELECT request_id, chunk_id, rank FROM lt) GROUP BY ALL)
SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12) DESC, chunk_id) AS position, round(score, 8) AS score
FROM f QUALIFY position <= 8""",
    "weighted_fusion": f"{HYBRID} SELECT request_id, chunk_id, position, round(score, 8) AS score, sources FROM fused WHERE position <= 20",
    "literal_coverage": f"""WITH {DOCS},{bm25(k=20)}
SELECT bm.request_id, bm.chunk_id, round(CASE WHEN len({word_set('b.text')}) = 0 THEN 0.0 ELSE
  len(list_intersect({word_set('b.text')}, {word_set("c.source_text || chr(10) || c.kb_id || chr(10) || c.lang")})) / len({word_set('b.text')}) END, 6) AS coverage
FROM bm JOIN benchmark b ON b.item_id = bm.request_id JOIN chunks c ON c.chunk_id = bm.chunk_id""",
    "evidence_dedup": """SELECT lang AS request_id, min(doc_id) AS chunk_id FROM documents
GROUP BY lang, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g')""",
    "ranked_budget_fill": f"""{HYBRID},
cand AS (SELECT request_id, f.chunk_id, position, strlen(source_text) AS bytes, length(source_text) AS chars FROM fused f JOIN chunks c USING (chunk_id) WHERE position <= 50),
walk AS (
  SELECT DISTINCT request_id, 0::BIGINT AS position, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS chars, NULL::BIGINT AS taken FROM cand
  UNION ALL
  SELECT w.request_id, c.position, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN total + c.bytes ELSE total END,
         CASE WHEN ok THEN w.chars + c.chars ELSE w.chars END, CASE WHEN ok THEN c.chunk_id END
  FROM walk w JOIN cand c ON c.request_id = w.request_id AND c.position = w.position + 1,
       LATERAL (SELECT n < 8 AND 2 + total + c.bytes + n + greatest(0, n - 8) <= 24000 AND w.chars + c.chars <= 12000 AS ok) x)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY position) AS hit_rank, taken AS chunk_id FROM walk WHERE taken IS NOT NULL""",
    "required_context": f"""WITH {LINES},{bm25(k=8)},
h AS (SELECT request_id, c.*, length(c.source_text) AS own, f.source_text AS first_text, f.chunk_id AS first_id
      FROM bm JOIN chunks c USING (chunk_id) LEFT JOIN chunks f ON f.chunk_id = c.document_id * 100000),
x AS (SELECT *, own <= 1200 AS hit_fits, CASE WHEN ordinal = 0 OR first_id IS NULL THEN false
             ELSE (CASE WHEN own <= 1200 THEN own + 2 ELSE 0 END) + length(first_text) <= 1200 END AS taken FROM h)
SELECT request_id, chunk_id, CASE WHEN taken THEN first_id::VARCHAR ELSE '' END AS parts,
  CASE WHEN hit_fits THEN own ELSE 0 END + CASE WHEN taken THEN length(first_text) + CASE WHEN hit_fits THEN 2 ELSE 0 END ELSE 0 END AS context_chars,
  CASE WHEN ordinal = 0 THEN 'disabled' WHEN NOT taken THEN 'unresolved' WHEN NOT hit_fits THEN 'truncated' ELSE 'complete' END AS context_state,
  CASE WHEN ordinal > 0 AND NOT taken AND first_id IS NULL AND hit_fits THEN 'dependency_unresolved'
       WHEN ordinal > 0 AND NOT taken THEN 'budget_omitted,dependency_unresolved' WHEN NOT hit_fits THEN 'budget_omitted' ELSE '' END AS omissions FROM x""",
    "optional_neighbours": f"""WITH {LINES},{bm25(k=8)},
h AS (SELECT request_id, c.chunk_id, c.ordinal, length(c.source_text) AS own, p.chunk_id AS a, length(p.source_text) AS la, n.chunk_id AS b, length(n.source_text) AS lb
  FROM bm JOIN chunks c USING (chunk_id) LEFT JOIN chunks p ON p.document_id = c.document_id AND p.ordinal = c.ordinal - 1
  LEFT JOIN chunks n ON n.document_id = c.document_id AND n.ordinal = c.ordinal + 1),
x AS (SELECT *, a IS NOT NULL AND own + la + 2 <= 1200 AS ta FROM h WHERE a IS NOT NULL OR b IS NOT NULL),
y AS (SELECT *, b IS NOT NULL AND own + CASE WHEN ta THEN la + 2 ELSE 0 END + lb + 2 <= 1200 AS tb FROM x)
SELECT request_id, chunk_id, concat_ws(',', CASE WHEN ta THEN a END, CASE WHEN tb THEN b END) AS parts FROM y""",
    "relation_expand_outgoing": expand("s.entity_id = r.subject_id"),
    "relation_expand_incoming": expand("s.entity_id = r.object_id"),
    "relation_expand_both": expand("s.entity_id = r.subject_id OR s.entity_id = r.object_id"),
    "relation_revalidate": f"""WITH {RELATIONS},
found AS (SELECT request_id, relation_id, subject_id, object_id, chunk_id FROM seeds s JOIN rel r ON s.entity_id = r.subject_id
          WHERE valid_from <= TIMESTAMP '2000-01-01' AND valid_until > TIMESTAMP '2000-01-01'
          QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY relation_id, chunk_id) <= 30),
flags AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS relation_id, min(l_returnflag) AS flag
          FROM lineitem GROUP BY 1)
SELECT request_id, f.relation_id, f.chunk_id FROM found f JOIN rel r USING (relation_id) JOIN flags g USING (relation_id) JOIN orders o ON o.o_orderkey = f.chunk_id
WHERE flag <> 'R' AND o_orderstatus <> 'P' AND r.valid_from <= TIMESTAMP '2000-07-01' AND r.valid_until > TIMESTAMP '2000-07-01'""",
    "fit_thresholds": f"WITH {CALIBRATION} SELECT channel, threshold, positives, negatives, families, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM fit",
    "split_leakage": f"""WITH {CALIBRATION}, f AS (SELECT lang AS family FROM scored JOIN documents ON doc_id = sample_id GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT 'calibration_test_family_leakage' AS code, count(*) AS n FROM f HAVING count(*) > 0""",
    "relevance_gate": f"""WITH {CALIBRATION}
SELECT sample_id, CASE WHEN split = 'test' THEN score >= (SELECT threshold FROM fit) END AS accepted FROM scored""",
}
