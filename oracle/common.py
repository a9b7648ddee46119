"""SQL shared by the twins: the driver's tables seen as the engine's tables."""

WORD = r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*"
SELECTION = r"[\p{L}\p{N}]+(?:[._:/+\-][\p{L}\p{N}]+)*"
DEV = r"[A-Za-z0-9_.:/+-]+"
STOP = ("a an the of for to and or is are be in on at by with what which how does do can could would please tell me "
        "about information available this that it its").split()
STOP_LIST = "[" + ",".join(f"'{w}'" for w in STOP) + "]"


def fold(x):
    return f"replace(lower({x}),'ß','ss')"


def words(x, pattern=WORD):
    return f"regexp_extract_all({fold(x)}, '{pattern}')"


def word_set(x):
    return f"list_filter(list_distinct({words(x, SELECTION)}), lambda w: NOT list_contains({STOP_LIST}, w))"


LINES = """
lines AS (
  SELECT doc_id AS document_id, source AS kb_id, lang, i - 1 AS ordinal, l[i] AS source_text
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)),
chunks AS (
  SELECT document_id * 100000 + ordinal AS chunk_id, document_id, kb_id, lang, ordinal, source_text FROM lines WHERE trim(source_text) <> '')"""

DOCS = "chunks AS (SELECT doc_id AS chunk_id, doc_id AS document_id, source AS kb_id, lang, text AS source_text FROM documents)"


def bm25(name="bm", k=50, fields="(SELECT chunk_id, 'text' AS field, source_text AS body, 1.0 AS boost FROM chunks)", queries=None):
    queries = queries or "(SELECT item_id AS request_id, text AS query FROM benchmark)"
    return f"""
{name}_toks AS (SELECT chunk_id, field, unnest({words('body')}) AS term FROM {fields}),
{name}_tf AS (SELECT chunk_id, field, term, count(*) AS tf FROM {name}_toks GROUP BY ALL),
{name}_dl AS (SELECT c.chunk_id, c.field, c.boost, len({words('c.body')}) AS dl FROM {fields} c),
{name}_stats AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM {name}_dl GROUP BY 1),
{name}_df AS (SELECT field, term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_q AS (SELECT DISTINCT request_id, unnest({words('query')}) AS term FROM {queries}),
{name}_s AS (
  SELECT q.request_id, t.chunk_id, t.field,
         sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.dl / greatest(1, s.avgdl)))) * any_value(l.boost) AS score
  FROM {name}_q q JOIN {name}_tf t ON q.term = t.term JOIN {name}_df d ON d.term = t.term AND d.field = t.field
  JOIN {name}_dl l ON l.chunk_id = t.chunk_id AND l.field = t.field JOIN {name}_stats s ON s.field = t.field GROUP BY ALL),
{name}_best AS (SELECT request_id, chunk_id, max(score) AS score FROM {name}_s GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {name}_best QUALIFY rank <= {k})"""


def logtf(name="lt", k=50):
    return f"""
{name}_toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(source_text), '{DEV}')) AS term FROM chunks),
{name}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM {name}_toks GROUP BY ALL),
{name}_q AS (SELECT request_id, term, count(*) AS w FROM (
    SELECT item_id AS request_id, unnest(regexp_extract_all(lower(text), '{DEV}')) AS term FROM benchmark) GROUP BY ALL),
{name}_s AS (SELECT request_id, chunk_id, sum((1 + ln(tf)) * w) AS score FROM {name}_q JOIN {name}_tf USING (term) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {name}_s QUALIFY rank <= {k})"""


def token_line(x):
    """The tokens of a text, each between blanks, so that a phrase of tokens is a part of it."""
    return f"' ' || array_to_string({words(x)}, ' ') || ' '"


GOLD = f"""
gold_d AS MATERIALIZED (SELECT doc_id, {token_line('text')} AS line FROM documents),
gold_b AS MATERIALIZED (SELECT item_id, {token_line('text')} AS line FROM benchmark),
gold AS (SELECT item_id AS request_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank
         FROM gold_b b JOIN gold_d d ON length(b.line) > 2 AND contains(d.line, b.line))"""

FUSED = """
lists AS (
  SELECT request_id, 'keyword' AS source, chunk_id, rank, 1.0 AS weight FROM bm
  UNION ALL SELECT request_id, 'vector', chunk_id, rank, 1.0 FROM lt
  UNION ALL SELECT request_id, 'relation', chunk_id, rank, 0.5 FROM gold),
fused_scores AS (
  SELECT request_id, chunk_id, sum(weight / (60 + rank)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12) DESC, chunk_id) AS position FROM fused_scores)"""

HYBRID = f"WITH RECURSIVE {DOCS},{bm25()},{logtf()},{GOLD},{FUSED}"
