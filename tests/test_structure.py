import re

from pyspark.sql import functions as F

from attestor.operators import structure, tree


def blocks_of(spark, text, **kw):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    marked = structure.mark_lines(structure.lines(rows, **kw))
    return [(r["text"], list(r["title_path"])) for r in structure.blocks(marked).orderBy("block_no").collect()]


def test_skipped_levels_close_up_and_fences_hide_headings(spark):
    text = "# A\n\none\n\n### C\n\ntwo\n\n```\n# no\n\nx\n```\n\n## B\n\nthree\n"
    assert blocks_of(spark, text) == [("one", ["A"]), ("two", ["A", "C"]), ("```\n# no\n\nx\n```", ["A", "C"]), ("three", ["A", "B"])]


def test_setext_numbered_and_veto(spark):
    text = "Title\n=====\n\nintro\n\n1. First part\nbody\n2. Costs 5 kg\nmore\n"
    assert blocks_of(spark, text) == [("intro", ["Title"]), ("body\n2. Costs 5 kg\nmore", ["Title", "1. First part"])]


def test_colon_keeps_the_list_behind_a_blank_line(spark):
    assert [b for b, _ in blocks_of(spark, "Only if:\n\n- sealed\n- cold\n\nnext\n")] == ["Only if:\n\n- sealed\n- cold", "next"]


def test_quality_gate_codes(spark):
    rows = spark.createDataFrame([(1, b"\xff\xfe"), (2, b"  \n"), (3, ("a" * 10 + "�").encode()), (4, b"fine")], "doc_id long, text binary")
    got = {r["doc_id"]: r["error_code"] for r in structure.quality_gate(rows).collect()}
    assert got == {1: "invalid_utf8", 2: "empty_content", 3: "replacement_character_ratio_high", 4: None}


def reference_ranges(value, max_chars, budget):
    """Brute force on positions, written from the rule in words."""
    ends = sorted({0, len(value), *(m.end() for m in re.finditer(r"(?<=[。！？])|(?<=[.!?])\s+|\n", value))})
    tokens = [m.end() for m in re.finditer(r"[㐀-鿿]|[A-Za-z]+|\d+|[^\s]", value)]
    out, at = [], 0
    while at < len(value):
        rest = [e for e in tokens if e > at]
        limit = min(at + max_chars, rest[budget - 1] if len(rest) >= budget else len(value))
        reach = [e for e in ends if at < e <= limit]
        end, forced = (max(reach), False) if reach else (limit, limit < len(value))
        if forced:
            blank = value.rfind(" ", at + max_chars // 2, end)
            end = blank + 1 if blank > at else end
        out.append((at, end, forced or at not in ends))
        at = end
    return [r for r in out if value[r[0]:r[1]].strip()]


def test_pieces_equal_brute_force(spark):
    texts = ["One. Two! Three? " * 12, "word " * 60 + "end. Tail is here.", "x" * 95 + ". Next one. " + "y " * 50, "储存条件。" * 30 + "ab cd " * 20, "short", "a.\n\nb. " * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in structure.chunk_ranges(rows, max_chars=40, max_tokens=12).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r["doc_id"], []).append((r["piece_start"], r["piece_end"], r["partial"]))
    for i, text in enumerate(texts):
        assert got[i] == reference_ranges(text, 40, 12), text[:30]


def test_table_rows_keep_escaped_pipes_and_cut_long_rows(spark):
    text = "h|v\n---|---\na\\|b|1\n" + "c" * 30 + "|" + "d" * 30
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
    cells = [(r["row_index"], r["column_index"], r["text"]) for r in structure.table_cells(rows, ["doc_id"]).orderBy("row_index", "column_index").collect()]
    assert cells[:2] == [(1, 0, "a\\|b"), (1, 1, "1")]
    pieces = structure.table_rows(rows, ["doc_id"], max_chars=43).orderBy("row_index", "piece_no").collect()
    assert [p["continuation"] for p in pieces] == [False, True, True] and "".join(p["row_piece"] for p in pieces[1:]) == "c" * 30 + "|" + "d" * 30


def test_product_columns_become_facts_or_go_to_review(spark):
    tables = spark.createDataFrame([(1, "p|A1|B2\n---|---|---\nweight|1|2"), (2, "p|A1|unit|B2\n---|---|---|---\nweight|1|kg|2")], "doc_id int, text string")
    cells = structure.table_cells(tables, ["doc_id"])
    named = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 3, "b")], "doc_id int, column_index int, entity_id string")
    facts, review = structure.unpivot_product_columns(cells, named, ["doc_id"])
    assert sorted(r["text"] for r in facts.collect()) == ["A1 | weight | 1", "B2 | weight | 2"]
    assert [r["doc_id"] for r in review.collect()] == [2]


def test_clauses_split_only_if_each_names_an_entity(spark):
    rows = spark.createDataFrame([(1, "A1 is red; B2 is blue."), (2, "A1 is red; it shines."), (3, "- one\n- two")], "doc_id int, text string")
    counts = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 0)], "doc_id int, clause_no int, n int")
    got = {}
    for r in structure.split_facts(rows, ["doc_id"], counts).orderBy("doc_id", "fact_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"].strip())
    assert got == {1: ["A1 is red;", "B2 is blue."], 2: ["A1 is red; it shines."], 3: ["- one", "- two"]}


def test_repeated_equal_headings_stay_separate_sections(spark):
    v = "c72ec9bf-67c6-540f-b008-8698e3f57210"
    rows = [(v, 0, ["A"], ["h0"], "x"), (v, 1, ["A"], ["h0"], "y"), (v, 2, ["A"], ["h9"], "z")]
    chunks = spark.createDataFrame(rows, "version_id string, ordinal int, title_path array<string>, heading_marks array<string>, source_text string")
    tree_rows, owners = structure.sections(chunks)
    content = sorted(r["content"] for r in tree_rows.collect())
    assert content == ["", "x\n\ny", "z"] and owners.select("section_id").distinct().count() == 2


def test_list_parents_and_footnotes(spark):
    rows = spark.createDataFrame([(1, "- a\n  - b\n    - c\n  - d\n- e")], "doc_id int, text string")
    assert [r["parent_no"] for r in tree.list_items(rows, ["doc_id"]).orderBy("item_no").collect()] == [None, 0, 1, 0, None]
    nodes = spark.createDataFrame([(1, "n1", "paragraph", "see [^a] and [^b] and [^c]"), (1, "n2", "footnote", "[^a]: yes"), (1, "n3", "footnote", "[^c]: x"), (1, "n4", "footnote", "[^c]: y")],
                                  "doc_id int, node_key string, kind string, text string")
    links, issues = tree.footnote_links(nodes)
    assert [r["source_key"] for r in links.collect()] == ["n2"] and sorted(r["label"] for r in issues.collect()) == ["b", "c"]


def test_closure_stops_at_depth_three_and_reports_cycles(spark):
    edges = [(1, i, i + 1, "governed_by", True) for i in range(5)] + [(2, 0, 1, "governed_by", True), (2, 1, 0, "governed_by", True), (3, 9, 0, "header_for", True)]
    got = {(r["doc_id"], r["main"]): (list(r["node_keys"]), r["issue"]) for r in tree.required_closure(
        spark.createDataFrame(edges, "doc_id int, source_key int, target_key int, type string, required boolean")).collect()}
    assert got[(1, 0)] == ([1, 2, 3], "dependency_closure_limit") and got[(1, 2)] == ([3, 4, 5], None)
    assert got[(2, 0)][1] == "dependency_cycle" and got[(3, 0)] == ([9], None)


def test_digest_ignores_row_order(spark):
    nodes = spark.createDataFrame([(1, "a", None, "document", "x"), (1, "b", "a", "paragraph", "y")], "doc_id int, node_key string, parent_key string, kind string, text string")
    edges = spark.createDataFrame([(1, "a", "b", "parent_of")], "doc_id int, source_key string, target_key string, type string")
    first = tree.graph_digest(nodes, edges).first()["digest"]
    assert first == tree.graph_digest(nodes.orderBy(F.desc("node_key")).repartition(3), edges).first()["digest"]
    assert first != tree.graph_digest(nodes.withColumn("text", F.lit("z")), edges).first()["digest"]
