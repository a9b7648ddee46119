"""Texts to lines, headings, blocks, pieces, tables and sections.

Input is a table of texts. A text is exploded to lines once; every rule below is a window over the
lines of one document or a fold inside one row, so documents are processed in parallel and a document is
never larger than the record it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.digests import uuid5

# --- Fixed values: patterns and limits that must equal the reference's. ---------------
ATX = r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
SETEXT_UNDERLINE = r"^\s*(?:={3,}|-{3,})\s*$"
NUMBERED = r"^((?:[IVX]{1,6}|[A-Z]|\d{1,2}(?:\.\d{1,2})*)[.、)]|第[一二三四五六七八九十\d]+章)\s+(.{2,160})\s*$"
NUMBERED_VETO = r"(?i)[。；;!?！？]|(?:RMB\s*\d|\d\s*(?:V\b|kg\b|g\b|元|天|小时))|[:：]\s*\d"
FENCE = r"^\s*(?:```|~~~)"
LIST_START = r"^\s*(?:[-*+]\s|\d+[.)]\s)"
LIST_BLOCK = r"^\s*(?:[·•*+\-]\s|\d+[.)]\s)"
TABLE_RULE = r"^\s*\|?[\s:|\-]+\|?\s*$"
CELL = r"(?:\\.|[^|])+"
SENTENCE_TOKEN = r"[㐀-鿿]|[A-Za-z]+|\d+|[^\s]"
MAX_CHARS, MAX_TOKENS, MAX_FACTS, MAX_DEPTH = 1200, 320, 10000, 16
# -----------------------------------------------------------------------------------------


def quality_gate(texts: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """B1: error code for invalid UTF-8, empty text, or more than 1 % replacement characters."""
    body = F.col(column)
    if dict(texts.dtypes)[column] == "binary":
        body = F.try_validate_utf8(body.cast("string"))
    ratio = F.regexp_count(body, F.lit("�")) / F.greatest(F.length(body), F.lit(1))
    code = (
        F.when(body.isNull(), "invalid_utf8").when(F.length(tx.strip(body)) == 0, "empty_content")
        .when(ratio > 0.01, "replacement_character_ratio_high")
    )
    return texts.select(id_col, code.isNull().alias("ok"), code.alias("error_code"))


def is_markdown(text: Column, name: Column | None = None, text_mode: Column | None = None) -> Column:
    """B2: by file name, by two ATX headings, by a heading before a blank line, or by a setext underline."""
    by_text = (
        (F.regexp_count(text, F.lit(r"(?m)^ {0,3}#{1,6}\s+\S")) >= 2)
        | text.rlike(r"(?m)^#{1,6}\s+.+\n\s*\n") | text.rlike(r"(?m)^[^\n|]{1,160}\n(?:={3,}|-{3,})\s*$")
    )
    named = F.lower(name).rlike(r"\.(?:md|markdown)$") if name is not None else F.lit(False)
    plain = text_mode.eqNullSafe(F.lit("plain")) if text_mode is not None else F.lit(False)
    return ~plain & (named | by_text)


def lines(texts: DataFrame, id_col: str = "doc_id", column: str = "text", markdown: Column | None = None) -> DataFrame:
    """``doc_id, line_no, line, start, markdown``; ``start`` is the character offset of the line."""
    mark = is_markdown(F.col(column)) if markdown is None else markdown
    exploded = texts.select(F.col(id_col).alias("doc_id"), mark.alias("markdown"),
                            F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return exploded.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def mark_lines(line_rows: DataFrame) -> DataFrame:
    """Every line with its role: heading (depth, title), consumed underline, or body.

    Inside a fence nothing is a heading. Of consecutive lines that could each be a setext title, every
    second one is the underline of the one before it.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stripped = tx.strip(F.col("line"))
    fence = F.col("markdown") & F.col("line").rlike(FENCE)
    rows = line_rows.withColumn("fenced", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1)
    could = (
        F.col("markdown") & ~F.col("fenced") & (F.length(stripped) > 0) & (F.length(stripped) <= 160)
        & ~F.col("line").rlike(FENCE) & ~F.contains("line", F.lit("|"))
        & F.coalesce(F.lead("line").over(order).rlike(SETEXT_UNDERLINE), F.lit(False))
    )
    rows = rows.withColumn("could", could)
    last_other = F.coalesce(F.max(F.when(~F.col("could"), F.col("line_no"))).over(before), F.lit(-1))
    rows = rows.withColumn("setext", F.col("could") & ((F.col("line_no") - last_other - 1) % 2 == 0))
    rows = rows.withColumn("underline", F.coalesce(F.lag("setext").over(order), F.lit(False)))
    open_line = ~F.col("fenced") & ~F.col("underline") & ~F.col("setext")
    atx = open_line & F.col("markdown") & F.col("line").rlike(ATX)
    number, body = F.regexp_extract("line", NUMBERED, 1), F.regexp_extract("line", NUMBERED, 2)
    numbered = open_line & ~atx & F.col("line").rlike(NUMBERED) & ~body.rlike(NUMBERED_VETO)
    depth = (
        F.when(F.col("setext"), F.when(F.contains(F.lead("line").over(order), F.lit("=")), 1).otherwise(2))
        .when(atx, F.length(F.regexp_extract("line", ATX, 1)))
        .when(numbered, F.when(number.rlike("^(?:[IVX]|第)"), 1).otherwise(1 + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))))
    )
    title = F.when(atx, F.regexp_extract("line", ATX, 2)).when(F.col("setext") | numbered, stripped)
    return rows.withColumn("depth", depth.cast("int")).withColumn("title", title).drop("could", "setext")


def headings(marked: DataFrame) -> DataFrame:
    """B3 output: ``doc_id, line_no, depth, title, start, end`` of each heading."""
    at = F.col("start") + F.instr("line", F.col("title")) - 1
    return marked.where(F.col("depth").isNotNull()).select(
        "doc_id", "line_no", "depth", "title", at.alias("start"), (at + F.length("title")).alias("end"))


def heading_paths(marked: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``doc_id, line_no, path``: the stack of open headings at each heading.

    The stack is cut by position, so a skipped level closes up: the effective level is
    ``t + min(0, min(depth - t))`` with ``t`` the running number of the heading.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    h = marked.where(F.col("depth").isNotNull()).withColumn("t", F.row_number().over(order))
    h = h.withColumn("level", F.col("t") + F.least(F.lit(0), F.min(F.col("depth") - F.col("t")).over(order)))
    slots = [
        F.last(F.when(F.col("level") <= k, F.when(F.col("level") == k, F.col("title")).otherwise("")), ignorenulls=True).over(order)
        for k in range(1, max_depth + 1)
    ]
    path = F.filter(F.array(*slots), lambda x: x.isNotNull() & (x != ""))
    return h.select("doc_id", "line_no", "depth", "level", "title", path.alias("path"))


def deep_headings(marked: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """B5 violations ``doc_id, line_no, code``: headings below the deepest allowed level; their version fails instead of losing titles."""
    return heading_paths(marked, max_depth).where(F.col("level") > max_depth).select("doc_id", "line_no", F.lit("heading_depth_limit").alias("code"))


def blocks(marked: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """B4 + B5: ``doc_id, block_no, text, start, end, title_path, markdown``.

    A blank line outside a fence ends a block, unless the block so far ends with a colon and a list follows.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    blank = F.length(tx.strip(F.col("line"))) == 0
    head = F.col("depth").isNotNull() | F.col("underline")
    rows = marked.withColumn("blank", blank & ~F.col("fenced") & ~head).withColumn("head", head)
    rows = rows.withColumn("previous", F.last(F.when(~blank, F.struct("line", "head")), ignorenulls=True).over(before))
    rows = rows.withColumn("following", F.last(F.when(~blank, F.col("line")), ignorenulls=True).over(after))
    keeps = (
        F.coalesce(~F.col("previous.head") & tx.strip(F.col("previous.line")).rlike("[:：]$"), F.lit(False))
        & F.coalesce(F.col("following").rlike(LIST_START), F.lit(False))
    )
    rows = rows.withColumn("breaks", F.col("head") | (F.col("blank") & ~keeps))
    rows = rows.withColumn("island", F.sum(F.col("breaks").cast("int")).over(order))
    paths = heading_paths(marked, max_depth).select("doc_id", "line_no", F.col("path").alias("own_path"))
    rows = rows.join(paths, ["doc_id", "line_no"], "left")
    rows = rows.withColumn("title_path", F.coalesce(
        F.last("own_path", ignorenulls=True).over(order), F.expr("cast(array() as array<string>)")))
    body = rows.where(~F.col("breaks")).groupBy("doc_id", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"),
        F.min("start").alias("raw_start"), F.first("title_path").alias("title_path"), F.first("markdown").alias("markdown"),
        F.min("line_no").alias("line_no"))
    body = body.withColumn("text", tx.strip(F.col("raw"))).where(F.length("text") > 0)
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    number = Window.partitionBy("doc_id").orderBy("island")
    start = F.col("raw_start") + lead
    return body.select("doc_id", F.row_number().over(number).alias("block_no"), "line_no", "text", start.alias("start"),
                       (start + F.length("text")).alias("end"), "title_path", "markdown")


def is_table(text: Column) -> Column:
    parts = F.split(text, "\n")
    return (F.size(parts) > 2) & F.contains(F.get(parts, F.lit(0)), F.lit("|")) & F.get(parts, F.lit(1)).rlike(TABLE_RULE)


def block_kind(text: Column) -> Column:
    """Table, code, footnote, list or paragraph by the leading pattern."""
    return (
        F.when(is_table(text), "table").when(text.rlike(FENCE), "code").when(text.rlike(r"^\s*\[\^[^]]+\]:"), "footnote")
        .when(text.rlike(LIST_BLOCK), "list").otherwise("paragraph")
    )


def _offsets(pieces: Column) -> Column:
    """Running end offset of each piece of a short array."""
    return F.aggregate(pieces, F.expr("cast(array() as array<int>)"), lambda acc, p: F.concat(
        acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(p)).cast("int"))))


def chunk_ranges(block_rows: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces of at most ``max_chars`` characters and ``max_tokens`` lexical tokens, cut at sentence or line ends.

    ``piece_start, piece_end`` are relative to the block. Where no end lies in reach, the cut falls after the
    last blank of the second half, or at the limit; that piece and one starting inside a sentence are partial.
    Most blocks fit whole and skip the fold; the fold walks one block inside its row.
    """
    token = r"(?>\s*(?:[㐀-鿿]|[A-Za-z]+|\d+|\S))"
    whole = (F.length("text") <= max_chars) & (F.regexp_count("text", F.lit(SENTENCE_TOKEN)) <= max_tokens)
    sentences = F.filter(F.regexp_extract_all(
        "text", F.lit(r"(?s).*?(?:[。！？]|[.!?]\s+|\n|$)"), F.lit(0)), lambda x: x != "")
    rows = block_rows.withColumn("whole", whole).withColumn("ends", F.when(~F.col("whole"), _offsets(sentences)))
    size = F.length("text")
    turns = F.sequence(F.lit(1), (2 * F.ceil(size / min(max_chars // 2, max_tokens)) + 2).cast("int"))
    range_type = "array<struct<start:int,end:int,partial:boolean>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {range_type})").alias("out"))

    def cut(at: Column) -> Column:
        # each intermediate value is bound once; a lambda would otherwise evaluate it per boundary
        text, ends = F.col("text"), F.col("ends")
        head = F.length(F.regexp_extract(F.substring(text, at + 1, size), r"(?s)^" + token + "{%d}" % max_tokens, 0))
        limit = tx.let(head, lambda h: F.least(at + max_chars, F.when(h > 0, at + h).otherwise(size), size))
        half = at + max_chars // 2

        def place(maximum: Column) -> Column:
            reach = F.array_max(F.filter(ends, lambda e: (e > at) & (e <= maximum)))
            tail = F.when(maximum > half, F.substring(text, half + 1, maximum - half)).otherwise(F.lit(""))
            blank = tx.let(F.instr(F.reverse(tail), F.lit(" ")), lambda b: F.when(b > 0, maximum - b + 1))
            inside = (at > 0) & ~F.array_contains(ends, at)
            return tx.let(reach, lambda r: F.struct(
                at.cast("int").alias("start"),
                F.coalesce(r, F.when(maximum < size, F.coalesce(blank, maximum)).otherwise(maximum)).cast("int").alias("end"),
                ((r.isNull() & (maximum < size)) | inside).alias("partial")))

        return tx.let(limit, place)

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["at"] >= size, acc).otherwise(tx.let(
            cut(acc["at"]),
            lambda r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(r)).alias("out"))))

    ranges = F.when(F.col("whole"), F.array(F.struct(
        F.lit(0).alias("start"), F.length("text").cast("int").alias("end"), F.lit(False).alias("partial")))).otherwise(
        F.aggregate(turns, start, step, lambda acc: acc["out"]))
    return rows.select(*block_rows.columns, F.posexplode(ranges).alias("piece_no", "r")).select(
        *[F.col(c) for c in block_rows.columns if c not in ("start", "end", "text")], "piece_no",
        F.col("r.start").alias("piece_start"), F.col("r.end").alias("piece_end"), F.col("r.partial").alias("partial"),
        F.substring("text", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"),
    ).where(F.length(tx.strip(F.col("text"))) > 0)


def fact_limit(facts: DataFrame, limit: int = MAX_FACTS) -> DataFrame:
    """Versions with more than ``limit`` facts, which fail whole. Counting is pre-aggregated per task."""
    return facts.groupBy("version_id").agg(F.count("*").alias("facts")).where(F.col("facts") > limit)


# --- tables ------------------------------------------------------------------------------


def table_cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row_index, column_index, label, text, row_text, header`` for each non-blank body cell.

    An escaped pipe stays in its cell. Row 1 is the first row after the rule line.
    """
    parts = F.split("text", "\n")
    header = F.regexp_replace(F.concat(F.get(parts, F.lit(0)), F.lit("\n"), F.get(parts, F.lit(1))), r"[\r\n]+$", "")
    rows = tables.where(is_table(F.col("text"))).select(
        *keys, header.alias("header"), F.get(parts, F.lit(0)).alias("header_line"),
        F.posexplode(F.slice(parts, F.lit(3), F.size(parts))).alias("r", "row_text"))
    cells = rows.select(*keys, "header", "header_line", (F.col("r") + 1).alias("row_index"), "row_text", F.posexplode(
        F.regexp_extract_all("row_text", F.lit(CELL), F.lit(0))).alias("column_index", "text"))
    return cells.where(F.length(tx.strip(F.col("text"))) > 0).withColumn(
        "label", F.when(F.col("column_index") == 0, "table_row_label").otherwise("table_cell"))


def table_rows(tables: DataFrame, keys: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """Each body row becomes its own fact, header plus row; an overlong row is cut at cells and marked continuation."""
    parts = F.split("text", "\n")
    header = F.regexp_replace(F.concat(F.get(parts, F.lit(0)), F.lit("\n"), F.get(parts, F.lit(1))), r"[\r\n]+$", "")
    rows = tables.where(is_table(F.col("text"))).select(
        *keys, header.alias("header"), F.posexplode(F.slice(parts, F.lit(3), F.size(parts))).alias("r", "row_text"))
    room = F.greatest(F.lit(1), F.lit(max_chars) - F.length("header") - 1)
    # cells with the pipe that follows them; a cell longer than the room is cut by length
    cells = F.regexp_extract_all("row_text", F.lit(r"(?s).*?(?:(?<!\\)\||$)"), F.lit(0))
    atoms = F.flatten(F.transform(F.filter(cells, lambda c: c != ""), lambda c: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / room) - 1).cast("int")),
        lambda i: F.substring(c, (i * room + 1).cast("int"), room.cast("int")))))
    pieces = F.aggregate(atoms, F.expr("cast(array() as array<string>)"), lambda acc, a: F.when(
        (F.size(acc) > 0) & (F.length(F.get(acc, F.size(acc) - 1)) + F.length(a) <= room),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.get(acc, F.size(acc) - 1), a)))
    ).otherwise(F.concat(acc, F.array(a))))
    whole = F.length("row_text") <= room
    return rows.select(
        *keys, (F.col("r") + 1).alias("row_index"), "header", (~whole).alias("continuation"),
        F.posexplode(F.when(whole, F.array("row_text")).otherwise(pieces)).alias("piece_no", "row_piece"),
    ).withColumn("text", F.concat_ws("\n", "header", "row_piece"))


def unpivot_product_columns(cells: DataFrame, header_entities: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One fact per (row, product column), and the tables that must go to review.

    ``header_entities(keys, column_index, entity_id)`` are catalog matches of header cells. Facts are built
    only where every column but the first names exactly one entity and no entity repeats.
    """
    header = cells.select(*keys, "header_line").distinct()
    columns = header.select(*keys, F.posexplode(F.transform(F.split(F.regexp_replace(F.trim("header_line"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)))
                            .alias("column_index", "column_name"))
    named = columns.join(header_entities, [*keys, "column_index"], "left").groupBy(*keys, "column_index", "column_name").agg(
        F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    shape = named.groupBy(*keys).agg(
        F.count("*").alias("width"), F.count_if(F.col("n") == 1).alias("products"), F.count_if((F.col("n") == 1) & (F.col("column_index") == 0)).alias("first"),
        F.count_distinct(F.when(F.col("n") == 1, F.col("entity_id"))).alias("entities"))
    multi = shape.where(F.col("products") >= 2)
    fine = (F.col("products") == F.col("width") - 1) & (F.col("first") == 0) & (F.col("entities") == F.col("products"))
    good = multi.where(fine).select(*keys)
    labels = cells.where("column_index = 0").select(*keys, "row_index", F.trim("text").alias("row_label"))
    values = cells.where("column_index > 0").select(*keys, "row_index", "column_index", F.trim("text").alias("value"))
    products = named.where("n = 1").join(good, keys, "left_semi").select(*keys, "column_index", "column_name", "entity_id")
    facts = values.join(products, [*keys, "column_index"]).join(labels, [*keys, "row_index"])
    counts = facts.groupBy(*keys, "row_index").agg(F.count("*").alias("filled")).join(shape.select(*keys, "products"), keys)
    complete = counts.where(F.col("filled") == F.col("products")).select(*keys, "row_index")
    facts = facts.join(complete, [*keys, "row_index"], "left_semi").select(
        *keys, "row_index", "column_index", "entity_id", F.concat_ws(" | ", "column_name", "row_label", "value").alias("text"))
    body_rows = cells.select(*keys, "row_index").distinct().join(multi.select(*keys), keys, "left_semi")
    review = body_rows.join(complete, [*keys, "row_index"], "left_anti").withColumn("review_reason", F.lit("table_alignment_missing"))
    return facts, review


def split_facts(block_rows: DataFrame, keys: list[str], entity_counts: DataFrame | None = None) -> DataFrame:
    """List items that start the block become facts; otherwise clauses, if each clause names an entity.

    ``entity_counts(keys, clause_no, n)`` gives the catalog entities per clause (clause cut as below); without
    it only lists split.
    """
    marks = r"(?m)^\s*(?:[·•*+\-]\s+|\d+[.)]\s+)"
    rows = block_rows.withColumn("marks", F.regexp_count("text", F.lit(marks))).withColumn(
        "is_list", (F.col("marks") > 1) & F.col("text").rlike(r"\A\s*(?:[·•*+\-]\s+|\d+[.)]\s+)"))
    items = F.filter(F.split("text", r"(?m)(?=^[ \t]*(?:[·•*+\-]\s+|\d+[.)]\s+))"), lambda x: F.length(tx.strip(x)) > 0)
    clauses = clause_array(F.col("text"))
    if entity_counts is None:
        by_clause = F.lit(False)
    else:
        named = entity_counts.groupBy(*keys).agg(
            F.min("n").alias("least"), F.sum("n").alias("total"))
        rows = rows.join(named, keys, "left")
        by_clause = ~F.col("is_list") & F.coalesce((F.col("least") > 0) & (F.col("total") > 1), F.lit(False)) & (F.size(clauses) > 1)
    parts = F.when(F.col("is_list"), items).when(by_clause, clauses).otherwise(F.array("text"))
    return rows.select(*keys, F.posexplode(parts).alias("fact_no", "text"))


def clause_array(text: Column) -> Column:
    """Clauses that end at a semicolon or after a sentence sign."""
    return F.filter(F.split(text, r"(?<=[;；])(?=[^\s;；])|(?<=[;；]\s)(?=\S)|(?<=[.!?。！？])(?=\s+\S)"), lambda x: F.length(tx.strip(x)) > 0)


# --- sections ------------------------------------------------------------------------------


def sections(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sections, chunk_sections)``.

    ``chunks(version_id, ordinal, title_path, heading_marks, source_text)``; ``heading_marks`` holds one
    string per level naming the physical heading, so repeated equal headings stay separate sections.
    A level opens a new section where the path up to it, or one of its headings, differs from the chunk before.
    """
    order = Window.partitionBy("version_id").orderBy("ordinal")
    rows = chunks.withColumn("last_path", F.coalesce(F.lag("title_path").over(order), F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("last_marks", F.coalesce(F.lag("heading_marks").over(order), F.expr("cast(array() as array<string>)")))
    differs = F.transform("title_path", lambda p, i: ~(
        F.coalesce(F.get("last_path", i) == p, F.lit(False))
        & (F.get("last_marks", i).isNull() | F.get("heading_marks", i).isNull() | (F.get("last_marks", i) == F.get("heading_marks", i)))))
    opened = F.array_position(differs, F.lit(True))  # first level that opens, 0 if none
    common = F.when(opened > 0, opened - 1).otherwise(F.size("title_path"))
    rows = rows.withColumn("common", common.cast("int"))
    # one row per level of each chunk; a level is opened by the latest chunk whose common prefix is shorter
    levels = rows.select("version_id", "ordinal", "title_path", "common", F.explode(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("title_path")))).alias("level"))
    levels = levels.where(F.col("level") <= F.size("title_path"))
    by_level = Window.partitionBy("version_id", "level").orderBy("ordinal")
    levels = levels.withColumn("opened_at", F.last(F.when(F.col("common") < F.col("level"), F.col("ordinal")), ignorenulls=True).over(by_level))
    named = lambda at, path: uuid5(F.col("version_id"), F.concat(F.lit("section:"), at.cast("string"), F.lit(":"), F.to_json(path)))
    root = uuid5(F.col("version_id"), F.lit("section:root"))
    levels = levels.withColumn("section_id", named(F.col("opened_at"), F.slice("title_path", F.lit(1), F.col("level"))))
    owner = levels.groupBy("version_id", "ordinal").agg(F.max_by("section_id", "level").alias("section_id"))
    chunk_sections = chunks.select("version_id", "ordinal", "source_text").join(owner, ["version_id", "ordinal"], "left").withColumn(
        "section_id", F.coalesce("section_id", root))
    content = chunk_sections.groupBy("version_id", "section_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("ordinal", "source_text"))), lambda x: x["source_text"]), "\n\n").alias("content"))
    by_chunk = Window.partitionBy("version_id", "ordinal").orderBy("level")
    opened_rows = levels.withColumn("parent_id", F.coalesce(F.lag("section_id").over(by_chunk), root)).where(
        F.col("opened_at") == F.col("ordinal"))
    tree = opened_rows.select("version_id", "section_id", "parent_id", "opened_at", "level",
                              F.slice("title_path", F.lit(1), F.col("level")).alias("title_path"))
    roots = chunks.select("version_id").distinct().select(
        "version_id", root.alias("section_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(-1).alias("opened_at"), F.lit(0).alias("level"), F.expr("cast(array() as array<string>)").alias("title_path"))
    number = Window.partitionBy("version_id").orderBy("opened_at", "level")
    full = tree.unionByName(roots).withColumn("ordinal", F.row_number().over(number) - 1)
    full = full.join(content, ["version_id", "section_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    return full.drop("opened_at"), chunk_sections.select("version_id", "ordinal", "section_id")
