"""Personal data (operator 5): spans by rule, and bootstrapped contextual extraction of further identifiers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ROW, SPACE_RUN, broadcast_small, cut, read, whole, with_row

# Fixed kinds and patterns. A quantifier is possessive, or a start is barred inside a run (unless the last match ended there), only where that leaves
# the leftmost greedy matches as they are; no pattern can then backtrack over a long run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
FOUND = "id"  # kind of a span that the method adds
CANDIDATE = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
MIN_DIGITS = 5
CONTEXT_CHARS = 64
ROUNDS = 3
MIN_SEEDS = 3  # different seed tokens that a pattern must have
CONFIDENCE = 0.85
BLOCK = 128


def running(array: Column) -> Column:
    """Inclusive running sums of a short array of integers."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all"))
    return F.aggregate(array, start, step, lambda s: s["all"])


def prefix_sums(df: DataFrame, name: str, numbers: str) -> DataFrame:
    """Adds column ``name``, the running sums of array column ``numbers``; in blocks, so that a long array is not copied once per element.

    Each step is a column of its own: inside a function of an element, an expression would be evaluated for every element.
    """
    df = df.withColumn("_b", F.when(F.size(numbers) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
                                                                        lambda b: running(F.slice(numbers, b * BLOCK + 1, BLOCK)))))
    df = df.withColumn("_n", F.when(F.size("_b") > 0, F.transform("_b", lambda b: F.element_at(b, -1))))
    df = df.withColumn("_n", F.when(F.size("_n") > 0, running(F.col("_n"))))
    sums = F.flatten(F.transform("_b", lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get("_n", k - 1), F.lit(0)))))
    return df.withColumn(name, F.when(F.size("_n") > 0, sums)).drop("_b", "_n")


def matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds column ``name``: the pattern's matches in ``_t`` as an array of (``m``, ``gap``, ``s``, ``e``), places in code points, end exclusive.

    The texts between matches come from a split by the same pattern, so places are running sums of lengths.
    """
    df = df.withColumn("_f", F.when(F.col("_maybe"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_f") > 0, F.split("_t", pattern, -1)))
    df = df.withColumn("_k", F.when(F.size("_f") > 0, F.transform("_f", lambda m, i: (F.char_length(m) + F.char_length(F.get("_g", i))).cast("long"))))
    df = prefix_sums(df, "_e", "_k")
    spans = F.transform("_f", lambda m, i: F.struct(m.alias("m"), F.get("_g", i).alias("gap"), (F.get("_e", i) - F.char_length(m)).alias("s"), F.get("_e", i).alias("e")))
    return df.withColumn(name, spans).drop("_f", "_g", "_k", "_e")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(F.split(F.reverse(number), "(?<=[0-9])(?=[0-9])"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.char_length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``_t``, the whole text) with ``base``: array of (``k``: number of the kind, ``s``, ``e``), by start, then kind."""
    docs = docs.withColumn("_maybe", F.col("_t").rlike("[0-9@]"))
    for kind in KINDS:
        docs = matches(docs, f"_{kind}", PATTERNS[kind])
    one = lambda k, kind: F.transform(F.filter(f"_{kind}", lambda x: valid(kind, x["m"])), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    return docs.withColumn("base", F.array_sort(F.concat(*[one(k, kind) for k, kind in enumerate(KINDS)]))).drop(*[f"_{k}" for k in KINDS])


def shape(token: Column) -> Column:
    """A token's form: digits 9, runs of letters a, marks at its ends dropped."""
    trimmed = F.regexp_replace(F.regexp_replace(token, "^[^\\p{L}0-9+@]++", ""), "(?<![^\\p{L}0-9])[^\\p{L}0-9]++$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "[0-9]", "9"), "\\p{L}++", "a")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row``, ``id``, ``base`` and ``near``: tokens with many digits or an @, with their places and the word to their left. Stored once."""
    rows = base_spans(docs.select(ROW, F.col(id_col).alias("id"), whole(text_col).alias("_t")))
    rows = matches(rows, "_c", CANDIDATE)
    wanted = F.filter("_c", lambda x: (F.char_length(digits(x["m"])) >= MIN_DIGITS) | x["m"].contains("@"))
    left = lambda gap: F.lower(F.element_at(F.split(F.btrim(F.right(gap, F.lit(CONTEXT_CHARS)), F.lit(" \t\n\x0b\x0c\r")), SPACE_RUN), -1))
    near = F.transform(wanted, lambda x: F.struct(x["m"].alias("token"), left(x["gap"]).alias("left"), x["s"].alias("s"), x["e"].alias("e")))
    return cut(rows.select(ROW, "id", "base", near.alias("near")))


def high_confidence(occurrences: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns (left word and form) whose instances are identifiers, from a graph of patterns and tokens.

    Tokens that hold a base span are seeds with score 1. Each round scores every pattern by the mean score of its different tokens (one
    doubtful token is added to each), and every other token by the chance that not all of its patterns are wrong, ``1 - prod(1 - score)``,
    over patterns with at least ``min_seeds`` seeds. Edges are distinct pairs, reduced in every task before they are shuffled, so copies of a document count once.
    """
    edges = cut(occurrences.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    scores = None
    for _ in range(rounds):
        known = edges.withColumn("score", F.col("seed").cast("double")) if scores is None else \
            edges.join(scores, "token", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("other", F.lit(0.0)))).drop("other")
        patterns = cut(known.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1.0)).alias("c"), F.count_if("seed").alias("seeds")).where(F.col("seeds") >= min_seeds))
        scores = edges.where("not seed").join(patterns, "pattern").groupBy("token").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("other"))
    return patterns.where(F.col("c") >= confidence).select("pattern", "c")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` (which carries ``_row``): the id, counts per kind, and the spans as arrays ``base`` and ``spans``.

    ``base`` holds the spans of the fixed patterns; ``spans`` adds tokens in high-confidence contexts that touch none of them (kind
    ``id``). Places are code points. A null text is empty; a text without digits and @ has no spans. An empty table gives no rows.
    """
    marks = marked(docs, id_col, text_col)
    inside = lambda x: F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    begins = lambda x: F.exists("base", lambda b: (b["s"] >= x["s"]) & (b["s"] < x["e"]))
    rows = marks.select(ROW, "base", F.explode("near").alias("x")).withColumn("touched", inside(F.col("x"))).withColumn("seed", begins(F.col("x"))) \
        .where("seed or not touched").select(ROW, "seed", F.concat_ws(" ", "x.left", shape(F.col("x.token"))).alias("pattern"), "x.token", "x.s", "x.e")
    occurrences = cut(rows)
    sure = broadcast_small(cut(high_confidence(occurrences, **options)))
    new = F.struct("s", F.lit(len(KINDS)).alias("k"), "e")
    found = occurrences.where("not seed").join(sure, "pattern").groupBy(ROW).agg(F.collect_list(new).alias("new"))
    every = marks.join(found, ROW, "left").withColumn("spans", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return every.select(ROW, F.col("id").alias(id_col), *counts, "base", "spans")


def op5_personal_data(spark, d):
    rows = find(with_row(read(spark, d, "documents")))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op5_personal_data": op5_personal_data}
ORACLES: dict[str, str] = {}
