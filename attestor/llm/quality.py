"""Quality rules (operator 8): a ledger of failure bits and measurements, policies over it, and ablations. DataFrame functions only.

Every rule is evaluated once per document. Policies are masks over the bits, so a new version of a policy, or leaving one rule out,
never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import SPACE_RUN, cut, read, whole

# Rule name -> condition over the measurements that fails a document. The order gives the bits and is part of the ledger's format.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "capitals": "2 * n_upper > word_chars",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_words")
# Policy versions: the rules whose failure drops a document.
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols"), "v3": (*BASE, "symbols", "capitals", "repeated_lines", "long_words", "short_words")}
CURRENT = "v3"

LOW31 = (1 << 31) - 1


def mask_of(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_m`` of measurements, all made in the row.

    Words in repeated 3-word windows: each window's hash is packed with its position into one number and the numbers are
    sorted, so equal hashes stand together; only windows with an equal hash are then compared as text. Covered words are counted
    from the sorted positions. The work per document is that of a sort, whatever the text repeats.
    """
    body = docs.select(F.struct("*").alias("_doc"), whole(text_col).alias("_t"))
    split = F.split(F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")), SPACE_RUN)
    body = body.withColumn("_w", split).withColumn("_n", F.when((F.size("_w") == 1) & (F.element_at("_w", 1) == ""), 0).otherwise(F.size("_w")))
    word = lambda i: F.get("_w", i)
    packed = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(~LOW31).bitwiseOR(i.cast("long")))
    body = body.withColumn("_p", F.when(F.col("_n") > 3, F.sort_array(packed)))
    same = lambda x, y: F.shiftright(x, 31) == F.shiftright(y, 31)
    beside = F.filter("_p", lambda x, j: F.coalesce(same(x, F.get("_p", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_p", j + 1)), F.lit(False)))
    body = body.withColumn("_c", F.when(F.col("_n") > 3, F.transform(beside, lambda x: x.bitwiseAND(LOW31).cast("int"))))
    grams = F.sort_array(F.transform("_c", lambda p: F.struct(F.concat_ws(" ", word(p), word(p + 1), word(p + 2)).alias("g"), p.alias("p"))))
    body = body.withColumn("_g", F.when(F.size("_c") > 0, grams))
    twice = F.filter("_g", lambda x, j: F.coalesce(x["g"] == F.get("_g", j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_g", j + 1)["g"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(3), p - s["last"])).alias("total")), lambda s: s["total"])
    lines = body.withColumn("_r", F.when(F.col("_g").isNotNull(), covered).otherwise(F.lit(0).cast("long"))) \
        .withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    chars = F.char_length("_t")
    return lines.select("_doc", F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", SPACE_RUN, "")).cast("long").alias("word_chars"),
        (chars - F.char_length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"),
        (chars - F.char_length(F.regexp_replace("_t", "\\p{Lu}+", ""))).cast("long").alias("n_upper")).alias("_m"))


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the measurements and ``fail_bits``; no shuffle.

    The rows are stored (a checkpoint on shared storage), so that a filter on a bit is never pushed into the measuring
    expressions and no policy evaluates a rule again. A null text has no words, like an empty one. Other columns are ignored. An empty table gives no rows.
    """
    rows = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return cut(rows.select(F.col("_doc.id").alias(id_col), "_m.*").withColumn("fail_bits", fail_bits()))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Ledger rows with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(mask_of(POLICIES[policy])) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT, by: list[str] | None = None) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it drops, and that the policy keeps without it.

    The ledger is first reduced to counts per group and bit pattern, at most two to the number of rules each; all else is
    arithmetic on those patterns.
    """
    by, mask = by or [], mask_of(POLICIES[policy])
    patterns = rows.groupBy(*by, F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = patterns.select("*", rules.alias("r")).select(*by, "bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy(*by, "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits"))


def op8_quality_ledger(spark, d):
    rows = apply_policy(ledger(read(spark, d, "documents")))
    base = F.col("fail_bits").bitwiseAND(mask_of(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits", "n_lines", "n_upper")


QUERIES = {"op8_quality_ledger": op8_quality_ledger}
ORACLES = {"op8_quality_ledger": r"""
with d as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from d),
k as (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from k where c > 1) group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
m as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
    (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::bigint as n_upper from d join l using (doc_id) left join r using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 4 * n_symbols > n_words then 4 else 0 end
    + case when 2 * n_upper > word_chars then 8 else 0 end + case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 16 else 0 end
    + case when word_chars > 20 * n_words then 32 else 0 end + case when word_chars < 2 * n_words then 64 else 0 end)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits, n_lines, n_upper from b
"""}
