"""URL filters (operator 4): fixed host and path rules, then association rules mined from labels. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from string import ascii_lowercase, ascii_uppercase

from attestor.llm.common import ROW, broadcast_small, cut, read, with_row

# Fixed rules: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

BAD = "label=bad"
MIN_PAGES = 20
MIN_CONFIDENCE = 0.75
MIN_LIFT = 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (``rule``, ``verdict``); null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host suffixes, host labels, path segments with digits made 0, extension, query keys, fragment."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, -k, k), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    rest = F.array_compact(F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))), F.when(url.contains("#"), F.lit("fragment"))))
    every = F.concat(rest, F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), F.transform(labels, lambda x: F.concat(F.lit("label="), x)), segments, keys)
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules ``items -> bad`` from rows with ``items`` and ``bad``: ``rule_id``, ``items``, ``confidence``, ``pages``, ``anchor``.

    FP-growth finds token sets that are frequent together with the bad label, from ``min_pages`` pages on, however many are labelled.
    Rules below the confidence, the lift or the number of pages go, and so do rules that a more general rule with at least their
    confidence makes needless; all rules are held against each other. A token of every page is left out before: it never makes a rule,
    and a rule with it is needless. ``anchor`` is the rule's rarest token, under which it is indexed.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, items array<string>, confidence double, pages long, anchor string")
    rows = cut(labelled.select("items", "bad"))
    total, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not bad:
        return empty
    counts = cut(rows.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq")))
    constant = [r["item"] for r in counts.where(F.col("freq") == total).select("item").collect()]  # tokens of one url at most
    telling = F.array_except("items", F.array(*[F.lit(x) for x in constant]).cast("array<string>"))
    with_label = rows.select(F.when(F.col("bad"), F.array_append(telling, F.lit(BAD))).otherwise(telling).alias("items"))
    # Half a page less, so that rounding cannot raise the least count.
    model = FPGrowth(itemsCol="items", minSupport=max(min_pages - 0.5, 0) / total).fit(with_label)
    sets = cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    joint = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.col("freq") >= min_pages)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("pages"))
    found = cut(joint.join(sets, "items").withColumn("confidence", F.col("pages") / F.col("freq"))
                .where((F.col("confidence") >= min_confidence) & (F.col("confidence") / (bad / total) >= min_lift)).select("items", "confidence", "pages"))
    subsets = found.select(F.explode("items").alias("dropped"), "*").select("items", "confidence", F.array_remove("items", F.col("dropped")).alias("general"))
    needless = subsets.join(found.select(F.col("items").alias("general"), F.col("confidence").alias("c")), "general").where("c >= confidence").select("items").distinct()
    kept = found.join(needless, "items", "left_anti")
    rarest = kept.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min(F.struct("freq", "item")).alias("least"))
    return cut(kept.join(rarest, "items").select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "pages", F.col("least.item").alias("anchor")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", fixed=RULES) -> DataFrame:
    """One row per row of ``pages`` (which carries ``_row``): id, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (the best mined rule).

    Fixed rules decide first. Any other url is blocked if a mined rule fits: each of its tokens looks up the rules anchored
    there, and a rule fits if the url has all its tokens. A null url, or one without ``://``, has an empty host and path and is allowed.
    An empty table gives no rows.
    """
    url = F.col(url_col)
    rows = pages.select(ROW, F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut(rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed)).withColumn("items", F.when(F.col("fixed").isNull(), tokens(F.col("url"), F.col("host"), F.col("path")))).drop("url"))
    index = broadcast_small(rules.select("anchor", F.col("items").alias("needs"), "confidence", "rule_id"))
    hits = rows.select(ROW, "items", F.explode("items").alias("anchor")).join(index, "anchor").where(F.size(F.array_except("needs", "items")) == 0)
    best = hits.groupBy(ROW).agg(F.max(F.struct("confidence", "rule_id", F.array_join("needs", " ").alias("text"))).alias("best"))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(best, ROW, "left").select(ROW, F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("best.text").alias("mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens and label of pages whose url names a labelled document by its number; bad means low quality or toxic."""
    url = F.col("url")
    number = F.regexp_extract(F.col("path"), "/([0-9]{1,18})(?:[./]|$)", 1)
    rows = pages.select(url, host_of(url).alias("host"), path_of(url).alias("path")).withColumn("doc_id", F.when(number != "", number).cast("long"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where(F.col("bad").isNotNull())
    return rows.join(marked, "doc_id").select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), "bad")


def op4_url_rules(spark, d):
    pages = read(spark, d, "pages")
    rules = mine(labelled_pages(pages, read(spark, d, "labels")))
    return judge(with_row(pages), rules).select("page_id", "host", "path", "rule", "verdict", "mined")


QUERIES = {"op4_url_rules": op4_url_rules}
ORACLES: dict[str, str] = {}
