"""Mixing sources to target weights (operator 10) by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import ROW, broadcast_small, cut, read, whole, with_row, without_row

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
SEED = 611
BINS = 1 << 16


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit("[^ \\t-\\r]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``): the total is shared by weight, no source above ``max_copies`` times its size.

    What a source cannot take is shared again by weight among the others until none is above its limit. That ends at
    ``min(limit, weight * level)`` for one common level, found from sums over the sources in order of limit / weight. The
    two windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))) \
        .withColumn("most", F.col("source_size") * F.lit(max_copies))
    every, upward = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(total_share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least(common * F.col("weight"), F.col("most"))).drop("weight", "most", "level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, bins: int = BINS, **targets) -> DataFrame:
    """One row per row of ``docs`` (which carries ``_row``): ``_row``, id, source, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Every document gets the whole copies that its source's factor ``target / source_size`` allows for certain. The rest of
    the target is a sample without replacement: document i gets the inclusion probability ``p_i``, the factor's fraction
    times a number from 0.5 to 1.5 that grows with the document's size, and documents are taken in the order of random odds divided by
    inclusion odds, ``u / (1 - u) / (p / (1 - p))`` (Pareto sampling), until the words of the source are used up. ``u`` is a
    hash of seed, id and size, so reruns agree; ties go by id (null last), then ``_row``.

    The cut in the order is found without sorting a source in one task: words are summed per source and bin of the rank
    (pre-aggregated in every task), and only rows of the bin that holds the cut are numbered. A null source is a source of
    its own, last in order. A null text has size 0. A source of size 0 has target 0. An empty table gives no rows.
    """
    rows = cut(docs.select(ROW, F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    goals = broadcast_small(cut(source_targets(sums, **targets)))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.col("source_size") / F.col("n")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(0.99), F.col("fraction") * (F.col("size") / (F.col("size") + mean + 1.0) + 0.5)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("size").cast("string"))), 1, 13), 16, 10).cast("long")
    ranked = (
        rows.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
        .withColumn("whole", F.floor(factor)).withColumn("fraction", factor - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", p).withColumn("u", (drawn + F.lit(0.5)) / F.lit(float(1 << 52)))
        .withColumn("rank", F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p")))
        .withColumn("bin", F.floor(F.col("rank") * bins).cast("int"))
    )
    per_bin = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_bin.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))) \
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))) \
        .select(F.col("source").alias("edge_source"), F.col("bin").alias("edge"), "before")
    placed = ranked.join(broadcast_small(cut(edges)), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    in_order = Window.partitionBy("source").orderBy("rank", F.col("id").isNull(), "id", ROW).rowsBetween(Window.unboundedPreceding, -1)
    sure = placed.where(F.col("edge").isNull() | (F.col("bin") != F.col("edge"))).withColumn("extra", F.coalesce((F.col("bin") < F.col("edge")).cast("long"), F.lit(0)))
    near = placed.where(F.col("bin") == F.col("edge")).withColumn(
        "extra", (F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2 <= F.col("rest")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    return sure.unionByName(near).select(ROW, F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sample_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with their own columns."""
    tagged = with_row(docs)
    copies = cut(mix(tagged, **options).where("copies > 0").select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy"))
    return without_row(tagged.join(broadcast_small(copies), ROW))


def op10_source_mix(spark, d):
    return mix(with_row(read(spark, d, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_source_mix": op10_source_mix}
ORACLES = {"op10_source_mix": r"""
with r as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from r group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as most from s),
l as (select *, (sum(source_size::double) over () * 1.5::double - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from w),
g as (select *, least((select max(level) from l where level * weight <= most) * weight, most) as target from l),
f as (select r.doc_id, r.source, r.size, g.source_size, g.target, g.n, case when g.source_size > 0 then g.target / g.source_size else 0 end as factor from r join g on r.source is not distinct from g.source),
p as (select *, floor(factor)::bigint as whole, target - floor(factor) * source_size as rest,
    greatest(1e-9::double, least(0.99::double, (factor - floor(factor)) * (size / (size + source_size / n + 1.0::double) + 0.5::double))) as p,
    (('0x' || md5('611:' || doc_id || ':' || size)[1:13])::bigint + 0.5::double) / 4503599627370496.0::double as u from f),
k as (select *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) as rank from p),
o as (select *, coalesce(sum(size) over (partition by source order by rank, doc_id nulls last rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, size, source_size, target, ((whole + case when before + size / 2 <= rest then 1 else 0 end) * size)::bigint as taken from o
"""}
