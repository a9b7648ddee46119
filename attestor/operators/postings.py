"""Stored postings with positions and block bounds.

A term's postings are cut into blocks, one per knowledge base and range of ``RANGE`` neighbouring chunks. A block is one row, with its size,
highest count and shortest length, from which every request knows an upper bound for each range before a posting is read. A search scores
the most promising ranges first; ranges whose bound is below the k-th score found there are never read. Results are exact.

The table is partitioned by a hash of the term and sorted by it inside each range, so a search reads the files and pages of the asked terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.session import broadcast_bounded, fits_broadcast
from attestor.sources.stored import cut

K1, B = 1.2, 0.75
RANGE = 1024
SEEDS = 2  # ranges that a request scores first
BUCKETS = 8  # files of a task; a search reads those of its terms
RANGES_A_PART = 16  # ranges that one task writes in a large table
WORDS = 1_000_000  # tokens that are sorted at once
FEW_REQUESTS = 64
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
ROW_GROUP = 8 << 20  # bytes that each open file holds in memory
# Columns whose values seldom repeat inside a row group: looking each one up for a dictionary costs more than writing it.
PLAIN = {f"parquet.enable.dictionary#{column}": "false" for column in ("term", "range", "chunk_ids.list.element", "positions.list.element.list.element")}
TERMS_IN_FILTER = 64
LOCAL_ROWS = 200_000
DIRECT_RANGES = 256
RANK_DIGITS = 6
SLACK = 10.0 ** -RANK_DIGITS


@dataclass(frozen=True)
class PostingIndex:
    """``packed(bucket, term, kb_id, field, range, n, total, max_tf, min_dl, chunk_ids, tfs, dls, positions)``, a row per block, and ``stats(kb_id, field, n, total_dl)``."""

    packed: DataFrame
    stats: DataFrame
    rule: str
    buckets: int
    ranges: int

    @property
    def postings(self) -> DataFrame:
        """``bucket, term, kb_id, field, range, chunk_id, tf, dl, positions``, a row per posting."""
        return unpacked(self.packed)

    def restricted(self, chunks: DataFrame) -> PostingIndex:
        """The index of the given ``chunks(chunk_id, kb_id)`` only: counts, bounds and statistics are those of the rows a request may see."""
        chunks = chunks.select("kb_id", "chunk_id").distinct()
        packed = blocks_of(self.postings.join(chunks, ["kb_id", "chunk_id"], "left_semi"))
        return PostingIndex(packed, base_stats(chunks, packed, self.stats), self.rule, self.buckets, self.ranges)


def posting_rows(fields: list[str], size: int, most_words: int = WORDS):
    """A function over Arrow batches of ``chunk_id, kb_id, part`` and the tokens of each field, ordered by base and id: the blocks of an index.

    Chunks are numbered as they come and every ``size`` different ones are a range, so equal ids share one. Tokens become numbers, and one stable sort by
    number puts the places of each term in every chunk side by side. A range of many words is sorted in several slices; its blocks then come in parts.
    """
    def rows_of(piece: pa.RecordBatch, at: int, field: str, numbers: np.ndarray) -> dict | None:
        words = piece.column(3 + at)
        lengths = np.asarray(words.value_lengths().fill_null(0), np.int64)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return None
        by_term = np.asarray(pc.sort_indices(coded.dictionary))
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        term, chunk = rank[np.asarray(coded.indices)], np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(chunk)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(term, kind="stable")  # chunks and places ascend already
        term, chunk, place = term[order], chunk[order], place[order]
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])
        tf, own, term = np.diff(np.r_[starts, len(term)]).astype(np.int32), chunk[starts], term[starts]
        dl, names, kbs = lengths[own].astype(np.int32), coded.dictionary.take(pa.array(by_term)), piece.column(1)
        base = np.cumsum(np.r_[0, [int(a != b) for a, b in pairwise(kbs.to_pylist())]])
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (base[own][1:] != base[own][:-1]) | (numbers[own][1:] != numbers[own][:-1])])
        bounds = pa.array(np.r_[first, len(term)], pa.int32())
        places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(place)], pa.int32()), pa.array(place, pa.int32()))
        return {"term": names.take(pa.array(term[first])), "kb_id": kbs.take(pa.array(own[first])), "field": field, "range": numbers[own[first]],
                "n": np.diff(np.r_[first, len(term)]), "total": np.add.reduceat(tf.astype(np.int64), first), "max_tf": np.maximum.reduceat(tf, first), "min_dl": np.minimum.reduceat(dl, first),
                **{name: pa.ListArray.from_arrays(bounds, values) for name, values in (("chunk_ids", piece.column(0).take(pa.array(own))), ("tfs", pa.array(tf)), ("dls", pa.array(dl)), ("positions", places))}}

    def run(batches):
        seen, last, schema = 0, None, None
        for batch in batches:
            ids, kbs, part = (batch.column(i) for i in range(3))
            schema = schema or pa.schema([("term", pa.string()), ("kb_id", kbs.type), ("field", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("max_tf", pa.int32()), ("min_dl", pa.int32()),
                                          ("chunk_ids", pa.list_(ids.type)), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))])
            keys = list(zip(kbs.to_pylist(), ids.to_pylist()))
            fresh = np.array([a != b for a, b in pairwise([last, *keys])], np.int64)
            numbers = (seen + np.cumsum(fresh) - 1) // size
            seen, last = seen + int(fresh.sum()), keys[-1] if keys else last
            total = np.cumsum(sum(np.asarray(batch.column(3 + i).value_lengths().fill_null(0), np.int64) for i in range(len(fields))))
            cuts = np.flatnonzero((np.diff(numbers) > 0) | (np.diff(total // most_words) > 0)) + 1
            for low, high in pairwise([0, *cuts.tolist(), len(keys)]):
                piece, own = batch.slice(low, high - low), numbers[low:high] + (np.asarray(part)[low:high].astype(np.int64) << 32)
                for at, field in enumerate(fields):
                    columns = rows_of(piece, at, field, own) if high > low else None
                    if columns is not None:
                        n = len(columns["term"])
                        arrays = [pa.array([columns[f.name]] * n, f.type) if isinstance(columns[f.name], str)
                                  else pa.array(columns[f.name]).cast(f.type) if isinstance(columns[f.name], np.ndarray) else columns[f.name] for f in schema]
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def unpacked(packed: DataFrame) -> DataFrame:
    """A row per posting of the blocks."""
    rows = F.arrays_zip(*[F.col(own).alias(name) for own, name in (("chunk_ids", "chunk_id"), ("tfs", "tf"), ("dls", "dl"), ("positions", "positions"))])
    return packed.select("bucket", "term", "kb_id", "field", "range", F.inline(rows))


def blocks_of(postings: DataFrame) -> DataFrame:
    """The blocks of a table of postings; each holds the chunks of one range."""
    rows = F.col("rows")
    grouped = postings.groupBy("bucket", "term", "kb_id", "field", "range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "dl", "positions"))).alias("rows"))
    return grouped.select("bucket", "term", "kb_id", "field", "range", "n", "total", "max_tf", "min_dl", rows["chunk_id"].alias("chunk_ids"), rows["tf"].alias("tfs"), rows["dl"].alias("dls"), rows["positions"].alias("positions"))


def base_stats(chunks: DataFrame, packed: DataFrame, fields: DataFrame) -> DataFrame:
    """Chunks and tokens per base and field; a chunk without tokens counts too."""
    counts = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(fields.select("field").distinct()))  # one row per field of the index
    totals = packed.groupBy("kb_id", "field").agg(F.sum("total").alias("total_dl"))
    return counts.join(totals, ["kb_id", "field"], "left").select("kb_id", "field", "n", F.coalesce("total_dl", F.lit(0)).alias("total_dl"))


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(chunks: DataFrame, path: str, fields: dict[str, Column] | None = None, rule: str = "corpus") -> PostingIndex:
    """Writes the index of ``chunks(chunk_id, kb_id, ...)`` to ``path`` and opens it.

    Texts are ranged by base and id once, then tokenised, and each task writes the blocks of its own ranges: only texts move, never
    postings, and a term that every chunk holds is written by all tasks. The number of files grows with the chunks, not with chunks times terms.
    """
    fields = fields or {"text": F.col("search_text")}
    spark = chunks.sparkSession
    texts = chunks.select("chunk_id", "kb_id", *[column.alias(f"_{name}") for name, column in fields.items()])
    ids = chunks.select("chunk_id", "kb_id")
    count = ids.count()
    parts = max(count // (RANGE * RANGES_A_PART), min(count // RANGE, 3 * spark.sparkContext.defaultParallelism)) + 1
    ranged = texts.repartitionByRange(parts, "kb_id", "chunk_id").sortWithinPartitions("kb_id", "chunk_id")
    words = ranged.select("chunk_id", "kb_id", F.spark_partition_id().alias("part"), *[tx.tokens(F.col(f"_{name}"), rule).alias(name) for name in fields])
    types = dict(ids.dtypes)
    block = (f"term string, kb_id {types['kb_id']}, field string, range long, n long, total long, max_tf int, min_dl int, "
             f"chunk_ids array<{types['chunk_id']}>, tfs array<int>, dls array<int>, positions array<array<int>>")
    rows = words.mapInArrow(posting_rows(list(fields), RANGE), block)
    empty = spark.createDataFrame([], f"{block}, bucket int")
    empty.write.partitionBy("bucket").parquet(f"{path}/packed")  # a table without rows has a folder too
    # A task keeps a file of each bucket open, so that its rows, sorted by term in every range, are not sorted again to be written. A task that has
    # as many files open as are allowed goes on by sorting, so one more is allowed.
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, str(BUCKETS + 1))
    try:
        rows.withColumn("bucket", bucket_of("term", BUCKETS)).write.mode("append").option("parquet.block.size", ROW_GROUP).options(**PLAIN).partitionBy("bucket").parquet(f"{path}/packed")
    finally:
        spark.conf.set(OPEN_FILES, before)
    packed = spark.read.schema(empty.schema).parquet(f"{path}/packed")
    names = spark.createDataFrame([(f,) for f in fields], "field string")
    totals = cut(packed.groupBy("kb_id", "field", "range").agg(F.sum("total").alias("total")))  # the blocks are read once for the statistics and the ranges
    base_stats(ids, totals, names).coalesce(1).write.parquet(f"{path}/stats")
    ranges = totals.select("kb_id", "range").distinct().count()
    spark.createDataFrame([(rule, BUCKETS, ranges)], "rule string, buckets int, ranges int").coalesce(1).write.parquet(f"{path}/settings")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PostingIndex:
    settings = spark.read.parquet(f"{path}/settings").first()
    return PostingIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("packed", "stats")], settings["rule"], settings["buckets"], settings["ranges"])


# --- asking -----------------------------------------------------------------------------------------------------------

def scopes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with ``scope_id``, and the bases of each different scope."""
    scoped = requests.withColumn("scope_id", F.xxhash64(F.array_sort("kb_ids")))
    return scoped, scoped.select("scope_id", F.explode("kb_ids").alias("kb_id")).distinct()


def at_hand(df: DataFrame) -> tuple[DataFrame, pd.DataFrame | None]:
    """A request-side table of at most ``LOCAL_ROWS`` rows is read once, kept and broadcast; a larger one stays as it is and joins by shuffle."""
    rows = df.limit(LOCAL_ROWS + 1).toPandas()
    if len(rows) > LOCAL_ROWS:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def of_terms(table: DataFrame, terms: DataFrame, few: list[str] | None, buckets: int) -> DataFrame:
    """Rows of ``table`` with one of ``terms(term)``. A few terms become a filter on bucket and term, which the files' partitions and
    statistics answer; more are met by a join on both."""
    if few is not None and len(few) <= TERMS_IN_FILTER:
        one_of = F.array(*[F.lit(t) for t in few]).cast("array<string>")
        parts = table.sparkSession.range(1).select(F.transform(one_of, lambda t: bucket_of(t, buckets))).first()[0]
        return table.where(F.col("bucket").isin(parts) & F.col("term").isin(few))
    keyed = terms.select(bucket_of("term", buckets).alias("bucket"), "term").distinct()
    return table.join(keyed if few is None else F.broadcast(keyed), ["bucket", "term"], "left_semi")


def bm25_gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))


@dataclass(frozen=True)
class Asked:
    """``weights(request_id, scope_id, field, term, weight, avgdl)`` of the requests, the asked blocks of the index, and the bases of each scope.

    ``small`` and ``small_kbs`` are the weights and bases in memory when both have at most ``LOCAL_ROWS`` rows.
    """

    weights: DataFrame
    kbs: DataFrame
    postings: DataFrame
    kind: str
    boosts: dict[str, float]
    small: pd.DataFrame | None
    small_kbs: pd.DataFrame | None


def ask(requests: DataFrame, index: PostingIndex, kind: str, boosts: dict[str, float] | None = None) -> Asked:
    """``kind`` bm25: a term's weight is its idf over the rows the request may see; logtf: its count in the query."""
    scoped, kbs = scopes(requests)
    asked, rows = at_hand(scoped.select("request_id", "scope_id", F.inline(tx.term_counts(tx.tokens(F.col("query"), index.rule)))).withColumnRenamed("tf", "asked"))
    kbs, kb_rows = at_hand(kbs)
    few = None if rows is None else sorted(set(rows["term"]))
    found = of_terms(index.packed, asked.select("term"), few, index.buckets).drop("bucket", "total", "positions")
    if kind == "bm25":
        df = found.select("kb_id", "field", "term", "n").join(kbs, "kb_id").groupBy("scope_id", "field", "term").agg(F.sum("n").alias("df"))
        stats = index.stats.join(kbs, "kb_id").groupBy("scope_id", "field").agg(F.sum("n").alias("total"), (F.sum("total_dl") / F.sum("n")).alias("avgdl"))
        weights = df.join(asked, ["scope_id", "term"]).join(F.broadcast(stats) if kb_rows is not None else stats, ["scope_id", "field"]).select(  # a row per scope and field
            "request_id", "scope_id", "field", "term", F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"), F.greatest(F.lit(1.0), "avgdl").alias("avgdl"))
    else:
        fields = index.stats.select("field").distinct()
        weights = asked.crossJoin(F.broadcast(fields)).select("request_id", "scope_id", "field", "term", F.col("asked").cast("double").alias("weight"), F.lit(1.0).alias("avgdl"))  # one row per field
    small = None
    if rows is not None and kb_rows is not None:
        weights, small = at_hand(weights)
    return Asked(weights, kbs, found, kind, boosts or {}, small, kb_rows if small is not None else None)


def pairs(asked: Asked) -> DataFrame:
    """Per request and block of one of its terms: the weight, the average length and the most that the block can add."""
    if asked.kind == "bm25":
        most = F.col("weight") * bm25_gain(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))  # grows with the count, falls with the length
    else:
        most = F.col("weight") * (1 + F.log("max_tf"))
    boosts = F.create_map(*[F.lit(x) for pair in asked.boosts.items() for x in pair])[F.col("field")] if asked.boosts else F.lit(None)
    rows = asked.postings.drop("chunk_ids", "tfs", "dls").join(asked.kbs, "kb_id").join(asked.weights, ["scope_id", "field", "term"])
    return rows.select("request_id", "kb_id", "range", "field", "term", "weight", "avgdl", (most * F.coalesce(boosts, F.lit(1.0))).alias("most"))


def range_bounds(asked: Asked) -> DataFrame:
    """``most`` per request and range: no chunk there can score more (the best field counts)."""
    per_field = pairs(asked).groupBy("request_id", "kb_id", "range", "field").agg(F.sum("most").alias("most"))
    return per_field.groupBy("request_id", "kb_id", "range").agg(F.max("most").alias("most"))


def score_ranges(asked: Asked, wanted: DataFrame | None, k: int) -> DataFrame:
    """Best ``k`` of each wanted ``(request_id, kb_id, range)``, or of all: ``request_id, chunk_id, score``.

    The postings of one range meet in one group, once, whatever the number of requests that ask for a term. The requests' weights are broadcast when
    they are few; else they meet the postings in the group.
    """
    kind, boosts, types = asked.kind, asked.boosts, dict(asked.weights.dtypes) | dict(asked.postings.dtypes)
    schema = f"request_id {types['request_id']}, chunk_id {types['chunk_ids'].removeprefix('array<').removesuffix('>')}, score double"
    right = asked.postings.select("kb_id", "range", "field", "term", "chunk_ids", "tfs", "dls")
    if wanted is not None:
        right = right.join(wanted.select("kb_id", "range").distinct(), ["kb_id", "range"], "left_semi")
    if asked.small is not None:
        handle = asked.weights.sparkSession.sparkContext.broadcast((asked.small, asked.small_kbs))

        def score_all(theirs: pd.DataFrame, chosen: pd.DataFrame | None) -> pd.DataFrame:
            weights, kbs = handle.value
            scope_ids = kbs["scope_id"][kbs["kb_id"] == theirs["kb_id"].iloc[0]] if len(theirs) else []
            mine = weights[weights["scope_id"].isin(scope_ids)]
            return score_range(mine if chosen is None else mine[mine["request_id"].isin(chosen["request_id"])], theirs, k, kind, boosts)

        if wanted is None:
            return right.groupBy("kb_id", "range").applyInPandas(lambda theirs: score_all(theirs, None), schema)
        return wanted.select("kb_id", "range", "request_id").groupBy("kb_id", "range").cogroup(right.groupBy("kb_id", "range")).applyInPandas(lambda chosen, theirs: score_all(theirs, chosen), schema)
    left = pairs(asked)
    left = (left if wanted is None else left.join(wanted, ["request_id", "kb_id", "range"])).select("kb_id", "range", "request_id", "field", "term", "weight", "avgdl")
    right = right.toDF(*right.columns)  # both sides come from the asked blocks; columns of their own keep them apart in the cogroup
    return left.groupBy("kb_id", "range").cogroup(right.groupBy("kb_id", "range")).applyInPandas(lambda mine, theirs: score_range(mine, theirs, k, kind, boosts), schema)


def score_range(asked: pd.DataFrame, postings: pd.DataFrame, k: int, kind: str, boosts: dict[str, float], block: int = 512) -> pd.DataFrame:
    """Scores of one range, given by its blocks, as products of (requests x terms) and (terms x chunks), in blocks; the best field counts."""
    out = []
    if len(asked) and len(postings):
        # Terms that the range does not hold leave first; numbers stand for terms from here on.
        names = pd.Index(postings["term"].unique())
        own = names.get_indexer(asked["term"])
        asked, own = asked[own >= 0], own[own >= 0]
        sizes = postings["chunk_ids"].map(len).to_numpy()
        code = np.repeat(names.get_indexer(postings["term"]), sizes)
        ids, chunk = np.unique(np.concatenate(postings["chunk_ids"].tolist()), return_inverse=True)
        requests, row = np.unique(asked["request_id"].to_numpy(), return_inverse=True)
        tf, dl = (np.concatenate(postings[name].tolist()).astype(np.float64) for name in ("tfs", "dls"))
        fields = np.repeat(postings["field"].to_numpy(), sizes)
        weight, lengths, asked_fields = asked["weight"].to_numpy(), asked["avgdl"].to_numpy(), asked["field"].to_numpy()
        cases = set(zip(asked_fields.tolist(), lengths.tolist()))
        for at in range(0, len(requests), block):
            scores = np.zeros((min(block, len(requests) - at), len(ids)))
            for field, avgdl in sorted(cases):
                mine = (asked_fields == field) & (lengths == avgdl) & (row >= at) & (row < at + block)
                theirs = fields == field
                gain = 1 + np.log(tf[theirs]) if kind == "logtf" else tf[theirs] * (K1 + 1) / (tf[theirs] + K1 * ((1 - B) + B * dl[theirs] / avgdl))
                total = np.zeros_like(scores)
                for low in range(0, len(names), block):
                    here, there = mine & (own >= low) & (own < low + block), (code[theirs] >= low) & (code[theirs] < low + block)
                    weights, gains = np.zeros((len(scores), block)), np.zeros((block, len(ids)))
                    weights[row[here] - at, own[here] - low] = weight[here]
                    gains[code[theirs][there] - low, chunk[theirs][there]] = gain[there]
                    total += weights @ gains
                np.maximum(scores, total * boosts.get(field, 1.0), out=scores)
            # ids ascend with their place, so a stable sort by score settles ties by id
            order = np.argsort(-np.round(scores, RANK_DIGITS), axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(scores, order, axis=1)
            i, j = np.nonzero(best > 0)
            out.append((requests[at + i], ids[order[i, j]], best[i, j]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(("request_id", "chunk_id", "score"), columns)))


def ranges_to_read(asked: Asked, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits of the first ranges of each request, and the further ranges whose bound reaches the k-th score found there."""
    order = Window.partitionBy("request_id").orderBy(F.col("most").desc(), "kb_id", "range")
    placed = cut(range_bounds(asked).withColumn("place", F.row_number().over(order)))
    first = cut(top_k(score_ranges(asked, placed.where(F.col("place") <= SEEDS).select("request_id", "kb_id", "range"), k), k))
    least = first.where(F.col("rank") == k).select("request_id", F.col("score").alias("least"))
    rest = placed.where(F.col("place") > SEEDS).join(least, "request_id", "left").where(F.col("least").isNull() | (F.col("most") + SLACK >= F.col("least")))
    return first, rest.select("request_id", "kb_id", "range")


def top_k(scored: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.round("score", RANK_DIGITS).desc(), F.col(id_col).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(requests: DataFrame, index: PostingIndex, k: int, kind: str = "bm25", boosts: dict[str, float] | None = None, direct: int = DIRECT_RANGES) -> DataFrame:
    """Exact best ``k`` per request: ``request_id, chunk_id, rank, score``. ``requests(request_id, query, kb_ids)``.

    An index of up to ``direct`` ranges is scored whole, since bounds would cost more than they save; the result is the same either way. So is any
    index when more than ``FEW_REQUESTS`` ask: a range is read if one of them wants it, and they would read nearly all ranges twice.
    """
    asked = ask(requests, index, kind, boosts)
    if index.ranges <= direct or (asked.small is not None and asked.small["request_id"].nunique() > FEW_REQUESTS):
        scored = score_ranges(asked, None, k)
    else:
        first, rest = ranges_to_read(asked, k)
        scored = first.select("request_id", "chunk_id", "score").unionByName(score_ranges(asked, rest, k))
    return top_k(scored, k).select("request_id", "chunk_id", "rank", "score")


# --- phrases ----------------------------------------------------------------------------------------------------------

def phrases(requests: DataFrame, index: PostingIndex, fields: list[str] | None = None) -> DataFrame:
    """``request_id, chunk_id`` of chunks that hold the query's tokens one behind the other in one field. ``requests(request_id, query, kb_ids)``.

    The rarest token of each phrase gives the places, the next rarest is asked for at its distance from it, and what is left is verified token
    by token. No text is read, and a frequent token's postings only meet places that the rare ones left. A query without tokens finds nothing.
    Only the queries' own tokens come to the driver, a row each. Places grow with the chunks: they are written, and broadcast when they are few.
    """
    scoped, kbs = scopes(requests)
    asked, rows = at_hand(scoped.select("request_id", "scope_id", F.posexplode(tx.tokens(F.col("query"), index.rule)).alias("at", "term")))
    kbs, _ = at_hand(kbs)
    few = None if rows is None else sorted(set(rows["term"]))
    blocks = of_terms(index.packed, asked.select("term"), few, index.buckets).select("kb_id", "field", "term", "n")
    if fields is not None:
        blocks = blocks.where(F.col("field").isin(fields))
    df = blocks.join(kbs, "kb_id").groupBy("scope_id", "term").agg(F.sum("n").alias("df"))
    own = Window.partitionBy("request_id", "scope_id")  # a query's own tokens
    rarest = own.orderBy("df", "at", "term")
    words = asked.join(df, ["scope_id", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0))).select(
        "request_id", "scope_id", "at", "term", F.min("df").over(own).alias("least"), F.count(F.lit(1)).over(own).alias("words"), F.row_number().over(rarest).alias("no"),
        F.lead("at", 1, -1).over(rarest).alias("next_at"), F.lead("term", 1, "").over(rarest).alias("next_term"))  # no nulls, which pandas would make floats of
    plan, planned = at_hand(cut(words.where("least > 0").drop("least")))
    lengths = {1, 2, 3} if planned is None else set(planned["words"].clip(upper=3))

    def postings_of(terms: DataFrame) -> DataFrame:
        found = unpacked(of_terms(index.packed, terms, few, index.buckets)).select("kb_id", "field", "chunk_id", "term", "positions")
        return found if fields is None else found.where(F.col("field").isin(fields))

    place = ["request_id", "kb_id", "field", "chunk_id", "start"]
    rare, _ = at_hand(plan.where("no = 1").join(kbs, "scope_id").select("request_id", "scope_id", "kb_id", "term", "at", "words", "next_at", "next_term"))
    begun = postings_of(rare.select("term")).join(rare, ["kb_id", "term"]).withColumn("p", F.explode("positions")).withColumn("start", F.col("p") - F.col("at")).where("start >= 0")
    found = [begun.where("words = 1").select("request_id", "chunk_id")] if 1 in lengths or not lengths else []
    stands = lambda at: F.array_contains("positions", F.col("start") + F.col(at))
    if lengths & {2, 3}:
        second = cut(begun.where("words > 1").select(*place, "scope_id", "words", "next_at", F.col("next_term").alias("term")))
        held = postings_of(plan.where("no = 2").select("term"))
        left = cut(held.join(broadcast_bounded(second, second, LOCAL_ROWS), ["kb_id", "field", "chunk_id", "term"]).where(stands("next_at")).select(*place, "scope_id", "words"))
        found.append(left.where("words = 2").select("request_id", "chunk_id"))
    if 3 in lengths:
        left = left.where("words > 2")
        others = plan.where("no > 2").select(F.col("request_id").alias("asker"), F.col("scope_id").alias("asked_scope"), "at", "term")
        more = left.join(others if planned is None else F.broadcast(others), F.col("request_id").eqNullSafe(F.col("asker")) & (F.col("scope_id") == F.col("asked_scope"))).select(
            *place, (F.col("words") - 2).alias("needed"), "at", "term")
        held = postings_of(others.select("term"))
        if fits_broadcast(more, LOCAL_ROWS):
            more = F.broadcast(more)
        else:  # only postings of chunks that are left are shuffled
            chunks = left.select("kb_id", "chunk_id").distinct()
            held = held.join(broadcast_bounded(chunks, chunks, LOCAL_ROWS), ["kb_id", "chunk_id"], "left_semi")
        rest = held.join(more, ["kb_id", "field", "chunk_id", "term"]).where(stands("at"))
        whole = rest.groupBy(*place).agg(F.count(F.lit(1)).alias("found"), F.first("needed").alias("needed")).where("found = needed")
        found.append(whole.select("request_id", "chunk_id"))
    return reduce(DataFrame.unionByName, found).distinct()
