"""Near copies (the pipeline's stage): documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are what operator 7 links: documents whose SimHash fingerprints differ by four bits or fewer, by its partition search. Fingerprints of 64 bits
alone do not reach the rest: at similarity 0.8 two SimHashes differ by ten bits on average. Sets that agree in a whole band of minimum hashes are
candidates too (a pair at 0.8 is missed with probability ``(1 - 0.8 ** 4) ** 32``, 5e-8, and less above). Every link is verified on the whole sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.byte_bpe import slices
from attestor.llm.common import ROW, broadcast_small, cut, only_rows, whole, with_row
from attestor.llm.simhash import components, fingerprint_roots, fingerprints

SHINGLE = 5
TENTHS = 8  # least similarity, in tenths
BANDS, ROWS = 32, 4
BLOCK = 2048  # sets of one side that one task compares
SLOTS = 1 << 14


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles; a text with fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint
    if len(tokens) < shingle:
        return np.array([xxh64_intdigest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    # In parts, so that a long text never has a list of all its shingles.
    parts = []
    for at in range(0, len(tokens) - shingle + 1, 50_000):
        part = tokens[at: at + 50_000 + shingle - 1]
        parts.append(np.unique(np.array([xxh64_intdigest(b" ".join(g), 42) for g in zip(*(part[i:] for i in range(shingle)))], np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return numbers[0], numbers[1] | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """One key per band of the set's minimum hashes."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    masks, odd = multipliers()
    for at in range(0, len(found), 512):
        part = found[at: at + 512]
        np.minimum(least, ((part[None, :] ^ masks[:, None]) * odd[:, None]).min(axis=1), out=least)
    return [xxh64_intdigest(least[b * ROWS: (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row``, ``id``, ``mark`` (128-bit hash of the set) and ``keys`` (its bands; none for an empty set) per row."""
    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                sets = [grams(t) for t in part.column(2).to_pylist()]
                keys = [np.array(bands(s), np.uint64).view(np.int64) if len(s) else np.array([], np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                                 names=[ROW, "id", "mark", "keys"])

    rows = docs.select(ROW, F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, f"{ROW} long, id {dict(rows.dtypes)['id']}, mark binary, keys array<bigint>")


def similar_links(marks: list[bytes], texts: list[str], first: list[int], second: list[int]) -> list[tuple[bytes, bytes]]:
    """Links that connect whatever is similar between the two sides (one side with itself if they are the same).

    Common shingles are counted for all pairs of the sides through an inverted list, so no pair is left out; a link is returned only where it joins two sets that were apart.
    """
    sets = [grams(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    alone = first == second
    names, at = np.unique(np.concatenate([sets[j] for j in second]), return_inverse=True)
    owner = np.repeat(np.arange(len(second)), sizes[second])
    order = np.argsort(at, kind="stable")
    owner, starts = owner[order], np.searchsorted(at[order], np.arange(len(names) + 1))
    others = np.array(second)
    root, links = list(range(len(sets))), []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, i in enumerate(first):
        place = np.searchsorted(names, sets[i])
        place = place[(place < len(names)) & (names[np.minimum(place, len(names) - 1)] == sets[i])]
        common = np.zeros(len(second), np.int64)
        for p in place:
            common[owner[starts[p]: starts[p + 1]]] += 1
        near = 10 * common >= TENTHS * (sizes[i] + sizes[others] - common)
        if alone:
            near[: k + 1] = False
        for j in others[near].tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((marks[i], marks[j]))
    return links


def verify(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of the groups of one slot; sets of one group and block pair are compared with each other."""
    out: list[tuple[bytes, bytes]] = []
    for (_, low, high), part in frame.groupby(["coarse", "low", "high"], sort=False):
        marks, texts, block = part["mark"].tolist(), part["text"].tolist(), part["block"].to_numpy()
        sides = [np.flatnonzero(block == side).tolist() for side in (low, high)]
        if all(sides):
            out += similar_links(marks, texts, *sides)
    return pd.DataFrame(out, columns=["a", "b"])


def similar(docs: DataFrame, rows: DataFrame, text_col: str, close: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between different sets (``mark``) with the components of all similar pairs that meet in a band or in ``close`` (``a``, ``b``).

    What bands and ``close`` connect is a coarse group; the texts of its sets meet once, in one task, or in one task for every two blocks of a large group.
    """
    entries = rows.select("mark", F.explode("keys").alias("key"))
    least = entries.groupBy("key").agg(F.min("mark").alias("a"), F.max("mark").alias("most")).where("a <> most").select("key", "a")
    met = entries.join(least, "key").where("mark <> a").select("a", F.col("mark").alias("b")).unionByName(close).distinct()
    coarse = cut(components(met).select(F.col("node").alias("mark"), F.col("root").alias("coarse")))
    coarse = coarse.unionByName(coarse.select(F.col("coarse").alias("mark"), "coarse").distinct()).distinct()
    sizes = coarse.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # Each set is given by the text of one of its rows.
    rank = rows.groupBy("mark").agg(F.min(ROW).alias(ROW))
    wanted = cut(coarse.join(sizes, "coarse").join(rank, "mark"))
    pieces = wanted.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")) \
        .withColumn("slot", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("coarse"), F.lit(SLOTS))).otherwise(F.xxhash64("coarse")))
    texts = docs.select(ROW, whole(text_col).alias("text")).join(broadcast_small(pieces), ROW)
    placed = texts.select("coarse", "mark", "text", "block", "slot", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("coarse", "mark", "text", "block", "slot", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return placed.groupBy("slot", "blocks", "low", "high").applyInPandas(verify, "a binary, b binary")


def fingerprint_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidates ``a``, ``b``: sets (``mark``, not empty) whose documents operator 7 puts into one group, each with the least of its group."""
    prints = cut(fingerprints(docs, id_col, text_col))
    rooted = fingerprint_roots(cut(prints.select("fp").distinct()))
    grouped = cut(rows.where(F.size("keys") > 0).select(ROW, "mark").join(prints.select(ROW, "fp"), ROW).join(rooted, "fp").select("root", "mark").distinct())
    return grouped.join(grouped.groupBy("root").agg(F.min("mark").alias("a")), "root").where("mark <> a").select("a", F.col("mark").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` (which carries ``_row``): ``_row``, the id, ``component_id`` and ``kept``.

    Similar documents are linked; ``component_id`` is the smallest id reachable (null ids last), and ``kept`` holds for one row of
    each component: the smallest id's, the first of repeated rows. Documents with equal sets (also: without words) are one. An empty table gives no rows.
    """
    rows = cut(signatures(docs, id_col, text_col))
    roots = components(similar(docs, rows, text_col, fingerprint_links(docs, rows, id_col, text_col), **options))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col(ROW).alias("row"))
    distinct = rows.groupBy("mark").agg(F.min(rank).alias("first"))
    rooted = cut(distinct.join(roots, F.col("mark") == F.col("node"), "left").select("mark", "first", F.coalesce("root", "mark").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(firsts, "root").select("mark", "least")
    return rows.select(ROW, "id", "mark").join(classes, "mark").select(
        ROW, F.col("id").alias(id_col), F.col("least.id").alias("component_id"), (F.col(ROW) == F.col("least.row")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near copies: one document of each component stays."""
    tagged = with_row(docs)
    return only_rows(tagged, near_groups(tagged, **options).where("kept"))
