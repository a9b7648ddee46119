"""Line dedup (operator 6): segment-partition edit join of text lines.

Two lines within ``edits`` of each other share one of ``edits + 1`` segments of the shorter one, unchanged, near its place. Every line is
indexed by its segments and looks up the substrings that may equal a segment of a line of its own length or up to ``edits`` less. Lines
that meet under a key are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.byte_bpe import slices
from attestor.llm.common import ROW, broadcast_small, cut, read, whole, with_row, written
from attestor.llm.simhash import components

EDITS = 2
MIN_CHARS = 20  # shorter lines are linked only when they are equal
MASK64 = (1 << 64) - 1
ODD, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # factors of the keys
SPAN = 1 << 17  # characters whose lines are hashed together
BLOCK = 1500  # lines of one side that one task compares under one key


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and end of ``edits + 1`` nearly equal segments, the longer ones last."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        to = at + short + (i >= parts - longer)
        out.append((at, to))
        at = to
    return out


def windows(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """For a line of ``length`` and an indexed line of ``other`` characters (not more): segment size and first and last start of the
    substrings that can equal each segment.

    An alignment with at most ``edits`` operations has a segment without an error for which at most i operations lie before
    it and ``edits - i`` behind it; the shift is then bounded from both sides.
    """
    extra, out = length - other, []
    for i, (at, to) in enumerate(segments(other, edits)):
        low = max(0, at - i, at + extra - (edits - i))
        high = min(length - (to - at), at + i, at + extra + (edits - i))
        out.append((to - at, low, high))
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Edit distance of at most ``edits``: words of ``2 * edits + 1`` bits, one per number of errors, hold the reachable diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    start = len(commonprefix((a, b)))
    end = min(len(commonprefix((a[::-1], b[::-1]))), len(a) - start, len(b) - start)
    a, b = a[start: len(a) - end], b[start: len(b) - end]
    if not a or not b:
        return len(a) + len(b) <= edits
    full = (1 << (2 * edits + 1)) - 1
    states = [1 << edits]
    for _ in range(edits):
        states.append((states[-1] | states[-1] << 1) & full)
    for j, c in enumerate(b):
        same, low = 0, j - edits
        for i, p in enumerate(a[max(low, 0): j + edits + 1], max(-low, 0)):
            if p == c:
                same |= 1 << i
        before, after = 0, 0
        for d, state in enumerate(states):
            new = (state & same) | (before | before >> 1 | after << 1 if d else 0)
            before, after = state, new & full
            states[d] = after
        if not after:
            return False
    return bool(states[edits] >> (len(a) - len(b) + edits) & 1)


@lru_cache(maxsize=1 << 16)
def cuts(length: int, edits: int) -> np.ndarray:
    """Where a line of this length is cut, a row per cut: hash seed for indexed length and segment, start, end, and 1 for its own segments.

    A line that looks up its own segment at its own place is left out: its own entry stands for both.
    """
    own = [(seed_of(length, i), at, to) for i, (at, to) in enumerate(segments(length, edits))]
    looked = [(seed_of(other, i), at, at + size) for other in range(length - edits, length + 1)
              for i, (size, low, high) in enumerate(windows(length, other, edits)) for at in range(low, high + 1)]
    return np.array([(*c, 1) for c in own] + [(*c, 0) for c in looked if c not in own], np.int64)


def seed_of(length: int, segment: int) -> int:
    return length << 8 | segment


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """``ODD ** i`` and ``ODD ** -i`` modulo 2 ** 64 for ``i`` up to ``SPAN``."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(SPAN, factor, np.uint64)]) for factor in (ODD, pow(ODD, -1, 1 << 64)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def mixed(sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Keys from the sums of substrings and the seeds of their cuts; every bit of a key depends on all bits of the sum."""
    x = sums ^ (seeds.astype(np.uint64) * np.uint64(SPREAD))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=256)
def key_of(part: str, seed: int) -> int:
    """Key of one substring: its code points as a polynomial in ``ODD`` modulo 2 ** 64, mixed with the seed."""
    up, total = powers()[0], 0
    for at in range(0, len(part), SPAN):
        codes = code_points(part[at: at + SPAN])
        total += int((codes * up[: len(codes)]).sum()) * pow(ODD, at, 1 << 64)
    return int(mixed(np.array([total & MASK64], np.uint64), np.array([seed]))[0])


def keys_of(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all cuts of the lines, whether each is a segment of its line, and the number of that line.

    A substring's sum is the difference of two sums from the start, so the characters are read once, however many cuts they are in.
    """
    places = [cuts(len(line), edits) for line in lines]
    line = np.repeat(np.arange(len(lines)), [len(p) for p in places])
    seed, at, to, own = np.ascontiguousarray(np.concatenate(places).T)
    sizes = np.array([len(x) for x in lines], np.int64)
    if sizes.sum() > SPAN:  # one long line
        keys = np.array([key_of(lines[i][a:b], c) for i, c, a, b in zip(line.tolist(), seed.tolist(), at.tolist(), to.tolist())], np.uint64)
    else:
        up, down = powers()
        codes = code_points("".join(lines))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        begin = (np.cumsum(sizes) - sizes)[line]
        at += begin
        keys = mixed((sums[begin + to] - sums[at]) * down[at], seed)
    return keys, own.astype(bool), line


def entry_keys(line: str, edits: int):
    """(key, own) of a line: its segments under its length, and the substrings it looks up."""
    keys, own, _ = keys_of([line], edits)
    return list(zip(keys.tolist(), own.tolist()))


def first_key(long: str, short: str, edits: int) -> int | None:
    """The first key under which the pair meets; a pair is counted there only."""
    for i, ((at, to), (_, low, high)) in enumerate(zip(segments(len(short), edits), windows(len(long), len(short), edits))):
        part = short[at:to]
        if low <= high and long.find(part, low, high + len(part)) >= 0:
            return key_of(part, seed_of(len(short), i))
    return None


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row``, ``id``, ``line_no`` (from 0), ``line`` of the lines with a word, without white space at their ends, and ``h``, their 128-bit hash."""
    rows = docs.select(ROW, F.col(id_col).alias("id"), F.posexplode(F.split(whole(text_col), "\n")).alias("line_no", "raw"))
    rows = rows.select(ROW, "id", "line_no", F.btrim("raw", F.lit(" \t\n\x0b\x0c\r")).alias("line")).where("line <> ''")
    return rows.withColumn("h", F.md5("line"))


def entries(lines: DataFrame, edits: int) -> DataFrame:
    """``key``, ``mark`` (64-bit line hash) and ``own`` per line and key; equal lines of one batch give their rows once."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, SPAN):
                marks = dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                if marks:
                    keys, own, line = keys_of(list(marks), edits)
                    names = np.fromiter(marks.values(), np.int64, len(marks))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names[line]), pa.array(own)], names=["key", "mark", "own"])

    return lines.select("line", "mark").mapInArrow(run, "key long, mark long, own boolean")


def compare(frame: pd.DataFrame, edits: int) -> pd.DataFrame:
    """Verified links of the keys of one group and block pair: per line their number, and a spanning set of links."""
    frame = frame.sort_values("key", kind="stable")
    keys, low, high = frame["key"].to_numpy(), frame["low"].to_numpy(), frame["high"].to_numpy()
    lines, names, block = frame["line"].tolist(), frame["h"].tolist(), frame["block"].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    links: dict[str, int] = {}
    edges: list[tuple[str, str, int]] = []
    for at, to in zip(starts, [*starts[1:], len(keys)]):
        texts = {(names[i], int(block[i])): lines[i] for i in range(at, to)}
        one_key(int(keys[at]), int(low[at]), int(high[at]), [(h, b, x) for (h, b), x in texts.items()], edits, links, edges)
    return pd.DataFrame([(h, None, n) for h, n in links.items()] + edges, columns=["a", "b", "n"])


def one_key(key: int, low: int, high: int, rows: list[tuple[str, int, str]], edits: int, links: dict[str, int], edges: list[tuple[str, str, int]]) -> None:
    """Compares the lines of one key: block ``low`` with block ``high``, or one block with itself.

    In large groups, lengths and letter counts (an edit changes at most two of them by one) reject most pairs as arrays before texts are compared.
    """
    first, second = ([i for i, r in enumerate(rows) if r[1] == side] for side in (low, high))
    sizes = np.array([len(r[2]) for r in rows])
    counts = None
    if len(rows) > 24:
        counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64) for _, _, x in rows]).astype(np.int32)
        second = np.array(second)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in first:
        if counts is None:
            others = [j for j in second if (j > i or low != high) and abs(sizes[j] - sizes[i]) <= edits]
        else:
            others = second[second > i] if low == high else second
            others = others[np.abs(sizes[others] - sizes[i]) <= edits]
            others = others[np.abs(counts[others] - counts[i]).sum(axis=1) <= 2 * edits].tolist()
        for j in others:
            (a, _, x), (b, _, y) = rows[i], rows[j]
            long, short = (x, y) if (len(x), x) > (len(y), y) else (y, x)
            found = first_key(long, short, edits)
            if found is not None and (found ^ key) & MASK64 == 0 and within(long, short, edits):
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                s, t = top(i), top(j)
                if s != t:
                    root[max(s, t)] = min(s, t)
                    edges.append((a, b, 0))


def edit_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """``a``, ``n`` (links of line a found in one place; sum them) or ``a``, ``b`` (a link) by line hash ``h``; ``lines`` has ``line`` and ``h``.

    Keys and 64-bit marks are written once and reduced, to the keys under which different lines meet; then the lines of those keys
    get their texts. A key with many lines is split into blocks, and every two blocks are compared by a task of their own.
    """
    long = lines.where(F.char_length("line") >= min_chars).select("line", "h", F.xxhash64("line").alias("mark"))
    keys = written(entries(long, edits), "line-keys")
    met = cut(keys.groupBy("key").agg(F.min("mark").alias("least"), F.max("mark").alias("most"), F.max("own").alias("own"))
              .where("own and least <> most").select("key"))
    members = cut(keys.join(broadcast_small(met), "key").select("key", "mark").distinct())
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    texts = long.join(broadcast_small(members.select("mark").distinct()), "mark", "left_semi").groupBy("mark", "h").agg(F.first("line").alias("line"))
    # Keys of one block share groups of some dozens, so that Python is called once for many; a key of several blocks has groups of its own.
    bits = max(1, (met.count() // 64).bit_length())
    slot = F.when(F.col("blocks") == 1, F.shiftrightunsigned("key", 64 - bits)).otherwise(F.col("key"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")) \
        .select("key", "mark", "block", slot.alias("slot"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("key", "mark", "block", "slot", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return placed.join(texts, "mark").groupBy("slot", "blocks", "low", "high").applyInPandas(lambda f: compare(f, edits), "a string, b string, n long")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per line with a word of every row of ``docs`` (which carries ``_row``): id, ``line_no``, ``class_id``, ``class_line``, ``n_links``, ``kept``.

    Lines are compared without white space at their ends, by code points. Equal lines are one text; texts of ``min_chars`` or more
    within ``edits`` of each other are linked, and a class is what links connect. The class is named by its first line
    (smallest id, null last, then line number, then row), which alone is ``kept``. ``n_links`` counts the other texts linked
    to the line's text. Null and empty texts have no lines. An empty table gives no rows.
    """
    lines = lines_of(docs, id_col, text_col)
    occurrences = cut(lines.select(ROW, "id", "line_no", F.unhex("h").alias("h")))
    found = cut(edit_links(lines, **options))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b is not null").select("a", "b"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "line_no", F.col(ROW).alias("row"))
    texts = occurrences.groupBy("h").agg(F.min(rank).alias("first"))
    rooted = texts.join(roots.select(F.unhex("node").alias("h"), F.unhex("root").alias("root")), "h", "left").join(counts.select(F.unhex("a").alias("h"), "n_links"), "h", "left") \
        .withColumn("root", F.coalesce("root", "h"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = cut(rooted.join(firsts, "root").select("h", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    same = (F.col(ROW) == F.col("least.row")) & (F.col("line_no") == F.col("least.line_no"))
    return occurrences.join(classes, "h").select(ROW, F.col("id").alias(id_col), "line_no", F.col("least.id").alias("class_id"), F.col("least.line_no").alias("class_line"), "n_links", same.alias("kept"))


def op6_line_dedup(spark, d):
    return line_classes(with_row(read(spark, d, "documents"))).drop(ROW)


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES: dict[str, str] = {}
