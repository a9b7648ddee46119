"""Directed link graphs of any size: trimming, weak components and strong components in rounds, each cut on shared storage.

A round is a join and an aggregation on node ids, so a graph is spread over all tasks whatever its versions' sizes. What is left
after trimming is handled component by component; components within ``GROUP_EDGES`` are finished by one small function each, larger ones by
further rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources.stored import cut

GROUP_EDGES = 20_000
TRIM_ROUNDS = 8


def trimmed(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``edges(a, b)`` without those into nodes that lead nowhere or out of nodes nothing leads to, until none is left or after ``rounds``."""
    edges = cut(edges)
    left = edges.count()
    while left and (rounds is None or rounds > 0):
        edges = cut(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
        before, left = left, edges.count()
        if left == before:
            break
        rounds = None if rounds is None else rounds - 1
    return edges


def weak_components(edges: DataFrame) -> DataFrame:
    """``node, part``: the least node of each component, directions aside. Large and small stars in turn; rounds grow with the logarithm of the longest path."""
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = cut(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        if after.exceptAll(pairs).isEmpty() and after.count() == pairs.count():
            roots = pairs.select(F.col("v").alias("node")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(roots.select("node", F.col("node").alias("part")))
        pairs = after


def strong_in_rounds(edges: DataFrame) -> DataFrame:
    """``node, strong`` of every node on a cycle, by colours: the greatest node that reaches each node is its colour, and what reaches that node
    inside the colour is its strong component. Those leave, the rest is trimmed and coloured again."""
    out, edges = None, trimmed(edges)
    while not edges.isEmpty():
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        colours = cut(nodes.select("node", F.col("node").alias("colour")))
        while True:
            ahead = edges.join(colours.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("seen"))
            after = cut(colours.join(ahead, "node", "left").select("node", F.greatest("colour", "seen").alias("colour")))
            if after.exceptAll(colours).isEmpty():
                break
            colours = after
        inside = edges.join(colours.withColumnRenamed("node", "a"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").where("colour = other").select("a", "b", "colour")
        inside = cut(inside)
        found = front = cut(colours.where("node = colour"))
        while not front.isEmpty():
            back = inside.join(front.withColumnRenamed("node", "b"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            front = cut(back.join(found, ["node", "colour"], "left_anti"))
            found = cut(found.unionByName(front))
        strong = found.select("node", F.col("colour").alias("strong"))
        out = strong if out is None else cut(out.unionByName(strong))
        gone = strong.select("node")
        edges = trimmed(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("strong"))
    # a node alone in its colour is on no cycle, since a link to itself is not an edge here
    several = out.groupBy("strong").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("strong")
    return out.join(several, "strong", "left_semi").select("node", "strong")


def strong_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """``node, strong`` of the nodes on cycles of whole components, by one depth-first walk with an explicit stack; time and memory are linear in the edges."""
    ahead: dict = {}
    for a, b in zip(pdf["a"], pdf["b"]):
        ahead.setdefault(a, []).append(b)
    number, low, held, on_stack, out = {}, {}, [], set(), []

    def enter(node):
        number[node] = low[node] = len(number)
        held.append(node)
        on_stack.add(node)
        walk.append((node, iter(ahead.get(node, ()))))

    for root in list(ahead):
        walk = []
        if root not in number:
            enter(root)
        while walk:
            node, rest = walk[-1]
            step = next(rest, None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(held.pop())
                    on_stack.difference_update(group)
                    if len(group) > 1:
                        out += [(n, max(group)) for n in group]
            elif step not in number:
                enter(step)
            elif step in on_stack:
                low[node] = min(low[node], number[step])
    return pd.DataFrame(out, columns=["node", "strong"])


def by_component(edges: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], limit: int = GROUP_EDGES) -> DataFrame:
    """``small`` over edges of components of at most ``limit`` edges (with a ``slot``), ``large`` over those of larger ones.

    A slot holds whole components, about ``limit`` edges of them, so that Python is called per slot and not per component.
    """
    placed = cut(edges.join(weak_components(edges).withColumnRenamed("node", "a"), "a"))
    slots = placed.count() // max(limit, 1) + 1
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(slots)))
    big = cut(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("part"))
    if big.isEmpty():
        return small(placed)
    return small(placed.join(big, "part", "left_anti")).unionByName(large(placed.join(big, "part", "left_semi").drop("part", "slot")))


def strong_components(edges: DataFrame, limit: int = GROUP_EDGES) -> DataFrame:
    """``node, strong`` (the component's greatest node) of every node on a cycle of ``edges(a, b)``; ids of any one type."""
    edges = trimmed(edges.where("a <> b").select("a", "b").distinct(), TRIM_ROUNDS)
    kind = edges.schema["a"].dataType.simpleString()
    return by_component(edges, lambda e: e.groupBy("slot").applyInPandas(strong_of_group, f"node {kind}, strong {kind}"), strong_in_rounds, limit)


def between_cycles(edges: DataFrame, limit: int = GROUP_EDGES) -> DataFrame:
    """``node``: what stays when edges into ends and out of beginnings are removed again and again: nodes on a cycle or on a way from one cycle to another."""
    edges = trimmed(edges.where("a <> b").select("a", "b").distinct(), TRIM_ROUNDS)
    kind = edges.schema["a"].dataType.simpleString()

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        while True:
            kept = pdf[pdf["b"].isin(set(pdf["a"])) & pdf["a"].isin(set(pdf["b"]))]
            if len(kept) == len(pdf):
                return pd.DataFrame({"node": pd.unique(pd.concat([pdf["a"], pdf["b"]]))})
            pdf = kept

    def all_rounds(e: DataFrame) -> DataFrame:
        left = trimmed(e)
        return left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()

    return by_component(edges, lambda e: e.groupBy("slot").applyInPandas(rest, f"node {kind}"), all_rounds, limit)
