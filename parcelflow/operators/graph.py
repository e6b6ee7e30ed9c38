"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.sources.shared import staged

EDGES_A_TASK = 500_000


def find(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = root[at]
    while True:
        up = root[at]
        if (up == at).all():
            return at
        at = up


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for members that have a link, roots left out; the root is the smallest index."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = find(root, i), find(root, j)
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    root = find(root, np.arange(n))
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's edges to (node, component)."""
    got = [f.to_numpy(np.int64) for f in frames if len(f)]
    if got:
        nodes, ends = np.unique(np.concatenate(got), return_inverse=True)
        ends = ends.reshape(-1, 2)
        member, root = forest(len(nodes), iter([(ends[:, 0], ends[:, 1])]))
        yield pd.DataFrame({"node": nodes[member], "component": nodes[root]})


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) of every node that has a smaller one in its component: the smallest there.

    Edges (a, b) are dealt to as many tasks as their number asks for, and each task replaces its edges by a forest. One
    task is the whole answer; several go on with two alternating steps until nothing changes: every node's larger
    neighbours are joined to its smallest neighbour, and every node's smaller neighbours are joined to the smallest of
    them. Only nodes that have edges take part, and each round is written to the shared folder.
    """
    edges = staged(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    tasks = max(1, -(-edges.count() // edges_a_task))
    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
    solved = dealt.mapInPandas(_solve, "node long, component long")
    if tasks == 1:
        return solved
    edges, before = staged(solved.toDF("a", "b").distinct()), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        met = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = staged(met.unionAll(low.select("a", F.col("low").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        before = state


def merge_in_order(links: list[tuple[int, int]], apart: list[tuple[int, int]]) -> dict[int, int]:
    """node: smallest node of its part, after ``links`` were followed one by one unless they bring a pair of ``apart`` together."""
    part = {n: [n] for link in links for n in link}
    top = {n: n for n in part}
    foes: dict[int, set[int]] = {n: set() for n in part}
    for a, b in apart:
        if a in top and b in top:
            foes[a].add(b)
            foes[b].add(a)
    for a, b in links:
        x, y = top[a], top[b]
        if x == y or y in foes[x]:
            continue
        if len(part[x]) + len(foes[x]) < len(part[y]) + len(foes[y]):
            x, y = y, x
        for n in part[y]:
            top[n] = x
        part[x] += part.pop(y)
        for f in foes.pop(y):
            foes[f].discard(y)
            foes[f].add(x)
            foes[x].add(f)
    least = {x: min(nodes) for x, nodes in part.items()}
    return {n: least[x] for n, x in top.items()}


def _merge_group(links: pd.DataFrame, apart: pd.DataFrame) -> pd.DataFrame:
    links = links.sort_values(["score", "a", "b"], ascending=[False, True, True], kind="stable")
    got = merge_in_order(list(zip(links.a.tolist(), links.b.tolist(), strict=True)), list(zip(apart.a.tolist(), apart.b.tolist(), strict=True)))
    return pd.DataFrame({"node": list(got.keys()), "component": list(got.values())}, dtype="int64")


def merge_apart(links: DataFrame, apart: DataFrame, most: int = EDGES_A_TASK) -> DataFrame:
    """(node, component): parts merged along ``links`` (a, b, score, group) from the highest score down (ties by a, b),
    unless both hold a pair of ``apart`` (a, b, group); the smallest node names its part.

    A group of up to ``most`` rows is one task's work; the rows of larger ones stay dealt and are merged in rounds.
    """
    rows = links.select("group").unionAll(apart.select("group")).groupBy("group").agg(F.count("*").alias("n"))
    large = staged(rows.where(F.col("n") > most).select("group"))
    few = lambda df: df.join(large, "group", "left_anti")
    small = few(links).groupBy("group").cogroup(few(apart).groupBy("group")).applyInPandas(_merge_group, "node long, component long")
    if large.isEmpty():
        return small
    return small.unionByName(_merge_in_rounds(links.join(large, "group", "left_semi"), apart.join(large, "group", "left_semi")))


def _merge_in_rounds(links: DataFrame, apart: DataFrame) -> DataFrame:
    """A link that is the highest at both of its parts comes before all others there, so in every round all such links are
    followed at once; they meet no part twice. Links between parts that must stay apart are dropped, as they would be
    refused for good. Each round is written to the shared folder.
    """
    ends = lambda df: df.select(*[F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")], *[c for c in df.columns if c not in ("a", "b")]).where("a <> b")
    links = staged(ends(links.select("a", "b", F.struct("score", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")).alias("rank"))))
    apart = staged(ends(apart.select("a", "b")).distinct())
    labels = staged(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    while True:
        links = staged(links.join(apart, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.max("rank").alias("rank")))
        if links.isEmpty():
            return labels
        top = links.select(F.col("a").alias("part"), "rank").unionAll(links.select("b", "rank")).groupBy("part").agg(F.max("rank").alias("rank"))
        of = lambda side: top.select(F.col("part").alias(side), "rank")
        merged = staged(links.join(of("a"), ["a", "rank"], "left_semi").join(of("b"), ["b", "rank"], "left_semi").select(F.col("b").alias("old"), F.col("a").alias("new")))

        def renamed(df: DataFrame, column: str, merged: DataFrame = merged) -> DataFrame:
            joined = df.join(merged.withColumnRenamed("old", column), column, "left")
            return joined.withColumn(column, F.coalesce("new", column)).drop("new")

        links = ends(renamed(renamed(links, "a"), "b"))
        apart = staged(ends(renamed(renamed(apart, "a"), "b")).distinct())
        labels = staged(renamed(labels, "component"))
