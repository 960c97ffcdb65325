"""Connected components of a link table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Nodes, about, of the links that one task joins into trees at once: bounds a task's memory, whatever the size of its partition.
FOREST = 1 << 16


#: Files of a round's table for each core: rounds shrink fast, and many small files cost more than they hold.
FILES = 3


def few(df: DataFrame, name: str) -> DataFrame:
    """saved(), by no more tasks than keep all cores busy."""
    return saved(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> (root, node) for each node of the trees that they form, roots included; a root is its tree's smallest node."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= FOREST:
            yield pa.RecordBatch.from_arrays([pa.array(map(top, list(up)), kind), pa.array(up, kind)], ["root", "node"])
            up.clear()
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(map(top, list(up)), kind), pa.array(up, kind)], ["root", "node"])


def connected(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) for every node that stands in a link; root is the smallest node of its component.

    Each round first joins the links that a task holds into trees, then takes every node to the smallest root that it has in any task and
    contracts the trees accordingly, until no link is left: stars vanish in one round and, as nodes are digests in random order, chains shrink
    by a constant factor. A node stands once in each tree, so what meets at a hub are its trees, not its links. Only whether links are left
    reaches the driver. The links are read once; each round's nodes and links are saved, and the rounds put together in the end.
    """
    kind = links.schema["u"].dataType.simpleString()
    edges, steps = links.where("u <> v").select("u", "v"), []
    while True:
        trees = edges.mapInArrow(_forests, f"root {kind}, node {kind}")
        step = few(trees.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")), "step")
        steps.append(step.select("node", "low"))
        pairs = step.select(F.col("low").alias("u"), F.explode("roots").alias("node")).distinct()
        edges = few(pairs.join(steps[-1], "node").select("u", F.col("low").alias("v")).where("u <> v"), "edges")
        if edges.isEmpty():
            break
    roots = steps[-1].withColumnRenamed("low", "root")
    for step in reversed(steps[:-1]):
        roots = step.join(roots.select(F.col("node").alias("low"), "root"), "low", "left").select("node", F.coalesce("root", "low").alias("root"))
    return few(roots, "roots") if len(steps) > 1 else roots


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """connected() of the links behind `roots` (node, root) and of more `links` (u, v), given between roots and nodes that `roots` lacks."""
    if links.isEmpty():
        return roots
    moved = connected(links)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("low")), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return few(old.unionByName(moved.join(roots, "node", "left_anti")), "roots")
