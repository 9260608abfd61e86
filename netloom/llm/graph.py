"""Connected components of links between 64-bit nodes, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import cut, map_batches

#: Links that one worker holds while it shortens them: some 8 MB.
HELD = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) with the smallest node that it reaches, itself left out."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            again = new[new]
            if np.array_equal(again, new):
                break
            new = again
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _shorten(batches: Iterator[pa.RecordBatch], held_most: int = HELD) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= held_most:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def _then_shorten(batches: Iterator[pa.RecordBatch], f) -> Iterator[pa.RecordBatch]:
    return _shorten(b for b in f(batches) if b.num_rows)


def components_of(rows: DataFrame, f, held: int = HELD) -> DataFrame:
    """components() of the links (a, b) that f makes of Arrow batches of `rows`: they are shortened
    where they are made, by the same worker."""
    return _components(map_batches(rows, partial(_then_shorten, f=f), "a long, b long"), held)


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(node, component) for every node of `links` (a, b: long); component is the smallest
    node that links reach. Nodes without links, links of a node with itself and nulls give no row.

    Each task first makes a forest of its links. Once at most `held` links (16 bytes each) are
    left, one task ends the work. While there are more, rounds of large-star and small-star go
    on: both keep components whole, and they lead to a star for each. A round's minima are
    partial sums before the shuffle; the joins by node are plain equi-joins that adaptive
    execution can split where one node has very many links.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    return _components(links.transform(map_batches, _shorten, "a long, b long"), held)


def _components(shortened: DataFrame, held: int) -> DataFrame:
    edges = cut(shortened, "links")  # a > b
    while (n := edges.count()) > held:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: a node's larger neighbours go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.transform(map_batches, _shorten, "a long, b long").distinct(), "small")
        # a star forest: each leaf has one centre, and no centre is a leaf
        n, leaves = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if n == leaves and edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").isEmpty():
            break
    if n <= held:
        edges = cut(edges.coalesce(1).transform(map_batches, partial(_shorten, held_most=held + 1), "a long, b long"), "stars")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
