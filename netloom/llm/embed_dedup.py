"""Embedding near-duplicates by tiled comparison along principal axes.

1. Equal vectors become one node with a count. Vectors are scaled to length 1, and rotated
   to the principal axes of all of them (their second moments are summed in Spark; the axes
   are a d x d matrix). A rotation keeps cosines.
2. Nodes are ordered by their first coordinate and dealt into blocks. Vectors with a cosine
   of at least t are at most sqrt(2 - 2t) apart, in each coordinate too, so only blocks whose
   ranges come that near make a tile.
3. In a tile, the products of the leading coordinates are accumulated, a strip of rows
   against a block at a time. What the remaining coordinates can add is at most the product
   of the suffix norms. Where that cannot reach t, the comparison stops; few pairs go on to
   the next coordinates, and what is left has its cosine taken in double precision from the
   vectors as they came.
4. A tile counts each node's links and returns a spanning forest of them; components() joins
   the forests. Links themselves are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.graph import components, forest
from netloom.llm.groups import runs
from netloom.llm.store import cut, map_batches, prepare

#: Nodes in a block, rows of a strip.
BLOCK, STRIP = 12288, 512
#: Leading coordinates after which bounds are looked at.
STEPS = (16, 32)
#: For rounding in single-precision bounds.
SLACK = 1e-4


def _vectors(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), -1) if raw else np.zeros((len(column), 0))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dims, vector): the components as doubles in bytes, or null for what links with nothing."""
    for batch in batches:
        out, dims = [], []
        for x in batch.column(1).to_pylist():
            v = None if x is None or None in x else np.array(x, np.float64)
            ok = v is not None and len(v) and np.isfinite(v).all() and v.any() and np.isfinite(n := np.linalg.norm(v)) and n > 0
            out.append((v + 0.0).tobytes() if ok else None)
            dims.append(len(v) if ok else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dims", "vector"])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        u = unit(_vectors(batch.column(0)))
        w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        m = (u * w[:, None]).T @ u
        total = m if total is None else total + m
    if total is not None:
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "moment"])


def _lead(batches: Iterator[pa.RecordBatch], axis: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lead = unit(_vectors(batch.column(batch.schema.get_field_index("vector")))) @ axis if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.float64())], [*batch.schema.names, "lead"])


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of a and b with a cosine of at least `least`; of one block, i < j."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = a / na[:, None], b / nb[:, None]
    if axes is not None:
        ya, yb = ya @ axes, yb @ axes
    d = ya.shape[1]
    steps = [s for s in STEPS if s < d] or [d]

    def suffix(y: np.ndarray, s: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", y[:, s:], y[:, s:])))

    s = steps[0]
    # the bound of the first step as one product: leading coordinates, and the suffix norm as one more
    left = np.hstack([ya[:, :s], suffix(ya, s)[:, None]]).astype(np.float32)
    right = np.hstack([yb[:, :s], suffix(yb, s)[:, None]]).astype(np.float32).T.copy()
    rest = {t: (suffix(ya, t), suffix(yb, t)) for t in steps[1:]}
    for first in range(0, len(a), STRIP):
        start = first if same else 0
        i, j = np.nonzero(left[first : first + STRIP] @ right[:, start:] >= least - SLACK)
        i, j = i + first, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            done, product = 0, np.zeros(len(x))
            for t in steps[1:]:
                product = product + np.einsum("ij,ij->i", ya[x, done:t], yb[y, done:t])
                go = product + rest[t][0][x] * rest[t][1][y] >= least - SLACK
                x, y, product, done = x[go], y[go], product[go], t
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            ok = cosine >= least
            if ok.any():
                yield x[ok], y[ok]


def _tiles(batches: Iterator[pa.RecordBatch], axes: np.ndarray | None, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): links of a forest with n null, and a node's number of links with b null."""
    for tile in runs(batches, ["low", "high"]):
        block, low, high = (tile[c].to_numpy() for c in ("block", "low", "high"))
        node, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
        v = _vectors(tile["vector"].combine_chunks())
        same = low[0] == high[0]
        left, right = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        links = np.zeros(len(node))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in near_pairs(v[left], v[right], axes, least, same):
            i, j = left[i], right[j]
            links += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            x, y = forest(node[i], node[j])
            a.append(x)
            b.append(y)
        a, b = forest(np.concatenate(a), np.concatenate(b))
        has = np.flatnonzero(links)
        n = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), n], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.nulls(len(has), pa.int64()), pa.array(links[has].astype(np.int64))], ["a", "b", "n"])


def blocked(nodes: DataFrame, dims: int, least: float) -> tuple[DataFrame, np.ndarray]:
    """(low, high, block, node, copies, vector), the tiles of vectors of one length in order of
    their first principal axis, and all axes."""
    moments = np.zeros(dims * dims)
    for at, m in nodes.select("vector", "copies").transform(map_batches, _moments, "at long, moment double").groupBy("at").agg(F.sum("moment")).collect():  # d * d rows
        moments[at] = m
    axes = np.linalg.eigh(moments.reshape(dims, dims))[1][:, ::-1].copy()
    blocks = max(1, -(-nodes.count() // BLOCK))
    led = nodes.select("vector", "node", "copies").transform(map_batches, partial(_lead, axis=axes[:, 0]), "vector binary, node long, copies long, lead double")
    led = cut(led.repartitionByRange(blocks, "lead").withColumn("part", F.spark_partition_id()), "ordered")
    parts = (led.agg(F.max("part")).first()[0] or 0) + 1
    led = led.withColumn("block", F.floor(F.col("part") * blocks / parts).cast("int")) if parts > blocks else led.withColumn("block", F.col("part"))
    ends = led.groupBy("block").agg(F.min("lead").alias("from"), F.max("lead").alias("to"))
    # blocks lie in order, so a block's near ones begin in the cells, as wide as a reach, that it covers or in the next
    apart = float(np.sqrt(2 - 2 * least)) + 1e-9
    cell = lambda c: F.floor(F.col(c) / apart)
    x = ends.select(F.col("block").alias("low"), F.col("to").alias("end"), F.explode(F.sequence(cell("from"), cell("to") + 1)).alias("cell"))
    y = ends.select(F.col("block").alias("high"), F.col("from").alias("start"), cell("from").alias("cell"))
    spans = x.join(y, "cell").where("high >= low").where(F.col("start") - F.col("end") <= apart).select("low", "high")
    spans = spans.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return led.join(spans, "block").select("low", "high", "block", "node", "copies", "vector"), axes


def near_embeddings(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of `vectors`.

    Vectors link when they have one length and their cosine in double precision is at least
    `least` (over 0). Null and zero vectors and such with null or non-finite components link
    with nothing: n_links is 0 and component_id their own id. Each length is compared within
    itself. Equal vectors link, rows with equal ids too; component_id is the smallest id that
    links reach, null ids left out; a null id is never kept. An empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.transform(map_batches, _clean, "vec_id long, dims int, vector binary")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # copies of a vector are one node, which the smallest of their rows names
    nodes = rows.where("vector is not null").groupBy("dims", "vector").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = cut(nodes, "nodes")
    # lengths with more nodes than a block, and in any case the commonest, have axes of their own
    lengths = nodes.groupBy("dims").agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).unionByName(lengths.where(F.col("n") > BLOCK)).distinct()
    large = [r["dims"] for r in top.select("dims").collect()]
    small = nodes.where(~F.col("dims").isin(large)) if large else nodes
    tiles = [(small.select(F.col("dims").alias("low"), F.col("dims").alias("high"), F.col("dims").alias("block"), "node", "copies", "vector"), None)]
    tiles += [blocked(nodes.where(F.col("dims") == d), d, least) for d in large]
    parts = []
    for placed, axes in tiles:
        placed = placed.repartition("low", "high").sortWithinPartitions("low", "high")
        parts.append(cut(placed.transform(map_batches, partial(_tiles, axes=axes, least=least), "a long, b long, n long"), "tiles"))
    found = spark.read.schema(parts[0].schema).parquet(*(x.cut_path for x in parts))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    label = components(found.where("b is not null").select("a", "b"))
    named = nodes.join(links.withColumnRenamed("a", "node"), "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("vector", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    out = rows.join(named, "vector", "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
