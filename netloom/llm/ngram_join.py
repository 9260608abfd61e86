"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold.

1. One pass over the texts gives each document its set's size and a 64-bit digest of the
   set; documents of one digest are one node from there on.
2. The same pass gives each set its signatures. Sets a and b with sizes in a band can only
   reach the threshold if they differ in at most H shingles. The band cuts the hash space
   into more than H ranges, so that two such sets are equal in one range at least, and the
   hash of what a set holds in a range is a signature. This loses no pair. Shingles of very
   many documents would tie strangers together, so a counting pass first marks the cells of
   a hash table that hold them, and signatures are made of the others; only sets with too
   little left have signatures of all their shingles, too. Any marking keeps the guarantee.
   Within a map task a signature goes out once; further sets that have it are tied to the first.
   Signatures shuffle in buckets of the hash space, sorted and packed: some twelve bytes each.
3. Sets with a common signature make families (connected components). A family is a tile, or
   if it is large, dealt into parts by size, of which those make tiles that can link. Only hashed bitmaps of the sets go there, about three bits a
   shingle. In a tile, sets lie in order of size; for a set, the band of sizes that can reach
   the threshold counts, and bit counts bound the overlap from above. Sets that a bound lets
   through make smaller families; most sets are in none. In a large corpus, strangers that
   share a shingle by chance tie each other to families of most of its sets. Sets of a family
   that one tile does not hold are therefore grouped anew first: minima of their shingles under
   some hundred orders, six of them a key. Two linked sets have no key in common with odds of
   2^-62, as two words one hash; strangers, who share few of their shingles, have none.
4. The texts of those families go to tiles in the same way. A band and the bound choose the
   pairs as before, but for what is linked already, and sorted arrays are intersected.
5. A tile returns a spanning forest of its links; components() joins the forests.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.graph import components_of, forest
from netloom.llm.groups import runs
from netloom.llm.store import cut, forget, map_batches, prepare, release
from netloom.llm.text import Words, batch_texts, graph_bytes, grams, mix

#: Sets, and shingles, of a family that one tile holds; larger families take several.
TILE_SETS, TILE_SHINGLES = 1024, 1 << 22
#: Cells of the table that finds common shingles, as a power of two, and cells counted as one row.
CELLS, CELL_BLOCK = 22, 4096
#: Keys of a bucket that one worker holds at once, as a power of two.
KEYS_OF_BUCKET = 20
#: Minima that make a key, and cells that tell which sets of large families are wanted, as a power of two.
MINIMA, WANTED = 6, 22
#: A band's largest size over its smallest.
BAND = 1.4
_SEED = np.uint64(0xA0761D6478BD642F)


def band_starts(top: int, percent: int) -> np.ndarray:
    """The smallest sizes of the bands up to that which holds `top`, and one more."""
    ratio = max(BAND, 100 / percent)
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array([*out, max(out[-1] + 1, int(out[-1] * ratio))], np.int64)


def ranges(largest: int, percent: int, spare: int) -> tuple[int, int]:
    """For sets of at most `largest` shingles: ranges to cut the hash space into, and how many of
    a set's ranges may be empty: `spare` percent more than the sets can differ in."""
    differ = 2 * largest * (100 - percent) // (100 + percent)
    extra = -(-(differ + 1) * spare // 100) + 2 if differ else 0
    return differ + 1 + extra, extra


def _by_range(shingles: np.ndarray, count: int, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of the ranges that aren't empty, their numbers)."""
    if not len(shingles):
        return shingles, shingles
    place = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sums = np.add.reduceat(mix(shingles ^ _SEED), firsts)
    with np.errstate(over="ignore"):
        return mix(sums + mix(place[firsts] + tag)), place[firsts]


def signatures(shingles: np.ndarray, rare: np.ndarray, starts: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one sorted set: in its own band, and in the next if a partner can be
    there. `rare` marks the shingles that signatures are made of.

    Two linked sets are equal in more ranges than may be empty. So either one of them has a
    range that isn't empty and equal, or both have too many empty ones, and then both have
    signatures of all shingles, for which the same holds; there empty ranges count, too.
    """
    n = len(shingles)
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = []
    for band in (own, own + 1):
        if band > own and 100 * n < percent * int(starts[band]):
            continue
        largest = int(starts[band + 1]) - 1
        with np.errstate(over="ignore"):
            tags = mix(np.array([2 * band + 1, 2 * band + 2], np.uint64) * _SEED)
        count, spare = ranges(largest, percent, 25)
        found, _ = _by_range(shingles[rare], count, tags[:1])
        out.append(found)
        if count - len(found) > spare:
            count, spare = ranges(largest, percent, 6)
            found, place = _by_range(shingles, count, tags[1:])
            out.append(found)
            if count - len(found) > spare:
                empty = np.setdiff1d(np.arange(count, dtype=np.uint64), place)
                with np.errstate(over="ignore"):
                    out.append(mix(mix(empty + tags[1:]) ^ _SEED))
    return np.concatenate(out)


def orders(percent: int) -> np.ndarray:
    """An odd factor for each order of the shingles: so many that two sets at the threshold,
    which share each minimum with odds of percent / 100, miss each other with odds of 2^-62."""
    hit = (percent / 100) ** MINIMA
    keys = math.ceil(62 * math.log(2) / -math.log1p(-hit)) if hit < 1 else 1
    with np.errstate(over="ignore"):
        return mix(np.arange(1, MINIMA * keys + 1, dtype=np.uint64) * _SEED) | np.uint64(1)


def minima_keys(shingles: np.ndarray, factors: np.ndarray, percent: int) -> np.ndarray:
    """The keys of one set, each a hash of MINIMA smallest shingles; none if the set is so small
    that no other can link with it."""
    n = len(shingles)
    if 100 * n < percent * (n + 1):
        return np.zeros(0, np.uint64)
    spread = mix(shingles ^ _SEED)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, n, 64):
            np.minimum(least, (spread[i : i + 64, None] * factors).min(axis=0), out=least)
        # one sum of mixed minima a key; a minimum's place is part of it
        return mix(mix(least ^ factors).reshape(-1, MINIMA).sum(axis=1, dtype=np.uint64))


def _minima(batches: Iterator[pa.RecordBatch], k: int, percent: int, wanted) -> Iterator[pa.RecordBatch]:
    """(node, keys) of the sets of texts whose digests lie in wanted cells."""
    hashed, wanted, factors = Words(graph_bytes()), wanted.value, orders(percent)
    for batch in batches:
        done: set[int] = set()
        for _, raw, offsets in batch_texts(batch.column(0)):
            nodes, keys = [], []
            for s in shingle_sets(*hashed(raw, offsets), k):
                digest = digest_of(s)
                if len(s) and digest not in done and wanted[digest & ((1 << WANTED) - 1)]:
                    done.add(digest)
                    nodes.append(digest)
                    keys.append(minima_keys(s, factors, percent))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys])
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "keys"])


def _unrolled_minima(batches: Iterator[pa.RecordBatch], k: int, percent: int, wanted, bits: int) -> Iterator[pa.RecordBatch]:
    yield from _unroll(_minima(batches, k, percent, wanted), bits)


def regrouped(near: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """`near` (node, n, family, ...) with the sets of families that one tile does not hold grouped
    anew by minima; of these, sets that share no key with another go. Others stay as they are.

    Which sets are wanted goes to the workers as marks of cells, four million at most; a set
    of another family in a marked cell is keyed for nothing, and its family stays what it was.
    """
    spark = near.sparkSession
    large = near.groupBy("family").agg(F.ceil(F.sum(_cost())).alias("parts")).where("parts > 1").select("family")
    members = near.join(large, "family", "left_semi")
    cell = F.col("node").bitwiseAND((1 << WANTED) - 1).cast("int").alias("cell")
    cells = members.select(cell).distinct().toArrow()["cell"].to_numpy()
    if not len(cells):
        return near
    wanted = np.zeros(1 << WANTED, bool)
    wanted[cells] = True
    total = members.count() * len(orders(percent)) // MINIMA
    keyed = docs.select("text").transform(map_batches, partial(_unrolled_minima, k=k, percent=percent, wanted=spark.sparkContext.broadcast(wanted), bits=_bucket_bits(spark, total)), "bucket long, keys binary, refs binary, nodes binary")
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    groups = components_of(keyed, _meet)
    again = members.drop("family").join(groups, "node").select(*(c for c in near.columns if c != "family"), F.col("component").alias("family"))
    columns = [c for c in near.columns if c != "family"] + ["family"]
    out = cut(near.join(large, "family", "left_anti").select(*columns).unionByName(again), "regrouped")
    del keyed
    release(spark)
    return out


def _bucket_bits(spark, keys: int) -> int:
    """Buckets of about a million keys, and some for each task at least, as a power of two."""
    return max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (keys >> KEYS_OF_BUCKET).bit_length())


def _count_cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(block, n, counts): shingles of different sets by cell, a block of cells a row."""
    hashed = Words(graph_bytes())
    counts, done = np.zeros(1 << CELLS, np.int32), set()
    for batch in batches:
        for _, raw, offsets in batch_texts(batch.column(0)):
            own = [np.zeros(0, np.uint64)]
            for s in shingle_sets(*hashed(raw, offsets), k):
                digest = digest_of(s)
                if digest not in done:
                    done.add(digest)
                    own.append(s)
            np.add.at(counts, (np.concatenate(own) & np.uint64((1 << CELLS) - 1)).astype(np.int64), 1)
    yield from _blocks(counts)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, 1 << CELLS, CELL_BLOCK):
        own = counts[i : i + CELL_BLOCK].astype(np.int64)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // CELL_BLOCK], pa.int32()), pa.array([int(own.sum())]), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["block", "n", "counts"])


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["block"]):
        own = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t["counts"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([t["block"][0].as_py()], pa.int32()), pa.array([int(own.sum())]), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["block", "n", "counts"])


def _mark_cells(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(np.frombuffer(zlib.decompress(x), np.int64) > least, bitorder="little").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["block", "bits"])


def common_cells(docs: DataFrame, k: int) -> np.ndarray:
    """Whether each cell holds far more shingles than most: over four times the mean and 32."""
    counts = docs.select("text").transform(map_batches, partial(_count_cells, k=k), "block int, n long, counts binary")
    counts = cut(counts.repartition("block").sortWithinPartitions("block").transform(map_batches, _sum_cells, "block int, n long, counts binary"), "cells")
    total = counts.agg(F.sum("n")).first()[0] or 0
    marks = counts.select("block", "counts").transform(map_batches, partial(_mark_cells, least=4 * total / (1 << CELLS) + 32), "block int, bits binary")
    out = np.zeros(1 << CELLS, bool)
    for block, bits in marks.collect():  # all blocks together are a fixed half megabyte
        out[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    forget(counts)
    return out


def shingle_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted set of shingles of k words; with fewer words, all of them as one."""
    whole = grams(words, k)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(whole[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield grams(words[a:b], n) if n else np.zeros(0, np.uint64)


def _digests(batches: Iterator[pa.RecordBatch], k: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    hashed, common = Words(graph_bytes()), common.value
    starts = band_starts(1 << 40, percent)
    for batch in batches:
        done: set[int] = set()
        for first, raw, offsets in batch_texts(batch.column(1)):
            words, firsts = hashed(raw, offsets)
            sizes, digests, bits, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(words, firsts, k):
                digest = digest_of(s)
                sizes.append(len(s))
                digests.append(digest)
                bits.append(bitmap(s).tobytes())
                if len(s) and digest not in done:
                    done.add(digest)
                    rare = ~common[(s & np.uint64((1 << CELLS) - 1)).astype(np.int64)]
                    keys.append(signatures(s, rare, starts, percent))
                    ends.append(ends[-1] + len(keys[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64))),
                ],
                ["doc_id", "n_shingles", "node", "bits", "n_keys", "keys"],
            )


def pack_bucket(keys: np.ndarray, nodes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys with their nodes: the first key and how far it is from each to the next, in as
    few bytes as the widest step has; each node's number among the different ones, and these."""
    own, refs = np.unique(nodes, return_inverse=True)
    steps = np.diff(keys)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    packed = keys[:1].tobytes() + bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return packed, refs.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes(), own.tobytes()


def unpack_bucket(packed: bytes, refs: bytes, own: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, width, nodes = np.frombuffer(packed[:8], np.uint64), packed[8], np.frombuffer(own, np.int64)
    at = np.frombuffer(refs, np.uint16 if len(nodes) <= 1 << 16 else np.uint32)
    steps = np.zeros((len(at) - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed[9:], np.uint8).reshape(-1, width) if width else 0
    with np.errstate(over="ignore"):
        keys = np.cumsum(np.concatenate([first, steps.view(np.uint64).ravel()]), dtype=np.uint64)
    return keys, nodes[at]


def _unroll(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, refs, nodes): keys with their nodes by the first `bits` bits of the key, packed.
    In a run of rows a key goes out once, with its first node; other nodes that have it are tied
    to that first one by a key that only the two have."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        keys, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        keys = keys.view(np.uint64)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = nodes[new][np.cumsum(new) - 1]
        tied = ~new & (first != nodes)
        keys, a, b = keys[new], nodes[tied], first[tied]
        nodes = nodes[new]
        if len(a):
            a, b = forest(a, b)
            with np.errstate(over="ignore"):
                tie = mix(a.view(np.uint64) * _SEED + b.view(np.uint64))
            keys, nodes = np.concatenate([keys, tie, tie]), np.concatenate([nodes, a, b])
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order], nodes[order]
        bucket = keys >> np.uint64(64 - bits)
        ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        for i in range(0, len(ends), 64):
            own = [pack_bucket(keys[x:y], nodes[x:y]) for x, y in zip(starts[i : i + 64], ends[i : i + 64], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[i : i + 64]].astype(np.int64)), *(pa.array(x, pa.binary()) for x in zip(*own, strict=True))], ["bucket", "keys", "refs", "nodes"])

    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        held.append((flat, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))))
        n += len(flat)
        if n >= 1 << 21:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: links between the nodes of each key, as a forest for each bucket."""
    for t in runs(batches, ["bucket"]):
        parts = [unpack_bucket(*x) for x in zip(*(t[c].to_pylist() for c in ("keys", "refs", "nodes")), strict=True)]
        keys, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        a, b = forest(nodes[same + 1], nodes[same])
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(shingles)) + np.uint64(len(shingles))])).view(np.int64)[0])


def _once(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Without rows whose keys are those of the row before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.concatenate([[tuple(c[0] for c in cols) != last], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            last = tuple(c[-1] for c in cols)
            yield batch.filter(pa.array(new))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle, named by its hash, in 64-bit words: a power of two of them,
    with two to four bits a shingle up to 2**16 bits. A wider map folds into a narrower one."""
    width = 1 << min(10, max(1, (2 * len(shingles) - 1).bit_length() - 6))
    flags = np.zeros(64 * width, np.uint8)
    flags[((shingles >> np.uint64(20)) & np.uint64(64 * width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def bounded_pairs(sizes: np.ndarray, bits: list[np.ndarray], percent: int, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i of a tile in order of size, the later sets that may reach the threshold
    with it by size and bit counts, best bound first; those with i's label are left out."""
    widths = np.array([len(b) for b in bits])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        end = int(np.searchsorted(sizes, 100 * sizes[own[-1]] // percent, "right"))
        rows = np.stack([b if len(b) == width else _fold(b, width) for b in bits[own[0] : end]])
        for i in own.tolist():
            last = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
            rest = np.flatnonzero(label[i + 1 : last] != label[i]) + i + 1
            if not len(rest):
                continue
            x, y = rows[i - own[0]], rows[rest - own[0]]
            only_i = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_j = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            bound = np.minimum(sizes[i] - only_i, sizes[rest] - only_j)
            fit = (100 + percent) * bound >= percent * (sizes[i] + sizes[rest])
            if fit.any():
                yield i, rest[fit][np.argsort(-bound[fit], kind="stable")]


def _join(label: np.ndarray, i: int, j: int) -> None:
    low, high = sorted((label[i], label[j]))
    label[label == high] = low


def bounded_links(nodes: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a tile that their bitmaps let through."""
    order = np.argsort(sizes, kind="stable")
    nodes, sizes, bits = nodes[order], sizes[order], [bits[i] for i in order]
    label = np.arange(len(nodes))
    links = []
    for i, rest in bounded_pairs(sizes, bits, percent, label):
        for j in rest.tolist():
            if label[j] != label[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                _join(label, i, j)
    return links


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of one tile, as pairs of nodes."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    nodes, sizes, sets = nodes[order], sizes[order], [sets[i] for i in order]
    label = np.arange(len(nodes))
    links = []
    for i, rest in bounded_pairs(sizes, [bitmap(s) for s in sets], percent, label):
        a = sets[i]
        for j in rest.tolist():
            if label[j] == label[i]:
                continue
            b = sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if (100 + percent) * int((b[at] == a).sum()) >= percent * (len(a) + len(b)):
                links.append((int(nodes[i]), int(nodes[j])))
                _join(label, i, j)
    return links


def _pairs_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _bounded_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    links: list[tuple[int, int]] = []
    for tile in runs(_once(batches, ["family", "tile", "node"]), ["family", "tile"]):
        bits = [np.frombuffer(x, np.uint64) for x in tile["bits"].to_pylist()]
        links += bounded_links(tile["node"].to_numpy(), tile["n"].to_numpy(), bits, percent)
        if len(links) >= 1 << 16:
            yield _pairs_batch(links)
            links = []
    yield _pairs_batch(links)


def _exact_tiles(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    hashed = Words(graph_bytes())
    links: list[tuple[int, int]] = []
    for tile in runs(_once(batches, ["family", "tile", "node", "copy"]), ["family", "tile"]):
        found: dict[int, np.ndarray] = {}  # rows of one id may hold other texts than the node's
        nodes = tile["node"].to_numpy()
        for first, raw, offsets in batch_texts(tile["text"]):
            for i, s in enumerate(shingle_sets(*hashed(raw, offsets), k), first):
                if nodes[i] not in found and digest_of(s) == nodes[i]:
                    found[nodes[i]] = s
        links += tile_links(np.array(list(found), np.int64), list(found.values()), percent)
        if len(links) >= 1 << 16:
            yield _pairs_batch(links)
            links = []
    yield _pairs_batch(links)


def _cost() -> Column:
    """The share of a tile that a set of n shingles takes."""
    return F.greatest(F.lit(1 / TILE_SETS), F.col("n") / TILE_SHINGLES)


def tiled(members: DataFrame, percent: int) -> DataFrame:
    """`members` (node, n, family, ...) with the tiles of each. A family of more sets or shingles
    than a tile holds is dealt into parts by size, equal sizes by a hash; two parts meet in a
    tile where the largest set of one can reach the threshold with the smallest of the other."""
    cost = _cost()
    whole = members.join(members.groupBy("family").agg(F.ceil(F.sum(cost)).alias("parts")), "family")
    small = whole.where("parts = 1").drop("parts").withColumn("tile", F.lit(0).cast("long"))
    large = whole.where("parts > 1").drop("parts")
    # places on a line, from counts by size: a family's rows themselves are never in one task
    sizes = large.groupBy("family", "n").agg(F.count("*").alias("sets"))
    before = F.sum(F.col("sets") * cost).over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0.0)))
    place = F.col("before") + F.pmod(F.xxhash64("node"), "sets") * cost
    large = large.join(sizes, ["family", "n"]).withColumn("part", F.floor(place).cast("int")).drop("sets", "before")
    parts = large.groupBy("family", "part").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    low = parts.select("family", F.col("part").alias("low"), F.col("most_n").alias("low_n"))
    high = parts.select("family", F.col("part").alias("high"), F.col("least_n").alias("high_n"))
    meet = low.join(high, "family").where((F.col("low") <= F.col("high")) & (100 * F.col("low_n") >= percent * F.col("high_n")))
    tile = F.shiftleft(F.col("low").cast("long"), 31) + F.col("high")
    meet = meet.select("family", tile.alias("tile"), F.explode(F.array_distinct(F.array("low", "high"))).alias("part"))
    large = large.join(meet, ["family", "part"]).select(*members.columns, "tile")
    return small.select(*members.columns, "tile").unionByName(large)


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of `docs`.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    shingles of k words; component_id is the smallest id that links reach. A null or empty
    text, or one without words, has no shingle and no link: its component is its own id; long
    texts count whole.
    Rows with equal text are linked, repeated ids too; a null id stays null and counts for
    nothing in a component's smallest id (a component of null ids alone is null). An empty
    table gives no rows. Other columns of `docs` are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_cells(docs, k))
    digests = cut(docs.transform(map_batches, partial(_digests, k=k, percent=percent, common=common), "doc_id long, n_shingles long, node long, bits binary, n_keys long, keys array<long>"), "digests")
    bits = _bucket_bits(spark, digests.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0])
    keyed = digests.where("n_keys > 0").select("node", "keys").transform(map_batches, partial(_unroll, bits=bits), "bucket long, keys binary, refs binary, nodes binary")
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket")
    families = components_of(keyed, _meet)
    whole, digests = digests, cut(digests.drop("n_keys", "keys"), "sizes")
    del keyed
    forget(whole)
    release(spark)

    # one text stands for all copies of a set, that of the smallest id
    nodes = cut(digests.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "nodes")
    digests = digests.drop("bits")
    near = cut(nodes.join(families, "node").select("node", "n", "bits", F.col("component").alias("family")), "near")
    near = tiled(regrouped(near, docs, k, percent), percent)
    near = near.select("family", "tile", "node", "n", "bits").repartition("family", "tile").sortWithinPartitions("family", "tile", "node")
    families = components_of(near, partial(_bounded_tiles, percent=percent))
    members = cut(nodes.join(families, "node").select("node", "least", "n", F.col("component").alias("family")), "members")
    members = tiled(members, percent)
    placed = docs.join(members, F.col("doc_id").eqNullSafe(F.col("least"))).select("family", "tile", "node", F.xxhash64("text").alias("copy"), "text")
    placed = placed.repartition("family", "tile").sortWithinPartitions("family", "tile", "node", "copy")
    found = components_of(placed, partial(_exact_tiles, k=k, percent=percent))
    release(spark)

    least = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    least = least.join(smallest, "component").select("node", "component_id")
    out = digests.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(least, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
