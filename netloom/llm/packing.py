"""Best-fit packing of documents into training sequences by linear grouping.

Each text becomes token ids and one separator; only texts longer than a sequence are cut.
The plan needs no documents, only how many pieces there are of each length: at most as many
numbers as a sequence has tokens, whatever the corpus.

1. Lengths over `small` are sorted and dealt into groups of equal cardinality, each rounded
   up to its largest length: few sizes. A linear programme over configurations (multisets
   of sizes that fit a sequence), solved by column generation, says how often to use which;
   the whole part of each is taken.
2. The actual pieces take the places of their group's size, which leaves gaps.
3. What the rounding left over and then the small lengths go, longest first, where they fit
   best: into the smallest gap that takes them, else into a new sequence.

Sequences with the same lengths are one class with a count, so the plan has some thousand
rows. A piece's number among the pieces of its length picks its sequence and offset from it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.bpe import WordIds
from netloom.llm.store import cut, map_batches, prepare
from netloom.llm.text import batch_texts

#: A class of like sequences: how many, and (length, copies in each, number of the first piece).
Class = tuple[int, list[tuple[int, int, int]]]



def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    ids = WordIds(path)
    task = TaskContext.get().partitionId()
    seen = np.zeros(size + 1, np.int64)
    for batch in batches:
        for first, raw, offsets in batch_texts(batch.column(1), 1 << 21):
            texts = ids.words(raw.tobytes(), offsets.tolist())
            ids.learn(set().union(*texts))
            out: list[tuple[int, int, int, int, int, int]] = []
            for i, words in enumerate(texts, first):
                tokens = b"".join([*map(ids.__getitem__, words), b"\0\0\0\0"])
                for piece, at in enumerate(range(0, len(tokens), 4 * size)):
                    part = tokens[at : at + 4 * size]
                    length = len(part) // 4
                    out.append((i, piece, at // 4, length, zlib.crc32(part), int(seen[length])))
                    seen[length] += 1
            row, piece, start, length, crc, rank = (np.array(x, np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc)), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )


def groups_of(counts: np.ndarray, small: int, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) of each group, longest first; all groups but the last hold equally many."""
    lengths = [(n, int(counts[n])) for n in range(len(counts) - 1, small, -1) if counts[n]]
    each = -(-sum(c for _, c in lengths) // groups) if lengths else 0
    out: list[list[tuple[int, int]]] = []
    room = 0
    for n, c in lengths:
        while c:
            if not room:
                out.append([])
                room = each
            take = min(c, room)
            out[-1].append((n, take))
            c -= take
            room -= take
    return out


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of at most `room` in all with the greatest worth."""
    best = np.zeros(room + 1)
    steps: list[tuple[int, np.ndarray]] = []
    for i, (s, y) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if y <= 1e-12:
            continue
        for _ in range(room // s):
            with_one = best[:-s] + y
            better = with_one > best[s:] + 1e-12
            if not better.any():
                break
            best = best.copy()
            best[s:][better] = with_one[better]
            steps.append((i, better))
    config, at = np.zeros(len(sizes), np.int64), room
    for i, better in reversed(steps):
        s = int(sizes[i])
        if at >= s and better[at - s]:
            config[i] += 1
            at -= s
    return float(best[room]), config


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and the whole number of times to use each, by column generation."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(room // sizes).astype(float)
    for _ in range(40 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, config = _best_configuration(sizes, worth, room)
        if value <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, demand), np.linalg.solve(basis, config.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = config
    x = np.linalg.solve(basis, demand)
    out, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable").tolist():
        config = np.rint(basis[:, j]).astype(np.int64)
        has = config > 0
        times = min(int(np.floor(x[j] + 1e-9)), int((left[has] // config[has]).min())) if has.any() else 0
        if times > 0:
            out.append((config, times))
            left -= times * config
    return out


def plan_classes(counts: np.ndarray, small: int, groups: int) -> list[Class]:
    """Classes that hold every piece of counts[length] once; the longest length is a whole sequence."""
    room = len(counts) - 1
    left, first = counts.astype(np.int64).copy(), np.zeros(room + 1, np.int64)
    done: list[Class] = []
    if left[room]:
        done.append((int(left[room]), [(room, 1, 0)]))
        left[room] = 0

    def take(length: int, n: int) -> int:
        at = int(first[length])
        first[length] += n
        left[length] -= n
        return at

    grouped = groups_of(left, small, groups)
    sizes = np.array([g[0][0] for g in grouped], np.int64)
    demand = np.array([sum(c for _, c in g) for g in grouped], float)
    open_classes: list[Class] = []
    for config, times in configurations(sizes, demand, room):
        # the group's pieces take the places, longest first, one place of all sequences after another
        places: list[list[tuple[int, int]]] = []
        for i in np.flatnonzero(config).tolist():
            for _ in range(int(config[i])):
                runs, need = [], times
                while need:
                    length, c = grouped[i][0]
                    n = min(c, need)
                    runs.append((length, n))
                    need -= n
                    grouped[i][0] = (length, c - n)
                    if n == c:
                        grouped[i].pop(0)
                places.append(runs)
        while times:
            n = min(p[0][1] for p in places)
            held = [(p[0][0], 1, take(p[0][0], n)) for p in places]
            open_classes.append((n, held))
            times -= n
            for p in places:
                p[0] = (p[0][0], p[0][1] - n)
                if not p[0][1]:
                    p.pop(0)

    # best fit: gaps by size
    gaps: dict[int, list[Class]] = {}
    order: list[int] = []

    def put(c: Class) -> None:
        gap = room - sum(length * k for length, k, _ in c[1])
        if not gap:
            done.append(c)
            return
        if gap not in gaps:
            gaps[gap] = []
            order.insert(bisect_left(order, gap), gap)
        gaps[gap].append(c)

    for c in open_classes:
        put(c)
    for length in range(room - 1, 0, -1):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                k = min(room // length, int(left[length]))
                n = int(left[length]) // k
                put((n, [(length, k, take(length, n * k))]))
                continue
            gap = order[at]
            n, held = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            k = min(gap // length, int(left[length]))
            use = min(n, int(left[length]) // k)
            if use < n:
                put((n - use, [(x, c, s + use * c) for x, c, s in held]))
            put((use, [*held, (length, k, take(length, use * k))]))
    return done + [c for g in order for c in gaps[g]]


def plan_rows(classes: list[Class]) -> np.ndarray:
    """Rows (length, first number, copies in a sequence, first sequence, offset), sorted."""
    rows, sequence = [], 0
    for n, held in classes:
        offset = 0
        for length, k, first in held:
            rows.append((length, first, k, sequence, offset))
            offset += length * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    plan = plan.value
    keys = (plan[:, 0] << 50) + plan[:, 1]
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        length = cols["length"].to_numpy(zero_copy_only=False)
        number = cols["number"].to_numpy(zero_copy_only=False)
        row = plan[np.searchsorted(keys, (length << 50) + number, "right") - 1] if len(plan) else np.zeros((0, 5), np.int64)
        nth = number - row[:, 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], [*names, "sequence_id", "offset"])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, small: int | None = None, groups: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A text's ids are those of the tokenizer file at `tokenizer` (a path that all workers have;
    it must drop white space) without special tokens, then id 0; more than `size` ids are cut
    into pieces of `size`, the last may be shorter. Pieces of one sequence lie without gaps
    from offset 0. A null or empty text is the id 0 alone. Rows with equal ids or texts are
    packed each; an empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = docs.transform(map_batches, partial(_pieces, path=tokenizer or tokenizer_path(), size=size), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")
    pieces = cut(pieces, "pieces")  # a piece's task and its rank there are fixed from here on
    counts = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    by_length = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        by_length[length] = n
    plan = spark.sparkContext.broadcast(plan_rows(plan_classes(by_length, size // 8 if small is None else small, groups)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # as many counts as tasks and lengths: too many to broadcast where there are many tasks
    numbered = pieces.join(counts.hint("merge"), ["length", "task"]).withColumn("number", F.col("before") + F.col("rank"))
    return numbered.transform(map_batches, partial(_assign, plan=plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
