"""Hard negatives by inner product: R-trees packed by sort-tile-recursive, searched best first.

Rows are dealt evenly into shards of about `SHARD` numbers. A task holds one shard at a time: its rows arrive first and are
packed into a tree, then the queries stream past it. Two rounds: the best rows of an anchor's own label (the positives),
then, for each of them, the best rows of other labels whose score lies in a window below the positive's.

A node's bounding box gives an interval of each coordinate's product with the query and so of the whole score. The queue of
a search is ordered by the best score still possible; boxes outside the window are never put in, and the search ends at the
first one strictly below the k-th score found. A box that only ties is left out where its least id comes after the k-th's,
so that thousands of equal vectors do not all have to be opened. The label is one more coordinate, tiled first.

All scores are whole numbers. They are computed in doubles where the components' size proves them exact there, else in 64
bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surety.llm.common import blocks, stored

SCALE = 256
FARTHEST = 1 << 25          # components beyond are set to it (131072 before scaling), so that scores fit 64 bits
SHARD = 1 << 19             # numbers in a shard: 8192 vectors of 64
LEAF, FANOUT, TILED = 64, 16, 4
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100         # per cent of the positive's score
NO_LIMIT = (1 << 62)


# ---------------------------------------------------------------- tree

def _tiles(rows: np.ndarray, columns: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Sort-tile-recursive: slabs along the first column, each tiled along the next; runs of `LEAF` rows at the end."""
    parts = -(-len(rows) // LEAF)
    if parts <= 1 or not columns:
        rows = rows[np.lexsort((ids[rows], columns[0][rows]))] if columns else rows
        return [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]
    rows = rows[np.lexsort((ids[rows], columns[0][rows]))]
    slab = LEAF * -(-parts // int(np.ceil(parts ** (1 / len(columns)))))
    return [t for i in range(0, len(rows), slab) for t in _tiles(rows[i:i + slab], columns[1:], ids)]


def packed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf. Labels with a leaf's worth of rows have leaves of their own, rarer ones share."""
    columns = [x[:, c] for c in np.argsort(-x.var(0), kind="stable")[:TILED].tolist()]
    order = np.lexsort((ids, labels))
    runs = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)
    own, rare = [r for r in runs if len(r) >= LEAF], [r for r in runs if len(r) < LEAF]
    leaves = [t for r in own for t in _tiles(r, columns, ids)]
    if rare:
        pool = np.concatenate(rare)
        leaves += [pool[i:i + LEAF] for i in range(0, len(pool), LEAF)]
    return leaves


class Tree:
    """Nodes lie in one list, leaves first, the root last; a node's children (or a leaf's rows) are a range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        leaves = packed(ids, labels, x)
        order = np.concatenate(leaves)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.leaves = len(leaves)
        first = np.cumsum([0, *[len(r) for r in leaves]])
        start = first[:-1]
        level = [np.minimum.reduceat(self.x, start), np.maximum.reduceat(self.x, start), np.minimum.reduceat(self.labels, start),
                 np.maximum.reduceat(self.labels, start), np.minimum.reduceat(self.ids, start)]
        levels, begin, end, base = [level], [start], [first[1:]], 0
        while len(level[0]) > 1:
            n = len(level[0])
            start = np.arange(0, n, FANOUT)
            level = [f.reduceat(a, start) for f, a in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.minimum), level)]
            levels.append(level)
            begin.append(base + start)
            end.append(base + np.minimum(start + FANOUT, n))
            base += n
        self.low, self.high, self.label_low, self.label_high, self.least_id = (np.concatenate(c) for c in zip(*levels))
        self.begin, self.end = np.concatenate(begin).tolist(), np.concatenate(end).tolist()
        self.size = int(np.abs(self.x).max()) if x.size else 0
        self.exact = [a.astype(np.float64) for a in (self.x, self.low, self.high)]

    def best(self, q_id: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score): up to k (-score, id), best first.

        Rows of the query's id take no part; of the others those of its label (`same`) or those of every other label.
        """
        doubles = len(q) * self.size * (int(np.abs(q).max()) if len(q) else 0) < 1 << 53
        x, low, high = self.exact if doubles else (self.x, self.low, self.high)
        up, down = (np.maximum(q, 0), np.minimum(q, 0)) if not doubles else (np.maximum(q, 0.0), np.minimum(q, 0.0))
        most, least = high @ up + low @ down, low @ up + high @ down
        mine = (self.label_low <= label) & (self.label_high >= label) if same else (self.label_low != label) | (self.label_high != label)
        most, least, least_id, opened = most.tolist(), least.tolist(), self.least_id, {}

        def rows_of(leaf: int) -> tuple[np.ndarray, np.ndarray]:
            if leaf not in opened:
                a, b = self.begin[leaf], self.end[leaf]
                fits = ((self.labels[a:b] == label) == same) & (self.ids[a:b] != q_id)
                opened[leaf] = (x[a:b] @ q)[fits], self.ids[a:b][fits]
            return opened[leaf]

        out, root = [], len(self.begin) - 1
        for floor, ceiling in windows:
            found: list[tuple[int, int]] = []
            queue = []

            def offer(node: int) -> None:
                if mine[node] and most[node] >= floor and least[node] <= ceiling:
                    heapq.heappush(queue, (-min(most[node], ceiling), int(least_id[node]), node))

            offer(root)
            while queue:
                bound, first_id, node = heapq.heappop(queue)
                if len(found) == k and (bound, first_id) > found[-1]:
                    if bound > found[-1][0]:
                        break                       # strictly below the k-th: so is the rest of the queue
                    continue                        # only ties, and with later ids
                if node >= self.leaves:
                    for child in range(self.begin[node], self.end[node]):
                        offer(child)
                    continue
                scores, ids = rows_of(node)
                keep = (scores >= max(floor, -found[-1][0] if len(found) == k else floor)) & (scores <= ceiling)
                if keep.any():
                    s, i = scores[keep], ids[keep]
                    top = np.lexsort((i, -s))[:k]
                    found = sorted(found + list(zip((-s[top].astype(np.int64)).tolist(), i[top].tolist())))[:k]
            out.append(found)
        return out


# ---------------------------------------------------------------- tables

def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, x (whole numbers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-FARTHEST)), F.lit(FARTHEST)).cast("int"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine & (F.size(v) > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size(v).alias("dim"), x.alias("x"))


_WINDOW = "array<struct<positive_id:bigint,positive_score:bigint,place:int>>"
_FOUND = "key long, anchor_id long, positive_id long, positive_score long, place int, id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _windows(listed: list | None) -> list[tuple[int | None, int | None, int, int, int]]:
    """positive_id, positive_score, place, least and greatest score of each search of a query."""
    if listed is None:
        return [(None, None, 0, -NO_LIMIT, NO_LIMIT)]
    return [(w["positive_id"], w["positive_score"], w["place"], -(-LOW * w["positive_score"] // 100), w["positive_score"] * HIGH // 100)
            for w in listed]


def _search(same: bool, k: int):
    """Rows sorted by dim, shard, is_query: a shard's vectors, then the queries that visit it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, tree = None, [], None
        for batch in batches:
            dims, shards, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "is_query"))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)]):
                if at != (at := (int(dims[a]), int(shards[a]))) or (not asks[a] and tree is not None):
                    rows, tree = [], None
                part = batch.slice(a, b - a)
                x = _matrix(part.column("x"), at[0])
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                if not asks[a]:
                    rows.append((ids, labels, x))
                    continue
                if not rows and tree is None:
                    continue
                if tree is None:
                    tree, rows = Tree(*(np.concatenate(c) for c in zip(*rows))), []
                out = []
                for key, q_id, label, q, listed in zip(part.column("key").to_pylist(), ids.tolist(), labels.tolist(), x, part.column("windows").to_pylist()):
                    asked = _windows(listed)
                    for (pid, pscore, place, *_), found in zip(asked, tree.best(q_id, label, q, [w[3:] for w in asked], same, k)):
                        out += [(key, q_id, pid, pscore, place, i, -s) for s, i in found]
                columns = list(zip(*out)) if out else [[]] * 7
                types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 ["key", "anchor_id", "positive_id", "positive_score", "place", "id", "score"])
    return run


def _best(rows: DataFrame, shards: int, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best of every search over all shards, with their rank."""
    cells = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    both = rows.select("dim", "shard", F.lit(False).alias("is_query"), "vec_id", "label", "x", F.lit(None).cast("long").alias("key"),
                       F.lit(None).cast(_WINDOW).alias("windows")).unionByName(cells.withColumn("is_query", F.lit(True)))
    found = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "is_query").mapInArrow(_search(same, k), _FOUND)
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every row for which `asked` holds.

    Needs vec_id, label and embedding; other columns are not read. Rows with a null id or label, a null or empty vector or
    a null or non-finite component take no part on either side; vectors of another length never meet. Higher scores come
    first, ties by smaller id. "Other" rows are those of another id: an id that stands in several rows counts each of them
    as a candidate, and each of them that differs as an anchor. Anchors without a positive, and positives without a row in
    their window (all of them with a score below zero), give no rows; an empty table gives none.
    """
    dealt = F.xxhash64(F.monotonically_increasing_id())     # even shards, whatever ids repeat
    rows = stored(usable(vectors).withColumn("deal", dealt))
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    shards = blocks(size["n"] * (size["dim"] or 1), SHARD)
    rows = rows.withColumn("shard", F.pmod("deal", F.lit(shards)))
    anchors = (rows.filter(asked).select("vec_id", "label", "dim", "x").distinct()
               .withColumn("key", F.xxhash64("vec_id", "label", "x")))
    near = stored(_best(rows, shards, anchors.withColumn("windows", F.lit(None).cast(_WINDOW)), True, positives))
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))).alias("windows"))
    found = _best(rows, shards, anchors.join(windows, "key"), False, negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
