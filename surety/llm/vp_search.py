"""Approximate nearest neighbours: one vantage-point tree per shard, searched by blocks of queries.

Rows are dealt into shards of about `SHARD` by a hash of their id; each shard becomes one tree, stored as one row. A search
pairs every block of queries with every tree (an equi-join on the shard's number) and keeps the k best of each tree, so
what meets at the end is k rows per query and shard. A child of a node is skipped when the query lies farther outside it
than `factor` times the distance of the k-th best so far; with factor 1 the triangle inequality makes that exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surety.llm.common import blocks, stored

SHARD, QUERY_BLOCK, LEAF = 8192, 2048, 64
FACTOR = 0.9


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf, inner nodes (vantage point, low, high, left, right; leaf: -1) and their radii."""
    order, nodes, radii = np.arange(len(x)), [], []

    def grow(low: int, high: int) -> int:
        at = len(nodes)
        nodes.append([-1, low, high, -1, -1])
        radii.append(0.0)
        if high - low > LEAF:
            own = order[low:high]
            far = np.sqrt(((x[own] - x[own[0]]) ** 2).sum(1))
            point = own[int(far.argmax())]          # an outer point parts the rest better than an inner one
            d = np.sqrt(((x[own] - x[point]) ** 2).sum(1))
            rank = np.argsort(d, kind="stable")
            cut = int(np.searchsorted(d[rank], d[rank[len(rank) // 2]], "left")) or int(np.searchsorted(d[rank], d[rank[0]], "right"))
            if cut < len(rank):                      # else all lie at one distance: stays a leaf
                order[low:high] = own[rank]
                radii[at] = (float(d[rank[cut - 1]]) + float(d[rank[cut]])) / 2
                nodes[at] = [int(point), low, high, 0, 0]
                nodes[at][3] = grow(low, low + cut)
                nodes[at][4] = grow(low + cut, high)
        return at

    if len(x):
        grow(0, len(x))
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    table = np.array(nodes, np.int64).reshape(-1, 5)
    inner = table[:, 0] >= 0
    table[inner, 0] = place[table[inner, 0]]
    return order, table, np.array(radii)


class _Search:
    """All queries of a block against one tree: queries walk together, each with its own k best."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, radii: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.ids, self.x, self.nodes, self.radii, self.q_ids, self.q, self.k, self.factor = ids, x, nodes, radii, q_ids, q, k, factor
        self.xx, self.qq = (x * x).sum(1), (q * q).sum(1)
        self.best = np.full((len(q), k), np.inf)
        self.best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        if len(x) and len(q):
            self.visit(0, np.arange(len(q)))

    def visit(self, node: int, who: np.ndarray) -> None:
        point, low, high, left, right = self.nodes[node].tolist()
        if point < 0:
            return self.compare(low, high, who)
        d = np.sqrt(((self.q[who] - self.x[point]) ** 2).sum(1))
        gap, inside = np.abs(d - self.radii[node]), d <= self.radii[node]
        for near, far, mask in ((left, right, inside), (right, left, ~inside)):
            if mask.any():
                self.visit(near, who[mask])
        for far, mask in ((right, inside), (left, ~inside)):
            stay = who[mask][gap[mask] <= self.factor * self.best[who[mask], -1]]
            if len(stay):
                self.visit(far, stay)

    def compare(self, low: int, high: int, who: np.ndarray) -> None:
        x, q = self.x[low:high], self.q[who]
        rough = self.qq[who][:, None] + self.xx[low:high] - 2 * (q @ x.T)
        slack = 1e-9 * (self.qq[who][:, None] + self.xx[low:high]) + 1e-300
        i, j = np.nonzero((rough - slack <= self.best[who, -1][:, None] ** 2) & (self.q_ids[who][:, None] != self.ids[low:high]))
        if not len(i):
            return
        d = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
        rows = np.unique(i)
        own = np.repeat(rows, self.k)
        row = np.r_[own, i]
        dist = np.r_[self.best[who[rows]].ravel(), d]
        ids = np.r_[self.best_id[who[rows]].ravel(), self.ids[low:high][j]]
        order = np.lexsort((ids, dist, row))
        first = np.searchsorted(row[order], rows)
        take = order[first[:, None] + np.arange(self.k)]
        self.best[who[rows]], self.best_id[who[rows]] = dist[take], ids[take]


_TREES = "dim int, shard long, ids binary, vectors binary, nodes binary, radii binary"
_BLOCKS = "dim int, block long, q_ids binary, q binary"


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    order, nodes, radii = _tree(x)
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64)[order].tobytes()],
                         "vectors": [x[order].tobytes()], "nodes": [nodes.tobytes()], "radii": [radii.tobytes()]})


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "block": [rows["block"].iloc[0]], "q_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "q": [x.tobytes()]})


def _walk(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                dim = row["dim"]
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                s = _Search(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, dim),
                            np.frombuffer(row["nodes"], np.int64).reshape(-1, 5), np.frombuffer(row["radii"]), q_ids,
                            np.frombuffer(row["q"]).reshape(-1, dim), k, factor)
                found = np.isfinite(s.best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)[found.ravel()]), pa.array(s.best_id[found]), pa.array(s.best[found])],
                                                 ["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part: no nulls, not zero, finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """One row per shard with its tree, in the shared folder, and the number of shards."""
    rows = usable(vectors)
    shards = blocks(rows.count(), SHARD)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return stored(dealt.groupBy("dim", "shard").applyInPandas(_grow, _TREES)), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by distance, then vec_id.

    Distances are Euclidean, in double precision, on the vectors as they are. Vectors that are null, all zero or hold a null
    or non-finite component take no part on either side, nor do rows without an id. A query is not compared with rows of its
    own id, nor with vectors of another length. Fewer than k candidates: all of them. Rows that repeat an id count each.
    """
    rows = usable(queries)
    parts = blocks(rows.count(), QUERY_BLOCK)
    packed = stored(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).groupBy("dim", "block").applyInPandas(_gather, _BLOCKS))
    cells = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = cells.join(index, ["dim", "shard"]).repartition("shard", "block").mapInArrow(_walk(k, factor), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, asked: Column, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """The k nearest rows of every row for which `asked` holds, against all rows."""
    index, shards = build_index(vectors)
    return search(index, shards, vectors.filter(asked), k, factor)
