"""MinHash near-dedup with tensored banding.

A text's set: the distinct shingles of its words, as 64-bit hashes. Two collections of `HALVES` half keys, each of `WIDTH`
minhashes, are computed per set; table (i, j) is keyed by half key i of the first and half key j of the second collection.
So HALVES^2 tables of 2 * WIDTH minhashes cost 2 * HALVES * WIDTH minhashes, not 2 * WIDTH * HALVES^2. With 9 and 2, a
pair of similarity 0.8 shares no table with probability 2 * (1 - 0.8^2)^9, 2 in 10,000, and a closer one less often.

Equal sets are one class before anything is compared, so copies cost one row each. Buckets are never expanded into pairs:
all members of a bucket are compared with its leader, and what passed is merged. Members of buckets that then still hold
different components are joined exactly, on the rarest words of their sets (prefix and position filters), so that no link
is lost whatever the buckets look like. All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surety.llm.common import fresh, raw_texts, stored, word_hashes
from surety.llm.graph import components

HALVES, WIDTH = 9, 2
SEED = 20240229

_U = np.uint64


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; the whole sequence where there are fewer; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i:len(w) - size + 1 + i]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return np.unique(h)


_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, (2 * HALVES, WIDTH), dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(1, 1 << 63, (2 * HALVES, WIDTH), dtype=np.uint64)


def half_keys(members: np.ndarray) -> np.ndarray:
    """The 2 * HALVES half keys of a set: WIDTH minhashes mixed into one number each."""
    least = np.empty(2 * HALVES * WIDTH, np.uint64)
    for i, (a, s) in enumerate(zip(_FACTORS.ravel(), _SHIFTS.ravel())):
        least[i] = ((members ^ s) * a).min()
    keys = np.zeros(2 * HALVES, np.uint64)
    for column in least.reshape(2 * HALVES, WIDTH).T:
        keys = (keys ^ column) * _U(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> _U(31)
    return keys


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, a array<long>, b array<long>"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, a, b = [], [], [], [], []
            for text in raw_texts(batch.column("text")):
                s = shingles(text, size)
                n.append(len(s))
                if not len(s):
                    for x in (d1, d2, a, b):
                        x.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                keys = half_keys(s).view(np.int64)
                a.append(keys[:HALVES])
                b.append(keys[HALVES:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(a, longs), pa.array(b, longs)], ["doc_id", "n_shingles", "d1", "d2", "a", "b"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, size) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in made], pa.int32()), pa.array([s.tobytes() for s in made], pa.binary())],
                ["node", "n", "members"])
    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("mu").to_pylist(), batch.column("mv").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")  # two sorted runs: merged
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; sizes are compared before any set is moved."""
    sizes = sets.select("node", "n")
    near = (pairs.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u")
            .join(sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
            .filter(100 * F.least("nu", "nv").cast("long") >= percent * F.greatest("nu", "nv").cast("long")).select("u", "v"))
    full = (near.join(sets.select(F.col("node").alias("u"), F.col("members").alias("mu")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("members").alias("mv")), "v"))
    return stored(full.mapInArrow(_similar(percent), "u long, v long"))


def _explode_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, blob in enumerate(batch.column("members").to_pylist()):
            s = np.frombuffer(blob, np.int64)
            one = pa.array(np.full(len(s), batch.column("node")[i].as_py(), np.int64))
            label = pa.array(np.full(len(s), batch.column("label")[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([one, label, pa.array(s), pa.array(np.full(len(s), len(s), np.int32))],
                                             ["node", "label", "shingle", "n"])


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different labels that can be similar, by the rarest members of their sets; none is lost.

    A set of n members that is similar to another shares at least ceil(percent * n / 100) with it, so one of its first
    n - ceil(...) + 1 in any common order; the order is rarest first. If the first shared member stands at places p and q of
    sets of n and m, they share at most 1 + min(n - p, m - q), which must reach percent / (100 + percent) * (n + m).
    """
    rows = stored(nodes.join(sets, "node").mapInArrow(_explode_members, "node long, label long, shingle long, n int"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("f", "shingle"))
    least = F.ceil(F.col("n") * percent / 100.0 - 1e-9)
    prefix = stored(rows.join(counts, "shingle").withColumn("place", place)
                    .filter((F.col("place") <= F.col("n") - least + 1) & (F.col("lo") < F.col("hi")))
                    .select("shingle", "node", "label", "n", "place"))
    right = prefix.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "place")))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    can = most * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    return (prefix.join(right, "shingle").filter((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & can)
            .select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct())


def _links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root of all classes that are linked with another one."""
    i, j = F.posexplode("a").alias("i", "x"), F.posexplode("b").alias("j", "y")
    keys = (classes.select("node", "b", i).select("node", "i", "x", j)
            .select(F.xxhash64("i", "j", "x", "y").alias("key"), "node"))
    led = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("hi")).filter("leader < hi").select("key", "leader")
    members = stored(keys.join(led, "key").filter("node != leader"))
    pairs = members.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    some = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = stored(docs.join(some, "doc_id", "left_semi").mapInArrow(_sets(size), "node long, n int, members binary"))
    edges = _confirmed(pairs, sets, percent)
    roots = components(edges)
    # What a bucket has not compared yet: members other than its leader that are of different components.
    labelled = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    rest = stored(labelled.join(mixed, "key").select("node", "label").distinct())
    if rest.isEmpty():
        return roots
    more = _confirmed(_prefix_pairs(rest, sets, percent), sets, percent)
    return roots if more.isEmpty() else components(edges.union(more))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, one row per row of `docs`.

    Link: 100 * |A and B| >= percent * |A or B| on the sets of word shingles. Null or empty texts and texts of white
    space only have the empty set and no links; fewer words than a shingle are one shingle. Equal texts are linked. Rows
    that share a doc_id count as one document. A null doc_id takes part in no link: component_id null, kept true. An empty
    table gives no rows; extra columns play no part.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(slim.mapInArrow(_sign(shingle_words), _SIGNED))
    classes = stored(signed.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2")
                     .agg(F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b")))
    roots = _links(classes, slim, shingle_words, percent)
    named = classes.select("d1", "d2", "node").join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each group, all columns as before. Rows without a doc_id stay."""
    gone = near_duplicates(docs, shingle_words, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(name := fresh(docs, "gone_id")))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
