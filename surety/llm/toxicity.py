"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Three jobs. The first counts, over all labelled training documents, in how many of each class every n-gram bin occurs (a
row of partial counts per task and bin), and keeps a bounded sample of them (`SAMPLE` a class, a documented parameter), so
that documents meet their labels once. The second reads the bins that differ between the classes from the sample and fits
the logistic regression in one task. The third is one map over all texts, whole ones, whose model is an array of `BINS`
numbers.

A feature is there or not, whatever the text's length, and its value is the log ratio of its shares in toxic and in other
documents, both smoothed towards the overall share: a bin no training document holds weighs nothing, so rare n-grams of a
long text do not add up. Bins whose ratio could be chance (likelihood ratio statistic under `CHANCE`) get the ratio 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import fresh, raw_texts, stored

BINS = 1 << 18
LENGTHS = (4, 5, 6)         # characters
SMOOTH = 10.0               # documents added to each bin, in the proportion of the classes
CHANCE = 15.0
FEATURES = 1 << 12          # bins with a weight, at most: those of the greatest statistic
SAMPLE = 8_000              # labelled rows of each class that the weights are fitted on, in expectation
RIDGE = 1.0
ROUNDS, MEMORY = 60, 8

_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 and c.isalnum() else 32 for i in range(1 << 16)], np.uint32)


def characters(text: bytes) -> np.ndarray:
    """Code points, lower-cased; a run of other characters than letters and digits is one blank, as are both ends."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = np.where(c < 1 << 16, _LOWER[c & 0xFFFF], c)
    c = np.concatenate((_BLANK, c, _BLANK))
    return c[(c != 32) | np.r_[True, c[:-1] != 32]]


_BLANK = np.array([32], np.uint32)


def grams(text: bytes) -> np.ndarray:
    """The bin of every n-gram of the text, repeated ones included."""
    c = characters(text)
    h, out = c, []
    for n in range(2, max(LENGTHS) + 1):
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * np.uint32(0x9E3779B1) ^ c[n - 1:]
        if n in LENGTHS:
            mixed = h * np.uint32(0x85EBCA6B)
            out.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BINS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_GATHERED = "bin int, other long, toxic long, pick long, text string"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a bin (bin -1: documents), and the drawn rows themselves (bin -2)."""
    counts, rows = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    names = ["bin", "other", "toxic", "pick", "text"]
    for batch in batches:
        toxic = batch.column("toxic")
        for text, y in zip(raw_texts(batch.column("text")), toxic.to_pylist()):
            counts[y, np.unique(grams(text))] += 1
            rows[y] += 1
        own = pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, -2, np.int32)), pa.nulls(batch.num_rows, pa.int64()),
                                          toxic.cast(pa.int64()), batch.column("pick"), batch.column("text")], names)
        yield own.filter(batch.column("drawn"))
    if rows.any():
        hit = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[-1, hit].astype(np.int32)), pa.array(np.r_[rows[0], counts[0, hit]]), pa.array(np.r_[rows[1], counts[1, hit]]),
            pa.nulls(len(hit) + 1, pa.int64()), pa.nulls(len(hit) + 1, pa.string())], names)


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Smoothed log-count ratio of each bin, 0 where it may be chance; at most `FEATURES` of them are not 0."""
    if not n_toxic or not n_other:
        return np.zeros(len(toxic))
    n = n_toxic + n_other
    share = n_toxic / n
    r = np.log((toxic + SMOOTH * share) / n_toxic) - np.log((other + SMOOTH * (1 - share)) / n_other)
    held = toxic + other
    cells = [(toxic, held * share), (other, held * (1 - share)), (n_toxic - toxic, (n - held) * share),
             (n_other - other, (n - held) * (1 - share))]
    statistic = 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-12)), 0.0) for seen, due in cells)
    strong = np.argsort(-statistic, kind="stable")[:FEATURES]
    out = np.zeros(len(r))
    keep = strong[statistic[strong] >= CHANCE]
    out[keep] = r[keep]
    return out


def _features(r: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = r != 0
        for batch in batches:
            held = [np.unique(g[known[g]]).astype(np.int32) for g in map(grams, raw_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))],
                                             ["pick", "toxic", "bins"])
    return run


def regression(at: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Ridge-penalised logistic regression by L-BFGS; the last weight is the intercept, which is not penalised.

    `at`: first entry of each row in `columns` and `values`, and their end.
    """
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))
    ridge = np.r_[np.full(width, RIDGE), 0.0]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, values * w[columns], len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gap = weight * (p - y)
        grad = np.r_[np.bincount(columns, gap[rows] * values, width), gap.sum()] + ridge * w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2), grad

    w, past = np.zeros(width + 1), []
    now, grad = loss(w)
    for _ in range(ROUNDS):
        step, used = grad.copy(), []
        for s, d in reversed(past):
            a = (s @ step) / (s @ d)
            used.append(a)
            step -= a * d
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(grad))
        for (s, d), a in zip(past, reversed(used)):
            step += s * (a - (d @ step) / (s @ d))
        size, slope = 1.0, float(grad @ step)
        while True:
            then, then_grad = loss(w - size * step)
            if then <= now - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        moved, turned = -size * step, then_grad - grad
        if moved @ turned > 1e-12:
            past = [*past[1 - MEMORY:], (moved, turned)]
        done = abs(now - then) <= 1e-7 * max(1.0, abs(now))
        w, now, grad = w + moved, then, then_grad
        if done:
            break
    return w


def _fit(r: np.ndarray, shares: tuple[float, float]):
    """One task: the weights of the bins, the intercept under bin -1."""
    known = np.flatnonzero(r)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pick", "ascending"), ("toxic", "ascending")]).combine_chunks()
        bins = rows.column("bins").combine_chunks()
        at = np.r_[0, np.cumsum(bins.value_lengths().to_numpy(zero_copy_only=False))]
        columns = np.searchsorted(known, bins.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
        y = rows.column("toxic").to_numpy().astype(np.float64)
        weight = rows.column("copies").to_numpy() / np.where(y > 0, shares[1], shares[0])
        w = regression(at, columns, r[known][columns], y, weight * len(y) / weight.sum(), len(known))
        return pa.table({"bin": pa.array(np.r_[known, -1].astype(np.int32)), "weight": pa.array(w)})
    return run


@dataclass(frozen=True)
class Model:
    weights: np.ndarray     # of each bin: fitted weight times log-count ratio
    intercept: float

    def score(self, text: bytes) -> float:
        g = grams(text)
        z = self.intercept + float(self.weights[np.unique(g[self.weights[g] != 0])].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """Learns from the documents for which `training` holds and that `labels` (doc_id, toxic) knows.

    `training` reads doc_id only. A document labelled more than once counts as toxic if any of its labels says so; null
    labels count as none, other values than 0 as 1. Every row of the documents that a label fits is a training row. With one
    class only, or none, the model gives every text the share of toxic rows (0 without any row).
    """
    known = stored(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
                   .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    sizes = known.filter(training).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    shares = tuple(min(1.0, SAMPLE / max(1, n)) for n in sizes)
    pick = F.xxhash64("doc_id", "text")
    drawn = F.pmod(pick, F.lit(1 << 30)) < F.when(F.col("toxic") > 0, int(shares[1] * (1 << 30))).otherwise(int(shares[0] * (1 << 30)))
    train = docs.filter(training).select("doc_id", "text").join(known, "doc_id").select(
        "text", "toxic", pick.alias("pick"), drawn.alias("drawn"))
    gathered = stored(train.mapInArrow(_gather, _GATHERED))
    counts = gathered.filter("bin >= -1").groupBy("bin").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    found = counts.collect()    # at most BINS + 1 rows
    toxic, other, rows = np.zeros(BINS), np.zeros(BINS), (0, 0)
    for r in found:
        if r["bin"] < 0:
            rows = (r["other"], r["toxic"])
        else:
            toxic[r["bin"]], other[r["bin"]] = r["toxic"], r["other"]
    if not rows[0] or not rows[1]:
        return Model(np.zeros(BINS), 500.0 if rows[1] else -500.0)
    r = ratios(toxic, other, rows[1], rows[0])
    sample = (gathered.filter("bin = -2").select("pick", F.col("toxic").cast("int").alias("toxic"), "text")
              .mapInArrow(_features(r), "pick long, toxic int, bins array<int>")
              .groupBy("pick", "toxic").agg(F.first("bins").alias("bins"), F.count("*").alias("copies")))   # copies count as one weighted row
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_fit(r, shares), "bin int, weight double").collect()
    weights, intercept = np.zeros(BINS), 0.0
    for f in fitted:
        if f["bin"] < 0:
            intercept = f["weight"]
        else:
            weights[f["bin"]] = f["weight"] * r[f["bin"]]
    return Model(weights, intercept)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "_toxicity"])
    return run


def predict(texts: DataFrame, model: Model) -> DataFrame:
    """The table with score (0 to 1, higher: likelier toxic) and predicted (1 from a score of 0.5 on), from the text alone.

    A null text counts as empty; an empty one, or one without letters and digits, gets the score of the intercept. Rows are
    judged one by one, so repeated rows get equal results and an empty table stays empty. Columns of these names that the
    table has are replaced.
    """
    own = texts.select(*[c for c in texts.columns if c.lower() not in ("score", "predicted")])
    name = fresh(own, "_toxicity")
    schema = T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())])
    scored = own.mapInArrow(_predict(model), schema)
    return scored.select(*own.columns, F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
