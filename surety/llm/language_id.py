"""Language ID: nearest centroid over normalised TF-IDF vectors of hashed byte trigrams, several centroids a language.

Three jobs: document frequencies of the n-gram bins over all training documents (one row of partial counts per task and
bin); spherical k-means per language on a bounded sample of labelled rows (`SAMPLE` a language); one map over all texts.
The model is a matrix of languages x centroids x bins, whose size does not depend on the corpus.

A text is rejected when its fit, its best cosine over the one expected at its length, lies under the floor of the language
it is nearest to: `SLACK` times the median fit of that language's sample, which a few junk or one-word rows do not move. A
text of n trigrams is a draw of n from the centroid's, so its cosine grows as the root of n / (n + `HALF`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from surety.llm.common import raw_texts, stored

BINS = 1 << 13
SAMPLE = 512        # labelled rows per language that the centroids are fitted on
CENTROIDS = 3
ROUNDS = 8
SLACK = 0.25
HALF = 400          # trigrams at which the square of the expected cosine is a half
LEAST = 0.1         # clusters with less than this share of a language's sample are dropped: wrong labels gather there
UNKNOWN = "und"

# Byte classes: letters of ASCII lower-cased, bytes of longer characters as they are, all else one blank.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def bins_of(text: bytes) -> np.ndarray:
    """Bin of each byte trigram of the whole text; runs of non-letters count as one blank, with one at either end."""
    b = _FOLD[np.frombuffer(text, np.uint8)]
    b = np.concatenate((_BLANK, b[(b != 32) | np.r_[True, b[:-1] != 32]], _BLANK))
    lower = np.r_[False, b[:-1] == 0xC3] & (b >= 0x80) & (b < 0x9F) & (b != 0x97)  # capitals of Latin-1 letters
    b = np.where(lower, b + 0x20, b).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) & np.uint32(BINS - 1)


_BLANK = np.array([32], np.uint32)


def has_letter(text: bytes) -> bool:
    if any(65 <= (c & 0xDF) <= 90 for c in text[:256]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def vector(text: bytes, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector (logarithmic counts); zero where no bin has weight."""
    return _vector(bins_of(text), idf)


def _vector(bins: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.bincount(bins, minlength=BINS)).astype(np.float32) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 else v


def expected(trigrams: np.ndarray) -> np.ndarray:
    """Cosine of a usual text with its language, by its number of trigrams."""
    n = np.maximum(1, trigrams)
    return np.sqrt(n / (n + HALF))


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for text in raw_texts(batch.column("text")):
            df[np.unique(bins_of(text))] += 1
            n += 1
    if n:
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, hit].astype(np.int32)), pa.array(np.r_[n, df[hit]])], ["bin", "n"])


def _centroids(idf: np.ndarray):
    """Spherical k-means on the sample of one language, started from rows spread over the sample."""
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pick", kind="stable")
        bins = [bins_of(t.encode("utf-8", "surrogatepass")) for t in rows["text"]]
        x, usual = np.stack([_vector(b, idf) for b in bins]), expected(np.array([len(b) for b in bins]))
        some = (x * x).sum(1) > 0
        x, usual = x[some], usual[some]
        if not len(x):
            return pd.DataFrame({"lang": [], "floor": [], "centroid": []})
        c = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            sums = np.stack([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
            c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
        c = c[size >= min(LEAST * len(x), size.max())]
        fits = np.minimum(1.0, (x @ c.T).max(1) / usual)     # centroids of few rows fit these rows too well
        floor = SLACK * float(np.median(fits))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "floor": floor,
                             "centroid": [v.astype(np.float32).tobytes() for v in c]})
    return fit


@dataclass(frozen=True)
class Model:
    langs: list[str]          # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray        # least fit, of each centroid's language


def fit(docs: DataFrame, training: Column) -> Model:
    """Centroids from the rows where `training` holds and lang is not null. An empty training set gives no centroid."""
    train = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = train.select("text").mapInArrow(_count_bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    df = {r["bin"]: r["n"] for r in counts.collect()}  # at most BINS + 1 rows
    total = df.pop(-1, 0)
    idf = np.full(BINS, np.log(1 + total) + 1 if total else 0.0, np.float32)    # bins never seen count in a text's norm
    if df:
        idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    sizes = train.groupBy("lang").agg(F.count("*").alias("rows"))
    pick = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    share = F.pmod(pick, F.lit(1 << 20)) / float(1 << 20)
    some = (train.select("lang", "text", pick.alias("pick"), share.alias("share")).join(F.broadcast(sizes), "lang")
            .filter(F.col("share") * F.col("rows") <= 2.0 * SAMPLE).drop("share", "rows"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    sample = some.withColumn("rank", first).filter(F.col("rank") <= SAMPLE).select("lang", "text", "pick")
    fitted = stored(sample.groupBy("lang").applyInPandas(_centroids(idf), "lang string, floor double, centroid binary"))
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["centroid"]))  # CENTROIDS a language
    return Model([r["lang"] for r in rows], np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows
                 else np.zeros((0, BINS), np.float32), idf, np.array([r["floor"] for r in rows]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            texts = raw_texts(batch.column("text"))
            for i in range(0, len(texts), 256):
                part = texts[i:i + 256]
                bins = [bins_of(t) for t in part]
                cos = np.stack([_vector(b, model.idf) for b in bins]) @ model.centroids.T
                usual = expected(np.array([len(b) for b in bins]))
                for t, row, most in zip(part, cos, usual.tolist()):
                    if not len(row) or not has_letter(t):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                        continue
                    best = int(row.argmax())
                    langs.append(model.langs[best])
                    scores.append(float(min(1.0, max(0.0, row[best]))))
                    rejected.append(bool(row[best] < model.floors[best] * most))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                [*batch.schema.names, "lang_pred", "score", "rejected"])
    return run


def predict(texts: DataFrame, model: Model) -> DataFrame:
    """The table with lang_pred, score (best cosine) and rejected added, from the column text alone.

    `und`, score 0 and rejected where the text is null or empty or has no letter, or where nothing was learned. A text
    that fits its nearest centroid less than that language's floor keeps the language and is marked rejected. Ties go to the language that
    sorts first. Rows are judged one by one, so repeated rows get equal results and an empty table stays empty.
    """
    schema = T.StructType([*texts.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return texts.mapInArrow(_predict(model), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of the table that are not rejected, columns as before. A null or empty text is rejected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            judged = next(_predict(model)(iter([slim])))
            yield batch.filter(pa.compute.invert(judged.column("rejected")))

    return docs.mapInArrow(run, docs.schema)
