"""Helpers shared by the operators: stored intermediate tables, folds, Arrow columns, ASCII case."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session takes a temporary one; on a cluster
    each executor would write to its own disk there, and what is read back would be incomplete, so it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "surety-checkpoints")


def importable(spark: SparkSession) -> None:
    """Lets Python workers that see the driver's files import this package; elsewhere it is shipped with --py-files.

    Rows hold whole documents, so Arrow batches of Spark's default length would be large: they are made shorter, unless
    the session has chosen a length of its own.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")


def stored(df: DataFrame) -> DataFrame:
    """Write the rows into the shared folder and read them back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/surety-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space bytes (what bytes.split() splits at)."""
    return text.lower().split()


def blocks(total: int, size: int) -> int:
    return max(1, -(-total // size))


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]).tobytes()
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_TABLE = 1 << 20
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n or more of each; those for long texts are not kept."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            made.append(np.full(min(2 * n, _TABLE) if n <= _TABLE else n, base, np.uint64))
            made[-1][0] = 1
            np.cumprod(made[-1], out=made[-1])
        if n > _TABLE:
            return made
        _powers = made
    return _powers


def word_hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, one text after the other, and the number of words of each: a polynomial over
    the word's bytes, mixed with its length. The polynomials of all words are differences of one running sum."""
    sizes = np.zeros(len(texts), np.int64)
    text = b" ".join([b"", *texts, b""])
    b = np.frombuffer(text, np.uint8)
    space = np.frombuffer(text.translate(_IS_SPACE), bool)
    edge = np.flatnonzero(space[1:] != space[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64), sizes
    start, end = edge[::2] + 1, edge[1::2] + 1
    up, down = _powers_to(len(b))
    h = np.take(_BYTE, b, mode="clip")
    h *= up[:len(b)]
    np.cumsum(h, out=h)
    h = (h[end - 1] - h[start - 1]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    first = np.cumsum([1, *(len(x) + 1 for x in texts)])
    sizes[:] = np.diff(np.searchsorted(start, first))
    return h ^ (h >> np.uint64(32)), sizes


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word that `words` gives, in order."""
    return word_hashes_of([text])[0]
