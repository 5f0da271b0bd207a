"""Line dedup: sorted runs of line hashes, keep bitmaps per document.

Every distinct line key of a document becomes one narrow row (hash, document, positions). The rows are range-partitioned
by (hash, document), so that a line held by a third of all documents spreads over many tasks, and sorted within
partitions. One streaming pass over each sorted partition decides every run; it holds at most `min_docs` documents of the
run at hand. Only the first and the last run of a partition can go on elsewhere: their counts meet in a table of two rows
per partition. What comes out is a compressed bitmap for each document that loses a line; texts never move for the decision.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import fresh, raw_texts, stored

WHITE = b" \t\n\x0b\x0c\r"
_KEYS = "doc_id long, row_key long, h1 long, h2 long, n_lines int, pos array<int>"
_RUNS = "kind int, doc_id long, row_key long, h1 long, h2 long, n_lines int, pos array<int>, n_docs long, part int"
DROP, DROP_IF_COMMON, DROP_IF_NOT_FIRST, COUNT = 0, 1, 2, 3


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            for doc, row, text in zip(ids, keys, raw_texts(batch.column("text"))):
                lines = text.split(b"\n")
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = line.strip(WHITE).lower()
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        places.setdefault(key, []).append(i)
                for key, pos in places.items():
                    h = xxhash.xxh3_128_digest(key)
                    out[0].append(doc)
                    out[1].append(row)
                    out[2].append(int.from_bytes(h[:8], "little", signed=True))
                    out[3].append(int.from_bytes(h[8:], "little", signed=True))
                    out[4].append(len(lines))
                    out[5].append(pos)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                             ["doc_id", "row_key", "h1", "h2", "n_lines", "pos"])
    return run


class _Run:
    """The run at hand: rows are held back until the run is known to be common."""

    def __init__(self, h: tuple[int, int], leads: bool):
        self.h, self.leads, self.docs, self.last, self.held, self.started = h, leads, 0, (), [], False


def _decide(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        now: _Run | None = None

        def emit(kind: int, row: tuple) -> None:
            out.append((kind, *row, 0, part))

        def put(r: _Run, row: tuple, kind: int) -> None:
            """One row of a run; the run's very first position is kept where first occurrences stay."""
            if keep_first and not r.started:
                r.started = True
                doc, key, h1, h2, n, pos = row
                if r.leads or kind == DROP_IF_COMMON:
                    emit(DROP_IF_NOT_FIRST, (doc, key, h1, h2, n, pos[:1]))
                if len(pos) > 1:
                    emit(kind, (doc, key, h1, h2, n, pos[1:]))
            else:
                emit(kind, row)

        def close(r: _Run, ends: bool) -> None:
            if r.leads or ends:
                out.append((COUNT, None, None, *r.h, None, None, r.docs, part))
                for row in r.held:
                    put(r, row, DROP_IF_COMMON)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()),
                     pa.int64(), pa.int32())
            names = ["kind", "doc_id", "row_key", "h1", "h2", "n_lines", "pos", "n_docs", "part"]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)
            out.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                h = (int(h1[s]), int(h2[s]))
                if now is None or now.h != h:
                    if now is not None:
                        close(now, False)
                    inner = now is not None and e < len(h1)
                    now = _Run(h, now is None)
                    if inner and e - s < min_docs:  # complete in this batch and too rare: nothing to look at
                        now.docs = e - s
                        continue
                cells = batch.slice(s, e - s)
                ids, keys = cells.column("doc_id").to_pylist(), cells.column("row_key").to_pylist()
                for doc, key, n, pos in zip(ids, keys, cells.column("n_lines").to_pylist(), cells.column("pos").to_pylist()):
                    if now.last != (doc,):
                        now.docs, now.last = now.docs + 1, (doc,)
                    row = (doc, key, *h, n, pos)
                    if now.docs < min_docs:
                        now.held.append(row)
                    else:
                        for held in now.held:
                            put(now, held, DROP)
                        now.held = []
                        put(now, row, DROP)
                    if len(out) >= 50_000:
                        yield flush()
        if now is not None:
            close(now, True)
        yield flush()
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, pos in zip(batch.column("n_lines").to_pylist(), batch.column("pos").to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[pos] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines"), pa.array(dropped, pa.int32()),
             pa.array(maps, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep_bitmap"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row: rows that repeat an id are told apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """doc_id, row_key, n_lines, n_dropped, keep_bitmap (zlib, one bit a line) of each document that loses a line.

    A line's key: the line stripped of ASCII white space, A-Z lower-cased. Keys of at least `min_chars` code points that
    stand in at least `min_docs` different documents lose all lines (`keep="none"`) or all but the first by document and
    position (`keep="first"`). Null or empty text: one empty line, whose key is too short to drop unless `min_chars` is 0.
    Rows with one doc_id are one document when documents are counted; rows with a null id likewise. An empty table gives
    no rows, and extra columns play no part.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    lines = keyed(docs).mapInArrow(_line_keys(min_chars), _KEYS)
    runs = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row_key")
    found = stored(runs.mapInArrow(_decide(min_docs, keep == "first"), _RUNS))
    totals = found.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("total"), F.min("part").alias("first_part"))
    open_runs = found.filter(F.col("kind").isin(DROP_IF_COMMON, DROP_IF_NOT_FIRST))
    late = open_runs.join(totals, ["h1", "h2"]).filter(
        (F.col("total") >= min_docs)
        & ((F.col("kind") == DROP_IF_COMMON) | (F.col("part") > F.col("first_part"))))
    columns = ["doc_id", "row_key", "n_lines", "pos"]
    drops = found.filter(F.col("kind") == DROP).select(columns).unionByName(late.select(columns))
    by_doc = drops.groupBy("doc_id", "row_key", "n_lines").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    return by_doc.mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines int, n_dropped int, keep_bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Text without the lines that the bitmap drops, lines before, lines dropped."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    stay = [x for x, k in zip(lines, keep.tolist()) if k]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: str) -> DataFrame:
    """The documents and their bitmap as column `keep`; names are chosen clear of the documents' own."""
    i, r, k = (fresh(docs, n) for n in ("bitmap_id", "bitmap_row", "text_key"))
    maps = bitmaps.select(F.col("doc_id").alias(i), F.col("row_key").alias(r), F.col("keep_bitmap").alias(keep))
    left = docs.withColumn(k, F.xxhash64("text"))
    same = left["doc_id"].cast("long").eqNullSafe(maps[i]) & (left[k] == maps[r])
    return left.join(maps, same, "left").select(*docs.columns, keep)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with the dropped lines gone; columns as before, null texts stay null, n_chars follows the text."""
    columns, keep = docs.columns, fresh(docs, "keep_bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else kept_text(t, m)[0]
                     for t, m in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(keep).to_pylist())]
            cols = [batch.column(c) for c in columns]
            at = columns.index("text")
            cols[at] = pa.array(texts, pa.binary()).cast(cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, columns)

    out = _with_bitmaps(docs, bitmaps, keep).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, one row per row of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_text(t, m) for t, m in zip(raw_texts(batch.column("text")), batch.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64()),
                 pa.array([hashlib.sha256(x[0]).hexdigest() for x in made], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_bitmaps(slim, bitmaps, "keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
