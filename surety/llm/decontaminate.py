"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a query set, taken in blocks of `BLOCK` items; documents are only ever read, never shuffled. Per block:

1. Document frequencies of the block's terms over all passages (windows of `WINDOW` words, half overlapping). Every term
   keeps a positive weight, however many passages hold it.
2. The passages that can reach the cosine asked for: a passage's cosine with an item cannot exceed the share of its norm
   that lies in that item's terms. These, with the numbers of the words around them, are written to the shared folder. So
   are the passages where an item stands by its words alone, which no frequency, length or neighbouring word can hide: an
   item lacks too much weight wherever none of its rarest terms stands, so only the words around those are compared.
3. A distributed randomised SVD of their TF-IDF matrix over the block's terms: tasks add up the sketch (A'A)G, one row per
   term leaves a task, and the small factor of a Nystroem step gives the right singular vectors. The items are rows of the
   matrix too, each as heavy as all passages together, and the rank is above the block's size: so the items' own directions
   come first in the latent space, however many passages and however flat their spectrum.
4. Search: each passage is projected and compared with all items of the block by cosine. Candidates are checked in the same
   task against the document's own words: idf-weighted longest common subsequence, and the same for the item's last words,
   its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import fresh, raw_texts, stored, words

WINDOW, STEP = 32, 16
BLOCK = 256            # items per block
COSINE = 0.3           # candidates
COMMON = 0.6           # least weighted share of an item that runs through the document in order
ANSWER = 0.5           # the same for the item's last quarter
SURE = 0.8             # from this share on the answer is not asked for
SHORT = 8              # items of fewer words count without the cosine only where all their words stand
SEED = 7


@dataclass(frozen=True)
class Items:
    """One block of the benchmark."""
    ids: list[int]
    terms: dict[bytes, int]
    runs: list[np.ndarray]      # term numbers of each item in order


@dataclass(frozen=True)
class Index:
    items: Items
    idf: np.ndarray
    basis: np.ndarray           # terms x rank, right singular vectors
    latent: np.ndarray          # items x rank, unit rows


def _block(rows: list) -> Items:
    terms: dict[bytes, int] = {}
    runs = [np.array([terms.setdefault(w, len(terms)) for w in words((r["text"] or "").encode("utf-8", "surrogatepass"))], int) for r in rows]
    return Items([r["item_id"] for r in rows], terms, runs)


def _numbers(text: bytes, terms: dict[bytes, int]) -> np.ndarray:
    get = terms.get
    return np.array([get(w, -1) for w in words(text)], np.int64)


def _passages(n: int) -> np.ndarray:
    """First words of the passages of a text of n words."""
    return np.arange(0, max(1, n - STEP), STEP)


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = len(items.terms)
        df, total = np.zeros(t, np.int64), 0
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                w = _numbers(text, items.terms)
                starts = _passages(len(w))
                total += len(starts)
                at = np.flatnonzero(w >= 0)
                if len(at):
                    step = at // STEP   # a word stands in the passages that start at its own step and the one before
                    own, prior = step[step < len(starts)] * t + w[at[step < len(starts)]], (step[step > 0] - 1) * t + w[at[step > 0]]
                    df += np.bincount(np.unique(np.r_[own, prior]) % t, minlength=t)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, hit].astype(np.int32)), pa.array(np.r_[total, df[hit]])], ["term", "n"])
    return run


def _weighted(w: np.ndarray, idf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per passage: its first word, its squared norm, and the share of that norm in the block's terms."""
    weight = np.where(w >= 0, idf[w], 0.0)
    square = np.r_[0.0, np.cumsum(np.where(w >= 0, weight, other) ** 2)]
    inside = np.r_[0.0, np.cumsum(weight ** 2)]
    starts = _passages(len(w))
    ends = np.minimum(starts + WINDOW, len(w))
    norm = np.maximum(square[ends] - square[starts], 1e-12)
    return starts, norm, (inside[ends] - inside[starts]) / norm


_HELD_NAMES = ["item", "common", "answer", "first_word", "last_word"]
_HELD_TYPE = pa.struct(list(zip(_HELD_NAMES, (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))))
_PASSAGES = ("doc_id long, start long, low long, norm double, near array<int>, "
             "held array<struct<item:int, common:double, answer:double, first_word:long, last_word:long>>")


def _reach(w: np.ndarray, asked: np.ndarray, idf: np.ndarray, holders: tuple[np.ndarray, np.ndarray], items: int) -> np.ndarray:
    """Per passage asked for: the greatest squared weight that it shares with one item. No cosine can exceed its root over the norm."""
    first, listed = holders
    passages = len(asked)
    wanted = np.r_[asked, False, False]
    at = np.flatnonzero(w >= 0)
    at = at[wanted[at // STEP] | wanted[at // STEP - 1]]
    many = first[w[at] + 1] - first[w[at]]
    item = listed[np.repeat(first[w[at]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    step, square = np.repeat(at // STEP, many), np.repeat(idf[w[at]] ** 2, many)
    shared = np.bincount(step * items + item, square, (passages + 1) * items).reshape(passages + 1, items)
    return (shared[:-1] + shared[1:]).max(1)    # a passage is two steps long


def _holders(pairs: set[tuple[int, int]], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(term, item) pairs as the place of each term's first item, and the items."""
    ordered = sorted(pairs)
    return np.searchsorted([t for t, _ in ordered], np.arange(terms + 1)), np.array([i for _, i in ordered], np.int64)


def _guides(items: Items, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rarest terms of each item: without one of them, less than COMMON of the item's weight is left."""
    pairs = set()
    for i, (run, weight) in enumerate(zip(items.runs, weights)):
        term, back = np.unique(run, return_inverse=True)
        mass = np.bincount(back, weight, len(term))
        order = np.lexsort((term, -mass / np.maximum(1, np.bincount(back, minlength=len(term)))))
        need = int(np.searchsorted(np.cumsum(mass[order]), (1 - COMMON + 1e-9) * weight.sum())) + 1
        pairs |= {(t, i) for t in term[order[:need]].tolist()}
    return _holders(pairs, len(items.terms))


def _lists(items: Items, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per item: its terms in order, their weights, and the weight of all its words."""
    found = []
    for run, weight in zip(items.runs, weights):
        terms, first = np.unique(run, return_index=True)
        found.append((terms, weight[first], float(weight.sum())))
    return found


def _held(w: np.ndarray, items: Items, weights: list[np.ndarray], lists: list, guides: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """item, common, answer, first and last word of the best run of every item that stands in a text by its words.

    The run may be as long as the item over COMMON. Besides the shares of weight, COMMON of the item's words must lie on it,
    or all of them if the item has fewer than SHORT.
    """
    first, listed = guides
    at = np.flatnonzero(w >= 0)
    many = first[w[at] + 1] - first[w[at]]
    at, many = at[many > 0], many[many > 0]
    if not len(at):
        return []
    item = listed[np.repeat(first[w[at]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    at = np.repeat(at, many)
    found = []
    for i in np.unique(item).tolist():
        run, weight, best = items.runs[i], weights[i], None
        size, (terms, heavy, total) = int(np.ceil(len(run) / COMMON)), lists[i]
        least = len(run) if len(run) < SHORT else COMMON * len(run)
        hits = at[item == i]
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * size) + 1) if len(hits) > 1 else [hits]:
            low = max(0, int(part[0]) - size + 1)
            text = w[low:int(part[-1]) + size]
            place = np.minimum(np.searchsorted(terms, text), len(terms) - 1)
            own = terms[place] == text
            value = np.where(own, heavy[place], 0.0)
            if value.sum() < (COMMON - 1e-9) * total:
                continue
            mass = np.r_[0.0, np.cumsum(value)]
            words_in = np.r_[0, np.cumsum(own)]
            start = np.flatnonzero(own)             # a heaviest run begins with a word of the item
            end = np.minimum(start + size, len(text))
            bound = (mass[end] - mass[start]) / total
            can = (bound >= COMMON - 1e-9) & (words_in[end] - words_in[start] >= least)
            for k in np.flatnonzero(can)[np.argsort(-bound[can], kind="stable")].tolist():
                if best and bound[k] <= best[0] or best and best[0] > 1 - 1e-9:
                    break
                span = text[start[k]:end[k]]
                if weight[np.isin(run, span)].sum() < (best[0] if best else COMMON - 1e-9) * total:
                    continue
                on = common_run(run, weight, span)
                if on.sum() >= least and (shares := _shares(on, weight)) and (not best or shares > best[:2]):
                    best = (*shares, low + int(start[k]), low + int(end[k]))
        if best:
            found.append((i, *best))
    return found


def _shares(on: np.ndarray, weight: np.ndarray) -> tuple[float, float] | None:
    """Shares of an item's and its answer's weight that lie on a run, where they are enough."""
    tail = len(on) - max(1, len(on) // 4)
    common = float(weight[on].sum() / weight.sum())
    answer = float(weight[tail:][on[tail:]].sum() / weight[tail:].sum())
    return (common, answer) if common >= COMMON and (answer >= ANSWER or common >= SURE) else None


def _informative(items: Items, idf: np.ndarray, other: float):
    """Passages that can reach the cosine with an item or hold one, with the term numbers of the words around them."""
    around = max((len(r) for r in items.runs), default=0)
    holders = _holders({(t, i) for i, r in enumerate(items.runs) for t in r.tolist()}, len(items.terms))
    weights = _item_weights(items, idf)
    guides, lists = _guides(items, weights), _lists(items, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                w = _numbers(text, items.terms)
                if not len(w):
                    continue
                starts, norm, share = _weighted(w, idf, other)
                held: dict[int, list] = {}
                for one in _held(w, items, weights, lists, guides):
                    held.setdefault(min(one[3] // STEP, len(starts) - 1), []).append(one)
                near = set(held)
                if (asked := share >= COSINE ** 2).any():
                    reach = _reach(w, asked, idf, holders, len(items.ids))
                    near |= set(np.flatnonzero(reach >= COSINE ** 2 * norm).tolist())
                for i in sorted(near):
                    low = max(0, int(starts[i]) - around)
                    rows.append((doc, int(starts[i]), low, float(norm[i]), w[low:starts[i] + WINDOW + around].astype(np.int32),
                                 [dict(zip(_HELD_NAMES, one)) for one in held.get(i, ())]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(_HELD_TYPE))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "start", "low", "norm", "near", "held"])
    return run


TOGETHER = 1024        # passages handled in one set of array operations


@dataclass(frozen=True)
class Rows:
    """Some stored passages: the words around each, and the sparse TF-IDF rows of the passages themselves."""
    doc: np.ndarray
    low: np.ndarray
    at: np.ndarray              # first word of the passage among the words around it
    near: list[np.ndarray]
    held: list[list[dict]]      # items that stand there by their words
    term: np.ndarray            # of all rows, one after the other
    value: np.ndarray
    row: np.ndarray

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The rows times a dense matrix."""
        out = np.zeros((len(self.near), basis.shape[1]), basis.dtype)
        first = np.flatnonzero(np.r_[True, np.diff(self.row) > 0]) if len(self.row) else self.row
        if len(first):
            out[self.row[first]] = np.add.reduceat(basis[self.term] * self.value[:, None].astype(basis.dtype), first, axis=0)
        return out

    def transposed_times(self, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms, and the transposed rows' product with a dense matrix at those terms."""
        order = np.argsort(self.term, kind="stable")
        term = self.term[order]
        first = np.flatnonzero(np.r_[True, np.diff(term) > 0]) if len(term) else term
        if not len(first):
            return term, np.zeros((0, dense.shape[1]))
        return term[first], np.add.reduceat(dense[self.row[order]] * self.value[order][:, None], first, axis=0)


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[Rows]:
    every = batch.column("held").to_pylist()
    flat, offsets = batch.column("near").values.to_numpy(), batch.column("near").offsets.to_numpy()
    doc, start, low, norm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "low", "norm"))
    for k in range(0, len(doc), TOGETHER):
        own = range(k, min(k + TOGETHER, len(doc)))
        near = [flat[offsets[i]:offsets[i + 1]] for i in own]
        at = start[k:k + TOGETHER] - low[k:k + TOGETHER]
        words_in = [n[i:i + WINDOW] for n, i in zip(near, at.tolist())]
        term = np.concatenate(words_in)
        row = np.repeat(np.arange(len(near)), [len(w) for w in words_in])
        weighs = (term >= 0) & (idf[term] > 0)
        term, row = term[weighs], row[weighs]
        value = idf[term] / np.sqrt(norm[k:k + TOGETHER])[row]
        yield Rows(doc[k:k + TOGETHER], low[k:k + TOGETHER], at, near, every[k:k + TOGETHER], term, value, row)


def _sketch(idf: np.ndarray, noise: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(noise.shape, np.float64)
        for batch in batches:
            for rows in _rows(batch, idf):
                term, part = rows.transposed_times(rows.times(noise))
                y[term] += part
        hit = np.flatnonzero(np.abs(y).sum(1))
        for k in range(0, len(hit), 1000):
            some = hit[k:k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(y[some]), pa.list_(pa.float64()))], ["term", "y"])
    return run


def _add(y: np.ndarray, term: np.ndarray, value: np.ndarray, noise: np.ndarray) -> None:
    """Adds a'(aG) of one sparse row a."""
    np.add.at(y, term, value[:, None] * (value @ noise[term]))


def build(docs: DataFrame, items: Items) -> tuple[Index, DataFrame]:
    """Latent space of one block and the passages to search. On the driver: arrays of terms x rank of that block."""
    t = len(items.terms)
    texts = docs.select("text")
    counts = {r["term"]: r["n"] for r in texts.mapInArrow(_count(items), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    df = np.zeros(t)
    df[list(counts)] = list(counts.values())
    idf = np.log((2 + total) / (1 + df))
    other = float(np.log(2 + total))
    rank = min(t, len(items.ids) + 32)
    noise = np.random.default_rng(SEED).standard_normal((t, rank))
    passages = stored(docs.select("doc_id", "text").mapInArrow(_informative(items, idf, other), _PASSAGES))
    parts = _summed(passages.mapInArrow(_sketch(idf, noise), "term int, y array<double>"))
    y = np.zeros((t, rank))
    for r in parts.toLocalIterator():
        y[r["term"]] = r["y"]
    weight = max(1, passages.count())     # an item's row weighs as much as all passages, each of which is at most 1 long
    for run in items.runs:
        term, tf = np.unique(run, return_counts=True)
        a = tf * idf[term]
        if (n := np.sqrt(a @ a)) > 0:
            _add(y, term, a * (np.sqrt(weight) / n), noise)
    basis = _nystroem(y, noise)
    latent = np.zeros((len(items.ids), basis.shape[1]))
    for i, run in enumerate(items.runs):
        z = idf[run] @ basis[run] if len(run) else latent[i]
        n = np.sqrt(z @ z)
        latent[i] = z / n if n > 0 else 0.0
    return Index(items, idf, basis.astype(np.float32), latent.astype(np.float32)), passages


def _summed(parts: DataFrame) -> DataFrame:
    """Sums of the sketch rows of each term: one row per term and task comes in, of which few share a term."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"term": [int(pdf["term"].iloc[0])], "y": [np.sum(np.stack(pdf["y"].to_numpy()), axis=0)]})

    return parts.groupBy("term").applyInPandas(add, "term int, y array<double>")


def _nystroem(y: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from Y = (A'A)G: A'A is approximated by Y (G'Y)^-1 Y'."""
    q, r = np.linalg.qr(y)
    core = noise.T @ y
    middle = r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-10) @ r.T
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-9
    return q @ vectors[:, keep]


def common_run(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words of the item lie on a heaviest common subsequence of item and text."""
    n, m = len(item), len(text)
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        hit = np.where(text == item[i], best[i, :-1] + weight[i], 0.0)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], hit))
    on, i, j = np.zeros(n, bool), n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            on[i] = True
    return on


_FOUND = "doc_id long, item_id long, cosine double, common double, answer double, first_word long, last_word long"


def _item_weights(items: Items, idf: np.ndarray) -> list[np.ndarray]:
    """Weights of each item's words in the common run."""
    return [idf[r] + 1e-3 for r in items.runs]


def _search(index: Index):
    items = index.items
    weights = _item_weights(items, index.idf)

    def checked(run: np.ndarray, weight: np.ndarray, near: np.ndarray) -> tuple | None:
        if weight[np.isin(run, near)].sum() < COMMON * weight.sum():      # no common subsequence can hold more
            return None
        return _shares(common_run(run, weight, near), weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows in _rows(batch, index.idf):
                cos = rows.times(index.basis) @ index.latent.T
                for k, i in zip(*(x.tolist() for x in np.nonzero(cos >= COSINE))):
                    at, reach = int(rows.at[k]), len(items.runs[i])
                    left = max(0, at - reach)
                    text = rows.near[k][left:at + WINDOW + reach]
                    if shares := checked(items.runs[i], weights[i], text):
                        low = int(rows.low[k]) + left
                        found.append((rows.doc[k], items.ids[i], float(cos[k, i]), *shares, low, low + len(text)))
                for k, held in enumerate(rows.held):
                    for h in held:
                        found.append((rows.doc[k], items.ids[h["item"]], float(cos[k, h["item"]]), *(h[c] for c in _HELD_NAMES[1:])))
            cols = list(zip(*found)) if found else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "item_id", "cosine", "common", "answer", "first_word", "last_word"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer and the span of words searched, for every document that holds an item.

    An item is held where COMMON of its weight and words, or all words if it has fewer than SHORT, run in order through
    a stretch no longer than the item over COMMON, and enough of its answer too; that search is exact. Beyond that, looser
    copies are found where a passage's cosine with the item is COSINE or more. Items and documents are lower-cased (A-Z) and split at ASCII white space. Null or empty texts hold nothing, and null
    or empty items are held by nothing; an empty table on either side gives no rows. A document that repeats an item gets
    one row for it (the best), and so do rows that repeat. Rows without a doc_id take no part.
    """
    slim = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    rows: list = []

    def search(part: list) -> DataFrame:
        index, passages = build(slim, _block(part))
        best = F.struct("common", "cosine", "answer", "first_word", "last_word")
        return (passages.mapInArrow(_search(index), _FOUND).groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
                .select("doc_id", "item_id", "b.cosine", "b.common", "b.answer", "b.first_word", "b.last_word"))

    asked = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in asked.toLocalIterator():  # one block of the query set at a time
        rows.append(row)
        if len(rows) == BLOCK:
            found, rows = search(rows) if found is None else found.unionByName(search(rows)), []
    if rows:
        found = search(rows) if found is None else found.unionByName(search(rows))
    return found if found is not None else docs.sparkSession.createDataFrame([], _FOUND)


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, columns as before."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(name := fresh(docs, "leak_id"))).filter(F.col(name).isNotNull()).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[name], "left_anti")
