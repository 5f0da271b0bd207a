"""Packing: order-preserving dynamic programming over document and sentence boundaries.

The tokens of a partition's documents form one stream, in the order in which the partition is read; nothing is shuffled.
A cut may stand at a document end (free), a sentence end (a small penalty) or, where a sentence runs on for long, at fill-in
points (a larger one). The least total of padding and cut penalties up to boundary j is

    f(j) = penalty(j) + min over i in the last `size` tokens of f(i) + padding(j - i)

with padding = size - (j - i), so the minimum slides over f(i) + position(i): a monotone queue gives it in constant time.
Sequences whose length is a power of two need no padding and are a few more transitions. The stream is planned in chunks
of `CHUNK` tokens; all but the last sequences of a chunk are committed, the rest is planned anew with the next chunk.
"""

from __future__ import annotations

import itertools
import os
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 400_000
_MEMORY = 150_000             # words whose ids a worker keeps
_AT_ONCE = 1 << 20            # bytes of text encoded at a time


@dataclass(frozen=True)
class Costs:
    """Penalties of cuts in tokens of padding, and where fill-in points stand; all in proportion to the sequence."""
    sentence: int
    forced: int
    fill: int       # fill-in points every so many tokens ...
    gap: int        # ... where boundaries are further apart than this
    near: int       # sentence ends closer than this to the next one are passed over
    least: int      # shortest sequence that goes unpadded by being a power of two

    @staticmethod
    def of(size: int) -> Costs:
        return Costs(max(1, size // 256), max(1, size // 32), max(1, size // 32), max(1, size // 8), size // 170, max(1, size // 8))


_MARKS = "★♥→•…§"     # one that is a single id stands between words encoded together; words that hold it are encoded alone

def _gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `pool` of such sizes from such places, one after the other."""
    return pool[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class WordIds:
    """Ids of texts, word by word: white space separates pre-tokens in this family, so the ids of a text are those of its words.

    Arrow lower-cases and splits the texts and numbers the distinct words; only those are looked up, and numpy gathers the ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # a task has one core; threads would each hold memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Stems are normalised letters only: nothing is left to normalise, and blanks are all there is to split at.
        self.stems = Tokenizer.from_file(path)
        self.stems.normalizer = None
        self.stems.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark, self.mark_id = next(((m, x[0]) for m in _MARKS if len(x := self._ids(m)) == 1), ("\0", -1))
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends, self.word_ends = (np.zeros(self.tokenizer.get_vocab_size() + 2, bool) for _ in range(2))
        self.ends[[i for t, i in vocab.items() if t.removesuffix("</w>").endswith((".", "!", "?"))]] = True
        self.word_ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}                       # word -> its number
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)      # ids of word k: pool[begin[k]:begin[k + 1]]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, missing: list[str]) -> list[np.ndarray]:
        """Ids of words, encoded many at a time with a mark between them."""
        found = []
        parts = [missing[i:i + 128] for i in range(0, len(missing), 128)]
        texts = [f" {self.mark} ".join(part) for part in parts]
        joined = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for part, text, encoded in zip(parts, texts, joined):
            ids = np.array(encoded.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) == len(part) - 1 == text.count(self.mark) and "<|" not in text and text.isprintable():
                found += [x[i > 0:] for i, x in enumerate(np.split(ids, at))]
            else:
                found += [np.array(self._ids(w), np.uint32) for w in part]
        return found

    def _of_stems(self, stems: list[str]) -> list[np.ndarray]:
        """Ids of words of normalised letters; every word ends with an id that says so, and only there does one stand."""
        found = []
        parts = [stems[i:i + 512] for i in range(0, len(stems), 512)]
        for part, encoded in zip(parts, self.stems.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)):
            ids = np.array(encoded.ids, np.uint32)
            at = (np.flatnonzero(self.word_ends[ids]) + 1).tolist()
            found += [ids[i:j] for i, j in zip([0, *at], at)] if len(at) == len(part) else self._encoded(part)
        return found

    def _learn(self, missing: list[bytes]) -> None:
        """Adds words. ASCII punctuation after letters is a pre-token of its own, so stems and tails are encoded apart."""
        whole = [w.decode("utf-8", "replace") for w in missing]
        cut: list[tuple[str, str]] = []
        for w in whole:
            stem = w.rstrip(string.punctuation)
            plain = stem.isalpha() and (stem.isascii() or stem.lower() == stem and unicodedata.is_normalized("NFC", stem))
            cut.append((stem, w[len(stem):]) if plain else ("", w))
        stems = list(dict.fromkeys(s for s, _ in cut if s))
        rest = list(dict.fromkeys(r for _, r in cut if r))
        ids = [np.zeros(0, np.uint32), *self._of_stems(stems), *self._encoded(rest)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        stem_no = {"": 0, **dict(zip(stems, itertools.count(1)))}
        rest_no = {"": 0, **dict(zip(rest, itertools.count(1 + len(stems))))}
        no = np.array([x for s, r in cut for x in (stem_no[s], rest_no[r])])
        learned = _gathered(np.concatenate(ids), (np.cumsum(sizes) - sizes)[no], sizes[no])
        sizes = sizes[no].reshape(-1, 2).sum(1)
        self.known.update(zip(missing, range(len(self.begin) - 1, len(self.begin) - 1 + len(missing))))
        self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(sizes)]
        self.pool = np.r_[self.pool, learned]

    def _forget(self, words: list[bytes]) -> None:
        """Drops the words learned last; those known first are the frequent ones and stay."""
        for w in words:
            del self.known[w]
        self.begin = self.begin[:len(self.begin) - len(words)].copy()
        self.pool = self.pool[:self.begin[-1]].copy()

    def encode(self, texts: pa.Array, last: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, followed by `last`; a null text counts as empty.

        The tokenizer lower-cases, so ASCII letters may be lower-cased before. Texts that may hold special tokens are
        encoded whole.
        """
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        missing = distinct[new].tolist()
        if missing:
            number[new] = np.arange(len(missing)) + len(self.begin) - 1
            self._learn(missing)
        begin, size = np.r_[self.begin[number], 0], np.r_[self.begin[number + 1] - self.begin[number], 1]
        # The closing id of a text is one word more, read from in front of the pool.
        begin[:-1] += 1
        pool = np.r_[np.uint32(last), self.pool]
        word_ends = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        codes = np.insert(coded.indices.to_numpy(), word_ends[1:], len(distinct))
        sizes = size[codes]
        stops = np.cumsum(sizes)
        ids = _gathered(pool, begin[codes], sizes)
        at = stops[word_ends[1:] + np.arange(len(texts))]
        out = [x.astype("<u4").tobytes() for x in np.split(ids, at[:-1])] if len(texts) else []
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            whole = texts[i].as_buffer().to_pybytes().decode("utf-8", "replace")
            out[i] = np.array([*self._ids(whole), last], "<u4").tobytes()
        if len(self.known) > _MEMORY:
            self._forget(missing[-(len(self.known) - _MEMORY):])
        return out


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts (first, number) of at most so many bytes in all; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right")))
        yield low, high - low
        low = high


def plan(positions: list[int], penalties: list[int], size: int) -> list[int]:
    """Ends of the sequences of the cheapest cut of a stream: indices into `positions`, the last one included.

    `positions` grow from above 0; the steps between them are at most `size`.
    """
    at = np.r_[0, positions]
    short: dict[int, list[int]] = {}          # boundaries that lie a power of two before a boundary
    for w in (1 << k for k in range(size.bit_length()) if Costs.of(size).least <= 1 << k < size):
        there = np.searchsorted(at, at - w)
        for j in np.flatnonzero(at[there] == at - w).tolist():
            short.setdefault(j, []).append(int(there[j]))
    spots = at.tolist()
    cost, before = [0.0] * len(spots), [-1] * len(spots)
    queue, keys, head = [0], [0.0], 0
    for j in range(1, len(spots)):
        p = spots[j]
        while spots[queue[head]] < p - size:
            head += 1
        best, arg = keys[head] + size - p, queue[head]
        if j in short:
            for k in short[j]:
                if cost[k] < best:
                    best, arg = cost[k], k
        best += penalties[j - 1]
        cost[j] = best
        before[j] = arg
        key = best + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    ends, j = [], len(spots) - 1
    while j > 0:
        ends.append(j - 1)
        j = before[j]
    return ends[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a cut may stand, and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = costs.sentence
    penalty[doc_ends] = 0
    ends = np.flatnonzero(penalty == costs.sentence)     # of sentence ends close together the last one stays
    penalty[ends[:-1][np.diff(ends) < costs.near]] = -1
    spots = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(np.r_[0, spots]) > costs.gap)
    for i in wide.tolist():
        penalty[np.arange((spots[i - 1] if i else 0) + costs.fill, spots[i], costs.fill)] = costs.forced
    penalty[0] = -1
    spots = np.flatnonzero(penalty >= 0)
    return spots, penalty[spots]


_encoders: dict[str, WordIds] = {}
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        coder = _encoders[path]
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []      # (doc_id, start of what is held, tokens of the document, ids from there)
        total = 0

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, total
            ids = np.frombuffer(b"".join(h[3] for h in held), "<u4")
            doc_ends = np.cumsum([len(h[3]) // 4 for h in held])
            spots, penalties = boundaries(ids, doc_ends, coder.ends, Costs.of(size))
            ends = spots[plan(spots.tolist(), penalties.tolist(), size)]
            if not final:
                ends = ends[:-4]
            rows: list[tuple] = []
            i, begin = 0, 0
            doc_from = np.r_[0, doc_ends]
            for end in ends.tolist():
                opened = begin
                while begin < end:
                    stop = min(end, int(doc_ends[i]))
                    doc, start, n, raw = held[i]
                    low = begin - int(doc_from[i])
                    rows.append((doc, start + low, stop - begin, n, sequence, begin - opened,
                                 raw[4 * low:4 * (low + stop - begin)]))
                    begin = stop
                    if stop == doc_ends[i]:
                        i += 1
                sequence += 1
            if i < len(held):
                low = begin - int(doc_from[i])
                doc, start, n, raw = held[i]
                held = [(doc, start + low, n, raw[4 * low:]), *held[i + 1:]]
            else:
                held = []
            total = sum(len(h[3]) for h in held) // 4
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            for k in range(0, len(rows), 4000):
                cols = list(zip(*rows[k:k + 4000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols)], names)

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for k, n in by_bytes(batch.column("text"), _AT_ONCE):
                for doc, raw in zip(docs[k:k + n], coder.encode(batch.column("text").slice(k, n), end_id)):
                    held.append((doc, 0, len(raw) // 4, raw))
                    total += len(raw) // 4
                if total >= CHUNK:
                    yield from cut(False)
        if held:
            yield from cut(True)
    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of the documents in sequences of at most `size` tokens: doc_id, start, length, doc_tokens, sequence_id,
    offset and the piece's ids (little-endian, 32 bits each).

    A document is its ids by the tokenizer, without special tokens, and `end_id` after them; a null or empty text is
    `end_id` alone. Every id lies in exactly one piece. Sequences are filled without gaps from offset 0; what is left to
    `size` is padding, and none is needed where the length is a power of two. Sequence ids are unique and follow the order
    of the input; rows that repeat are packed as often as they stand there. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer_path, size, end_id), _SCHEMA)
