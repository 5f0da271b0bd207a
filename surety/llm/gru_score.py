"""LM scoring with a gated recurrent network.

Counts of all training tokens are a distributed table. Words that make up at least 1 / `HOT` of all tokens, so at most
`HOT` of them, go to the workers; the counts of all rarer words are joined on the word's hash. The `VOCAB` most frequent
words are the network's vocabulary. For any other word the network predicts "another word" and the word itself follows the
smoothed counts among the words outside the vocabulary, so the probabilities of all words add up to one.

The network: a GRU of `HIDDEN` units; the next word is predicted through its class, then within the class. It is trained by
truncated back-propagation in numpy, on every training document: first one trainer on its share of about `TRAINER` tokens,
then from there one trainer for each share, whose weights are averaged. Scoring runs many documents side by side, each with its own state,
which is carried across windows of `STEPS` tokens through the whole document.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import stored

HOT = 1 << 19
VOCAB, CLASS_SIZE = 4096, 64
HIDDEN, STEPS, LANES, TRAIN_LANES = 32, 32, 768, 256
TRAINER = 3_000_000      # tokens of a share, in expectation
SMOOTH = 0.1
PIECE = 2 << 20          # bytes of texts that are split into words together
CHUNK = 3_600_000        # tokens that are scored together in a task; 36 bytes each
ROWS = 2048              # states whose next words are predicted at once
TAILS = 256              # words outside the vocabulary are told apart on input by their last letters
END = b""                # the end of a document; no word is empty
f4 = np.float32


# ---------------------------------------------------------------- words

def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about PIECE bytes together."""
    part = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(column)]
    return zip(edges, edges[1:])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and how many each has: A-Z lower-cased, split at the six ASCII white-space bytes; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    word = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0       # white space at the ends leaves empty ones
    count = np.r_[0, np.cumsum(word)][np.r_[0, ends]]
    return flat if word.all() else flat.filter(pa.array(word)), np.diff(count)


# ---------------------------------------------------------------- counts

def _hash(word: bytes) -> int:
    """What Spark's xxhash64 gives."""
    return (xxhash.xxh64_intdigest(word, 42) ^ (1 << 63)) - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for a, b in _pieces(column):
            once = pc.value_counts(_split(column.slice(a, b - a))[0])
            yield pa.RecordBatch.from_arrays([once.field("values").view(pa.binary()), once.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([b - a], pa.int64())], ["word", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """Words known to the workers, most frequent first; the first VOCAB of them are the network's."""
    packed: bytes             # the words, compressed
    counts: np.ndarray
    total: int                # training tokens
    distinct: int

    @property
    def norm(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    @property
    def size(self) -> int:
        return min(VOCAB, len(self.counts))

    def base(self) -> np.ndarray:
        return np.log10((self.counts + SMOOTH) / self.norm)

    def rest(self) -> float:
        """Smoothed probability of all words outside the network's vocabulary."""
        return max(1.0 - float(np.sum((self.counts[:self.size] + SMOOTH) / self.norm)), SMOOTH / self.norm)


def count(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """word, h, n of all tokens of the documents, and what of it the workers are given."""
    counts = stored(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
                    .select("word", F.xxhash64("word").alias("h"), "n"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = counts.filter(F.col("n") * HOT >= total).select("word", "n").toArrow()   # at most HOT rows
    rows = sorted(zip(hot.column("word").to_pylist(), hot.column("n").to_pylist()), key=lambda r: (r[0] != END, -r[1], r[0]))
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, 0))
    return counts, Vocabulary(zlib.compress(b" ".join(w for w, _ in rows[1:])), np.array([n for _, n in rows], np.int64), total, distinct)


_lookups: dict[tuple, tuple] = {}


def _lookup(v: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """The known words but the end, and the input number of each known word."""
    key = (zlib.crc32(v.packed), len(v.counts), v.total)
    if key not in _lookups:
        _lookups.clear()
        known = zlib.decompress(v.packed).split(b" ") if len(v.counts) > 1 else []
        size = v.size
        inputs = np.array([i if i < size else size + _tail(w) for i, w in enumerate([END, *known])], np.int32)
        _lookups[key] = (pa.array(known, pa.binary()).view(pa.string()), inputs)
    return _lookups[key]


def _tail(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] * 7 if len(word) > 1 else 0)) % TAILS


# ---------------------------------------------------------------- network

class Network:
    """Weights. Input words have rows of pre-activations; word 0 is the end, word `size` stands for all others."""

    def __init__(self, size: int, weights: dict[str, np.ndarray]):
        self.size, self.w = size, weights
        self.classes = -(-size // CLASS_SIZE) + 1     # the last class is "another word"
        self.low = _low(weights)

    @staticmethod
    def fresh(v: Vocabulary) -> Network:
        rng = np.random.default_rng(3)
        size, classes = v.size, -(-v.size // CLASS_SIZE) + 1
        p = np.full((classes - 1) * CLASS_SIZE, 1e-12)
        p[:size] = (v.counts[:size] + SMOOTH) / v.norm
        p = p.reshape(-1, CLASS_SIZE)
        w = {"x": rng.normal(0, 0.3, (size + TAILS, 3 * HIDDEN)), "u": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN)),
             "c": rng.normal(0, 0.05, (HIDDEN, classes)), "cb": np.log(np.r_[p.sum(1), v.rest()]),
             "o": rng.normal(0, 0.05, (classes - 1, HIDDEN, CLASS_SIZE)), "ob": np.log(p / p.sum(1, keepdims=True))}
        return Network(size, {k: x.astype(f4) for k, x in w.items()})

    def table(self) -> np.ndarray:
        """The rows of the input words gate by gate."""
        return np.ascontiguousarray(self.w["x"].reshape(-1, 3, HIDDEN).transpose(1, 0, 2))

    def gates(self) -> np.ndarray:
        """The recurrent weights gate by gate: update, reset, candidate."""
        return np.ascontiguousarray(self.w["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """State after tokens with pre-activations x (gates x rows x HIDDEN). Leaves both gates and the recurrent part of the
        candidate in g, the candidate in n."""
        np.matmul(h, u, out=g)
        zr = g[:2]
        zr += x[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], g[2], out=n)
        n += x[2]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[0]
        new += n
        return new

    def _classes(self, target: np.ndarray) -> np.ndarray:
        return np.where(target >= self.size, self.classes - 1, target // CLASS_SIZE)

    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the words of each class, with the biases as a last row, met by states that end in 1."""
        return np.concatenate((self.w["c"], self.w["cb"][None])), np.concatenate((self.w["o"], self.w["ob"][:, None]), 1)

    def _within(self, h: np.ndarray, which: np.ndarray, o: np.ndarray) -> Iterator[tuple]:
        """Rows whose target is in the vocabulary, ordered by class, a few classes at a time: the rows, their states, the scores
        of the words of their class, and class and bounds of the rows of each class."""
        order = np.argsort(which.astype(np.int16), kind="stable")
        edges = np.searchsorted(which[order], np.arange(self.classes)).tolist()
        k = 0
        while k < self.classes - 1:
            low, spans = edges[k], []
            while k < self.classes - 1 and (edges[k + 1] - low <= ROWS or not spans):
                if edges[k] < edges[k + 1]:
                    spans.append((k, edges[k] - low, edges[k + 1] - low))
                k += 1
            if spans:
                rows = order[low:edges[k]]
                own, scores = h[rows], np.empty((len(rows), CLASS_SIZE), o.dtype)
                for c, a, b in spans:
                    np.matmul(own[a:b], o[c], out=scores[a:b])
                yield rows, own, scores, spans

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target (word number, or `size`) after state h."""
        c, o = self.output()
        h, which, out = np.concatenate((h, np.ones((len(h), 1), c.dtype)), 1), self._classes(target), np.empty(len(h), c.dtype)
        for k in range(0, len(h), ROWS):
            logits = h[k:k + ROWS] @ c
            out[k:k + ROWS] = logits[np.arange(len(logits)), which[k:k + ROWS]] - _log_sum(logits, self.low)
        for rows, _, scores, _ in self._within(h, which, o):
            inner = scores[np.arange(len(rows)), target[rows] % CLASS_SIZE]
            out[rows] += inner - _log_sum(scores, self.low)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, fresh_start: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, float]:
        """Back-propagation through one window (steps x lanes), the state at its end, input rows' gradient and the loss."""
        steps, lanes = x.shape
        w, rows, kind = self.w, steps * lanes, self.w["u"].dtype
        u, kept = self.gates(), (1 - fresh_start)[:, :, None].astype(kind)
        xs = self.table().take(x.ravel(), 1).reshape(3, steps, lanes, HIDDEN)
        prior, n, gates = np.empty((steps, lanes, HIDDEN), kind), np.empty((steps, lanes, HIDDEN), kind), np.empty(xs.shape, kind)
        states = np.ones((steps, lanes, HIDDEN + 1), kind)
        for t in range(steps):
            np.multiply(h, kept[t], out=prior[t])
            h = self.step(xs[:, t], prior[t], u, gates[:, t], n[t])
            states[t, :, :HIDDEN] = h
        flat, target, low = states.reshape(rows, -1), y.ravel(), _low(w)
        which, d, (c, o) = self._classes(target), np.empty((rows, HIDDEN), kind), self.output()
        of_c, of_o, loss = np.zeros_like(c), np.zeros_like(o), 0.0
        for k in range(0, rows, ROWS):
            part = slice(k, k + ROWS)
            p = flat[part] @ c
            loss -= _softmax(p, which[part], rows, low)
            of_c += flat[part].T @ p
            np.matmul(p, w["c"].T, out=d[part])
        for some, own, q, spans in self._within(flat, which, o):
            loss -= _softmax(q, target[some] % CLASS_SIZE, rows, low)
            inner = np.empty((len(some), HIDDEN), kind)
            for k, a, b in spans:
                np.matmul(own[a:b].T, q[a:b], out=of_o[k])
                np.matmul(q[a:b], w["o"][k].T, out=inner[a:b])
            d[some] += inner
        g = {"c": of_c[:-1], "cb": of_c[-1], "o": of_o[:, :-1], "ob": of_o[:, -1]}
        d = d.reshape(steps, lanes, HIDDEN)
        dn, dg = np.empty((steps, lanes, HIDDEN), kind), np.empty((3, steps, lanes, HIDDEN), kind)
        back, ut = np.zeros((lanes, HIDDEN), kind), np.ascontiguousarray(u.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            back += d[t]
            z, r, gh = gates[:, t]
            rest = 1 - z
            np.multiply(n[t], n[t], out=dn[t])
            np.subtract(1, dn[t], out=dn[t])
            dn[t] *= rest
            dn[t] *= back
            rest *= z
            rest *= back
            np.subtract(prior[t], n[t], out=dg[0, t])
            dg[0, t] *= rest
            np.subtract(1, r, out=rest)
            rest *= gh
            rest *= r
            np.multiply(dn[t], rest, out=dg[1, t])
            np.multiply(dn[t], r, out=dg[2, t])
            back *= z
            for part in np.matmul(dg[:, t], ut):
                back += part
            back *= kept[t]
        g["u"] = np.concatenate(np.matmul(prior.transpose(0, 2, 1), dg).sum(1), 1)
        return g, h, np.concatenate((dg[0], dg[1], dn), 2).reshape(rows, -1), float(loss) / rows


def _low(w: dict[str, np.ndarray]) -> bool:
    """Whether no score can overflow exp; states lie between -1 and 1."""
    return max(np.abs(w[m]).sum(-2).max(initial=0) + w[b].max(initial=0) for m, b in (("c", "cb"), ("o", "ob"))) < 60


def _softmax(x: np.ndarray, at: np.ndarray, rows: int, low: bool) -> float:
    """Makes scores of each row the gradient of the loss over `rows` rows; returns the sum of the logs at the targets."""
    if not low:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    total, every = x @ np.ones(x.shape[1], x.dtype), np.arange(len(x))
    hit = x[every, at] / total
    x *= (1 / (total * rows))[:, None].astype(x.dtype)
    x[every, at] -= x.dtype.type(1 / rows)
    return np.log(hit + 1e-20).sum()


def _log_sum(x: np.ndarray, low: bool = False) -> np.ndarray:
    """log of the sum of exp, in place of x; `low`: nothing in x can overflow."""
    ones = np.ones(x.shape[1], x.dtype)
    if low:
        return np.log(np.exp(x, out=x) @ ones)
    top = x.max(1)
    x -= top[:, None]
    return top + np.log(np.exp(x, out=x) @ ones)


def _row_sums(x: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of groups of rows; `order` lists them group after group, `edges` are the first places of the groups in it."""
    sizes = np.diff(edges, append=len(order))
    by_size = np.argsort(-sizes, kind="stable")
    out = np.empty((len(sizes), x.shape[1]), x.dtype)
    large = int(np.count_nonzero(sizes > 24))
    for k in by_size[:large].tolist():
        out[k] = x[order[edges[k]:edges[k] + sizes[k]]].sum(0)
    rest = by_size[large:]                 # largest first: those with more than k rows come first
    first, made = edges[rest], x[order[edges[rest]]]
    for k, some in enumerate(np.searchsorted(-sizes[rest], -np.arange(1, 24)).tolist(), 1):
        if some:
            made[:some] += x[order[first[:some] + k]]
    out[rest] = made
    return out


def train(net: Network, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, rate: float) -> Network:
    """One pass of Adam over a token stream that is dealt to lanes; `starts` marks first tokens of documents."""
    lanes = max(1, min(TRAIN_LANES, len(inputs) // STEPS))
    length = len(inputs) // lanes
    x, y, s = (a[:lanes * length].reshape(lanes, length).T for a in (inputs, targets, starts.astype(f4)))
    w = {k: v.copy() for k, v in net.w.items()}
    net = Network(net.size, w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    h, turns = np.zeros((lanes, HIDDEN), f4), max(1, length // STEPS)
    for turn in range(turns):
        part = slice(turn * STEPS, (turn + 1) * STEPS)
        if not len(x[part]):
            break
        g, h, dx, _ = net.gradient(x[part], y[part], s[part], h)
        word = x[part].ravel()
        order = np.argsort(word.astype(np.int16), kind="stable")
        edges = np.flatnonzero(np.diff(word[order], prepend=-1))
        rows = word[order[edges]]
        g["x"] = _row_sums(dx, order, edges)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        lr = rate * (1 - turn / turns) * np.sqrt(1 - 0.99 ** (turn + 1)) / (1 - 0.9 ** (turn + 1))
        for k, v in g.items():
            own = rows if k == "x" else slice(None)
            v *= f4(scale)
            mean, spread = first[k][own], second[k][own]
            mean *= f4(0.9)
            mean += f4(0.1) * v
            v *= v
            v *= f4(0.01)
            spread *= f4(0.99)
            spread += v
            if k == "x":
                first[k][own], second[k][own] = mean, spread
            np.sqrt(spread, out=v)
            v += f4(1e-7)
            np.divide(mean, v, out=v)
            v *= f4(lr)
            w[k][own] -= v
    return net


def _known(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Number of each token, -1 where it is not known, and input number of the token before; where each text ends, places of
    the words that are not known, and these words."""
    known, inputs = _lookup(v)
    flat, sizes = _split(texts)
    found = pc.fill_null(pc.index_in(flat, value_set=known), -2).to_numpy(zero_copy_only=False) + 1
    ends = np.cumsum(sizes + 1)
    word = np.ones(len(flat) + len(sizes), bool)
    word[ends - 1] = False
    ids = np.zeros(len(word), np.int64)
    ids[word] = found
    others = flat.filter(pa.array(found < 0)).view(pa.binary()).to_pylist()
    places, size = np.flatnonzero(ids < 0), v.size
    x = np.zeros(len(ids) + 1, np.int64)
    x[1:] = inputs[ids]
    x[places + 1] = [size + _tail(z) for z in others]
    x[ends] = 0
    return ids, x[:-1], ends, places, others


def _numbered(texts: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input numbers (of the token before), targets and starts of a stream of documents."""
    column = pa.array(texts, pa.binary())
    xs, ys, starts = [], [], []
    for a, b in _pieces(column):
        ids, x, ends, _, _ = _known(column.slice(a, b - a).view(pa.string()), v)
        s = np.zeros(len(ids), bool)
        s[np.r_[0, ends[:-1]]] = True
        xs.append(x)
        ys.append(np.where((ids >= 0) & (ids < v.size), ids, v.size))
        starts.append(s)
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(starts)


def _pack(net: Network) -> list[tuple[int, list[float]]]:
    flat = np.concatenate([net.w[k].ravel() for k in sorted(net.w)])
    return [(i, flat[i:i + 4096].astype(float)) for i in range(0, len(flat), 4096)]


def _unpack(like: Network, rows: list) -> Network:
    flat = np.concatenate([np.array(r["part"], f4) for r in sorted(rows, key=lambda r: r["at"])])
    out, at = {}, 0
    for k in sorted(like.w):
        out[k] = flat[at:at + like.w[k].size].reshape(like.w[k].shape)
        at += like.w[k].size
    return Network(like.size, out)


def _trainer(net: Network, v: Vocabulary, rate: float):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pick", "text"], kind="stable")
        made = train(net, *_numbered([t.encode("utf-8", "surrogatepass") for t in rows["text"]], v), rate)
        return pd.DataFrame(_pack(made), columns=["at", "part"])
    return fit


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean of the parts of each place; rows come ordered by place."""
    now, total, n = None, None, 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total / n], pa.list_(pa.float64()))], ["at", "part"])

    for batch in batches:
        for i, at in enumerate(batch.column("at").to_pylist()):
            part = batch.column("part").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
            if at != now:
                if n:
                    yield flush()
                now, total, n = at, part.copy(), 1
            else:
                total += part
                n += 1
    if n:
        yield flush()


def fit(docs: DataFrame, v: Vocabulary) -> Network:
    """Trains on the documents (texts without null). The driver holds one set of weights, about two megabytes."""
    net = Network.fresh(v)
    if v.total == 0:
        return net
    # rows are dealt evenly whatever repeats: also copies under one id go to different trainers
    pick = F.xxhash64("doc_id", F.monotonically_increasing_id())
    trainers = max(1, round(v.total / TRAINER))
    dealt = docs.select("text", pick.alias("pick")).withColumn("trainer", F.pmod("pick", F.lit(trainers)))

    def averaged(rows: DataFrame, start: Network, rate: float) -> Network:
        made = rows.groupBy("trainer").applyInPandas(_trainer(start, v, rate), "at int, part array<double>")
        lists = made.repartition("at").sortWithinPartitions("at").mapInArrow(_mean, "at int, part array<double>")
        return _unpack(start, lists.collect())

    net = averaged(dealt.filter(F.col("trainer") == 0), net, 0.01)
    return averaged(dealt, net, 0.004)


# ---------------------------------------------------------------- scoring

def lanes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane and place in its lane of the first token of each document: longest first, each to the shortest lane."""
    lane, place = np.zeros(len(lengths), int), np.zeros(len(lengths), int)
    heap = [(0, k) for k in range(min(LANES, len(lengths)))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[i], place[i] = k, used
        heapq.heappush(heap, (used + int(lengths[i]), k))
    return lane, place


def score_stream(net: Network, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of log10 probabilities of each document of a stream."""
    lane, place = (a.astype(np.int32) for a in lanes_of(lengths))
    size = np.bincount(lane, lengths).astype(int)
    rank = np.empty(len(size), np.int32)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(size))       # longest lane first: active lanes come first
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    step = np.arange(len(x), dtype=np.int32) - (first - place).astype(np.int32)[doc]
    active = np.bincount(step)
    ends = np.cumsum(active)
    at = (ends - active).astype(np.int32)[step]
    at += rank[lane][doc]                 # lanes active at a step have the lowest ranks
    order = np.empty(len(x), np.int32)
    order[at] = np.arange(len(x), dtype=np.int32)
    del step, at
    x, y, doc = x[order], y[order], doc[order]
    kept = (order != first.astype(np.int32)[doc]).astype(f4)[:, None]
    del order
    out, h = np.zeros(len(lengths)), np.zeros((len(size), HIDDEN), f4)
    u, table, n = net.gates(), net.table(), len(active)
    g, made = np.empty(3 * h.size, f4), np.empty(h.size, f4)
    for t0 in range(0, n, STEPS):
        low, states, at = int(ends[t0] - active[t0]), [], 0
        for t in range(t0, min(t0 + STEPS, n)):
            k, at = int(active[t]), int(ends[t] - active[t])
            h = net.step(table.take(x[at:at + k], 1), h[:k] * kept[at:at + k], u, g[:3 * k * HIDDEN].reshape(3, k, HIDDEN), made[:k * HIDDEN].reshape(k, HIDDEN))
            states.append(h)
        high = int(ends[min(t0 + STEPS, n) - 1])
        p = net.log_probability(np.concatenate(states), y[low:high])
        out += np.bincount(doc[low:high], p.astype(float), len(lengths))
    return out / np.log(10)


_SCORED = [("n_tokens", T.LongType()), ("n_hot", T.LongType()), ("base_hot", T.DoubleType()), ("network", T.DoubleType()),
           ("base_vocab", T.DoubleType()), ("n_other", T.LongType()), ("tail_h", T.ArrayType(T.LongType())), ("tail_n", T.ArrayType(T.LongType()))]


def _score(net: Network, v: Vocabulary):
    known = v.base()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(rows: list[tuple], xs: list, ys: list) -> pa.RecordBatch:
            lengths = np.array([r[2] for r in rows])
            total = score_stream(net, np.concatenate(xs), np.concatenate(ys), lengths)
            cols = list(zip(*rows))
            made = [pa.array(list(c), pa.list_(pa.int64()) if isinstance(c[0], list) else pa.int64() if k not in (4, 5) else pa.float64())
                    for k, c in enumerate(cols)]
            return pa.RecordBatch.from_arrays([made[0], made[1], made[2], made[3], made[4], pa.array(total, pa.float64()), made[5], made[6], made[7], made[8]],
                                              ["doc_id", "row", "n_tokens", "n_hot", "base_hot", "network", "base_vocab", "n_other", "tail_h", "tail_n"])

        rows, xs, ys, held = [], [], [], 0
        for batch in batches:
            ids, uids = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for a, b in _pieces(batch.column("text")):
                at, x, ends, places, others = _known(batch.column("text").slice(a, b - a), v)
                first = np.r_[0, ends[:-1]]
                hot, inside = at >= 0, (at >= 0) & (at < v.size)
                base = np.where(hot, known[at], 0)
                sums = [np.add.reduceat(c, first).tolist() for c in ((hot & (v.counts[at] > 0)).astype(int), base, np.where(inside, base, 0), (~inside).astype(int))]
                cuts = np.searchsorted(places, np.r_[0, ends]).tolist()
                tails = [Counter(others[i:j]) for i, j in zip(cuts, cuts[1:])]
                rows += [(doc, uid, n, *own, [_hash(z) for z in tail], list(tail.values()))
                         for doc, uid, n, *own, tail in zip(ids[a:b], uids[a:b], np.diff(np.r_[0, ends]).tolist(), *sums, tails)]
                xs.append(x.astype(np.int16))
                ys.append(np.where(inside, at, v.size).astype(np.int16))
                held += len(at)
                if held >= CHUNK:
                    yield scored(rows, xs, ys)
                    rows, xs, ys, held = [], [], [], 0
        if rows:
            yield scored(rows, xs, ys)

    return run


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    Tokens: words (A-Z lower-cased, split at ASCII white space), then one end, so null, empty and blank texts have one token.
    Counts come from all rows where `training` holds; with none, every word has the smoothed count of an unseen one. Every
    row is scored over its whole text; rows that repeat are scored each; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", training.alias("training"))
    train_docs = slim.filter("training").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts, v = count(train_docs)
    net = fit(train_docs, v)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), *[T.StructField(n, t) for n, t in _SCORED]])
    scored = stored(slim.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(_score(net, v), schema))
    tails = scored.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("m"))
    found = tails.join(counts.filter(F.col("n") * HOT < v.total).select("h", "n"), "h", "left")
    prior = F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / v.norm)
    rare = found.groupBy("row").agg(F.sum(F.col("m") * prior).alias("base_tail"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("n_tail"))
    whole = scored.drop("tail_h", "tail_n").join(rare, "row", "left")
    base = F.col("base_hot") + F.coalesce("base_tail", F.lit(0.0))
    outside = base - F.col("base_vocab") - F.col("n_other") * float(np.log10(v.rest()))
    return whole.select("doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
                        base.alias("base_score"), (F.col("network") + outside).alias("score"))
