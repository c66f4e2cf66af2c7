"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as an embedding of the word and the mean of embeddings of its character
4-grams, both hashed. The network reads windows of ``WINDOW`` words, each beginning ``STRIDE`` words after
the last, that together cover the whole text; a text is as toxic as its most toxic window. It is trained
from random weights on a bounded sample of labelled documents: those windows of a document that the network
finds most toxic learn its label, and in the first third of the training, when it finds nothing yet, those
with the most words that are frequent in toxic documents. These counts choose windows and are no inputs. The probability is calibrated on a part of the sample kept aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared, words

WINDOW, STRIDE = 24, 12
#: Text bytes that are read at once, and windows that are learned from at once.
BATCH, GROUP = 1 << 20, 128
WORD_BITS, CHAR_BITS = 18, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 6, 6, 8, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    """By exp, which numpy has vectorised on more processors."""
    return 2 / (1 + np.exp(np.minimum(-2 * x, 60))) - 1


@dataclass
class Text:
    """Words of some texts: the different ones with their n-grams, and the texts as sequences of them."""

    hash: np.ndarray  # of each different word as it stands
    word: np.ndarray  # its bucket
    gram: np.ndarray  # buckets of their n-grams, one after another
    cuts: np.ndarray  # where each word's n-grams begin, one more than words
    index: np.ndarray  # for each word of the texts, which different word it is
    bounds: np.ndarray  # where each text's words begin, one more than texts

    def of(self, used: np.ndarray) -> Text:
        """Some of the different words, without texts."""
        return Text(self.hash[used], self.word[used], *_grams(self, used), np.zeros(0, np.int32), np.zeros(1, np.int64))


def read(texts: pa.Array) -> Text:
    """The words of whole texts. Punctuation at a word's ends is dropped; null: no words."""
    hashes, bounds, first, last, data = words.word_spans(texts)
    if not len(hashes):
        return Text(hashes, np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32), bounds)
    known, one, index = np.unique(hashes, return_index=True, return_inverse=True)
    first, last = first[one].copy(), last[one].copy()
    mark = _PUNCTUATION[data]
    for _ in range(4):
        first += (first < last - 1) & mark[first]
        last -= (first < last - 1) & mark[last - 1]
    n = last - first
    size = n + 2  # the word between two gaps
    cuts = np.concatenate([[0], np.cumsum(size)])
    text = np.zeros(int(cuts[-1]) + 3, np.uint64)
    inside = np.repeat(first - cuts[:-1] - 1, size) + np.arange(int(cuts[-1]))
    offset = np.arange(int(cuts[-1])) - np.repeat(cuts[:-1], size)
    real = (offset > 0) & (offset <= np.repeat(n, size))
    text[:-3][real] = words._LOWER[data[inside[real]]]
    gram = text[:-3] + (text[1:-2] << np.uint64(8)) + (text[2:-1] << np.uint64(16)) + (text[3:] << np.uint64(24))
    # n-grams that would reach into the next word are cut at its gap
    left = np.repeat(size, size) - offset
    gram = np.where(left >= 4, gram, gram & ((np.uint64(1) << (np.minimum(left, 4).astype(np.uint64) * np.uint64(8))) - np.uint64(1)))
    sums = np.add.reduceat(words.mix(gram * _STEP + offset.astype(np.uint64)), cuts[:-1])
    return Text(known, (words.mix(sums) >> np.uint64(64 - WORD_BITS)).astype(np.int64), (words.mix(gram) >> np.uint64(64 - CHAR_BITS)).astype(np.uint32), cuts, index.astype(np.int32), bounds)


def read_all(texts: list[str], most_bytes: int = 512 << 10) -> Text:
    """As ``read`` over all texts, with the working memory of about ``most_bytes`` of them."""
    parts, some, size = [], [], 0
    for k, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size >= most_bytes or k == len(texts) - 1:
            parts.append(read(pa.array(some, pa.large_string())))
            some, size = [], 0
    if not parts:
        return read(pa.array([], pa.large_string()))
    known, one, place = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([np.diff(p.cuts) for p in parts])
    begins = np.cumsum(sizes) - sizes
    cuts = np.concatenate([[0], np.cumsum(sizes[one])])
    grams = np.concatenate([p.gram for p in parts])[np.repeat(begins[one] - cuts[:-1], sizes[one]) + np.arange(int(cuts[-1]))]
    first = np.cumsum([0] + [len(p.hash) for p in parts])
    index = np.concatenate([place[first[k] :][p.index] for k, p in enumerate(parts)]).astype(np.int32)
    ends = np.cumsum([0] + [len(p.index) for p in parts])
    bounds = np.concatenate([[0]] + [p.bounds[1:] + ends[k] for k, p in enumerate(parts)])
    return Text(known, np.concatenate([p.word for p in parts])[one], grams, cuts, index, bounds)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; a text without words has one without words."""
    n = np.diff(bounds)
    many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(k * STRIDE, np.maximum(0, n - WINDOW)[text])
    return bounds[:-1][text] + start, np.minimum(n[text] - start, WINDOW), text


@dataclass
class Network:
    """Weights by name, and the calibration."""

    w: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(seed: int = 17) -> Network:
        rng = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM

        def near(*shape: int, size: float) -> np.ndarray:
            return (rng.standard_normal(shape) * size).astype(np.float32)

        w = {"word": near(1 << WORD_BITS, WORD_DIM, size=0.02), "char": near(1 << CHAR_BITS, CHAR_DIM, size=0.02)}
        for side in "fb":
            w |= {f"x{side}": near(dim, 3 * HIDDEN, size=0.4), f"h{side}": near(HIDDEN, 3 * HIDDEN, size=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"a": near(2 * HIDDEN, ATTEND, size=0.4), "ac": np.zeros(ATTEND, np.float32), "av": near(ATTEND, size=0.4), "o": near(2 * HIDDEN, size=0.4), "oc": np.zeros(1, np.float32)}
        return Network(w)

    def inputs(self, t: Text) -> np.ndarray:
        """A row for each different word."""
        if not len(t.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.w["char"][t.gram], t.cuts[:-1]) / np.diff(t.cuts)[:, None].astype(self.w["char"].dtype)
        return np.concatenate([self.w["word"][t.word], chars], 1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the words put into both directions' gates, with a row of zeros for no word."""
        return {side: np.concatenate([x @ self.w[f"x{side}"] + self.w[f"c{side}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for side in "fb"}

    def forward(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows given as rows of word numbers (-1 past the end)."""
        n, steps = index.shape
        states, kept = np.empty((steps, n, 2 * HIDDEN), np.float32), {}
        for k, side in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), self.w[f"h{side}"]
            kept[side] = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                x, r = gates[side].take(index[:, t], axis=0), h @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])))
                z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = _tanh(x[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
                m = mask[:, t, None]
                out = h + m * (1 - z) * (new - h)
                if keep:
                    kept[side].append((t, h, z, reset, new, r[:, 2 * HIDDEN :], m))
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = out
                h = out
        e = _tanh(states @ self.w["a"] + self.w["ac"])
        s = np.where(mask.T > 0, e @ self.w["av"], -1e9)
        s = np.exp(s - s.max(0))
        alpha = s / s.sum(0) * (mask.sum(1) > 0)
        context = (alpha[:, :, None] * states).sum(0)
        logit = context @ self.w["o"] + self.w["oc"]
        return (logit, (states, e, alpha, context, kept)) if keep else logit

    def backward(self, gates, index, mask, saved, d_logit) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the weights above the inputs, and of each side's gate inputs by window and step."""
        states, e, alpha, context, kept = saved
        g = {"o": context.T @ d_logit, "oc": d_logit.sum(keepdims=True)}
        d_context = d_logit[:, None] * self.w["o"]
        d_states = alpha[:, :, None] * d_context
        d_alpha = (states * d_context).sum(2)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["av"] = np.einsum("tn,tna->a", d_s, e)
        d_e = d_s[:, :, None] * self.w["av"] * (1 - e * e)
        g["ac"] = d_e.sum((0, 1))
        g["a"] = np.einsum("tnh,tna->ha", states, d_e)
        d_states = d_states + d_e @ self.w["a"].T
        d_gates = {}
        for k, side in enumerate("fb"):
            u = self.w[f"h{side}"]
            d_u, d_x = np.zeros_like(u), np.zeros((len(index), index.shape[1], 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, reset, new, rn, m in reversed(kept[side]):
                d_out = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = d_out * m * (1 - z) * (1 - new * new)
                d_z = -d_out * m * (new - h) * z * (1 - z)
                d_r = d_new * rn * reset * (1 - reset)
                d_rec = np.concatenate([d_z, d_r, d_new * reset], 1)
                d_x[:, t] = np.concatenate([d_z, d_r, d_new], 1)
                d_u += h.T @ d_rec
                d_h = d_out * (1 - m * (1 - z)) + d_rec @ u.T
            g[f"h{side}"] = d_u
            d_gates[side] = d_x
        return g, d_gates

    def logits(self, t: Text, most: int = 2048, most_words: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of every window of all texts, with the window's first word and text.

        Inputs are made for the words of about ``most_words`` places at once.
        """
        first, size, text = windows(t.bounds)
        out = np.empty(len(first), np.float32)
        cuts = np.flatnonzero(np.r_[True, np.diff(first // most_words) > 0, True]) if len(first) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            used = np.unique(t.index[first[lo] : first[hi - 1] + size[hi - 1]])
            own = t.of(used)
            gates = self.projected(self.inputs(own))
            for i in range(lo, hi, most):
                index, mask = window_words(t, first[i : min(hi, i + most)], size[i : min(hi, i + most)])
                out[i : min(hi, i + most)] = self.forward(gates, np.where(index >= 0, np.searchsorted(used, index), -1), mask)
        return out, first, text

    def scores(self, t: Text) -> np.ndarray:
        """Each text's probability."""
        logit, _, text = self.logits(t)
        if not len(logit):
            return np.zeros(0)
        best = np.maximum.reduceat(logit, np.flatnonzero(np.r_[True, text[1:] != text[:-1]])).astype(np.float64)
        return _sigmoid(self.scale * best + self.shift)


def window_words(t: Text, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (-1 past the end) and mask of windows."""
    step = np.arange(WINDOW)
    mask = step < size[:, None]
    at = np.where(mask, first[:, None] + step, 0)
    index = t.index[at] if len(t.index) else np.zeros(at.shape, np.int64)
    return np.where(mask, index, -1), mask.astype(np.float32)


def _evidence(t: Text, y: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """For each different word the log odds of the label among documents that have a word of its bucket, at least 0."""
    seen = np.zeros((2, 1 << WORD_BITS), np.int64)
    for doc in np.flatnonzero(learn):
        seen[y[doc], np.unique(t.word[t.index[t.bounds[doc] : t.bounds[doc + 1]]])] += 1
    total = [max(1, int((y[learn] == k).sum())) for k in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    return np.where(seen.any(0), np.maximum(odds, 0), 0.0)[t.word]


def fit(texts: list[str], labels: list[int], prior: float, steps: int = 600, seed: int = 5) -> Network:
    """A network trained on whole texts with labels 0 and 1; ``prior`` is the share of 1 among all labels.

    It goes over the texts as often as about ``steps`` steps of ``GROUP`` windows take, at least four times.
    """
    net = Network.new()
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        net.w["o"][:] = 0
        net.shift = -4.0 if not len(y) or y[0] == 0 else 4.0
        return net
    t = read_all(texts)
    aside = np.arange(len(y)) % 5 == 0
    first, length, text = windows(t.bounds)
    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    evidence = np.concatenate([[0], np.cumsum(_evidence(t, y, ~aside)[t.index])])
    rank = evidence[first + length] - evidence[first]
    rng = np.random.default_rng(seed)
    memory: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step, epochs = 0, max(4, round(steps * GROUP / max(1, int((~aside).sum() + 2 * (~aside & (y == 0)).sum()))))
    for epoch in range(epochs):
        order = np.lexsort((-rank, text))
        top = order[begins]
        second = order[np.minimum(begins + 1, np.append(begins[1:], len(order)) - 1)]
        other = begins + (rng.random(len(begins)) * np.diff(np.append(begins, len(text)))).astype(np.int64)
        zero = y[text[begins]] == 0
        pick = np.concatenate([top, second[zero], other[zero]])
        pick = pick[~aside[text[pick]]]
        rng.shuffle(pick)
        for i in range(0, len(pick), GROUP):
            step += 1
            _learn(net, t, pick[i : i + GROUP], first, length, y[text[pick[i : i + GROUP]]], memory, step, 0.01 * 0.8 ** (10 * epoch / epochs))
        if epochs // 3 <= epoch < epochs - 1:  # until then the windows whose words are frequent in toxic texts
            rank = net.logits(t)[0]
    logit = net.logits(t)[0]
    best = np.maximum.reduceat(logit, begins).astype(np.float64)
    _calibrate(net, best[aside], y[aside], prior)
    return net


def _learn(net: Network, t: Text, pick: np.ndarray, first: np.ndarray, length: np.ndarray, y: np.ndarray, memory: dict, step: int, rate: float) -> None:
    index, mask = window_words(t, first[pick], length[pick])
    used = np.unique(index[index >= 0])
    own = t.of(used)
    index = np.where(index >= 0, np.searchsorted(used, index), -1)
    x = net.inputs(own)
    gates = net.projected(x)
    logit, saved = net.forward(gates, index, mask, keep=True)
    g, d_gates = net.backward(gates, index, mask, saved, ((_sigmoid(logit) - y) / len(y)).astype(np.float32))
    d_in = np.zeros_like(x)
    real = index >= 0
    for side in "fb":
        rows = np.zeros((len(used), 3 * HIDDEN), np.float32)
        np.add.at(rows, index[real], d_gates[side][real])
        g[f"x{side}"], g[f"c{side}"] = x.T @ rows, rows.sum(0)
        d_in += rows @ net.w[f"x{side}"].T
    for name, value in g.items():
        _adam(net.w[name], memory[name], slice(None), value + 1e-5 * net.w[name], step, rate)
    size = np.diff(own.cuts)
    for name, places, value in (("word", own.word, d_in[:, :WORD_DIM]), ("char", own.gram, np.repeat(d_in[:, WORD_DIM:] / size[:, None], size, 0))):
        rows, back = np.unique(places, return_inverse=True)
        total = np.zeros((len(rows), value.shape[1]), np.float32)
        np.add.at(total, back, value)
        _adam(net.w[name], memory[name], rows, total, step, rate)


def _grams(t: Text, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(t.cuts)[used]
    cuts = np.concatenate([[0], np.cumsum(size)])
    return t.gram[np.repeat(t.cuts[:-1][used] - cuts[:-1], size) + np.arange(int(cuts[-1]))], cuts


def _adam(w: np.ndarray, memory: list[np.ndarray], rows, g: np.ndarray, step: int, rate: float) -> None:
    m, v = memory
    m[rows] = 0.9 * m[rows] + 0.1 * g
    v[rows] = 0.99 * v[rows] + 0.01 * g * g
    w[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray, prior: float) -> None:
    """Fits scale and shift on texts kept aside, weighted so that their labels are as frequent as in all."""
    if len(y) < 20 or y.min() == y.max():
        return
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method with a small ridge
        p = _sigmoid(a * logit + b)
        e, s = weight * (p - target), weight * p * (1 - p)
        grad = np.array([(e * logit).sum() + 1e-3 * (a - 1), e.sum()])
        hess = np.array([[(s * logit * logit).sum() + 1e-3, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess + 1e-9 * np.eye(2), grad), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    net.scale, net.shift = max(float(a), 1e-3), float(b)


def held_out(doc_id: str = "doc_id", of: int = 3, remainder: int = 1):
    """Whether crc32 of the id as text has this remainder; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == remainder, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 2000, most_bytes: int = 16 << 20) -> Network:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The sample has about ``toxic`` and ``clean`` documents of the two labels, and texts of ``most_bytes`` at
    most, chosen by a hash of the id. Several labels of one id count as their largest and several texts as
    the smallest; null labels and ids count as none. Without labels every text scores low.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [], 0.0)
    prior = sizes.get(1, 0) / sum(sizes.values())
    chance = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where((F.col("toxic").isin(1) & (chance < toxic / max(1, sizes.get(1, 0)))) | (F.col("toxic").isin(0) & (chance < clean / max(1, sizes.get(0, 0)))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # as many rows as the sample
    total, chosen = 0, []
    for _, doc, size in sorted((chance_of(r["doc_id"]), r["doc_id"], r["b"]) for r in found.select("doc_id", F.octet_length("text").alias("b")).collect()):
        if total + size <= most_bytes:
            chosen.append(doc)
            total += size
    if not chosen:
        return fit([], [], prior)
    rows = found.join(F.broadcast(spark.createDataFrame([(d,) for d in chosen], "doc_id long")), "doc_id", "left_semi").collect()
    rows = sorted(rows, key=lambda r: chance_of(r["doc_id"]))
    net = fit([r["text"] for r in rows], [r["toxic"] for r in rows], prior)
    del rows
    shared.trim()
    return net


def chance_of(doc_id: int) -> int:
    """A fixed shuffling of ids."""
    return int(words.mix(np.array([doc_id & (2**64 - 1)], np.uint64))[0])


def score(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for the whole text of each row of ``docs``.

    Null and empty texts have the score of a window without words. Equal texts score equally, whatever their
    ids; a long text is read as a whole, its windows some thousands at a time; an empty table gives an empty
    one; further columns, whatever their names, are not read.
    """
    shared.small_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches):
        shared.begin("toxicity")
        net = sent.value
        for batch in batches:
            for part in shared.text_batches([batch], BATCH):
                p = net.scores(read(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, net: Network, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns, whatever their names.

    Null texts stay; repeated rows are judged alike; an empty table gives an empty one.
    """
    shared.small_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        shared.begin("toxicity")
        net = sent.value
        for batch in batches:
            for part in shared.text_batches([batch], BATCH):
                texts = part.column(text_col)
                yield part.filter(pa.array((net.scores(read(texts)) < threshold) | texts.is_null().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
