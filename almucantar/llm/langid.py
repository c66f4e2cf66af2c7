"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of
labelled documents, and the scores are calibrated by a temperature that a part of the sample kept aside
gives. Document frequencies count all documents that may be learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared

#: Features are hashed to this many places.
BITS = 15
#: Text bytes that are read at once.
BATCH = 1 << 20
_LETTER = np.zeros(0, bool)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536)
    return _LETTER


def counts(text: str | None) -> np.ndarray | None:
    """How often each hashed 1-, 2- and 3-gram of letters and gaps occurs; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(c, 65535)]
    high = c > 65535
    if high.any():
        letter[high] = [chr(x).isalpha() for x in c[high]]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]  # gaps in a row are one
    c = np.concatenate([[np.uint64(32)], c[keep], [np.uint64(32)]])
    one = c * _K[0]
    two = one[:-1] + c[1:] * _K[1]
    three = two[:-1] + c[2:] * _K[2]
    grams = np.concatenate([one, two + np.uint64(1), three + np.uint64(2)])
    grams = (grams ^ (grams >> np.uint64(31))) * _K[1]
    return np.bincount((grams >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)


@dataclass
class Model:
    """Languages, weights by feature and language, inverse document frequencies and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(n)
        x = (1 + np.log(n[at])) * self.idf[at]
        return at, (x / np.sqrt((x * x).sum())).astype(np.float64)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 without a letter."""
        n = counts(text) if self.languages else None
        if n is None:
            return "und", 0.0
        p = softmax(self.logits(*self.features(n)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], frequencies: np.ndarray, n_docs: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> Model:
    """Follow-the-regularised-leader over ``rows`` (language, feature places, counts); a fifth calibrates."""
    languages = sorted({r[0] for r in rows})
    size, k = 1 << BITS, len(languages)
    model = Model(languages, np.zeros((size, k)), np.zeros(k), np.log((1 + n_docs) / (1 + frequencies)) + 1)
    dense = np.zeros(size)
    data = []
    for lang, at, n in rows:
        dense[at] = n
        data.append((languages.index(lang), *model.features(dense)))
        dense[at] = 0
    aside, used = data[::5] if len(data) >= 5 * max(1, k) else [], [d for i, d in enumerate(data) if i % 5 or len(data) < 5 * max(1, k)]
    z, n, zb, nb = np.zeros((size, k)), np.zeros((size, k)), np.zeros(k), np.zeros(k)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            y, at, x = used[i]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) > l1, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2), 0.0)
            b = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            p = softmax(x @ w + b)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    model.weights = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    model.bias = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    if aside:
        logits = np.array([model.logits(at, x) for _, at, x in aside])
        y = np.array([d[0] for d in aside])

        def loss(t: float) -> float:
            s = logits / t
            return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.exp(np.linspace(math.log(0.1), math.log(10), 81)), key=loss))
    return model


def held_out(doc_id: str = "doc_id", of: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text has this remainder; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == remainder, F.lit(True))


def train(docs: DataFrame, per_language: int = 600, most_languages: int = 500) -> Model:
    """Learns from the rows with text and lang of ``docs`` (doc_id, text, lang).

    The sample has about ``per_language`` documents of each of the ``most_languages`` most frequent languages at
    most, chosen by a hash of id and text, equal ones once; document frequencies cover all rows. The driver gets one count a language, the frequencies (a fixed
    number) and the sample's features.
    """
    shared.small_arrow_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def frequencies(batches):
        shared.begin("langid")
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in shared.text_batches(batches, BATCH):
            for text in batch.column(0).to_pylist():
                own = counts(text)
                if own is not None:
                    total += own > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["place", "n"])

    by_place = {r["place"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    n_docs, found = by_place.pop(-1, 0), np.zeros(1 << BITS, np.int64)
    found[list(by_place)] = list(by_place.values())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(1 << BITS))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def features(batches):
        for batch in shared.text_batches(batches, BATCH):
            out = [(d, lang, np.flatnonzero(n), n[n > 0]) for d, lang, n in ((d, lang, counts(t)) for d, t, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)) if n is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2].astype(np.int32) for x in out], pa.list_(pa.int32())), pa.array([x[3].astype(np.int32) for x in out], pa.list_(pa.int32()))], ["doc_id", "lang", "place", "n"])

    sample = rows.where(chance < share[F.col("lang")]).distinct().mapInArrow(features, "doc_id long, lang string, place array<int>, n array<int>").toArrow()
    sample = sample.take(np.array(sorted(range(sample.num_rows), key=lambda i: (sample["doc_id"][i].as_py() or -1, sample["lang"][i].as_py(), len(sample["place"][i]))), np.int64))
    places, ns = sample["place"].combine_chunks(), sample["n"].combine_chunks()
    data = [(lang, places[i].values.to_numpy(), ns[i].values.to_numpy()) for i, lang in enumerate(sample["lang"].to_pylist())]
    rng = np.random.default_rng(3)
    return fit([data[i] for i in rng.permutation(len(data))], found, n_docs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for the whole text of each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Equal texts
    score equally, texts of any length as a whole; an empty table gives an empty one; further columns, whatever
    their names, are not read.
    """
    shared.small_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as features and languages

    def run(batches):
        shared.begin("langid")
        model = sent.value
        for batch in shared.text_batches(batches, BATCH):
            out = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
