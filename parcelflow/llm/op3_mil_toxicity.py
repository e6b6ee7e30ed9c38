"""Toxicity by multiple-instance learning: labels belong to documents, scores to sentences.

A sentence's probability is a logistic function of its words and their prefixes; a document's is their noisy-or, 1 - prod(1 - p). Word
weights are trained from document labels through the noisy-or with a soft threshold that keeps the weight list short,
on a bounded sample of labelled rows (``TRAIN_ROWS``, the smallest hashes of doc_id). Every sentence of every text is
then scored where the text lies, and the sentence with the largest probability is located.

Defined results: null and empty texts have no sentence and score 0; a null doc_id has no fold and isn't held out; null
labels aren't learnt from; without any label of either kind every score is the share of toxic labels, or 0; repeated
rows repeat; other columns play no part. Offsets count code points of the text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, documents, fold

TRAIN_ROWS, LEAST_DOCS, STEPS, SPARSE = 5000, 3, 200, 1e-4
PREFIXES = (5, 6, 7)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_STOP = re.compile(r"[.!?\n]+")
SCORES = "doc_id long, score double, worst_start int, worst_end int, worst_score double"


def sample_of_labels(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> pd.DataFrame:
    """At most ``rows`` labelled rows outside the held-out fold, with their whole texts: (text, label)."""
    allowed = labels.where(F.col(label).isNotNull() & (fold("doc_id", modulus) != held)).select("doc_id", F.col(label).alias("label"))
    some = allowed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows).select("text", "label").toPandas()


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, and its prefixes marked as such."""
    return [word, *[f"{word[:k]}-" for k in PREFIXES if len(word) > k]]


class _Totals(dict):
    """Words' summed feature weights, worked out when first met; forgotten when there are too many."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got


class NoisyOr:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.totals = weights, bias, _Totals(weights)

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and probabilities of the sentences that have words."""
        tokens = _tokens(text)
        if not tokens:
            return np.empty(0, int), np.empty(0)
        ends = np.fromiter((t[0] in ".!?\n" for t in tokens), bool, len(tokens))
        score = np.fromiter(map(self.totals.__getitem__, tokens), float, len(tokens))
        which = np.cumsum(ends)
        words = np.bincount(which, ~ends)
        z = np.bincount(which, score) + self.bias
        some = np.flatnonzero(words > 0)
        return some, 1 / (1 + np.exp(-np.clip(z[some], -30, 30)))

    def score(self, text: str) -> tuple[float, int, float]:
        some, p = self.sentences(text)
        if not len(p):
            return 0.0, -1, 0.0
        best = int(np.argmax(p))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int(some[best]), float(p[best])


def fit(texts: list[str], labels: list[int], steps: int = STEPS, least: int = LEAST_DOCS, sparse: float = SPARSE) -> NoisyOr:
    share = float(np.mean(labels)) if len(labels) else 0.0
    if not 0 < share < 1:
        return NoisyOr({}, -30.0 if share == 0 else 30.0)
    split = [_tokens(t) for t in texts]
    parts_of = {w: features(w) for s in split for w in s if w[0] not in ".!?\n"}
    seen = Counter(f for s in split for f in {f for w in set(s) for f in parts_of.get(w, ())})
    words = sorted(f for f, n in seen.items() if n >= least)
    number = {f: k for k, f in enumerate(words)}
    numbers = {w: [number[f] for f in fs if f in number] for w, fs in parts_of.items()}
    word, sentence, bag, sentences = [], [], [], 0
    for d, tokens in enumerate(split):
        had = False
        for t in tokens:
            if t[0] in ".!?\n":
                had = False
                continue
            if not had:
                had, sentences = True, sentences + 1
                bag.append(d)
            word += numbers[t]
            sentence += [sentences - 1] * len(numbers[t])
    if not sentences or not words:
        return NoisyOr({}, float(np.log(share / (1 - share))))
    word, sentence, bag, y = np.array(word), np.array(sentence), np.array(bag), np.array(labels, float)
    w, b = np.zeros(len(words)), np.log(share / (1 - share)) - np.log(max(1.0, sentences / len(texts)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[word], sentences) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-6), 1.0)
        g = p * np.maximum(pull[bag], -50) / len(y)
        gw, gb = np.bincount(word, g[sentence], len(w)), g.sum()
        rate = 0.3 if step < steps * 0.6 else 0.05
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        size = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w = w - size * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - size * sparse, 0)
        b -= rate * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-4)
    keep = np.abs(w) > 1e-3
    return NoisyOr({words[k]: float(w[k]) for k in np.flatnonzero(keep)}, float(b))


def locate(text: str, number: int) -> tuple[int, int]:
    """Start and end of the sentence of that number; -1 for none."""
    start = 0
    for k, stop in enumerate(_STOP.finditer(text)):
        if k == number:
            return start, stop.start()
        start = stop.end()
    return (start, len(text)) if number >= 0 else (-1, -1)


def score_documents(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score, and the worst sentence's place and probability, for every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as long as the sample's word list at most

    def columns(texts: list[str]) -> list[pa.Array]:
        rows = []
        for text in texts:
            score, number, worst = shared.value.score(text)
            rows.append((score, *locate(text, number), worst))
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int32(), pa.int32(), pa.float64()), strict=True)]

    return by_text(docs, columns, SCORES)


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """A row for every sentence whose own probability is ``least`` or more: doc_id, start, end, probability, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(texts: list[str]) -> list[pa.Array]:
        found = []
        for text in texts:
            some, p = shared.value.sentences(text)
            places = [(*locate(text, int(some[k])), float(p[k])) for k in np.flatnonzero(p >= least)]
            found.append([{"start": start, "end": end, "probability": q, "sentence": text[start:end]} for start, end, q in places])
        return [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("sentence", pa.string())])))]

    return by_text(docs, columns, "doc_id long, s array<struct<start:int,end:int,probability:double,sentence:string>>").select("doc_id", F.inline("s"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> NoisyOr:
    got = sample_of_labels(docs, labels, "toxic", 5, 0, rows)
    return fit([t or "" for t in got.text], [int(x) for x in got.label])


def op3_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score",
    )
