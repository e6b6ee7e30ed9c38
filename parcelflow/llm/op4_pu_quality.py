"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1 outside the held-out fold; unlabelled web text is drawn from all documents without
looking at labels. Both samples are bounded (``POSITIVES``, ``UNLABELLED``, the smallest hashes of doc_id). A first
classifier tells the samples apart; on held-back halves the class prior is the least ratio, over thresholds, of the
unlabelled share above to the positive share above. The final linear model, over binned surface measures and hashed words
and character trigrams, minimises
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) and is applied to every whole text where it lies.

Defined results: null and empty texts have all measures 0 and are scored like any; a null doc_id isn't held out; null
labels aren't learnt from; without positives every score is 0; repeated rows repeat; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, documents, fold

POSITIVES, UNLABELLED, BINS, STEPS = 3000, 6000, 16, 400
MEASURES, WORDS, GRAMS, CONTENTS = 18, 1024, 1024, 0.3  # surface measures, buckets of words and of trigrams, and the length of each
_KINDS = np.zeros((10, 256))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*#$%&", b"|", b"!", b"?;:()[]{}<>/\\_=+~^@\"'", b".,", b"\n", b" \t\r", b"abcdefghijklmnopqrstuvwxyz")):
    _KINDS[_k, list(_chars)] = 1


def measures(text: str) -> np.ndarray:
    """Surface measures of a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    share = _KINDS @ np.bincount(raw, minlength=256) / n
    words = text.split()
    if not words:
        return np.concatenate([share, np.zeros(8)])
    k, counts = len(words), Counter(words)
    lines = text.split("\n")
    ended = sum(x.rstrip().endswith((".", "!", "?", ":", ";")) for x in lines)
    return np.concatenate([share, [
        np.log1p(k), len(text) / k, len(counts) / k, max(counts.values()) / k,
        sum(map(eq, words, words[1:])) / k, len(set(zip(words, words[1:]))) / k, ended / len(lines), len(set(lines)) / len(lines),
    ]])


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return got


_BUCKETS = _Buckets()


def _share(counts: np.ndarray) -> np.ndarray:
    """Damped counts, as a vector of the length of CONTENTS."""
    out = np.log1p(counts)
    return out * (CONTENTS / max(1e-9, float(np.sqrt(out @ out))))


def contents(text: str) -> np.ndarray:
    """Hashed words and character trigrams of a whole text."""
    low = text.lower()
    words = low.split()
    some = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), minlength=WORDS)
    raw = np.frombuffer(low.encode(), np.uint8).astype(np.uint32)
    grams = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761) >> np.uint32(22) if len(raw) > 2 else np.empty(0, np.uint32)
    return np.concatenate([_share(some), _share(np.bincount(grams, minlength=GRAMS))])


def features(texts: list[str]) -> np.ndarray:
    """A row a text: surface measures, then hashed contents."""
    return np.array([np.concatenate([measures(t), contents(t)]) for t in texts], np.float32).reshape(-1, MEASURES + WORDS + GRAMS)


class PuModel:
    def __init__(self, edges: list[np.ndarray], w: np.ndarray, b: float, prior: float):
        self.edges, self.w, self.b, self.prior = edges, w, b, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(x), 1 / (1 + np.exp(-self.b)))
        return _sigmoid((binned(x, self.edges) @ self.w + self.b).astype(float))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x[:, :MEASURES].T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One column a bin edge of the measures, 1 if the measure is above it; the other columns as they are."""
    return np.concatenate([*[(x[:, [k]] > e[None, :]) for k, e in enumerate(edges)], x[:, len(edges) :]], axis=1).astype(np.float32)


def _descend(grad, size: int, steps: int, decay: float) -> tuple[np.ndarray, float]:
    w, m, v = np.zeros((3, size + 1), np.float32)
    for step in range(1, steps + 1):
        g = grad(w[:-1], w[-1])
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - (0.1 if step < steps * 0.7 else 0.02) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w[:-1], float(w[-1])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradient(x: np.ndarray, push: np.ndarray) -> np.ndarray:
    return np.append(push @ x, push.sum())


def class_prior(p: np.ndarray, u: np.ndarray, steps: int = STEPS) -> float:
    """Least ratio of shares above a threshold of a positive-versus-unlabelled classifier, on rows held back from it."""
    if len(p) < 8 or len(u) < 8:
        return 0.5
    deal = np.random.default_rng(0)
    p, u = p[deal.permutation(len(p))], u[deal.permutation(len(u))]
    half_p, half_u = len(p) // 2, len(u) // 2
    a, b = p[:half_p], u[:half_u]
    w, c = _descend(lambda w, c: _gradient(a, (_sigmoid(a @ w + c) - 1) / len(a)) + _gradient(b, _sigmoid(b @ w + c) / len(b)), p.shape[1], steps, 1e-3)
    sp, su = p[half_p:] @ w + c, u[half_u:] @ w + c
    at = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    qp, qu = np.array([(sp >= t).mean() for t in at]), np.array([(su >= t).mean() for t in at])
    bound = (qu + np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))) / np.maximum(qp, 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS) -> PuModel:
    if not len(positives) or not len(unlabelled):
        return PuModel([], np.empty(0), -30.0, 0.0)
    edges = bin_edges(np.concatenate([positives, unlabelled]))
    p, u = binned(positives, edges), binned(unlabelled, edges)
    prior = class_prior(p, u, steps) if prior is None else prior

    def grad(w, b):
        gp, gu = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()
        positive = prior * _gradient(p, (gp - 1) / len(p))
        if loss(gu) - prior * loss(gp) < 0:  # the estimated risk on negatives counts as zero and has no slope
            return positive
        return positive + _gradient(u, gu / len(u)) - prior * _gradient(p, gp / len(p))

    w, b = _descend(grad, p.shape[1], steps, 1e-3)
    return PuModel(edges, w, b, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PuModel:
    trusted = labels.where((F.col("quality") == 1) & (fold("doc_id", 4) != 2)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    web = docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)

    def rows(ids: DataFrame, most: int) -> np.ndarray:
        """Features, worked out where the texts lie; as many numbers a row come to the driver."""
        some = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").limit(most)
        got = by_text(some, lambda texts: [pa.array([x.tobytes() for x in features(texts)], pa.binary())], "doc_id long, x binary").toArrow()
        raw = b"".join(x for _, x in sorted(zip(got.column("doc_id").to_pylist(), got.column("x").to_pylist(), strict=True)))
        return np.frombuffer(raw, np.float32).reshape(-1, MEASURES + WORDS + GRAMS)

    return fit(rows(trusted, 2 * positives), rows(web, 2 * unlabelled))


def score_documents(docs: DataFrame, model: PuModel) -> DataFrame:
    """(doc_id, score) of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many numbers as there are features
    return by_text(docs, lambda texts: [pa.array(shared.value.score(features(texts)))], "doc_id long, score double")


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
