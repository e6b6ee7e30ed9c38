"""Language identification with a blended-spectrum string kernel.

A text's features are the distinct letter n-grams of lengths 1 to 3 that it holds (runs of other characters are one
boundary; letters that no training text has share one symbol). k(x, z) is the number of common n-grams over the geometric
mean of both counts. Landmark texts give Nystroem features K(x, Z) K(Z, Z)^(-1/2); a one-versus-rest ridge regression
over them gives a language's margin. Batches of texts are scored by two matrix products. The model is fitted on a
bounded sample (``TRAIN_ROWS``, ``LANDMARKS`` a language) of rows with a language, outside the held-out fold.

Defined results: a null text and one without a letter are ``und`` with score 0; a null doc_id isn't held out; if no
row can be learnt from, every text is ``und``; repeated rows repeat; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, documents, fold, unused

TRAIN_ROWS, LANDMARKS, RIDGE, BATCH = 3000, 20, 1e-2, 256
DENSE, CELLS = 122, 1 << 25  # symbols up to which n-grams are marked in an array; values of a presence matrix at once
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Alphabet:
    """Symbols: 0 a boundary, 1 up to n the known letters, n + 1 any other letter."""

    def __init__(self, letters: list[str]):
        self.letters, self.base = letters, len(letters) + 2

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            out = np.where(_letters(), self.base - 1, 0).astype(np.int32)
            out[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
            self._table = out
        return self._table

    def __getstate__(self):
        return {"letters": self.letters, "base": self.base}

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the distinct n-grams; none if the text has no letter."""
        s = self.table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        s = np.concatenate([[0], s, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])].astype(np.int64)
        if len(s) < 3:
            return np.empty(0, np.int64)
        n, two = self.base, s[:-1] * self.base + s[1:]
        if n > DENSE:
            found = np.unique(np.concatenate([s, n + two, n + n * n + two[:-1] * n + s[2:]]))
            return found[found != 0]
        seen = np.zeros(n + n * n + n * n * n, bool)
        seen[s] = True
        seen[0] = False
        seen[n + two] = True
        seen[n + n * n + two[:-1] * n + s[2:]] = True
        return np.flatnonzero(seen)


class KernelModel:
    def __init__(self, alphabet: Alphabet, grams: np.ndarray, landmarks: np.ndarray, weights: np.ndarray, classes: list[str]):
        self.alphabet, self.grams, self.landmarks, self.weights, self.classes = alphabet, grams, landmarks, weights, classes

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values with the landmarks, and which texts have a letter."""
        most = max(1, CELLS // max(1, len(self.grams)))
        if len(texts) > most:
            some = [self.kernel(texts[k : k + most]) for k in range(0, len(texts), most)]
            return np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        present, norm = np.zeros((len(texts), len(self.grams)), np.float32), np.ones(len(texts), np.float32)
        for k, text in enumerate(texts):
            own = self.alphabet.grams(text)
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            present[k, at[self.grams[at] == own]] = 1
            norm[k] = len(own)
        return present @ self.landmarks / np.sqrt(np.maximum(norm, 1))[:, None], norm > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.classes:
            return ["und"] * len(texts), np.zeros(len(texts))
        kernel, some = self.kernel(texts)
        margin = kernel @ self.weights[:-1] + self.weights[-1]
        best = margin.argmax(axis=1)
        score = np.clip((margin[np.arange(len(texts)), best] + 1) / 2, 0, 1).astype(float)
        return [self.classes[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    classes = sorted(set(langs))
    alphabet = Alphabet(sorted({c for t in texts for c in set(t.lower()) if c.isalpha() and len(c) == 1}))
    sets = [alphabet.grams(t) for t in texts]
    usable = [k for k, s in enumerate(sets) if len(s)]
    if not usable:
        return KernelModel(alphabet, np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((1, 0)), [])
    chosen = [k for c in classes for k in sorted((k for k in usable if langs[k] == c), key=lambda k: -len(sets[k]))[: 4 * landmarks : 4]]
    grams = np.unique(np.concatenate([sets[k] for k in chosen]))
    columns = np.zeros((len(grams), len(chosen)), np.float32)
    for j, k in enumerate(chosen):
        columns[np.searchsorted(grams, sets[k]), j] = 1 / np.sqrt(len(sets[k]))
    model = KernelModel(alphabet, grams, columns, np.empty((0, 0)), classes)
    values, vectors = np.linalg.eigh(model.kernel([texts[k] for k in chosen])[0].astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = model.kernel([texts[k] for k in usable])[0] @ root
    phi1 = np.column_stack([phi, np.ones(len(phi))])
    y = np.where(np.array([langs[k] for k in usable])[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    penalty = np.diag([ridge * len(phi)] * phi.shape[1] + [0.0])
    w = np.linalg.lstsq(phi1.T @ phi1 + penalty, phi1.T @ y, rcond=None)[0]
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> KernelModel:
    allowed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    some = allowed.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    got = allowed.select("doc_id", "text", "lang").join(F.broadcast(some), "doc_id").orderBy("doc_id").limit(2 * rows).select("text", "lang").toPandas()
    return fit(got.text.tolist(), got.lang.tolist(), landmarks)


def predict_languages(docs: DataFrame, model: KernelModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks times their n-grams

    def columns(texts: list[str]) -> list[pa.Array]:
        langs, score = shared.value.predict(texts)
        return [pa.array(langs, pa.string()), pa.array(score, pa.float64())]

    return by_text(docs, columns, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: KernelModel | None = None) -> DataFrame:
    """``docs`` without the rows whose language is ``und``, a null ``lang`` filled with the prediction. No shuffle."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def language(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), BATCH):
            out += shared.value.predict([t or "" for t in text.iloc[at : at + BATCH]])[0]
        return pd.Series(out, dtype=str)

    found = unused(docs, "found")
    predicted = F.pandas_udf(language, "string").asNondeterministic()  # worked out once: not copied into the filter below
    known = docs.withColumn(found, predicted(F.col("text"))).where(F.col(found) != "und")
    return known.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict_languages(docs, train(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
