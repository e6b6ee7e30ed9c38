import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import op3_mil_toxicity as op3
from parcelflow.llm import op4_pu_quality as op4
from parcelflow.llm import op10_string_kernel_language as op10
from parcelflow.llm.common import fold

DATA = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    pos = (y == 1).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_folds_are_crc32_of_the_id(spark):
    df = spark.createDataFrame([(k,) for k in (0, 7, 123456)] + [(None,)], "doc_id long")
    assert [r[0] for r in df.select(fold("doc_id", 5)).collect()] == [zlib.crc32(str(k).encode()) % 5 for k in (0, 7, 123456)] + [None]


def test_noisy_or_combines_sentences_and_locates_the_worst():
    model = op3.NoisyOr({"bad": 3.0}, -2.0)
    _, p = model.sentences("All fine. So bad! Bad bad.")
    score, number, worst = model.score("All fine. So bad! Bad bad.")
    assert score == pytest.approx(1 - np.prod(1 - p)) and worst == pytest.approx(p.max())
    start, end = op3.locate("All fine. So bad! Bad bad.", number)
    assert "All fine. So bad! Bad bad."[start:end].strip() == "Bad bad"
    assert model.score("") == (0.0, -1, 0.0)


def test_training_without_both_labels():
    assert op3.fit(["a b"], [0]).score("a b")[0] < 1e-6 and op3.fit([], []).score("x")[0] < 1e-6


def test_toxicity_on_held_out_labels(spark):
    out = op3.op3_mil_toxicity(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert out.score.between(0, 1).all() and len(out) == 1000 and auc(m.score.to_numpy(), m.toxic.to_numpy()) > 0.75


def test_quality_on_held_out_labels(spark):
    out = op4.op4_pu_quality(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert out.score.between(0, 1).all() and len(out) == 1000 and auc(m.score.to_numpy(), m.quality.to_numpy()) > 0.85


def test_class_prior_and_nonnegative_risk():
    r = np.random.default_rng(0)
    pos = r.normal(2, 1, (1500, 3))
    unl = np.concatenate([r.normal(2, 1, (1400, 3)), r.normal(-2, 1, (600, 3))])
    model = op4.fit(pos, unl)
    assert 0.6 < model.prior < 0.8
    assert model.score(np.full((1, 3), 2.0))[0] > 0.7 > 0.3 > model.score(np.full((1, 3), -2.0))[0]
    assert op4.fit(pos[:0], unl).score(unl[:3]).max() < 1e-6


def test_kernel_counts_common_grams():
    alphabet = op10.Alphabet(["a", "b"])
    assert len(alphabet.grams("ab")) == 2 + 3 + 2 and len(alphabet.grams("12 !")) == 0  # a b | _a ab b_ | _ab ab_
    model = op10.fit(["aaa aab", "bbb bba"] * 5, ["x", "y"] * 5)
    assert model.predict(["aab aaa", "bbba", "", "7"])[0] == ["x", "y", "und", "und"]


def test_languages(spark, docs, empty):
    out = op10.op10_string_kernel_language(spark, DATA).toPandas()
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    m = out[out.held_out].merge(truth, on="doc_id")
    assert (m.lang == m.lang_pred).mean() > 0.97
    kept = op10.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.drop("lang").exceptAll(kept.drop("lang")).collect()} == {102, 103, 104, 107}
    assert kept.where("lang is null").isEmpty() and kept.join(docs.where("lang is not null").select("doc_id", F.col("lang").alias("own")), "doc_id").where("lang <> own").isEmpty()
    assert op10.keep_known(empty).count() == 0 and op10.predict_languages(empty, op10.train(empty)).count() == 0


def test_models_on_odd_rows(docs, empty):
    model = op3.NoisyOr({"one": 9.0}, -4.0)
    out = {r.doc_id: r for r in op3.score_documents(docs, model).collect()}
    assert out[102].score == out[103].score == 0 and out[105].score > 0.9 and (out[105].worst_start, out[105].worst_end) == (0, 3)
    assert op3.score_documents(empty, model).count() == 0
    assert op3.offending_sentences(docs, model).where("doc_id = 106").first().sentence == "one two"
    pu = op4.fit(op4.features(["good words here"] * 20), op4.features(["## 12"] * 20), prior=0.5)
    assert op4.score_documents(docs, pu).count() == docs.count() and op4.score_documents(empty, pu).count() == 0


def test_every_letter_of_large_scripts_keeps_its_symbol():
    scripts = {"x": [chr(0x4E00 + k) for k in range(400)], "y": [chr(0x6000 + k) for k in range(400)]}
    r = np.random.default_rng(4)
    texts = [("".join(r.choice(letters, 60)), lang) for lang, letters in scripts.items() for _ in range(60)]
    model = op10.fit([t for t, _ in texts], [lang for _, lang in texts])
    assert len(model.alphabet.letters) == len({c for t, _ in texts for c in t}) > 700
    assert model.predict(["".join(r.choice(letters, 40)) for letters in scripts.values() for _ in range(50)])[0] == ["x"] * 50 + ["y"] * 50
    small, large = op10.Alphabet(["a", "b"]), op10.DENSE
    want = small.grams("ab, ba aab").tolist()
    op10.DENSE = 0
    try:
        assert small.grams("ab, ba aab").tolist() == want
    finally:
        op10.DENSE = large


def test_toxicity_scores_equal_a_plain_noisy_or(spark, docs, rows):
    """Every row's score, worst sentence and its place against a sum over characters' sentences written out."""
    weights = {"w1": 1.5, "w2": -0.5, "one": 2.0, "w30": 0.7, "w": 0.1, "no": 1.0}
    model = op3.NoisyOr(weights, -3.0)
    for r in op3.score_documents(docs, model).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id and (d is not None or t)) if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        best, none, at = (0.0, -1, -1), 1.0, 0
        for sentence in re.split(r"([.!?\n]+)", text or "")[::2]:
            found = [w.lower() for w in re.findall(r"[^\W\d_]+", sentence)]
            if found:
                z = -3.0
                for w in found:
                    z += weights.get(w, 0) + sum(weights.get(w[:k] + "-", 0) for k in (5, 6, 7) if len(w) > k)
                p = 1 / (1 + math.exp(-z))
                none *= 1 - p
                start = (text or "").index(sentence, at)
                if p > best[0]:
                    best = (p, start, start + len(sentence))
            at += len(sentence)
        assert r.score == pytest.approx(1 - none, abs=1e-9) and r.worst_score == pytest.approx(best[0]) and (r.worst_start, r.worst_end) == best[1:]


def test_quality_features_and_scores_equal_plain_counts(spark, docs, rows):
    def slow(text):
        low, n = text.lower(), max(1, len(text.encode()))
        kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "*#$%&", "|", "!", "?;:()[]{}<>/\\_=+~^@\"'", ".,", "\n", " \t\r", "abcdefghijklmnopqrstuvwxyz"]
        out = [sum(c in k for c in text) / n for k in kinds]
        w = text.split()
        lines = text.split("\n")
        out += [math.log1p(len(w)), len(text) / len(w), len(set(w)) / len(w), max(Counter(w).values()) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), len(set(zip(w, w[1:]))) / len(w),
                sum(x.rstrip().endswith((".", "!", "?", ":", ";")) for x in lines) / len(lines), len(set(lines)) / len(lines)] if w else [0.0] * 8
        raw = low.encode()
        for buckets, at in ((op4.WORDS, [zlib.crc32(x.encode()) % op4.WORDS for x in low.split()]), (op4.GRAMS, [((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> 22 for k in range(len(raw) - 2)])):
            counts = [math.log1p(at.count(b)) if b in set(at) else 0.0 for b in range(buckets)]
            size = math.sqrt(sum(x * x for x in counts)) or 1.0
            out += [op4.CONTENTS * x / size for x in counts]
        return out

    some = [t or "" for d, t, *_ in rows if d is not None and d < 108][::9] + ["", "É é! *x* | 12\n\nabc abc.", "ß"]
    assert np.allclose(op4.features(some), [slow(t) for t in some], atol=1e-5)
    model = op4.fit(op4.features(some[:4] * 5), op4.features(some[4:] * 5), prior=0.4)
    got = {r.doc_id: r.score for r in op4.score_documents(docs, model).collect()}
    for d, t, *_ in rows[::11]:
        x = slow(t or "")
        z = model.b
        bits = [float(np.float32(x[k]) > edge) for k, e in enumerate(model.edges) for edge in e] + x[op4.MEASURES :]
        z += sum(a * float(b) for a, b in zip(bits, model.w, strict=True))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_quality_learns_contents_where_surfaces_agree(spark):
    """Two vocabularies of one shape: only hashed contents tell them apart."""
    r = np.random.default_rng(1)
    make = lambda kind: " ".join(f"{kind}{r.choice(list('bcdfg'))}{r.choice(list('aeiou'))}{r.choice(list('klmn'))}" for _ in range(60))
    good, bad = [make("pa") for _ in range(120)], [make("ze") for _ in range(120)]
    model = op4.fit(op4.features(good[:60]), op4.features(good[60:90] + bad[:60]))
    assert model.score(op4.features(good[90:])).min() > model.score(op4.features(bad[60:])).max()


def test_languages_equal_a_plain_kernel_machine():
    """Kernel values by counting common n-grams of sets, and the margins the model's weights give them."""
    texts = ["the cat and the dog", "eine katze und ein hund", "el gato y el perro", "a dog", "ein", "the, the: cat!", "los perros"] * 2
    model = op10.fit(texts[:7], ["en", "de", "es", "en", "de", "en", "es"], landmarks=4)

    def grams(text):
        s = "_" + re.sub(r"[^a-z]+", "_", text.lower()) + "_"
        s = re.sub("_+", "_", s)
        return {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)} - {"_"}

    asked = ["the dog", "hund und katze", "perro", "cats"]
    kernel, some = model.kernel(asked)
    chosen = [k for lang in ("de", "en", "es") for k in sorted((k for k in range(7) if ["en", "de", "es", "en", "de", "en", "es"][k] == lang), key=lambda k: -len(grams(texts[k])))[:16:4]]
    want = [[len(grams(x) & grams(texts[k])) / math.sqrt(len(grams(x)) * len(grams(texts[k]))) for k in chosen] for x in asked]
    assert np.allclose(kernel, want, atol=1e-5) and some.all()
    margin = np.array(want) @ model.weights[:-1] + model.weights[-1]
    langs, score = model.predict(asked)
    assert langs == [["de", "en", "es"][b] for b in margin.argmax(axis=1)] and np.allclose(score, np.clip((margin.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)
