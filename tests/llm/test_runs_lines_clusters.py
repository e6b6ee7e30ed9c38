import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from parcelflow.llm import op11_periodic_runs as op11
from parcelflow.llm import op12_line_dedup as op12
from parcelflow.llm import op13_centroid_clustering as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w):
    """Every period in turn; the smallest period of a stretch comes first."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j + (j > i))
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(r):
    n, letters = r.randrange(80), r.choice([1, 2, 2, 3, 6, 30])
    w = [str(r.randrange(letters)) for _ in range(n)]
    for _ in range(r.randrange(3)):
        s, p, times = r.randrange(len(w) + 1), 1 + r.randrange(7), r.randrange(50)
        root = [str(r.randrange(letters)) for _ in range(p)]
        w[s:s] = [root[k % p] for k in range(times)]
    return w


def test_runs_equal_brute_force_with_and_without_cuts():
    r = random.Random(3)
    for _ in range(1500):
        w = random_words(r)
        number = {}
        whole = op11.runs_of([number.setdefault(x, len(number)) + 1 for x in w])
        want = slow_runs(w)
        assert [tuple(x) for x in whole.tolist()] == want, w
        assert [tuple(x) for x in op11.find_runs(w).tolist()] == want, w


def test_extensions_equal_plain_comparison():
    r = random.Random(4)
    for letters in (1, 2, 4):
        s = [1 + r.randrange(letters) for _ in range(300)]
        tree = op11.SuffixTree(s)
        i, j = (np.array([r.randrange(301) for _ in range(2000)]) for _ in range(2))
        i, j = i[i != j], j[i != j]

        def plain(a, b, s=s):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            return n

        assert tree.extension(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(range(301), key=lambda k, s=s: [*s[k:], 0]) == np.argsort(tree.rank).tolist()


def test_long_periods_and_long_runs():
    base = [str(k) for k in range(3000)]
    assert op11.find_runs(["x", *base * 4, "y"]).tolist() == [[1, 12000, 3000]]
    assert op11.find_runs(base * 3).tolist() == [] and op11.find_runs(["a"] * 5).tolist() == []
    assert op11.find_runs(["a"] * 50_000).tolist() == [[0, 50_000, 1]]


def slow_row(doc, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def order(rows):
    return sorted(rows, key=lambda x: tuple(str(v) for v in x))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, " ".join(random_words(r))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, "a b " * 20), (None, None), (503, "ha " * 9), (503, "ha " * 9), (504, "é é " * 8), (-7, "x y z " * 6)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "'b' as best", "2 as start", "3 as collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11.op11_periodic_runs(spark, str(tmp_path))
    assert order(tuple(x) for x in found.collect()) == order(slow_row(*x) for x in rows)
    assert {zlib.crc32(str(k).encode()) % 10 for k in range(400)} >= {0}
    one = op11.periodic_runs(spark.createDataFrame([(1, "so na na na na na na end")], "doc_id long, text string")).first()
    assert one.collapsed == "so na end" and one.best.asDict() == {"start": 1, "length": 6, "period": 1}


def test_periodic_runs_of_an_empty_table(empty):
    assert op11.periodic_runs(empty).count() == 0


LINES = [
    (1, "Hello\n  COMMON \nworld"), (2, "common\nx"), (3, "\tCommon\n\ncommon"), (4, "plain"), (5, None), (6, ""), (7, "common"), (7, "common"), (None, "common\nrare"), (None, " common\nÄrger"),
    (8, "\n\n\n"), (9, "commoN\nlast\n"), (10, "x\nX \n x"), (11, "ärger"), (None, None),
]


def slow_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    texts = [(t or "").split("\n") for _, t in rows]
    held = Counter(k for lines in texts for k in {key(x) for x in lines} if k)
    out = []
    for (doc, _), lines in zip(rows, texts, strict=True):
        kept = [x for x in lines if held[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    frame = spark.createDataFrame(LINES, "doc_id long, text string").selectExpr("*", "'a' as row", "1 as salt", "2 as place", "'l' as line", "3 as places", "4 as lines", "'f' as flags")
    for least in (1, 2, 3, 6, 7, 8, 100):
        assert order(tuple(x) for x in op12.drop_common_lines(frame, min_docs=least).collect()) == order(slow_lines(LINES, least)), least


def test_line_dedup_with_a_line_in_most_documents(spark):
    r = random.Random(6)
    rows = [(k, "\n".join(r.choice(["all alike", f"own {k} {j}", f"few {k % 40}", ""]) for j in range(r.randrange(1, 30)))) for k in range(600)]
    rows.append((600, "\n".join(["all alike", "own"] * 4000)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(tuple(x) for x in op12.drop_common_lines(frame).collect()) == order(slow_lines(rows, 10))


def test_line_dedup_of_an_empty_table(empty):
    assert op12.drop_common_lines(empty).count() == 0


def slow_clusters(rows, count=16, rounds=3):
    kept = []
    for vec, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec, [max(-(1 << 24), min(1 << 24, int(np.floor(64 * x)) if abs(x) < 1e12 else (1 << 24 if x > 0 else -(1 << 24)))) for x in e]))
    seeds = sorted(kept, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))[:count]
    centroids = [v for _, v in seeds]
    for k in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if k < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    return [(vec, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (vec, _), (d, n) in zip(kept, near, strict=True)]


def test_clusters_equal_brute_force(spark, tmp_path):
    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(k, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for k in range(150)]
    rows += [(k, [float(r.randrange(-1, 2)) for _ in range(64)]) for k in range(200, 260)] + [(k, [0.0] * 64) for k in range(300, 330)] + [(7, rows[7][1]), (7, [0.5] * 64)]
    rows += [(None, [0.25] * 64), (None, [0.25] * 64), (400, None), (401, []), (402, [0.0] * 63), (403, [0.0] * 65), (404, [None] + [0.0] * 63), (405, [float("nan")] + [0.0] * 63), (406, [float("-inf")] + [1.0] * 63), (407, [1e300] + [0.0] * 63), (408, [-1e300] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as v", "'x' as distance", "3 as inertia")
    assert order(tuple(x) for x in op13.clusters(frame).collect()) == order(slow_clusters(rows))
    few = rows[:3]
    assert order(tuple(x) for x in op13.clusters(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()) == order(slow_clusters(few))
    frame.where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    none = op13.op13_centroid_clustering(spark, str(tmp_path))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nearest_equals_all_distances_with_ties():
    r = np.random.default_rng(8)
    for spread in (1, 2, 50, 1 << 24):
        x, c = r.integers(-spread, spread + 1, (400, 64)), r.integers(-spread, spread + 1, (16, 64))
        c[5], c[9] = c[2], c[1]
        who, best = op13.nearest(x, c)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (who == d.argmin(axis=1)).all()
