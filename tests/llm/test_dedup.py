import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from parcelflow.llm import op1_perfect_hash_dedup as op1
from parcelflow.llm import op5_simhash_trie as op5
from parcelflow.llm import op9_compact_windows as op9

from .conftest import words


def test_perfect_hash_is_minimal_and_checks_members():
    r = random.Random(1)
    keys = np.frombuffer(r.randbytes(32 * 5000), "<u8").reshape(-1, 4)
    levels = op1.build_hash(keys)
    assert sorted(op1.slots_of(levels, keys).tolist()) == list(range(5000))
    assert len(op1.build_hash(keys[:0])) == 0


def test_exact_dedup_equals_brute_force(docs, rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in op1.exact_dedup(docs).collect()]
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_nonmembers_and_history(spark):
    digests = op1.digests_of(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string"))
    batch = op1.digests_of(spark.createDataFrame([(7, "a"), (8, "z"), (9, "z")], "doc_id long, text string"))
    got = {bytes(r.digest): (r.keep_id, r.group_size, r.member) for r in op1.dedup_digests(batch, digests, per_bucket=1).collect()}
    key = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {key("a"): (7, 2, True), key("b"): (2, 1, False), key("c"): (3, 1, False), key("z"): (9, 2, False)}


def test_keep_one_keeps_columns_and_one_row(docs, rows):
    kept = op1.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})


def test_empty_tables(empty):
    assert op1.exact_dedup(empty).count() == op1.keep_one(empty).count() == op5.near_groups(empty).count() == op5.keep_one(empty).count() == op9.repeated_passages(empty).count() == 0


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_the_definition():
    for text in (None, "", " \t", "A", "É a", "X y Z", "É b\x0bC d e", words(50, 1), words(45000, 2)):
        assert op5.fingerprint(text) == slow_fingerprint(text)


def components(nodes, edges):
    root = {n: n for n in nodes}
    for a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = {}
    for n in nodes:
        r = n
        while root[r] != r:
            r = root[r]
        out[n] = r
    return out


def test_trie_join_finds_every_close_pair():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4)} | {0, 1, 3, (1 << 64) - 1}
    v = np.array(sorted(values), np.uint64)
    want = {(int(a), int(b)) for k, a in enumerate(v) for b in v[k + 1 :] if int(a ^ b).bit_count() <= 2}
    assert {(min(int(v[i]), int(v[j])), max(int(v[i]), int(v[j]))) for x in op5.trie_pairs(v, 0) for i, j in zip(*x)} == want
    old, op5.FRONTIER = op5.FRONTIER, 50
    try:
        assert sum(len(i) for i, _ in op5.trie_pairs(v, 0)) == len(want)
    finally:
        op5.FRONTIER = old


def test_near_groups_equal_brute_force(docs, rows):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    n = len(rows)
    comp = components(range(n), [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[comp[i]].append(rows[i][0])
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", str(min(least[comp[i]], default=None))) for i in range(n))
    got = op5.near_groups(docs).select("doc_id", op5.hex_of("fp").alias("f"), "component_id").collect()
    assert sorted((str(a), b, str(c)) for a, b, c in got) == want


def test_components_of_long_chains_in_one_task_and_in_many(spark):
    r = random.Random(5)
    order = list(range(200))
    r.shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(150)] + [(order[k], order[k + 1]) for k in range(160, 180)] + [(7, 7)]
    want = {k: v for k, v in components(range(200), edges).items() if k != v}
    df = spark.createDataFrame(edges, "a long, b long")
    for a_task in (1000, 20):
        assert {x.node: x.component for x in op5.components(df, a_task).collect()} == want


def test_compact_windows_cover_every_subsequence_once():
    r = random.Random(2)
    for n in (0, 5, 30, 80):
        h = np.array([r.randrange(40) for _ in range(2 * n)], np.uint64)
        nodes = list(zip(*(x.tolist() for x in op9.compact_windows(h, np.array([0, n]), np.array([n, 2 * n]), 6))))
        for start in (0, n):
            for i in range(start, start + n):
                for j in range(i + 5, start + n):
                    hits = [c for left, c, right in nodes if left <= i <= c <= j <= right]
                    assert len(hits) == 1 and h[hits[0]] == h[i : j + 1].min()
        assert all(right < n or left >= n for left, _, right in nodes)


def test_shingles_of_joined_texts_are_those_of_each():
    texts = [words(60, 1), None, "", words(49, 2), words(50, 3), words(300, 4)]
    joined, starts = op9.shingled(texts)
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        own = joined[starts[k] : starts[k + 1]]
        assert own.tolist() == op9.shingles(t).tolist() and len(own) == (len(w) - 4 if len(w) >= 50 else 0)
        assert len(set(own.tolist())) == len({tuple(w[i : i + 5]) for i in range(len(own))})


def test_longest_stretch():
    assert op9.longest(np.array([0, 1, 1, 1, 0, 0, 1, 0], float), 0.9) == (1, 4)
    assert op9.longest(np.zeros(4), 0.9) == (0, 0)


def test_repeated_passages_are_found_and_clean_documents_left(docs, rows):
    got = op9.repeated_passages(docs).collect()
    assert set(op9.repeated_passages(docs).columns) == {"doc_id", "start_word", "end_word", "partner_id", "similarity", "class_id"}
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add(r.partner_id)
    assert 110 in found[109] and 109 in found[110]  # a passage of 60 words inside another text
    assert 112 in found[30] | found[112] and 111 in found[20] | found[111]
    text = {d: (t or "").lower().split() for d, t, *_ in rows if d is not None}
    n = lambda d: {tuple(text[d][k : k + 50]) for k in range(len(text[d]) - 49)}
    exact = {d for d in text for e in text if d != e and n(d) & n(e)}
    assert exact <= set(found) and all(d in exact | {112, 30} for d in found)
    passage = next(r for r in got if r.doc_id == 110)
    assert (passage.start_word, passage.end_word, passage.similarity) == (5, 65, 1.0)


def test_passages_with_a_line_that_other_documents_hold(spark):
    docs, want = [], set()
    for k in range(12):
        for others, width in ((3, 0), (30, 50_000)):
            line, at = words(30, 500 + k, 10**6), 10_000 * k + width * 10
            around = [words(15, 600 + k + width, 10**6), words(15, 700 + k + width, 10**6)]
            docs += [(at + i, f"{words(20, at + i, 10**6)} {line} {words(20, at + i + 500, 10**6)}") for i in range(1, others)]
            docs += [(at + i, f"{words(20, at + i, 10**6)} {around[0]} {line} {around[1]} {words(20, at + i + 500, 10**6)}") for i in (0, others)]
            want.add((at, at + others))
    got = op9.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got} == want


def test_passages_survive_a_shorter_copy_between_them(spark):
    docs, want = [], set()
    for k in range(60):
        passage, other = words(60, 900 + k, 10**6), lambda n, k=k: words(40, 10_000 + 10 * k + n, 10**6)
        docs += [(3 * k, f"{other(0)} {passage} {other(1)}"), (3 * k + 1, f"{other(2)} {' '.join(passage.split()[8:52])} {other(3)}"), (3 * k + 2, f"{other(4)} {passage} {other(5)}")]
        want.add((3 * k, 3 * k + 2))
    got = op9.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got} == want


def test_stretches_are_the_same_however_the_table_is_cut(spark, docs):
    near = []
    for k in range(40):
        passage = words(120, 40 + k // 8, 10**6).split()
        own = [w if (k * 31 + j * 17) % 23 else f"x{k}y{j}" for j, w in enumerate(passage)] if k % 3 else passage
        near.append((1000 + k, f"{words(30, 3000 + k, 10**6)} {' '.join(own)} {words(30, 4000 + k, 10**6)}"))
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(near, "doc_id long, text string"))
    cuts = [sorted(map(tuple, op9.repeated_stretches(table.repartition(n)).collect())) for n in (1, 4, 16)]
    assert cuts[0] == cuts[1] == cuts[2] and cuts[0]
    pairs = op9.repeated_passages(table).collect()
    covered, held = defaultdict(set), defaultdict(set)
    for r in pairs:
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    sizes = defaultdict(set)
    for doc, start, end, group, size, partner in cuts[0]:
        assert not held[doc] & set(range(start, end))
        held[doc] |= set(range(start, end))
        sizes[group, size].add(doc)
        assert partner != doc and partner in covered
    assert held == covered and all(len(d) == size and min(d) == group for (group, size), d in sizes.items())
    assert op9.repeated_stretches(table.where("false")).count() == 0


def near_pairs(texts, least=50):
    """Brute force: pairs of texts with stretches of equal length, ``least`` words or more, at a Jaccard of 0.8 or more."""
    sets = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (x.split() for x in texts)]
    out = set()
    for a in range(len(sets)):
        for b in range(a):
            n = least - 4
            for shift in range(n - len(sets[b]), len(sets[a]) - n + 1):
                low, high = max(0, shift), min(len(sets[a]), len(sets[b]) + shift)
                equal = np.cumsum([0] + [sets[a][i] == sets[b][i - shift] for i in range(low, high)])
                if len(equal) > n and (equal[n:] - equal[:-n]).max() >= 1.6 / 1.8 * n:
                    out.add((b, a))
                    break
    return out


def test_recall_of_passages_with_edits(spark):
    """Passages of 100 words of which one in fifty is changed: half of them fall below 0.8 as a whole, not in every part."""
    r, texts = random.Random(8), []
    for k in range(25):
        passage = words(100, 2000 + k, 10**6).split()
        edited = [w if r.random() > 0.02 else f"x{r.random()}" for w in passage]
        texts += [f"{words(30, 5000 + 4 * k, 10**6)} {' '.join(p)} {words(30, 5001 + 4 * k, 10**6)}" for p in (passage, edited)]
    want = near_pairs(texts)
    got = {(min(x.doc_id, x.partner_id), max(x.doc_id, x.partner_id)) for x in op9.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) > 15 and len(want & got) >= 0.9 * len(want)
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_a_common_line_is_dealt_by_its_contexts(spark):
    """A line that all of 300 texts hold is a common signature; passages around it are found, other texts left alone."""
    line, docs, want = words(30, 1, 10**6), [], set()
    for k in range(300):
        before, after = words(40, 100 + k, 10**6), words(40, 1000 + k, 10**6)
        if k % 30 == 1:  # the same twelve words on each side as the text before
            before = " ".join(before.split()[:28] + docs[-1][1].split()[28:40])
            after = " ".join(docs[-1][1].split()[70:82] + after.split()[12:])
            want.add((k - 1, k))
        docs.append((k, f"{before} {line} {after}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(op9.common_signatures(df)) > 0
    got = {(min(x.doc_id, x.partner_id), max(x.doc_id, x.partner_id)) for x in op9.repeated_passages(df).collect()}
    assert got == want


def test_every_pair_of_a_large_group_is_looked_at(spark):
    """Pairs that share a line that 40 other texts hold, and 25 words after an edit beside it: no order makes them neighbours."""
    docs, want = [], set()
    for k in range(8):
        line, after, at = words(31, 20_000 + k, 10**6), words(25, 22_000 + k, 10**6), 1000 * k
        docs += [(at + i, f"{words(30, 30_000 + at + i, 10**6)} {line} {words(30, 40_000 + at + i, 10**6)}") for i in range(1, 41)]
        docs += [(at + i, f"{words(30, 50_000 + at + i, 10**6)} {line} edit{i} {after} {words(30, 60_000 + at + i, 10**6)}") for i in (0, 41)]
        want.add((at, at + 41))
    got = op9.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got} == want


def test_pairs_that_add_nothing_make_no_rows():
    """30 windows whose longest common stretch leaves out a shared shingle: rows that connect documents, none a pair."""
    import pyarrow as pa

    n, width = 30, 2 * op9.AROUND + 1
    around = np.tile(np.arange(width, dtype="<u4"), (n, 1))
    for own in (*range(3, 8), *range(61, 66), *range(67, width)):
        around[:, own] = 1000 * (own + 1) + np.arange(n)
    bare = np.packbits(np.tile(np.arange(width) == 66, (n, 1)), axis=1)
    for classes, want in ((np.zeros(n, int), 0), (np.arange(n), n - 1)):
        columns = [[5] * n, [0] * n, [0] * n, range(n), [0] * n, classes, [0] * n, [x.tobytes() for x in around], [x.tobytes() for x in bare]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["sig", "one", "two", "doc_id", "low", "class_id", "block", "around", "bare"]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
        for batches in ([batch], [batch.slice(0, 7), batch.slice(7)]):
            got = [r for b in op9._compared(iter(batches)) for r in b.to_pylist()]
            assert len(got) == want and all((r["a_start"], r["a_end"]) == (0, 65) and r["similarity"] > 0.8 for r in got)
            assert want == 0 or set(components(range(n), [(r["a"], r["b"]) for r in got]).values()) == {0}


BIG = 2**60 + 1


def test_ids_stay_exact_beside_nulls(spark):
    """An id above 2**53 and a null in one batch, through every operator that carries ids."""
    from parcelflow.llm import op3_mil_toxicity as op3
    from parcelflow.llm import op4_pu_quality as op4
    from parcelflow.llm import op6_vector_packing as op6
    from parcelflow.llm import op7_mpeg_audio as op7
    from parcelflow.llm import op8_mix_sources as op8
    from parcelflow.llm import op10_string_kernel_language as op10

    df = spark.createDataFrame([(BIG, "one text here", "en", "s"), (None, "another text", None, "s"), (None, None, "en", None)], "doc_id long, text string, lang string, source string").coalesce(1)
    texts = {BIG, None}
    model = op3.NoisyOr({"text": 1.0}, -1.0)
    pu = op4.fit(op4.features(["a b c"] * 20), op4.features(["1 2"] * 20), prior=0.5)
    ids = lambda x: {r.doc_id for r in x.collect()}
    assert ids(op1.exact_dedup(df)) == texts and {r.keep_id for r in op1.exact_dedup(df).collect()} == texts and ids(op1.keep_one(df)) == texts and op1.keep_one(df).count() == 3
    assert ids(op3.score_documents(df, model)) == texts and ids(op3.offending_sentences(df, model, 0.0)) == texts and ids(op4.score_documents(df, pu)) == texts
    assert ids(op5.near_groups(df)) == texts and {r.component_id for r in op5.near_groups(df).collect()} == texts and ids(op5.keep_one(df)) == texts
    assert ids(op6.pack(df)) == texts and ids(op7.media_columns(df)) == texts and ids(op8.mix(op8.staged(op8.sized(df)))) == texts
    assert ids(op10.predict_languages(df, op10.fit(["one text", "ein wort"] * 3, ["en", "de"] * 3))) == texts


def test_keep_one_knows_rows_by_id_and_text(spark):
    a, b = words(60, 1), words(60, 2)
    df = spark.createDataFrame([(5, a), (3, b), (5, b), (3, b), (7, None), (None, ""), (8, a + " x" * 0)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as digest", "3 as copies", "4 as wins")
    got = op5.keep_one(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(5, a), (3, b), (7, "")])
