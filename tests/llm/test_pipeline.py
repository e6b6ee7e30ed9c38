from collections import Counter, defaultdict

from parcelflow.llm import op1_perfect_hash_dedup as op1
from parcelflow.llm import op5_simhash_trie as op5
from parcelflow.llm import op8_mix_sources as op8

from .test_dedup import components, slow_fingerprint


def test_stages_equal_brute_force(spark, docs):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    known = stages["language_id"](spark, docs, "")
    rows = [r.asDict() for r in known.collect()]
    assert {r["doc_id"] for r in docs.drop("lang").exceptAll(known.drop("lang")).collect()} == {102, 103, 104, 107} and known.where("lang is null").isEmpty()
    best = {}
    for r in rows:
        best[r["text"]] = max((r["doc_id"] is not None, r["doc_id"] or 0), best.get(r["text"], (False, 0)))
    once = op1.staged(stages["exact_dedup"](spark, op1.staged(known), ""))
    assert sorted((r.text, r.doc_id is not None, r.doc_id or 0) for r in once.collect()) == sorted((t, *k) for t, k in best.items())
    left = [(r.doc_id, r.text) for r in once.collect()]
    fps = [slow_fingerprint(t) for _, t in left]
    comp = components(range(len(left)), [(i, j) for i in range(len(left)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(left):
        groups[comp[i]].append(doc)
    want = Counter(str(min((d for d in g if d is not None), default=None)) for g in groups.values())
    near = op5.staged(stages["near_dedup"](spark, once, ""))
    assert Counter(str(r.doc_id) for r in near.collect()) == want
    mixed = stages["mix_sources"](spark, near, "")
    decided = op8.mix(op8.staged(op8.sized(near))).collect()
    assert mixed.columns == docs.columns and Counter(str(r.doc_id) for r in mixed.collect()) == Counter({str(r.doc_id): -(-r.taken // r["size"]) for r in decided if r.taken})
    packed = stages["pack"](spark, mixed, "")
    assert packed.where("piece = 0").count() == mixed.count()
