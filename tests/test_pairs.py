"""Pairs formed and decided in blocks against every pair of the same listings."""

import random

from pyspark.sql import functions as F

from parcelflow.operators import blocking, pairs, resolve

from .test_listings import listings
from .test_resolution import components


def mixed(spark, seed=5, n=90):
    r = random.Random(seed)
    words = ["lake", "ring", "hill", "brand7", "nation3", "oak", "field"]
    return listings(spark, *[{
        "kind": r.choice(["plot", "plot", "house"]), "lat": None if k % 7 == 0 else 52.3 + r.randrange(6) * 0.004, "lon": 17.4 + r.randrange(4) * 0.006, "location_precision": r.choice(["exact", "approx", None]),
        "location_radius_km": r.choice([0.0, 1.0, 5.0, None]), "area_m2": None if k % 13 == 0 else r.choice([500.0, 510.0, 540.0, 590.0, 840.0]), "plot_area_m2": r.choice([None, 700.0, 720.0, 900.0]),
        "price": r.choice([None, 100_000, 101_000, 102_900, 140_000]), "city": r.choice(["A", " a", "B", None]), "title": " ".join(r.sample(words, r.randrange(1, 5))) if k % 17 else None,
        "advertiser_name": r.choice([None, "Oak Team", "Oak", "QX"]), "external_id": r.choice([None, None, "REF-77", "ref-78"]),
    } for k in range(n)])


def decided(spark, forms):
    ids = forms.select("listing_id")
    every = ids.toDF("a_id").crossJoin(ids.toDF("b_id")).where("a_id < b_id")
    return [r for r in resolve.decisions(every, forms).collect() if r.matched]


def test_matches_in_blocks_are_those_of_every_pair(spark, monkeypatch):
    forms = resolve.normal_forms(mixed(spark))
    want = {(r.a_id, r.b_id): (r.reason, round(r.score, 9)) for r in decided(spark, forms)}
    assert len({x.split("+")[0] for x, _ in want.values()}) >= 5 and any("loose" in x for x, _ in want.values()) and any(x.startswith("identity") for x, _ in want.values())
    for cell in (pairs.ROWS_A_CELL, 3):  # cells in one part, and dealt over several tasks
        monkeypatch.setattr(pairs, "ROWS_A_CELL", cell)
        got = resolve.matches(forms).collect()
        assert len(got) == len(want) and {(r.a_id, r.b_id): (r.reason, round(r.score, 9)) for r in got} == want


def test_links_connect_what_matches_connect_with_few_rows(spark):
    forms = resolve.normal_forms(mixed(spark, 6).unionAll(mixed(spark, 6).selectExpr("listing_id + 100", *mixed(spark, 6).columns[1:])))
    found, links = resolve.matches(forms).collect(), resolve.links(forms).collect()
    want = components(range(300), [(r.a_id, r.b_id) for r in found])
    assert components(range(300), [(r.a_id, r.b_id) for r in links]) == want and len(links) < len(found) / 2


def test_sets_by_bits_and_one_by_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    rows = [r.sample("abcdefghijkl", r.randrange(7)) for _ in range(40)] + [None]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(41) for b in range(41)], strict=True))
    want = [len(set(rows[a] or ()) & set(rows[b] or ())) for a, b in zip(i, j, strict=True)]
    for most in (64, 0):
        monkeypatch.setattr(pairs, "MOST_WORDS", most)
        assert pairs._lists(pa.chunked_array([pa.array(rows, pa.list_(pa.string()))]))[0].shared(i, j).tolist() == want


def test_capped_suspects_are_the_first_of_all(spark, monkeypatch):
    r = random.Random(9)
    rows = [(k, k // 3, r.choice("xyz"), r.choice(["plot", "house"]), r.choice([100_000, 104_000, 130_000]), r.choice([500.0, 530.0, 700.0]), 52.3 + r.random() * 0.06, 17.4 + r.random() * 0.06) for k in range(300)]
    df = spark.createDataFrame(rows, "listing_id long, property_id long, source string, kind string, price long, area_m2 double, lat double, lon double")
    every = {}
    for x in blocking.suspects(df).collect():
        every.setdefault(x.a_id, set()).add(x.b_id)
        every.setdefault(x.b_id, set()).add(x.a_id)
    want = {(a, b) for a, held in every.items() for b in sorted(held)[:3]}
    for rows_at_once in (pairs.PAIRS_AT_ONCE, 100):
        monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", rows_at_once)
        got = blocking.capped_suspects(df, 3).collect()
        assert len(got) == len(want) > 300 and {(x.probe, x.candidate) for x in got} == want


def test_suspects_are_decided_where_they_are_formed(spark):
    held = mixed(spark, 8).withColumn("property_id", F.col("listing_id")).withColumn("source", (F.col("listing_id") % 4).cast("string"))
    forms = resolve.normal_forms(held)
    want = {r.reason: r["count"] for r in resolve.decisions(blocking.suspects(held).select("a_id", "b_id"), forms).groupBy("reason").count().collect()}
    assert {r.reason: r.pairs for r in blocking.suspect_reasons(held, forms).collect()} == want and len(want) > 3


def test_candidates_are_counted_without_their_rows(spark):
    forms = resolve.normal_forms(mixed(spark, 11).withColumn("lat", F.col("lat") + F.col("listing_id") % 5 * 0.06))
    usable = forms.where("listing_id % 5 <> 0")
    want = {}
    for x in blocking.candidates(forms, usable).collect():
        want.setdefault(x.probe, []).append(x.candidate)
    got = {x.probe: tuple(x[1:]) for x in blocking.candidate_counts(forms, usable).collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()} and len({len(v) for v in want.values()}) > 5
