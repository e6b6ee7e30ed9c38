"""Blocking, components, re-resolution, manual changes and intake against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo, text
from parcelflow.operators import alerts, blocking, cdc, graph, resolve, spatial, stats
from parcelflow.sources import sinks

from .test_listings import listings


def components(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(4)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    want = {k: v for k, v in components(range(300), edges).items() if k != v}
    df = spark.createDataFrame(edges, "a long, b long")
    for a_task in (10_000, 40):
        assert {x.node: x.component for x in graph.components(df, a_task).collect()} == want


def test_blocking_with_one_wide_listing_loses_no_match(spark):
    """One listing matches within 50 km, the others within 2: every grid is as wide as its pair needs."""
    rows = [{"lat": 52.31 + (k % 9) * 0.05, "lon": 17.4 + k * 0.02, "area_m2": 840.0 + k % 5, "location_precision": "approx", "location_radius_km": 1.0} for k in range(30)]
    rows += [{"lat": 52.4, "lon": 17.5, "location_precision": "approx", "location_radius_km": 50.0}, {"lat": 52.2, "lon": 17.3, "location_precision": "approx", "location_radius_km": 9.0}]
    forms = resolve.normal_forms(listings(spark, *rows))
    ids = forms.select("listing_id")
    every = ids.toDF("a_id").crossJoin(ids.toDF("b_id")).where("a_id < b_id")
    matched = lambda p: {(r.a_id, r.b_id) for r in resolve.decisions(p, forms).where("matched").collect()}
    pairs = resolve.matchable_pairs(forms)
    assert matched(every) == matched(pairs) and pairs.count() == pairs.distinct().count()
    assert any(31 in p for p in matched(pairs))


def test_candidates_meet_in_area_buckets(spark):
    r = random.Random(7)
    rows = [{"lat": None if k % 6 == 0 else 52.3 + r.random() * 0.3, "lon": 17.4 + r.random() * 0.3, "area_m2": None if k % 11 == 0 else r.choice([100.0, 130.0, 133.4, 75.0, 1000.0, 1059.0, 0.5]), "kind": r.choice(["plot", "house"]), "city": r.choice(["A", "a", "B"])} for k in range(60)]
    forms = resolve.normal_forms(listings(spark, *rows))
    got = {(x.probe, x.candidate) for x in blocking.candidates(forms, forms).collect()}
    want, held = set(), {k + 1: x for k, x in enumerate(rows)}
    for i, a in held.items():
        for j, b in held.items():
            if i == j or a["kind"] != b["kind"]:
                continue
            low, high = (0.75, 1.25) if a["kind"] == "house" else (0.94, 1.06)
            area = a["area_m2"] is None or b["area_m2"] is None or a["area_m2"] * low <= b["area_m2"] <= a["area_m2"] * high
            if a["lat"] is None or b["lat"] is None:
                near = a["city"].lower() == b["city"].lower()
            else:
                near = abs(a["lat"] - b["lat"]) <= 10 / 111.32 and abs(a["lon"] - b["lon"]) <= 10 / (111.32 * __import__("math").cos(__import__("math").radians(a["lat"])))
            if near and area:
                want.add((i, j))
    assert got == want


@pytest.mark.parametrize(("names", "want"), [
    ({1: "Stary Dąb", 2: "stary dąb Zachód", 3: "Zachód"}, {(1, 2), (2, 3)}),
    ({1: "team1", 2: "wierzba team1"}, {(1, 2)}),
    ({1: "ab", 2: "ab cd"}, set()),
    ({1: "ab", 2: "AB"}, {(1, 2)}),
])
def test_same_sellers_in_either_order(spark, names, want):
    df = spark.createDataFrame(list(names.items()), "id long, name string").select("id", text.seller_tokens(F.col("name")).alias("seller"))
    assert {(r.a_id, r.b_id) for r in blocking.same_sellers(df, "id").collect()} == want


def test_suspects_equal_brute_force(spark):
    import math

    r = random.Random(3)
    rows = [(k, k // 3, r.choice("xyz"), r.choice(["plot", "house"]), r.choice([100, 105, 111, 150, None]), r.choice([500.0, 530.0, 556.0, 700.0, None]), 52.0 + r.random() * 0.08, 17.0 + r.random() * 0.1) for k in range(120)]
    df = spark.createDataFrame(rows, "listing_id long, property_id long, source string, kind string, price long, area_m2 double, lat double, lon double")

    def km(a, b):
        h = math.sin(math.radians(b[6] - a[6]) / 2) ** 2 + math.cos(math.radians(a[6])) * math.cos(math.radians(b[6])) * math.sin(math.radians(b[7] - a[7]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    close = lambda x, y: x is not None and y is not None and abs(x - y) / max(x, y) <= 0.1
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[2] != b[2] and a[3] == b[3] and close(a[4], b[4]) and close(a[5], b[5]) and km(a, b) <= 2}
    assert {(x.a_id, x.b_id) for x in blocking.suspects(df).collect()} == want and len(want) > 20


def slow_clusters(n, edges, apart):
    part = {k: {k} for k in range(n)}
    for a, b, score in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = part[a], part[b]
        if x is not y and not any((min(i, j), max(i, j)) in apart for i in x for j in y):
            x |= y
            for k in y:
                part[k] = x
    return {k: min(v) for k, v in part.items()}


@pytest.mark.parametrize("seed", range(2))
def test_clusters_respect_exclusions(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = sorted({(*sorted(r.sample(range(k // 15 * 15, k // 15 * 15 + 15), 2)), r.choice([1.0, 2.0, 2.5])) for k in r.choices(range(n), k=90)})
    edges = list({e[:2]: e for e in edges}.values())
    apart = {tuple(sorted(r.sample(range(k // 15 * 15, k // 15 * 15 + 15), 2))) for k in r.choices(range(n), k=12)}
    nodes = spark.range(n).withColumnRenamed("id", "listing_id")
    flipped = [(b, a) if r.random() < 0.5 else (a, b) for a, b in apart] + [(1000, 1001)]
    got = resolve.clusters(nodes, spark.createDataFrame(edges, "a_id long, b_id long, score double"), spark.createDataFrame(flipped, "a_id long, b_id long"), most=(10**6, 20)[seed])
    found = {x.listing_id: x.property_id for x in got.collect()}
    assert found == slow_clusters(n, edges, apart) and not any(found[a] == found[b] for a, b in apart)


def test_an_excluded_pair_stays_apart_through_a_third(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,), (3,), (7,), (8,)], "listing_id long"), spark.createDataFrame([(1, 2, 2.0), (2, 3, 3.0), (7, 8, 1.0)], "a_id long, b_id long, score double")
    own = lambda x: {r.listing_id: r.property_id for r in resolve.clusters(nodes, edges, spark.createDataFrame(x, "a_id long, b_id long")).collect()}
    assert own([(3, 1)]) == {1: 1, 2: 2, 3: 2, 7: 7, 8: 7} and own([(1, 7)]) == own([]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} and own([(8, 7)])[8] == 8


def slow_reassign(rows, matched, apart, passes, key):
    still = {i: (pin and p is not None) or (lat is None and city is None) for i, p, pin, lat, city in rows}
    held = {i: p for i, p, *_ in rows}
    base = max([p for p in held.values() if p is not None] + [0]) + 1
    near = {i: [] for i in held}
    for a, b, score in matched:
        if (a, b) not in apart:
            near[a].append((b, score))
            near[b].append((a, score))
    turn = sorted((i for i in held if not still[i]), key=key)
    for _ in range(passes):
        before, lone = dict(held), []
        for i in turn:
            votes = {}
            for j, score in near[i]:
                if held[j] is not None:
                    n, best = votes.get(held[j], (0, -1))
                    votes[held[j]] = (n + 1, max(best, score))
            if votes:
                held[i] = max(votes, key=lambda p: (*votes[p], -p))
            elif held[i] is None and near[i]:
                held[i] = base + i
                lone.append(i)
            else:
                lone.append(i)
        for i in lone:
            if held[i] is None or any(held[j] == held[i] for j in held if j != i):
                held[i] = base + i
        if held == before:
            break
    return held


@pytest.mark.parametrize("seed", range(2))
def test_reassignment_by_votes_equals_one_after_the_other(spark, seed):
    import hashlib

    r = random.Random(seed)
    n = 40
    rows = [(i, r.choice([None, *range(12)]), r.random() < 0.15, r.choice([None, 1.0, 1.0, 1.0]), r.choice([None, "c"])) for i in range(n)]
    matched = list({e[:2]: e for e in ((*sorted(r.sample(range(n), 2)), r.choice([1.0, 1.5, 2.0])) for _ in range(44))}.values())
    apart = {e[:2] for e in r.sample(matched, 8)}
    df = spark.createDataFrame(rows, "listing_id long, property_id long, pinned boolean, lat double, city string")
    pairs, out = spark.createDataFrame(matched, "a_id long, b_id long, score double"), spark.createDataFrame([(b, a) for a, b in apart], "a_id long, b_id long")
    by_hash = seed % 2 == 0
    got = resolve.reassign(df, pairs, out, passes=1 + seed % 3, order=None if by_hash else F.col("listing_id"))
    key = (lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)) if by_hash else (lambda i: i)
    assert {x.listing_id: x.property_id for x in got.collect()} == slow_reassign(rows, matched, apart, 1 + seed % 3, key)


def test_reassignment_without_pairs_or_listings(spark):
    df = spark.createDataFrame([(1, 5, False, 1.0, "c"), (2, 5, False, 1.0, "c"), (3, None, True, 1.0, "c"), (4, None, False, None, None)], "listing_id long, property_id long, pinned boolean, lat double, city string")
    none = spark.createDataFrame([], "a_id long, b_id long, score double")
    got = {x.listing_id: x.property_id for x in resolve.reassign(df, none, order=F.col("listing_id")).collect()}
    assert got == {1: 7, 2: 5, 3: 9, 4: None} and resolve.reassign(df.limit(0), none).count() == 0


def test_merges_or_flags_and_splits_exclude_siblings(spark):
    schema = "property_id long, hidden boolean, favorite boolean, favorite_at long, note string"
    df = spark.createDataFrame([(1, False, True, None, None), (2, True, False, 7, "two"), (3, False, False, 9, "three"), (4, False, False, None, None)], schema)
    got = {r.property_id: tuple(r)[1:] for r in resolve.merge_flags(df, spark.createDataFrame([(1, 3), (1, 2)], "target long, source long")).collect()}
    assert got == {1: (True, True, 7, "two"), 4: (False, False, None, None)}
    held = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 8)], "listing_id long, property_id long")
    split = spark.createDataFrame([(2,), (3,), (4,)], "listing_id long")
    assert {(r.a_id, r.b_id) for r in resolve.split_exclusions(held, split).collect()} == {(1, 2), (2, 3), (1, 3)}


def test_logs_in_slices_equal_whole_logs(spark):
    r = random.Random(9)
    at, rows = 0, []
    for k in range(400):
        at += r.choice([0, 1, 40, 700, 5000])
        rows.append((k, r.choice("ab"), at, r.random() < 0.7))
    df = spark.createDataFrame(rows, "event_id long, source string, s long, failed boolean").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    streak, recent = {}, {}
    for source in "ab":
        run, own = 0, [x for x in rows if x[1] == source]
        for k, (event, _, at, failed) in enumerate(own):
            run = run + 1 if failed else 0
            if failed:
                streak[event] = (run, min(360, 45 * 2 ** (run - 1)))
            recent[event] = sum(at - 600 < x[2] <= at for x in own)
    assert {x.event_id: (x.streak, x.backoff_minutes) for x in stats.failure_streaks(df).collect()} == streak
    assert {x.event_id: x.recent for x in stats.trailing_rate(df, 3).collect()} == recent
    for x in stats.gaps(df, 60_000_000).collect():
        times = [y[2] for y in rows if y[1] == x.source]
        pauses = [b - a for a, b in zip(times, times[1:])]
        assert (x.gaps, x.least_us, x.too_soon) == (len(pauses), min(pauses) * 10**6, sum(p < 60 for p in pauses))


def test_nearest_centres_equal_brute_force(spark):
    import math

    r = random.Random(5)
    centres = [(f"t{k:02}", 50 + r.random() * 3, 17 + r.random() * 3) for k in range(25)] + [("far", -40.0, 150.0)]
    points = [(k, 50 + r.random() * 3, 17 + r.random() * 3) for k in range(60)] + [(100, 10.0, 60.0), (101, 80.0, -170.0), (102, -50.0, 149.0)]
    km = lambda a, b, c, d: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    want = {k: min(centres, key=lambda c: km(lat, lon, c[1], c[2]))[0] for k, lat, lon in points}
    got = spatial.nearest_centres(spark.createDataFrame(points, "listing_id long, lat double, lon double"), spark.createDataFrame(centres, "terc string, c_lat double, c_lon double"))
    assert {x.listing_id: x.terc for x in got.collect()} == want


def test_failed_chunks_stop_their_search_only(spark):
    chunks = spark.createDataFrame([(s, c, f"{s}{c}") for s in (1, 2) for c in range(3)], "spec_id int, chunk int, ids string")
    tried = alerts.send(chunks, (F.col("spec_id") == 1) & (F.col("chunk") == 1))
    assert {(x.spec_id, x.chunk, x.ok) for x in tried.collect()} == {(1, 0, True), (1, 1, False), (2, 0, True), (2, 1, True), (2, 2, True)}
    assert {x.property_id for x in alerts.notified(alerts.log(tried, F.col("ok"), "2020-01-01")).collect()} == {10, 20, 21, 22}


def test_attribute_overlay_and_links(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    maps = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    assert one(cdc.overlay(maps(a="1", b="2"), maps(b="3", c="4"))) == {"a": "1", "b": "3", "c": "4"} and one(cdc.overlay(F.lit(None).cast("map<string,string>"), maps(a="1"))) == {"a": "1"}
    links = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(k).alias("k")) for k, u in enumerate("abac")])
    assert [x.k for x in one(cdc.distinct_links(links))] == [0, 1, 3]
    assert one(text.query_parameter(F.lit("http://x.y/z?a=1&page=7#q"), "page")) == "7" and one(text.query_parameter(F.lit("http://x.y/z"), "page")) is None
    assert [one(text.kind_of_label(F.lit(x), F.lit("?"))) for x in ("Domek", "działka", "las")] == ["house", "plot", "?"]
    assert one(text.location_path(F.lit("3001"), F.lit("Stare Pole"), F.lit("Stare Pole"), F.lit(True))) == "wielkopolskie/stare-pole/stare-pole"
    assert one(text.area_text(F.lit(12345.0), F.lit("plot"))) == "1,23 ha" and one(text.shortened(F.lit("x" * 91))) == "x" * 87 + "…"
    s, w, n, e = map(F.lit, (50.0, 17.0, 51.0, 18.0))
    assert one(geo.covering_radius_km(s, w, n, e)) == 66 and one(F.struct(*geo.expand(s, w, n, e, F.lit(0.0)))) == (50.0, 17.0, 51.0, 18.0)


def test_lines_and_units_load(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text('{"properties":{"road":"A"},"geometry":{"type":"LineString","coordinates":[[17,52],[17.1,52],[17.2,52.1]]}}\n'
                                           '{"properties":{"road":"B"},"geometry":{"type":"MultiLineString","coordinates":[[[1,2]],[[3,4],[5,6]]]}}\n{"properties":{"road":"C"},"geometry":{"type":"Point","coordinates":[1,2]}}')
    got = sorted(tuple(r) for r in sinks.load_lines(spark, str(tmp_path / "l")).collect())
    assert got == [("A", 0, 0, 52.0, 17.0, 52.0, 17.1), ("A", 0, 1, 52.0, 17.1, 52.1, 17.2), ("B", 1, 0, 4.0, 3.0, 6.0, 5.0)]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.json").write_text('{"terc":"1","name":"n","centre":[0.5,0.5],"rings":[[[0,0],[0,1],[1,1]],[[0,0],[1,1]]]}')
    edges = sorted((r.ring, r.edge, r.a_lat, r.a_lon, r.b_lat, r.b_lon) for r in sinks.load_units(spark, str(tmp_path / "u")).collect())
    assert edges == [(0, 0, 0.0, 0.0, 0.0, 1.0), (0, 1, 0.0, 1.0, 1.0, 1.0), (0, 2, 1.0, 1.0, 0.0, 0.0)]


def test_csv_quotes_and_flags(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a; "b"', True, None), (2, "plain", None, 5), (3, None, False, 7)], "listing_id long, title string, is_private boolean, price long").withColumn("first_seen_at", F.lit("2020-02-03").cast("timestamp_ntz"))
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "c"), ["listing_id", "title", "is_private", "price", "created"])
    lines = [line for p in (tmp_path / "c").glob("*.csv") for line in p.read_text().splitlines()]
    assert lines == ["listing_id;title;is_private;price;created", '1;"a; ""b""";tak;;2020-02-03', "2;plain;;5;2020-02-03", "3;;nie;7;2020-02-03"]


def test_intake_leaves_every_listing_with_a_golden_record(spark):
    from parcelflow.plans.listing_queries import AREA
    from parcelflow.streaming import pipeline

    intake, last = pipeline.run_intake(spark, "/root/testdata/sf0.001", AREA)
    rows, golden = intake.listings(spark, last), intake.properties(spark, last)
    assert rows.count() == rows.select("source", "source_id").distinct().count() and rows.where("property_id is null").isEmpty()
    again = resolve.golden(pipeline.Intake._ready(rows))
    columns = [c for c in golden.columns if c not in ("links", "sources")]
    assert golden.select(columns).exceptAll(again.select(columns)).isEmpty() and golden.count() == again.count() < rows.count()


def test_intake_observes_exclusions_pins_and_grace(spark):
    from parcelflow.streaming.pipeline import Intake

    schema = (
        "listing_id long, source string, source_id string, kind string, title string, price long, lat double, lon double, location_precision string, location_radius_km double, area_m2 double, plot_area_m2 double, city string, "
        "advertiser_name string, external_id string, is_active boolean, deactivated_at timestamp_ntz, last_seen_at timestamp_ntz, property_id long, needs_assignment boolean, seen boolean")
    from datetime import datetime as at

    now = at(2020, 12, 1)
    base = ("s", "x", "plot", "Brzozowa Polana pod lasem", 100000, 52.0, 17.0, "exact", 0.0, 900.0, None, "C", None, None)

    def assigned(held, new, **how):
        rows = [(k, *base, off is None, off, now, p, False, False) for k, p, off in held] + [(k, *base, True, None, now, None, True, True) for k in new]
        out = Intake("unused", (0.0, 0.0, 1.0, 1.0), **how)._assigned(spark.createDataFrame(rows, schema)).collect()
        return {r.listing_id: r.property_id for r in out}, {r.listing_id for r in out if r.touched}

    pairs = lambda *x: spark.createDataFrame(list(x), "a_id long, b_id long")
    held = [(1, 11, None), (2, 11, None), (3, 12, None)]
    assert assigned(held, [7], exclusions=pairs((7, 1), (2, 7)))[0][7] == 12
    old, recent = at(2020, 6, 1), at(2020, 6, 10)
    assert assigned([(1, 11, old), (2, 11, old), (3, 12, None)], [7])[0][7] == 12 and assigned([(1, 11, recent), (2, 11, recent), (3, 12, None)], [7])[0][7] == 11
    assert len(set(assigned([], [7, 8, 9], exclusions=pairs((7, 8)))[0].values())) == 2
    pins = spark.createDataFrame([(2, "merge", 12, 1), (3, "split", None, 1), (7, "merge", 40, 2), (7, "merge", 41, 1)], "listing_id long, action string, property_id long, at long")
    got, touched = assigned(held, [7, 8], overrides=pins)
    assert (got[1], got[2], got[3], got[7]) == (11, 12, 3, 40) and touched == {2, 3, 7, 8} and got[8] in (3, 11, 12, 40)


def test_nearest_lines_equal_the_scan(spark):
    import math

    r = random.Random(11)
    lines = []
    for variant in "AB":
        for k in range(40):
            lat, lon = 52 + r.random() * 2, 17 + r.random() * 2
            far = r.choice([0.0005, 0.01, 0.8])
            lines.append((variant, r.choice("xyz"), k, lat, lon, lat + (r.random() - 0.5) * far, lon + (r.random() - 0.5) * far))
    lines += [("C", "one", 0, 10.0, 100.0, 10.0, 100.0), ("A", "w", 99, 53.0, 18.0, 53.0, 18.1), ("A", "v", 98, 53.0, 18.0, 53.0, 18.1)]
    points = [(k, 52 + r.random() * 2, 17 + r.random() * 2) for k in range(150)] + [(900, 53.01, 18.05), (901, -60.0, -150.0), (902, None, 18.0), (903, 53.0, 18.05)]
    kx = {v: 111320 * math.cos(math.radians(sum(x[3] + x[5] for x in lines if x[0] == v) / (2 * sum(x[0] == v for x in lines)))) for v in "ABC"}

    def metres(p, s):
        k = kx[s[0]]
        px, py, ax, ay, bx, by = p[2] * k, p[1] * 111320, s[4] * k, s[3] * 111320, s[6] * k, s[5] * 111320
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if n == 0 else max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    p = spark.createDataFrame(points, "listing_id long, lat double, lon double")
    table = spark.createDataFrame(lines, "variant string, road string, seg_no int, a_lat double, a_lon double, b_lat double, b_lon double")
    got = {(x.listing_id, x.variant): (x.metres, x.road) for x in spatial.nearest_lines(p, table).collect()}
    want = {(q[0], v): min((metres(q, s), s[1]) for s in lines if s[0] == v) for q in points if q[1] is not None for v in "ABC"}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) <= 0.0006 + 1e-9 * want[k][0] for k in want) and got[900, "A"][1] == got[903, "A"][1] == "v"
    assert spatial.nearest_lines(p.limit(0), table).count() == spatial.nearest_lines(p, table.limit(0)).count() == 0


def test_rings_by_strips_equal_brute_force(spark):
    import math

    r = random.Random(13)
    rings = []
    for unit in range(12):
        for ring in range(1 + unit % 2):
            lat, lon, n = 52 + r.random(), 17 + r.random(), r.randrange(3, 25)
            corners = [(lat + r.uniform(0.02, 0.3) * math.sin(2 * math.pi * k / n), lon + r.uniform(0.02, 0.3) * math.cos(2 * math.pi * k / n)) for k in range(n)]
            rings.append((f"u{unit}", ring, corners))
    rings.append(("square", 0, [(52.0, 17.0), (52.0, 17.5), (52.5, 17.5), (52.5, 17.0)]))
    edges = [(t, g, k, *c[k], *c[(k + 1) % len(c)]) for t, g, c in rings for k in range(len(c))]
    points = [(k, 51.7 + 1.6 * r.random(), 16.7 + 1.6 * r.random()) for k in range(400)] + [(900, None, 1.0), (901, 52.25, 17.25), (902, 52.5, 17.2)]

    def inside(lat, lon, c):
        cross = 0
        for (a, x), (b, y) in zip(c, c[1:] + c[:1]):
            cross += (a > lat) != (b > lat) and lon < (y - x) * (lat - a) / (b - a) + x
        return cross % 2 == 1

    want = sorted((k, t) for k, lat, lon in points if lat is not None for t, _, c in rings if inside(lat, lon, c))
    table = spark.createDataFrame(edges, "terc string, ring int, edge int, a_lat double, a_lon double, b_lat double, b_lon double")
    got = spatial.containing_units(spark.createDataFrame(points, "listing_id long, lat double, lon double"), table)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
