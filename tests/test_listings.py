import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo, text
from parcelflow.operators import alerts, cdc, resolve, stats, table
from parcelflow.sources import extract

FORM = "listing_id long, kind string, lat double, lon double, location_precision string, location_radius_km double, area_m2 double, plot_area_m2 double, price long, city string, title string, advertiser_name string, external_id string"
BASE = dict(listing_id=1, kind="plot", lat=52.31, lon=17.44, location_precision="exact", location_radius_km=0.0, area_m2=840.0, plot_area_m2=None, price=131000, city="Modrzewie",
            title="Rozległa łąka Modrzewie Jeziorna", advertiser_name=None, external_id=None)


def listings(spark, *changes):
    rows = [BASE | {"listing_id": k + 1} | c for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in FORM.split(", ")) for r in rows], FORM)


def decide(spark, a, b):
    forms = resolve.normal_forms(listings(spark, a, b))
    pair = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    r = resolve.decisions(pair, forms).first()
    return r.matched, r.reason


@pytest.mark.parametrize(("a", "b", "want"), [
    ({}, {"price": 118000}, (True, "exact+area+title")),
    ({}, {"kind": "house"}, (False, "kind")),
    ({}, {"lat": 52.34}, (False, "far")),
    ({}, {"area_m2": 955.0}, (False, "area")),
    ({"external_id": "QK/7731", "lat": None}, {"external_id": "qk/7731", "lat": None, "area_m2": 9.0}, (True, "identity:ref")),
    ({"external_id": "QK/7731"}, {"external_id": "QK/7731", "lat": 53.4}, (False, "identity_key_far")),
    ({"area_m2": 412.0, "title": "a"}, {"area_m2": 409.5, "title": "b"}, (True, "same_point+figures")),
    ({"kind": "house", "plot_area_m2": 730.0}, {"kind": "house", "plot_area_m2": 910.0}, (True, "same_point+figures")),
    ({"kind": "house", "plot_area_m2": 730.0}, {"kind": "house", "plot_area_m2": 910.0, "location_precision": "approx"}, (False, "plot_area")),
    ({"kind": "house", "area_m2": 310.0, "advertiser_name": "Cztery Dęby"}, {"kind": "house", "area_m2": 355.0, "advertiser_name": "Cztery Dęby Oddział II"}, (True, "exact+area+price+area_loose")),
    ({"area_m2": 700.0}, {"area_m2": 812.0}, (False, "area")),
    ({"lat": None}, {}, (True, "unknown+area+price+title+city")),
])
def test_decisions(spark, a, b, want):
    assert decide(spark, a, b) == want


def test_blocking_loses_no_match(spark):
    rows = [{"lat": 52.31 + k * 0.004, "area_m2": 840.0 + 5 * k, "location_precision": "approx" if k % 2 else "exact", "location_radius_km": 1.0 * (k % 2)} for k in range(14)]
    rows += [{"lat": None}, {"area_m2": None}, {"external_id": "REF-77", "lat": 51.5}, {"external_id": "ref-77", "lat": 51.51, "area_m2": 5.0}]
    forms = resolve.normal_forms(listings(spark, *rows))
    ids = forms.select("listing_id")
    every = ids.toDF("a_id").crossJoin(ids.toDF("b_id")).where("a_id < b_id")
    matched = lambda p: {(r.a_id, r.b_id) for r in resolve.decisions(p, forms).where("matched").collect()}
    assert matched(every) == matched(resolve.matchable_pairs(forms)) and (17, 18) in matched(every)


def test_clusters_exclusions_and_overrides(spark):
    nodes = spark.range(1, 9).toDF("listing_id")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a_id long, b_id long")
    got = {r.listing_id: r.property_id for r in resolve.clusters(nodes, edges, spark.createDataFrame([(3, 2)], "a_id long, b_id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8}
    over = spark.createDataFrame([(4, "split", None, 1), (5, "merge", 1, 1), (5, "merge", 6, 2)], "listing_id long, action string, property_id long, at int")
    fixed = {r.listing_id: (r.property_id, r.is_pinned) for r in resolve.apply_overrides(nodes.selectExpr("listing_id", "1L as property_id"), over).collect()}
    assert fixed[4] == (4, True) and fixed[5] == (6, True) and fixed[1] == (1, False)


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.title_tokens(F.lit("Działka budowlana 8 ar, Modrzewie – światłowód w drodze!"))) == ["modrzewie", "swiatlowod", "drodze"]
    tokens = lambda s: text.title_tokens(F.lit(s))
    sim = lambda a, b: one(text.title_similarity(tokens(a), tokens(b), text.bigrams(tokens(a)), text.bigrams(tokens(b))))
    assert sim("dolny sad", "dolny sad") == 1 and sim("sad", "dolny sad") is None
    same = lambda a, b: one(text.same_seller(text.seller_tokens(F.lit(a)), text.seller_tokens(F.lit(b))))
    assert not same("QX ESTATES", "QX Nieruchomości Modrzewie") and same("CZTERY DĘBY - ODDZIAŁ II", "Cztery Dęby Oddział K9 Stare Pole")
    assert one(text.advertiser_key(F.lit("Osoba prywatna"), F.lit(None).cast("string"))) is None
    keys = lambda r: one(text.identity_keys(F.lit("5"), F.lit(r)))
    assert keys("2468") == ["mg:5"] and keys("753159") == ["mg:5", "ref:753159"] and keys("Qk / 77 31") == ["mg:5", "ref:qk/7731"]
    assert [one(text.area_label(F.lit(x))) for x in ("2 350 m²", "71,25 m²", "0,42 ha", "8 ar", "x")] == [2350, 71.25, pytest.approx(4200), 800, None]
    assert one(text.lenient_number(F.lit("1 234,5"))) == 1234.5 and one(text.rooms(F.lit("THREE"))) == 3
    assert str(one(text.local_time(F.lit("2021-06-11 13:05:09")))) == "2021-06-11 11:05:09" and str(one(text.month_name_date(F.lit("9 maja 2019")))) == "2019-05-09"
    assert [one(text.age_days(F.lit(x))) for x in ("dzisiaj", "2 tygodnie temu", "3 miesiące", "5 dni temu")] == [0, 14, 90, 5]
    assert one(text.strip_html(F.lit("a<br/>b &amp; <b>c</b>"))) == "a b & c" and one(text.slug(F.lit("Stare Pole, łąka"))) == "stare-pole-laka"


STORED = (
    "listing_id long, source string, source_id string, observed_at timestamp_ntz, kind string, title string, price long, area_m2 double, lat double, lon double, location_precision string, location_radius_km double, city string, "
    "advertiser_name string, advertiser_id string, is_private boolean, rooms int, price_negotiable boolean, attributes map<string,string>, property_id long, is_active boolean, source_refreshed_at timestamp_ntz"
)
ROW = (1, "s", "1", None, "plot", "t", 100000, 10.0, 50.0, 20.0, "exact", 0.0, "c", "x", "id", None, 3, False, {"a": "1", "b": "2"}, 9, True, None)


def _stored(spark, **k):
    return spark.createDataFrame([tuple((dict(zip([f.split()[0] for f in STORED.split(", ")], ROW, strict=True)) | k).values())], STORED)


def test_upsert_flags(spark):
    old = _stored(spark)
    got = lambda old=old, **k: cdc.upsert(old, _stored(spark, **k)).first()
    flags = lambda **k: (lambda r: (r.inserted, r.changed, r.price_changed, r.previous_price))(got(**k))
    assert flags() == (False, False, False, 100000) and flags(price=90000) == (False, True, True, 100000) and flags(lat=49.5) == (False, True, False, 100000)
    assert flags(lat=None) == (False, False, False, 100000) and flags(source_id="2") == (True, True, False, None) and flags(price=None)[2] is True
    assert not flags(advertiser_id=None)[1] and not flags(advertiser_name=None)[1] and not flags(advertiser_name="y")[1] and flags(advertiser_id="other")[1]


def test_upsert_keeps_an_exact_pin_and_what_a_list_leaves_out(spark):
    less = dict.fromkeys(("lat", "lon", "location_radius_km", "area_m2", "city", "advertiser_name", "advertiser_id", "rooms"), None) | {"location_precision": "unknown", "price": 5, "price_negotiable": True, "attributes": {"b": "3", "c": "4"}}
    r = cdc.upsert(_stored(spark), _stored(spark, **less)).first()
    assert (r.lat, r.lon, r.location_precision, r.location_radius_km, r.area_m2, r.city, r.advertiser_id, r.rooms, r.price, r.price_negotiable) == (50.0, 20.0, "exact", 0.0, 10.0, "c", "id", 3, 5, True)
    assert r.attributes == {"a": "1", "b": "3", "c": "4"} and r.needs_assignment
    same = cdc.upsert(_stored(spark), _stored(spark, city="other", rooms=7)).first()
    assert (same.changed, same.city, same.rooms, same.needs_assignment) == (False, "c", 3, False)
    bumped = cdc.upsert(_stored(spark), _stored(spark, city="other", source_refreshed_at=datetime(2020, 1, 1))).first()
    assert (bumped.changed, bumped.city, bumped.needs_assignment) == (True, "other", False)
    assert cdc.upsert(_stored(spark, property_id=None), _stored(spark)).first().needs_assignment and cdc.upsert(_stored(spark, is_active=False), _stored(spark)).first().needs_assignment


def test_ads_are_judged_by_their_own_place_first(spark):
    area = (49.9, 19.95, 50.05, 20.15)

    def outcome(attempts=0, **patch):
        row = {"source": "s", "source_id": "1", "status": "ok", "lat": None, "lon": None, "location_precision": None, "location_radius_km": None, "city": None, "attributes": None} | patch
        p = spark.createDataFrame([tuple(row.values())], "source string, source_id string, status string, lat double, lon double, location_precision string, location_radius_km double, city string, attributes map<string,string>")
        return cdc.route(cdc.enrich(_stored(spark, lat=51.5).withColumn("attempts", F.lit(attempts)), p, "2020-01-01"), area).first()

    assert outcome(lat=50.055, lon=20.0).outcome == "assign"  # 0.6 km beyond the edge, within 1 km of slack
    assert outcome(lat=50.08, lon=20.0).outcome == "delete" and outcome(lat=50.08, lon=20.0, location_radius_km=4.0).outcome == "assign"
    assert outcome(lat=51.0, lon=20.0, status="gone").outcome == "delete" and outcome(status="gone").outcome == "deactivate"
    assert outcome().outcome == "assign" and outcome(status="skip").outcome == "wait" and outcome(status="skip", attempts=2).outcome == "assign"  # the stored place, far off, isn't judged
    r = outcome(lat=50.0, lon=20.1, location_precision="approx", location_radius_km=0.5, city="new", attributes={"b": "x"})
    assert (r.lat, r.lon, r.location_precision, r.location_radius_km, r.city, r.attributes, r.attempts, r.is_active, r.price) == (50.0, 20.1, "approx", 0.5, "new", {"a": "1", "b": "x"}, 1, True, 100000)
    gone = outcome(status="gone", lat=50.0)
    assert (gone.is_active, gone.lat, gone.location_precision) == (False, 51.5, "exact") and gone.deactivated_at is not None and gone.enriched_at is not None and outcome(status="skip").enriched_at is None


def test_pages_limits_and_nulls_last(spark):
    rows = spark.createDataFrame([(1, 42), (2, None), (3, 17), (4, 99)], "listing_id long, price long")
    assert [r.price for r in table.page(rows, "price", False, 0, 10).collect()] == [17, 42, 99, None]
    assert [r.price for r in table.page(rows, "price", True, 1, 3).collect()] == [42, 17, None]


def test_areas_and_rings(spark):
    points = spark.createDataFrame([(1, 49.95, 20.05, 1.0), (2, 50.3, 20.05, 1.0), (3, None, None, None)], "listing_id long, lat double, lon double, r double")
    inside = points.select(geo.in_area(F.col("lat"), F.col("lon"), F.col("r"), (49.9, 20.0, 50.0, 20.1)).alias("x")).collect()
    assert [r.x for r in inside] == [True, False, None]
    from parcelflow.operators import spatial

    ring = [(49.9, 20.0), (49.9, 20.1), (50.0, 20.1), (50.0, 20.0)]
    edges = spark.createDataFrame([("a", 0, k, *ring[k], *ring[(k + 1) % 4]) for k in range(4)], "terc string, ring int, edge int, a_lat double, a_lon double, b_lat double, b_lon double")
    meets = lambda *area: spatial.units_meeting(edges, area).count() == 1
    assert meets(49.95, 20.05, 50.2, 20.3) and meets(49.0, 19.0, 51.0, 21.0) and meets(49.94, 19.0, 49.96, 21.0) and not meets(50.1, 20.0, 50.2, 20.1)
    assert [spark.range(1).select(spatial.level(F.lit(m))).first()[0] for m in (150, 151, 500, 501)] == ["on", "near", "near", "far"]


def test_stop_pages(spark):
    walks = {"one empty": [5, 0, 3, 1], "two": [5, 0, 0, 3], "five": [1, 1, 1, 1, 1, 1], "short": [1]}
    rows = spark.createDataFrame([(w, k + 1, n) for w, ns in walks.items() for k, n in enumerate(ns)], "walk string, page int, new_count int")
    assert {r.walk: r.stop_page for r in stats.stop_pages(rows, ["walk"]).collect()} == {"one empty": 4, "two": 3, "five": 5, "short": 1}


def test_adaptive_histogram_keeps_every_row(spark):
    prices = spark.createDataFrame([(k * 37 % 400000,) for k in range(5000)], "price long")
    got = stats.adaptive_histogram(prices, [0, 100000, 300000], most=400).collect()
    assert sum(r.rows for r in got) == 5000 and all(r.rows <= 400 or r.high - r.low < 40000 for r in got)


def test_digest_chunks(spark):
    rows = lambda n: spark.createDataFrame([(1, k, k + 1) for k in range(n)], "spec_id int, property_id long, rn int")
    assert [(r.chunk, r.properties, r.summary) for r in alerts.chunks(rows(25)).orderBy("chunk").collect()] == [(0, 10, False), (1, 10, False), (2, 5, False)]
    assert [(r.chunk, r.properties, r.summary) for r in alerts.chunks(rows(45)).collect()] == [(0, 45, True)]


def test_offers_payload(spark):
    offer = {"id": 7, "url": "u", "title": "T", "params": [{"key": "price", "value": {"value": 100, "currency": "PLN", "label": "100 zł"}}, {"key": "m", "value": {"key": "900", "label": "900 m²"}}],
             "map": {"lat": 50.0, "lon": 20.0, "radius": 0}, "location": {"city": {"name": "C"}}, "user": {"id": 3, "name": "N"}, "business": False}
    body = json.dumps({"data": [offer, {"title": "no id"}, offer | {"id": 8, "params": [{"key": "price", "value": {"value": 5, "currency": "EUR"}}]}]})
    pages = spark.createDataFrame([("olx", "plot", body)], "source string, kind string, body string")
    got = {r.source_id: r for r in extract.offers_json(pages).collect()}
    assert got["7"].price == 100 and got["7"].area_m2 == 900 and got["7"].city == "C" and got["7"].is_private is True and got["8"].price is None and None in got
    assert stats.parse_quality(extract.offers_json(pages)).first().errors == 1


def test_embedded_state_and_json_ld(spark):
    item = {"id": 1, "slug": "s", "title": "t", "totalPrice": {"value": 5, "currency": "PLN"}, "areaInSquareMeters": 10.0, "roomsNumber": "TWO", "isPrivateOwner": True}
    state = lambda root: '<script id="__NEXT_DATA__" type="application/json">' + json.dumps(root) + "</script>"
    props = {"pageProps": {"data": {"searchAds": {"items": [item, item, item | {"id": 2, "totalPrice": None}]}}}}
    pages = spark.createDataFrame([("otodom", "house", state({"props": props})), ("otodom", "plot", state(props))], "source string, kind string, body string")
    got = extract.embedded_state(pages).orderBy("kind", "source_id").collect()
    assert [(r.kind, r.source_id, r.price) for r in got] == [("house", "1", 5), ("house", "2", None), ("plot", "1", 5), ("plot", "2", None)] and got[0].rooms == 2
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Offer","sku":"9","price":"70000"}]}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"Offer","sku":"10","price":"80000"}</script>'
    nodes = extract.json_ld(spark.createDataFrame([(page,)], "body string")).collect()
    assert sorted((r.node["sku"], r.node["price"]) for r in nodes) == [("10", "80000"), ("9", "70000")]


def test_rest_of_the_library_needs_no_training_data_part():
    import pathlib

    import parcelflow

    root = pathlib.Path(parcelflow.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "parcelflow.llm" in p.read_text()]
