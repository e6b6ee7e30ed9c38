"""The intake in tiles: same tables as without them, a batch stays in its own and can run again; exact rates as a stream."""

import math
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parcelflow.streaming import tiles
from parcelflow.streaming.pipeline import Intake

SIGHTING = (
    "obs_id long, listing_id long, source string, source_id string, observed_at timestamp_ntz, kind string, title string, price long, area_m2 double, plot_area_m2 double, lat double, lon double, "
    "location_precision string, location_radius_km double, city string, advertiser_name string, external_id string, is_private boolean")
WORLD = (-90.0, -180.0, 90.0, 180.0)


def batches(r: random.Random, n: int, size: int) -> list[list[tuple]]:
    """Sightings of few homes by many listings: places at tile edges, moves, missing places and towns, shared keys."""
    homes = [(r.choice([49.9999, 50.0001, 50.24, 51.7]), r.choice([16.9999, 17.0001, 17.49, 20.3]), r.choice(["Ab", "ab", "Cd", None]), r.choice([900.0, 1500.0, None]), r.choice([100000, 150000])) for _ in range(8)]
    out = []
    for b in range(n):
        rows = []
        for k in range(size):
            number = r.randrange(40)
            lat, lon, city, area, price = homes[(number + (r.random() < 0.1)) % len(homes)]
            if r.random() < 0.35:
                lat = lon = None
            key = f"REF-{number % 5}" if number % 7 == 0 else None
            rows.append((b * 1000 + k, number, "s", str(number), datetime(2020, 1, 1) + timedelta(days=b, minutes=k), "plot", f"Brzozowa Polana pod lasem {number % 8}", price + r.choice([0, 0, 500]), area, None, lat, lon,
                         "exact" if number % 2 else "approx", 0.0, city, None, key, None))
        out.append(rows)
    return out


def take_in(spark, intake: Intake, parts: list[list[tuple]]) -> None:
    for n, rows in enumerate(parts):
        intake.on_batch(spark.createDataFrame(rows, SIGHTING), n)


def same(a, b) -> bool:
    columns = [c for c in a.columns if c not in ("links", "sources")]
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and a.count() == b.count()


def test_tiles_change_no_table(spark, tmp_path):
    parts = batches(random.Random(3), 2, 30)
    how = {
        "exclusions": spark.createDataFrame([(1, 9), (2, 10)], "a_id long, b_id long"),
        "overrides": spark.createDataFrame([(3, "split", None, 1), (4, "merge", 12, 2)], "listing_id long, action string, property_id long, at long")}
    cut, whole = Intake(f"{tmp_path}/cut", WORLD, **how), Intake(f"{tmp_path}/whole", WORLD, step=(1000.0, 1000.0), **how)
    take_in(spark, cut, parts)
    take_in(spark, whole, parts)
    assert cut.stored.listed(spark, 1).count() > whole.stored.listed(spark, 1).count()
    listings, properties = cut.listings(spark, 1).cache(), cut.properties(spark, 1).cache()
    assert same(listings, whole.listings(spark, 1)) and same(properties, whole.properties(spark, 1)) and 1 < properties.count() < listings.count()
    cut.on_batch(spark.createDataFrame(parts[1], SIGHTING), 1)  # a batch that runs again
    assert same(cut.listings(spark, 1), whole.listings(spark, 1)) and same(cut.properties(spark, 1), whole.properties(spark, 1))
    assert cut.history(spark).count() == whole.history(spark).count()
    cut.vacuum(spark, 1)
    assert same(cut.listings(spark, 1), whole.listings(spark, 1)) and same(cut.properties(spark, 1), whole.properties(spark, 1))


def test_a_batch_stays_in_its_tiles(spark, tmp_path):
    at = lambda k, lat, lon, city, day: (day * 1000 + k, k, "s", str(k), datetime(2020, 1, 1) + timedelta(days=day), "plot", f"Dom {k}", 1000 * k, 900.0 + 300 * k, None, lat, lon, "exact", 0.0, city, None, None, None)
    intake = Intake(f"{tmp_path}/t", WORLD)
    far = [at(k, 40.0 + k, 10.0, "Town", 0) for k in range(1, 9)]
    take_in(spark, intake, [far, [at(3, None, None, "Town", 1), at(50, 43.01, 10.01, "Town", 1), at(51, None, None, None, 1), at(5, 45.0, 10.0, "Town", 1)]])
    written = lambda n: {x[5:] for x in os.listdir(f"{tmp_path}/t/listings/rows/v={n}") if x.startswith("tile=")}
    # A place once known stays: listing 3 keeps its tile, where 50 joins it; 51 has neither place nor town; 5 is seen again.
    assert len(written(0)) == 8 and {x for x in written(1) if x[0] == "g"} == {"g172_20", "g180_20"} and len(written(1)) == 3
    assert intake.stored.vacuum(spark, 1) == 2 and intake.listings(spark, 1).count() == 10


def test_tiles_around_hold_the_box(spark):
    r = random.Random(5)
    points = [(r.uniform(-80, 80), r.uniform(-170, 170)) for _ in range(60)] + [(None, 1.0)]
    got = {x.tile for x in tiles.tiles_around(spark.createDataFrame(points, "lat double, lon double"), 10.0).collect()}
    for lat, lon in points[:-1]:
        wide = 10 / (111.32 * max(0.2, math.cos(math.radians(lat))))
        corners = [(lat + a * 10 / 111.32, lon + b * wide, "x") for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert {f"g{int(y // 0.25)}_{int(x // 0.5)}" for y, x, _ in corners} <= got
    named = spark.createDataFrame([(1, 50.1, 17.1, "A"), (2, None, 17.1, "A"), (3, None, None, "a"), (4, 1.0, None, None)], "id long, lat double, lon double, city string")
    a, b, c, d = [x.tile for x in named.select("id", tiles.tile(F.col("id"))).orderBy("id").collect()]
    assert a == "g200_34" and b == c and d.startswith("n")


def test_trailing_rate_as_a_stream_equals_the_batch(spark):
    from parcelflow.operators import stats
    from parcelflow.streaming import ingest

    r, t0 = random.Random(9), datetime(2020, 3, 1, 10)
    log = [(k, r.choice("aab"), t0 + timedelta(seconds=r.choice([0, 0.000001, 599.999999, 600]) + 60 * r.randrange(200))) for k in range(400)]
    events = spark.createDataFrame(log, "event_id long, source string, ts timestamp_ntz")
    before = spark.conf.get(ingest.STORE)
    got = {tuple(x) for x in ingest.run_trailing(events, 5).collect()}
    want = {tuple(x) for x in stats.trailing_rate(events, 5).collect()}
    assert got == want and len(want) == 400 and any(x[3] for x in want) and not all(x[3] for x in want) and spark.conf.get(ingest.STORE) == before
    assert ingest.run_trailing(events.limit(0), 5).count() == 0
