"""Snapshot, change, filter and table queries over the listing views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import cdc, table
from parcelflow.sources.fixtures import CENTRE, CUR_SQL, NOW, OBS_SQL, arrival, current, observations, snapshot

QUERIES, ORACLES = {}, {}
AREA = (49.9, 19.95, 50.05, 20.15)
SPLIT = "1997-06-01 00:00:00"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(f"WITH {CUR_SQL} SELECT listing_id, source, source_id, title, price, area_m2, first_seen_at, last_seen_at FROM cur")
def listing_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select("listing_id", "source", "source_id", "title", "price", "area_m2", "first_seen_at", "last_seen_at")


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, lag(price) OVER k AS previous, row_number() OVER k AS rn FROM obs WINDOW k AS (PARTITION BY source, source_id ORDER BY observed_at, obs_id))
SELECT obs_id, listing_id, price, previous AS previous_price, observed_at FROM w WHERE price IS NOT NULL AND (rn = 1 OR price IS DISTINCT FROM previous)""")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return cdc.price_changes(observations(spark, d))


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, lag(price) OVER k AS previous, row_number() OVER k AS rn FROM obs WINDOW k AS (PARTITION BY source, source_id ORDER BY observed_at, obs_id)),
c AS (SELECT * FROM w WHERE price IS NOT NULL AND (rn = 1 OR price IS DISTINCT FROM previous))
SELECT listing_id, count(*) AS points, string_agg(CAST(price AS VARCHAR), '>' ORDER BY observed_at, obs_id) AS path FROM c GROUP BY listing_id HAVING count(*) > 1""")
def price_path(spark: SparkSession, d: str) -> DataFrame:
    return cdc.price_paths(cdc.price_changes(observations(spark, d)))


_SPLIT_SQL = OBS_SQL + f""",
old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY observed_at DESC, obs_id DESC) AS rn FROM obs WHERE observed_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
new AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY observed_at, obs_id) AS rn FROM obs WHERE observed_at >= TIMESTAMP '{SPLIT}') WHERE rn = 1)"""


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, d)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    old = snapshot(obs.where(F.col("observed_at") < cut)).drop("first_seen_at", "last_seen_at")
    new = cdc.first_per_key(obs.where(F.col("observed_at") >= cut), ["observed_at", "obs_id"])
    return old, new


# Stored rows: some without a property, some inactive; new ones: some without a place, an area, a name or an id, some refreshed.
_NEWS_SQL = _SPLIT_SQL + """,
o AS (SELECT * REPLACE (CASE WHEN obs_id % 7 = 0 THEN NULL ELSE area_m2 END AS area_m2), CASE WHEN listing_id % 7 <> 3 THEN listing_id END AS property_id, listing_id % 13 <> 0 AS is_active, CASE WHEN obs_id % 4 <> 0 THEN observed_at END AS source_refreshed_at, CAST(listing_id % 5 AS INT) AS rooms, FALSE AS price_negotiable FROM old),
n AS (SELECT * REPLACE (CASE WHEN obs_id % 3 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN obs_id % 3 = 0 THEN 'unknown' ELSE location_precision END AS location_precision, CASE WHEN obs_id % 3 = 0 THEN NULL ELSE location_radius_km END AS location_radius_km,
  CASE WHEN obs_id % 5 = 0 THEN NULL ELSE area_m2 END AS area_m2, CASE WHEN obs_id % 2 = 0 THEN NULL ELSE advertiser_name END AS advertiser_name, CASE WHEN obs_id % 11 = 0 THEN NULL ELSE city END AS city,
  CASE WHEN listing_id % 4 = 1 THEN (SELECT any_value(q.price) FROM old q WHERE q.source = new.source AND q.source_id = new.source_id) ELSE price END AS price,
  CASE WHEN listing_id % 8 = 1 THEN (SELECT any_value(q.title) FROM old q WHERE q.source = new.source AND q.source_id = new.source_id) ELSE title END AS title),
  CASE WHEN obs_id % 6 = 0 THEN observed_at END AS source_refreshed_at, CAST(CASE WHEN obs_id % 2 = 0 THEN listing_id % 3 END AS INT) AS rooms, obs_id % 2 = 0 AS price_negotiable FROM new)"""
_DIFF = "(n.price IS DISTINCT FROM o.price OR NOT coalesce(o.is_active, TRUE) OR n.title IS DISTINCT FROM o.title OR (n.area_m2 IS NOT NULL AND n.area_m2 IS DISTINCT FROM o.area_m2) OR (n.lat IS NOT NULL AND n.lon IS NOT NULL AND (n.lat IS DISTINCT FROM o.lat OR n.lon IS DISTINCT FROM o.lon)) OR (n.advertiser_id IS NOT NULL AND n.advertiser_id IS DISTINCT FROM o.advertiser_id))"
_LATER = "coalesce(n.source_refreshed_at > coalesce(o.source_refreshed_at, TIMESTAMP '1970-01-01'), FALSE)"
_pick = lambda c: f"CASE WHEN inserted THEN n_{c} WHEN changed THEN coalesce(n_{c}, o_{c}) ELSE o_{c} END AS {c}"
_put = lambda c: f"CASE WHEN changed THEN n_{c} ELSE o_{c} END AS {c}"
_place = lambda c: f"CASE WHEN inserted OR (changed AND n_lat IS NOT NULL AND n_lon IS NOT NULL) THEN n_{c} ELSE o_{c} END AS {c}"
_KEPT = ("area_m2", "rooms", "city", "is_private", "advertiser_name", "advertiser_id", "source_refreshed_at")
_SIDES = ", ".join(f"n.{c} AS n_{c}, o.{c} AS o_{c}" for c in (*_KEPT, "title", "price", "price_negotiable", "lat", "lon", "location_precision", "location_radius_km"))


@query(f"""WITH {_NEWS_SQL}, j AS (SELECT coalesce(o.listing_id, n.listing_id) AS listing_id, o.listing_id IS NULL AS inserted, o.listing_id IS NULL OR {_DIFF} OR {_LATER} AS changed, o.listing_id IS NULL OR {_DIFF} OR o.property_id IS NULL AS needs_assignment,
  o.listing_id IS NOT NULL AND n.price IS DISTINCT FROM o.price AS price_changed, coalesce(o.kind, n.kind) AS kind, {_SIDES} FROM n LEFT JOIN o USING (source, source_id))
SELECT listing_id, inserted, changed, price_changed, needs_assignment, o_price AS previous_price, kind, {_put("title")}, {_put("price")}, {_put("price_negotiable")}, {", ".join(map(_place, ("lat", "lon", "location_precision", "location_radius_km")))},
  {", ".join(map(_pick, _KEPT))} FROM j""")
def upsert_classified(spark: SparkSession, d: str) -> DataFrame:
    """Flags and stored fields of listings seen again, with and without what a list page may leave out."""
    old, new = _old_new(spark, d)
    none = lambda c, k: F.when(F.col("obs_id") % k != 0, F.col(c))
    same = old.select("source", "source_id", F.col("price").alias("old_price"), F.col("title").alias("old_title"))
    old = old.withColumns({
        "property_id": F.when(F.col("listing_id") % 7 != 3, F.col("listing_id")), "is_active": F.col("listing_id") % 13 != 0, "source_refreshed_at": none("observed_at", 4), "rooms": (F.col("listing_id") % 5).cast("int"),
        "price_negotiable": F.lit(False), "area_m2": none("area_m2", 7)})
    new = new.join(same, ["source", "source_id"], "left").withColumns({
        "lat": none("lat", 3), "location_precision": F.coalesce(none("location_precision", 3), F.lit("unknown")), "location_radius_km": none("location_radius_km", 3), "area_m2": none("area_m2", 5),
        "advertiser_name": none("advertiser_name", 2), "city": none("city", 11), "price": F.when(F.col("listing_id") % 4 == 1, F.col("old_price")).otherwise(F.col("price")),
        "title": F.when(F.col("listing_id") % 8 == 1, F.col("old_title")).otherwise(F.col("title")), "source_refreshed_at": F.when(F.col("obs_id") % 6 == 0, F.col("observed_at")),
        "rooms": F.when(F.col("obs_id") % 2 == 0, F.col("listing_id") % 3).cast("int"), "price_negotiable": F.col("obs_id") % 2 == 0})
    return cdc.upsert(old, new).select(
        "listing_id", "inserted", "changed", "price_changed", "needs_assignment", "previous_price", "kind", "title", "price", "price_negotiable", *cdc.PLACED, "area_m2", "rooms", "city", "is_private", "advertiser_name", "advertiser_id", "source_refreshed_at")


@query(f"""WITH {CUR_SQL}, s AS (SELECT source, kind, max(last_seen_at) - INTERVAL 90 DAY AS started FROM cur GROUP BY source, kind)
SELECT listing_id, source, kind, last_seen_at, NOT (last_seen_at < started) AS is_active FROM cur JOIN s USING (source, kind)""")
def sweep_deactivated(spark: SparkSession, d: str) -> DataFrame:
    cur = current(spark, d).withColumn("is_active", F.lit(True))
    sweeps = cur.groupBy("source", "kind").agg((F.max("last_seen_at") - F.expr("interval 90 days")).alias("started"))
    return cdc.sweep(cur, sweeps).select("listing_id", "source", "kind", "last_seen_at", "is_active")


@query(f"WITH {CUR_SQL} SELECT listing_id, valid_to, NOT (valid_to < TIMESTAMP '{NOW}') AS is_active FROM cur")
def expired(spark: SparkSession, d: str) -> DataFrame:
    return cdc.expire(current(spark, d).withColumn("is_active", F.lit(True)), NOW).select("listing_id", "valid_to", "is_active")


_RADIUS = geo.cosine_sql(*CENTRE)


@query(f"""WITH {CUR_SQL} SELECT listing_id, kind, price, area_m2, first_seen_at, round({_RADIUS}, 6) AS km FROM cur
WHERE kind IN ('plot') AND price >= 100000 AND price <= 320000 AND area_m2 >= 200 AND first_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 2000 DAY AND lat IS NOT NULL AND {_RADIUS} <= 12 AND source IN ('olx','gratka','otodom')
ORDER BY first_seen_at DESC, listing_id DESC LIMIT 5000""")
def radius_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    spec = table.Filters(kinds=("plot",), price_min=100000, price_max=320000, area_min=200, added_within_days=2000, distance_km=12, sources=("olx", "gratka", "otodom"))
    rows = current(spark, d).where(table.predicate(spec, CENTRE, NOW))
    return table.newest(rows, 5000).select("listing_id", "kind", "price", "area_m2", "first_seen_at", F.round(geo.cosine_km(*CENTRE, F.col("lat"), F.col("lon")), 6).alias("km"))


@query(f"WITH {CUR_SQL} SELECT listing_id, lat, lon, first_seen_at > TIMESTAMP '1995-01-01' AS is_new FROM cur WHERE lat BETWEEN 49.95 AND 50.02 AND lon BETWEEN 19.9 AND 20.1")
def bbox_view(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).where(geo.in_box(F.col("lat"), F.col("lon"), 49.95, 19.9, 50.02, 20.1))
    return rows.select("listing_id", "lat", "lon", (F.col("first_seen_at") > F.lit("1995-01-01").cast("timestamp_ntz")).alias("is_new"))


_S, _W, _N, _E = AREA
_MARGIN = "greatest(CAST(1 AS DOUBLE), coalesce(location_radius_km, 0))"
_LAT, _LON = f"({_MARGIN}/111.32)", f"({_MARGIN}/(CAST(111.32 AS DOUBLE)*greatest(CAST(0.2 AS DOUBLE), cos(radians(CAST({round((_S + _N) / 2, 5)} AS DOUBLE))))))"
_INSIDE = f"(lat >= {_S}-{_LAT} AND lat <= {_N}+{_LAT} AND lon >= {_W}-{_LON} AND lon <= {_E}+{_LON})"


@query(f"WITH {CUR_SQL} SELECT listing_id, lat, lon FROM cur WHERE lat IS NULL OR {_INSIDE}")
def inside_area(spark: SparkSession, d: str) -> DataFrame:
    inside = geo.in_area(F.col("lat"), F.col("lon"), F.col("location_radius_km"), AREA)
    return current(spark, d).where(F.coalesce(inside, F.lit(True))).select("listing_id", "lat", "lon")


@query(f"WITH {CUR_SQL} SELECT listing_id, lat, lon FROM cur WHERE lat IS NOT NULL AND NOT {_INSIDE}")
def outside_area(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).where(~geo.in_area(F.col("lat"), F.col("lon"), F.col("location_radius_km"), AREA)).select("listing_id", "lat", "lon")


@query(f"""WITH {CUR_SQL}, f AS (SELECT *, coalesce(p_size % 3 = 0, FALSE) AS property_hidden FROM cur LEFT JOIN part ON CAST(source_id AS BIGINT) = p_partkey
  WHERE (contains(lower(title), 'nation1') OR contains(lower(city), 'nation1') OR source_id = 'nation1') AND kind = 'house' AND area_m2 BETWEEN 200 AND 900)
SELECT listing_id, title, price, property_hidden, count(*) OVER () AS total FROM f ORDER BY price ASC NULLS LAST, listing_id DESC LIMIT 100 OFFSET 100""")
def offers_page(spark: SparkSession, d: str) -> DataFrame:
    hidden = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("source_id"), (F.col("p_size") % 3 == 0).alias("property_hidden"))
    rows = current(spark, d).where(table.matches("nation1") & (F.col("kind") == "house") & F.col("area_m2").between(200, 900))
    rows = rows.join(hidden, "source_id", "left").withColumn("property_hidden", F.coalesce("property_hidden", F.lit(False)))
    page, total = table.page(rows, "price", descending=False, offset=100, limit=100), rows.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total)).select("listing_id", "title", "price", "property_hidden", "total")  # one row of totals


@query(f"""WITH {CUR_SQL}, d AS (SELECT CASE WHEN price IS NULL THEN 'no price' WHEN price < 200000 THEN 'low' ELSE 'high' END AS band, price, area_m2, listing_id FROM cur)
SELECT listing_id, band, price, floor(price/area_m2*100+0.5)/100 AS price_per_m2, row_number() OVER (PARTITION BY band ORDER BY price DESC NULLS LAST, listing_id) AS place
FROM d QUALIFY place <= 50""")
def ranked_views(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("price").isNull(), "no price").when(F.col("price") < 200000, "low").otherwise("high")
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.col("price").desc_nulls_last(), "listing_id"))
    rows = current(spark, d).select("listing_id", band.alias("band"), "price", geo.round2(F.col("price") / F.col("area_m2")).alias("price_per_m2"))
    return rows.withColumn("place", place).where("place <= 50")


@query(f"""WITH {CUR_SQL} SELECT listing_id, 3 - CAST(listing_id % 5 AS INT) AS attempts, first_seen_at FROM cur
WHERE lat IS NULL AND 3 - listing_id % 5 < 3 AND last_seen_at >= TIMESTAMP '1996-01-01' ORDER BY first_seen_at DESC, listing_id DESC LIMIT 200""")
def enrichment_backlog(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).withColumn("is_active", F.col("last_seen_at") >= F.lit("1996-01-01").cast("timestamp_ntz")).withColumn("attempts", (3 - F.col("listing_id") % 5).cast("int"))
    return table.backlog(rows.withColumn("enriched_at", F.lit(None).cast("timestamp_ntz")), 200).select("listing_id", "attempts", "first_seen_at")


def enrichment_sql(area: tuple[float, float, float, float]) -> str:
    """Stored rows without a place where the id is divisible by 3, and details of their ads: gone, read, skipped, far."""
    south, west, north, east = area
    margin = "greatest(CAST(1 AS DOUBLE), coalesce(p_radius, 0))"
    wide = f"({margin}/(CAST(111.32 AS DOUBLE)*greatest(CAST(0.2 AS DOUBLE), cos(radians(CAST({round((south + north) / 2, 5)} AS DOUBLE))))))"
    inside = f"(p_lat >= {south}-{margin}/111.32 AND p_lat <= {north}+{margin}/111.32 AND p_lon >= {west}-{wide} AND p_lon <= {east}+{wide})"
    given = "p_lat IS NOT NULL AND p_lon IS NOT NULL"
    return f"""{_SPLIT_SQL},
s AS (SELECT * REPLACE (CASE WHEN listing_id % 3 = 0 THEN NULL ELSE lat END AS lat), CAST(listing_id % 5 AS INT) AS attempts, CASE WHEN kind = 'plot' AND listing_id % 2 = 0 THEN 'rolna' END AS plot_type FROM old),
p AS (SELECT source, source_id, CASE WHEN listing_id % 11 = 0 THEN 'gone' WHEN obs_id % 4 = 0 THEN 'skip' ELSE 'ok' END AS status, CASE WHEN obs_id % 7 <> 0 THEN lat + CASE WHEN obs_id % 5 = 0 THEN CAST(0.3 AS DOUBLE) ELSE 0 END END AS p_lat, lon AS p_lon, location_precision AS p_precision, location_radius_km AS p_radius,
  CASE WHEN kind = 'house' THEN plot_area_m2 + 1 END AS p_plot, CASE WHEN kind = 'plot' AND obs_id % 3 <> 0 THEN 'budowlana' END AS p_type, CASE WHEN obs_id % 6 <> 0 THEN city END AS p_city FROM new),
q AS (SELECT s.listing_id, s.source, attempts + 1 AS attempts, CASE WHEN {given} THEN p_lat ELSE lat END AS lat, CASE WHEN {given} THEN p_lon ELSE lon END AS lon, CASE WHEN {given} THEN coalesce(p_precision, location_precision) ELSE location_precision END AS location_precision,
  CASE WHEN {given} THEN coalesce(p_radius, location_radius_km) ELSE location_radius_km END AS location_radius_km, coalesce(p_plot, plot_area_m2) AS plot_area_m2, coalesce(p_type, plot_type) AS plot_type, coalesce(p_city, city) AS city, status <> 'gone' AS is_active,
  CASE WHEN {given} AND NOT {inside} THEN 'delete' WHEN status = 'gone' THEN 'deactivate' WHEN status = 'ok' OR attempts + 1 >= 3 THEN 'assign' ELSE 'wait' END AS outcome FROM s JOIN p USING (source, source_id))"""


def enrichment_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new = _old_new(spark, d)
    stored = old.withColumns({
        "lat": F.when(F.col("listing_id") % 3 != 0, F.col("lat")), "attempts": (F.col("listing_id") % 5).cast("int"), "plot_type": F.when((F.col("kind") == "plot") & (F.col("listing_id") % 2 == 0), "rolna")})
    plot, k = F.col("kind") == "plot", F.col("obs_id")
    patch = new.select(
        "source", "source_id", F.when(F.col("listing_id") % 11 == 0, "gone").when(k % 4 == 0, "skip").otherwise("ok").alias("status"), F.when(k % 7 != 0, F.col("lat") + F.when(k % 5 == 0, 0.3).otherwise(0.0)).alias("lat"), "lon",
        "location_precision", "location_radius_km", F.when(~plot, F.col("plot_area_m2") + 1).alias("plot_area_m2"), F.when(plot & (k % 3 != 0), "budowlana").alias("plot_type"), F.when(k % 6 != 0, F.col("city")).alias("city"))
    return stored, patch


ENRICHED = ["listing_id", "attempts", "lat", "lon", "location_precision", "location_radius_km", "plot_area_m2", "plot_type", "city", "is_active", "outcome"]


@query(f"WITH {enrichment_sql(AREA)} SELECT {', '.join(ENRICHED)} FROM q")
def enrichment_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Ad details applied to their listings, and what becomes of each."""
    stored, patch = enrichment_input(spark, d)
    return cdc.route(cdc.enrich(stored, patch, NOW), AREA).select(*ENRICHED)


@query(f"""WITH {CUR_SQL}, m AS (SELECT *, listing_id % 4 = 0 AS was FROM cur) SELECT listing_id, TRUE AS ignored, source_id AS property_id FROM m WHERE NOT was AND price > 180000 AND kind = 'house'""")
def bulk_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).withColumn("ignored", F.col("listing_id") % 4 == 0)
    changed = cdc.set_ignored(rows, (F.col("price") > 180000) & (F.col("kind") == "house"), True)
    return changed.select("listing_id", "ignored", F.col("source_id").alias("property_id"))


@query(f"""WITH {CUR_SQL}, g AS (SELECT source_id AS property_id, count(*) AS before, count(*) FILTER (WHERE lat IS NOT NULL AND NOT {_INSIDE}) AS pruned FROM cur GROUP BY source_id)
SELECT property_id, before, pruned, before = pruned AS removed FROM g WHERE pruned > 0""")
def prune_outside(spark: SparkSession, d: str) -> DataFrame:
    out = F.coalesce(~geo.in_area(F.col("lat"), F.col("lon"), F.col("location_radius_km"), AREA), F.lit(False))
    grouped = current(spark, d).groupBy(F.col("source_id").alias("property_id")).agg(F.count("*").alias("before"), F.count_if(out).alias("pruned"))
    return grouped.where("pruned > 0").withColumn("removed", F.col("before") == F.col("pruned"))


@query("""WITH e AS (SELECT user_id % 997 AS property_id, ts, event_id, CASE event_id % 3 WHEN 0 THEN 'hide' WHEN 1 THEN 'favorite' ELSE 'note' END AS action, event_id % 2 = 0 AS on_ FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id, action ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT property_id, coalesce(bool_or(on_) FILTER (WHERE action='hide'), FALSE) AS hidden, max(ts) FILTER (WHERE action='hide' AND on_) AS hidden_at, coalesce(bool_or(on_) FILTER (WHERE action='favorite'), FALSE) AS favorite,
  max(ts) FILTER (WHERE action='favorite' AND on_) AS favorite_at, max('n' || CAST(event_id AS VARCHAR)) FILTER (WHERE action='note') AS note
FROM r WHERE rn = 1 GROUP BY property_id""")
def user_flags(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_id") % 3 == 0, "hide").when(F.col("event_id") % 3 == 1, "favorite").otherwise("note")
    events = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 997).alias("property_id"), "ts", "event_id", action.alias("action"), (F.col("event_id") % 2 == 0).alias("on"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("note"))
    return cdc.latest_flags(events)
