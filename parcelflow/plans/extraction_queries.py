"""Extraction of landed bodies, loaders of lines and polygons, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import text
from parcelflow.operators import stats
from parcelflow.sources import adapters, extract, landed, landing, portals, sinks
from parcelflow.sources.fixtures import CUR_SQL, SOURCES, current
from parcelflow.sources.shared import scratch, staged
from parcelflow.streaming.pages import PageIntake
from parcelflow.streaming.pages import run as run_pages

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _landed(spark: SparkSession, d: str, form) -> DataFrame:
    return staged(form(current(spark, d)))


_ID, _LD = "CAST(listing_id AS VARCHAR)", "CASE WHEN listing_id % 2 = 0 THEN price - price // 10 ELSE price END"


@query(f"""WITH {CUR_SQL} SELECT source, kind, {_ID} AS source_id, '/d/' || {_ID} AS url, title, CASE WHEN listing_id % 7 <> 0 AND price > 0 THEN price END AS price, area_m2,
  CASE WHEN kind = 'house' THEN plot_area_m2 END AS plot_area_m2, lat, lon, CASE WHEN lat IS NULL THEN 'unknown' WHEN location_radius_km = 0 THEN 'exact' ELSE 'approx' END AS location_precision, city, advertiser_name, is_private FROM cur""")
def extract_offers(spark: SparkSession, d: str) -> DataFrame:
    return extract.offers_json(_landed(spark, d, landing.offers)).select("source", "kind", "source_id", "url", "title", "price", "area_m2", "plot_area_m2", "lat", "lon", "location_precision", "city", "advertiser_name", "is_private")


@query(f"""WITH {CUR_SQL} SELECT source, kind, {_ID} AS source_id, title, CASE WHEN listing_id % 5 <> 0 THEN price END AS price, area_m2, plot_area_m2, CAST(listing_id % 3 + 1 AS INT) AS rooms, is_private FROM cur""")
def extract_state(spark: SparkSession, d: str) -> DataFrame:
    return extract.embedded_state(_landed(spark, d, landing.states)).select("source", "kind", "source_id", "title", "price", "area_m2", "plot_area_m2", "rooms", "is_private")


@query(f"""WITH {CUR_SQL} SELECT {_ID} AS source_id, lat, lon, CASE WHEN location_radius_km = 0 THEN 'exact' ELSE 'approx' END AS location_precision, listing_id % 11 = 0 AS is_gone,
  'Area=' || CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ',MarketType=' || kind AS attributes FROM cur""")
def extract_ads(spark: SparkSession, d: str) -> DataFrame:
    ads = extract.ad_details(_landed(spark, d, landing.ads))
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat_ws("=", x.key, x.value))
    return ads.select("source_id", "lat", "lon", "location_precision", "is_gone", F.array_join(pairs, ",").alias("attributes"))


_AT = "CASE WHEN lat IS NULL THEN 'unknown' WHEN location_radius_km = 0 THEN 'exact' ELSE 'approx' END AS location_precision, CASE WHEN lat IS NOT NULL THEN location_radius_km END AS location_radius_km"
_ORIGIN = "CASE source WHEN 'gratka' THEN 'https://gratka.pl' WHEN 'morizon' THEN 'https://www.morizon.pl' WHEN 'domiporta' THEN 'https://www.domiporta.pl' WHEN 'adresowo' THEN 'https://adresowo.pl' END"
_CENTS = lambda x: f"floor(({x}) * 100 + CAST(0.5 AS DOUBLE)) / 100"
_WARSAW = lambda x: f"((({x}) AT TIME ZONE 'Europe/Warsaw') AT TIME ZONE 'UTC')"


def _text(ts: str, df: DataFrame) -> DataFrame:
    """Times as text, so that both engines compare them alike."""
    return df.withColumn(ts, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {CUR_SQL}, t AS (SELECT *, listing_id % 5 <> 0 AS listed, listing_id % 17 <> 0 AS linked FROM cur WHERE listing_id % 9 <> 0 AND listing_id % 11 <> 0),
u AS (SELECT *, CASE WHEN listed THEN area_m2 + 1 ELSE area_m2 END AS area, CASE WHEN price > 0 THEN price END AS amount FROM t)
SELECT source, kind, CASE WHEN linked THEN {_ID} END AS source_id, CASE WHEN linked THEN 'https://x.pl/oferta/' || {_ID} || '.html' END AS url, title || ' }};{{" & ]' AS title, amount AS price, area AS area_m2, CASE WHEN kind = 'house' THEN plot_area_m2 END AS plot_area_m2,
  CASE WHEN listed AND linked THEN CAST(100 AS DOUBLE) ELSE {_CENTS("amount / area_m2")} END AS price_per_m2, CASE WHEN kind = 'house' THEN CAST(listing_id % 6 AS INT) END AS rooms, CASE WHEN kind = 'plot' THEN 'budowlana' END AS plot_type,
  lat, lon, {_AT}, city, district, is_private, 'no:' || trim(advertiser_id) AS advertiser_id, CASE WHEN listed AND linked THEN 'Opis' END AS description_excerpt,
  strftime({_WARSAW("make_timestamp(year(observed_at), 3, day(observed_at), 0, 0, 0)")}, '%Y-%m-%d %H:%M:%S') AS source_created_at FROM u WHERE linked
UNION ALL SELECT source, kind, NULL, NULL, title || ' }};{{" & ]', amount, area_m2, CASE WHEN kind = 'house' THEN plot_area_m2 END, {_CENTS("amount / area_m2")}, CASE WHEN kind = 'house' THEN CAST(listing_id % 6 AS INT) END, CASE WHEN kind = 'plot' THEN 'budowlana' END,
  lat, lon, {_AT}, city, district, is_private, 'no:' || trim(advertiser_id), NULL, strftime({_WARSAW("make_timestamp(year(observed_at), 3, day(observed_at), 0, 0, 0)")}, '%Y-%m-%d %H:%M:%S') FROM u WHERE NOT linked""")
def extract_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a script's object whose strings hold brackets; offers at their side by the id of their link."""
    rows = portals.tiles(_landed(spark, d, landing.tile_maps))
    return _text("source_created_at", rows.select(
        "source", "kind", "source_id", "url", "title", "price", "area_m2", "plot_area_m2", "price_per_m2", "rooms", "plot_type", "lat", "lon", "location_precision", "location_radius_km", "city", "district", "is_private", "advertiser_id", "description_excerpt", "source_created_at"))


@query(f"""WITH {CUR_SQL}, n AS (SELECT *, listing_id % 19 <> 0 AS linked, 1 AS copy FROM cur UNION ALL SELECT * REPLACE (1 AS price), FALSE, 2 FROM cur WHERE listing_id % 4 = 0 AND listing_id % 19 = 0)
SELECT source, kind, CASE WHEN linked THEN 'f' || {_ID} END AS source_id, CASE WHEN linked THEN {_ORIGIN} || '/nieruchomosci/ob/' || {_ID} END AS url, title,
  CASE WHEN price > 0 THEN price END AS price, area_m2, {_CENTS("price / area_m2")} AS price_per_m2, CASE WHEN kind = 'house' THEN CAST(listing_id % 6 AS INT) END AS rooms, city, 'D' || CAST(listing_id % 9 AS VARCHAR) AS district, advertiser_name, is_private,
  CASE WHEN is_private IS NOT NULL THEN 'mg-agency:' || CAST(listing_id % 1000 AS VARCHAR) END AS advertiser_id, 'mg:' || {_ID} AS keys, listing_id % 8 = 0 AS promoted,
  strftime({_WARSAW("date_trunc('day', observed_at)")}, '%Y-%m-%d %H:%M:%S') AS source_created_at, strftime({_WARSAW("CASE WHEN listing_id % 3 = 0 THEN last_seen_at ELSE date_trunc('day', observed_at) END")}, '%Y-%m-%d %H:%M:%S') AS source_refreshed_at FROM n""")
def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes under a key that ends in the request's path; the first of each id stays, nodes without a link are errors."""
    rows = portals.nodes(_landed(spark, d, landing.node_lists))
    keys = text.identity_keys(F.col("attributes")["internalId"], F.col("attributes")["externalId"], F.col("attributes")["offerNumber"])
    rows = rows.select(
        "source", "kind", "source_id", "url", "title", "price", "area_m2", "price_per_m2", "rooms", "city", "district", "advertiser_name", "is_private", "advertiser_id", F.array_join(keys, ",").alias("keys"),
        (F.col("attributes")["promoted"] == "true").alias("promoted"), "source_created_at", "source_refreshed_at")
    return _text("source_created_at", _text("source_refreshed_at", rows))


_GONE = "listing_id % 11 = 0 OR listing_id % 14 = 0"


@query(f"""WITH {CUR_SQL}, a AS (SELECT *, listing_id % 14 <> 0 AS held, CAST(CASE WHEN listing_id % 3 = 0 THEN 1500 ELSE CAST(area_m2 AS BIGINT) END AS DOUBLE) AS plot FROM cur)
SELECT source, kind, CASE WHEN held THEN 'f' || {_ID} END AS source_id, {_GONE} AS is_gone, CASE WHEN held THEN lat END AS lat, CASE WHEN held THEN lon END AS lon, CASE WHEN held AND lat IS NOT NULL THEN 'approx' ELSE 'unknown' END AS location_precision,
  CASE WHEN held AND lat IS NOT NULL THEN CASE WHEN listing_id % 5 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END END AS location_radius_km, CASE WHEN held THEN plot END AS plot_area_m2, CASE WHEN held THEN 'budowlana' END AS plot_type,
  CASE WHEN held THEN strftime({_WARSAW("date_trunc('day', observed_at)")}, '%Y-%m-%d %H:%M:%S') END AS added_at, CASE WHEN held THEN 'Opis ad & x' END AS description_excerpt,
  CASE WHEN held THEN 'Data dodania=' || strftime(observed_at, '%d.%m.%Y') || ',Media=' || city || ',Pow. działki=' || CASE WHEN listing_id % 3 = 0 THEN '0,15' ELSE CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) END || ' m²,Typ działki=Budowlana' ELSE '' END AS details FROM a""")
def detail_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ad bodies of the node portals: three label lists as one map, the later ones first, and plots typed in hectares."""
    ads = portals.node_ads(_landed(spark, d, landing.node_bodies))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.concat_ws("=", x.key, x.value)), ",")
    return _text("added_at", ads.select("source", "kind", "source_id", "is_gone", "lat", "lon", "location_precision", "location_radius_km", "plot_area_m2", "plot_type", "added_at", "description_excerpt", F.coalesce(pairs, F.lit("")).alias("details")))


@query(f"""WITH {CUR_SQL}, c AS (SELECT *, listing_id % 2 = 0 AND price IS NOT NULL AS listed FROM cur WHERE listing_id % 13 <> 0)
SELECT source, kind, {_ID} AS source_id, CASE WHEN listed THEN 'https://www.domiporta.pl/x/' || {_ID} ELSE {_ORIGIN} || '/nieruchomosci/x/' || {_ID} END AS url, title,
  CASE WHEN listed THEN price - price // 10 ELSE price END AS price, area_m2, CASE WHEN kind = 'house' THEN plot_area_m2 END AS plot_area_m2, CAST(listing_id % 6 AS INT) AS rooms, CASE WHEN listed THEN city END AS city,
  CASE WHEN listed THEN coalesce(is_private, FALSE) END AS is_private, CASE WHEN listed THEN 'domiporta:' || lower(advertiser_name) END AS advertiser_id FROM c""")
def extract_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a page joined with its list in JSON-LD."""
    rows = portals.listed_cards(_landed(spark, d, landing.cards))
    return rows.select("source", "kind", "source_id", "url", "title", "price", "area_m2", "plot_area_m2", "rooms", "city", "is_private", "advertiser_id")


@query(f"""WITH {CUR_SQL} SELECT source, kind, {_ID} AS source_id, {_ORIGIN} || '/o/x-' || {_ID} AS url, title, price, area_m2, {_CENTS("price / area_m2")} AS price_per_m2,
  CASE WHEN kind = 'house' THEN CAST(listing_id % 6 AS INT) END AS rooms, city, is_private, {_ID} AS code FROM cur""")
def extract_labelled_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the results' list whose bold values are told apart by their units."""
    rows = portals.labelled_cards(_landed(spark, d, landing.offer_cards)).withColumn("code", F.col("attributes")["publicCode"])
    return rows.select("source", "kind", "source_id", "url", "title", "price", "area_m2", "price_per_m2", "rooms", "city", "is_private", "code")


@query(f"""WITH {CUR_SQL}, a AS (SELECT *, listing_id % 11 <> 0 AS held FROM cur)
SELECT source, kind, CASE WHEN held THEN {_ID} END AS source_id, NOT held AS is_gone, CASE WHEN held THEN lat END AS lat, CASE WHEN held THEN lon END AS lon, CASE WHEN held THEN area_m2 END AS area_m2,
  CASE WHEN held THEN CASE WHEN listing_id % 2 = 0 THEN 'rolna' ELSE 'budowlana' END END AS plot_type, CASE WHEN held THEN is_private END AS is_private,
  CASE WHEN held THEN 'Media=prąd & gaz,Rodzaj działki=' || CASE WHEN listing_id % 2 = 0 THEN 'Rolna' ELSE 'Budowlana' END || CASE WHEN is_private THEN ',advertiserType=prywatny' WHEN NOT is_private THEN ',advertiserType=agencja' ELSE '' END ELSE '' END AS details FROM a""")
def extract_card_ads(spark: SparkSession, d: str) -> DataFrame:
    """Ad pages of the card portal: place from JSON-LD or meta tags, features from the page's list."""
    ads = portals.listed_card_ads(_landed(spark, d, landing.card_ads))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.concat_ws("=", x.key, x.value)), ",")
    return ads.select("source", "kind", "source_id", "is_gone", "lat", "lon", "area_m2", "plot_type", "is_private", pairs.alias("details"))


@query(f"""WITH {CUR_SQL}, a AS (SELECT *, listing_id % 11 <> 0 AS held FROM cur)
SELECT source, kind, CASE WHEN held THEN {_ID} END AS source_id, NOT held AS is_gone, CASE WHEN held THEN lat END AS lat, CASE WHEN held THEN lon END AS lon,
  CASE WHEN NOT held OR lat IS NULL THEN 'unknown' WHEN location_radius_km = 0 THEN 'exact' ELSE 'approx' END AS location_precision, CASE WHEN held AND lat IS NOT NULL THEN location_radius_km END AS location_radius_km,
  CASE WHEN held AND kind = 'house' THEN plot_area_m2 END AS plot_area_m2, CASE WHEN held THEN 'budowlana' END AS plot_type, CASE WHEN held THEN 'małopolskie' END AS region, held AND listing_id % 4 = 0 AS price_negotiable, CASE WHEN held THEN is_private END AS is_private,
  CASE WHEN held AND is_private THEN 1 WHEN held AND NOT is_private THEN CAST(listing_id % 5 + 2 AS INT) END AS added_days_ago, CASE WHEN held THEN 'Numer=' || {_ID} || ',Rodzaj działki=Budowlana,gmina=G' ELSE '' END AS details FROM a""")
def extract_labelled_ads(spark: SparkSession, d: str) -> DataFrame:
    """Ad pages of the labelled portal: the script's place and circle, list items of a label and a value."""
    ads = portals.labelled_card_ads(_landed(spark, d, landing.offer_card_ads))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda x: F.concat_ws("=", x.key, x.value)), ",")
    return ads.select("source", "kind", "source_id", "is_gone", "lat", "lon", "location_precision", "location_radius_km", "plot_area_m2", "plot_type", "region", "price_negotiable", "is_private", "added_days_ago", pairs.alias("details"))


@query(f"WITH {CUR_SQL} SELECT source, kind, count(DISTINCT CAST(source_id AS BIGINT) // 50) AS nodes, count(*) FILTER (WHERE listing_id % 2 = 0 AND price IS NOT NULL) AS offers FROM cur GROUP BY 1, 2")
def json_ld_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed JSON-LD blocks and the offers they list; a malformed block stands beside each."""
    nodes = extract.json_ld(_landed(spark, d, landing.cards))
    listed = F.size(F.from_json(F.col("node")["itemListElement"], f"array<{extract.LD}>"))
    return nodes.groupBy("source", "kind").agg(F.count("*").alias("nodes"), F.sum(listed).alias("offers"))


_KEPT = "NOT (source = 'nieruchomosci_online' AND (listing_id % 9 = 0 OR listing_id % 11 = 0)) AND NOT (source = 'domiporta' AND listing_id % 13 = 0)"
_UNREAD = "(source = 'nieruchomosci_online' AND listing_id % 17 = 0) OR (source IN ('gratka', 'morizon') AND listing_id % 19 = 0)"


@query(f"""WITH {CUR_SQL}, n AS (SELECT *, {_UNREAD} AS bad FROM cur WHERE {_KEPT} UNION ALL SELECT *, TRUE FROM cur WHERE source IN ('gratka', 'morizon') AND listing_id % 76 = 0)
SELECT source, count(*) AS items, count(*) FILTER (WHERE bad) AS errors, CAST(sum(area_m2 + CASE WHEN source = 'nieruchomosci_online' AND listing_id % 5 <> 0 AND NOT bad THEN 1 ELSE 0 END) AS BIGINT) AS area FROM n GROUP BY source""")
def normalised_listings(spark: SparkSession, d: str) -> DataFrame:
    """All sources' bodies, each in its own form, through the adapter registry into one schema."""
    rows = staged(adapters.normalise(staged(_all_pages(spark, d))))
    area = rows.groupBy("source").agg(F.sum("area_m2").cast("long").alias("area"))
    return stats.parse_quality(rows).join(area, "source")


def _all_pages(spark: SparkSession, d: str) -> DataFrame:
    cur, pages = current(spark, d), None
    for source, form in landing.LANDED.items():
        landed = form(cur.where(F.col("source") == source))
        pages = landed if pages is None else pages.unionByName(landed)
    return pages


_PER_PAGE = "CASE source WHEN 'nieruchomosci_online' THEN 41 WHEN 'domiporta' THEN 36 WHEN 'gratka' THEN 35 WHEN 'morizon' THEN 35 END"


@query(f"""WITH {CUR_SQL}, n AS (SELECT source, kind, CAST(source_id AS BIGINT) // 50 + 1 AS page, {_KEPT} AS kept, {_UNREAD} AS bad, source IN ('gratka', 'morizon') AND listing_id % 76 = 0 AS again FROM cur),
p AS (SELECT source, kind, page, CASE WHEN source NOT IN ('olx', 'otodom') THEN count(*) END AS total, count(*) FILTER (WHERE kept) + count(*) FILTER (WHERE again) AS items, count(*) FILTER (WHERE kept AND bad) + count(*) FILTER (WHERE again) AS errors FROM n GROUP BY 1, 2, 3),
t AS (SELECT *, CAST(greatest(1, CAST(ceil(total / {_PER_PAGE}) AS BIGINT)) AS INT) AS pages FROM p)
SELECT source, kind, CAST(page AS INT) AS page, total, CASE WHEN total IS NOT NULL AND {_PER_PAGE} IS NOT NULL THEN pages END AS total_pages, CASE WHEN source = 'adresowo' THEN '/l2' END AS next, source = 'adresowo' OR coalesce(page < CASE WHEN {_PER_PAGE} IS NOT NULL THEN pages END, FALSE) AS has_more, items, errors FROM t""")
def list_extents(spark: SparkSession, d: str) -> DataFrame:
    """What each landed list page says of its list, its items and how many of them can't be read."""
    path = scratch(spark, "landed")
    landed.land(_all_pages(spark, d).withColumns({"location": F.lit("l"), "fetched_at": F.lit("2024-01-01").cast("timestamp_ntz")}), path)
    pages, where = landed.read(spark, path), ["source", "kind", "location", "page"]
    counts = adapters.normalise(pages).groupBy(*where).agg(F.count("*").alias("items"), F.count_if(F.col("source_id").isNull()).alias("errors"))
    told = adapters.extents(pages).join(counts, where, "left").na.fill(0, ["items", "errors"])
    return told.select("source", "kind", "page", "total", "total_pages", "next", "has_more", "items", "errors")


_TAKEN = ("gratka", "morizon", "adresowo")


@query(f"""WITH {CUR_SQL}, b AS (SELECT *, listing_id % 2 = 0 AS two, listing_id % 5 = 0 AS three, price + CASE WHEN listing_id % 2 = 0 AND listing_id % 3 = 0 THEN 1000 ELSE 0 END AS later FROM cur WHERE source IN {_TAKEN} AND NOT ({_UNREAD}))
SELECT source, CASE WHEN source = 'adresowo' THEN {_ID} ELSE 'f' || {_ID} END AS source_id, kind, title, CASE WHEN three AND listing_id % 10 = 5 THEN NULL ELSE later END AS price, area_m2, '2024-01-01' AS first_seen, CASE WHEN three THEN '2024-01-03' WHEN two THEN '2024-01-02' ELSE '2024-01-01' END AS last_seen,
  CASE WHEN price IS NULL THEN 0 WHEN two AND listing_id % 3 = 0 THEN 2 ELSE 1 END AS history_rows FROM b""")
def landed_intake(spark: SparkSession, d: str) -> DataFrame:
    """Pages that land day by day, taken in by a stream that starts anew each day: the stored listings and their prices."""
    path, intake, last = scratch(spark, "landed"), PageIntake(scratch(spark, "intake")), -1
    k = F.col("listing_id")
    cur = staged(current(spark, d).where(F.col("source").isin(*_TAKEN)))
    later = cur.withColumn("price", F.col("price") + F.when((k % 2 == 0) & (k % 3 == 0), 1000).otherwise(0))
    days = [cur, later.where(k % 2 == 0), later.where(k % 5 == 0).withColumn("price", F.when(k % 10 != 5, F.col("price")))]
    for n, rows in enumerate(days):
        for source in _TAKEN:
            pages = landing.LANDED[source](rows.where(F.col("source") == source))
            landed.land(pages.withColumns({"location": F.lit("l"), "fetched_at": F.lit(f"2024-01-0{n + 1}").cast("timestamp_ntz")}), path)
        last = max(last, run_pages(spark, path, intake))
    counts = intake.history(spark).groupBy("listing_id").agg(F.count("*").alias("history_rows"))
    rows = intake.listings(spark, last).join(counts, "listing_id", "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("source", "source_id", "kind", "title", "price", "area_m2", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), F.coalesce("history_rows", F.lit(0)).alias("history_rows"))


_SHAPES = """p AS (SELECT s_nationkey AS n, s_suppkey, CAST(50 AS DOUBLE) + (s_suppkey % 17) * CAST(0.01 AS DOUBLE) AS lat, CAST(20 AS DOUBLE) + (s_suppkey % 23) * CAST(0.01 AS DOUBLE) AS lon FROM supplier)"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """A feature a nation, with its suppliers' places as points."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    at = F.struct("s_suppkey", F.array(F.lit(20.0) + (F.col("s_suppkey") % 23) * F.lit(0.01), F.lit(50.0) + (F.col("s_suppkey") % 17) * F.lit(0.01)).alias("xy"))
    return s.groupBy(F.col("s_nationkey").alias("n")).agg(F.transform(F.sort_array(F.collect_list(at)), lambda x: x.xy).alias("points"))


@query(f"""WITH {_SHAPES}, k AS (SELECT *, count(*) OVER (PARTITION BY n) AS m, row_number() OVER (PARTITION BY n ORDER BY s_suppkey) - 1 AS i FROM p),
q AS (SELECT *, CASE WHEN n % 2 = 0 THEN 0 WHEN i < m // 2 THEN 0 ELSE 1 END AS part FROM k),
s AS (SELECT n, part, row_number() OVER w - 1 AS seg_no, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM q WINDOW w AS (PARTITION BY n, part ORDER BY i))
SELECT 'N' || CAST(n AS VARCHAR) AS road, CAST(part AS INT) AS part, CAST(seg_no AS INT) AS seg_no, a_lat, a_lon, b_lat, b_lon FROM s WHERE b_lat IS NOT NULL""")
def polyline_load(spark: SparkSession, d: str) -> DataFrame:
    """Axis features, LineString and MultiLineString, written as GeoJSON and loaded as segments."""
    half = F.floor(F.size("points") / 2).cast("int")
    rows = _shapes(spark, d).withColumn("road", F.concat(F.lit("N"), F.col("n").cast("string")))
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("road").alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates")).alias("geometry")))
    parts = F.array(F.slice("points", F.lit(1), half), F.slice("points", half + 1, F.size("points") - half))
    many = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("road").alias("properties"), F.struct(F.lit("MultiLineString").alias("type"), parts.alias("coordinates")).alias("geometry")))
    path = scratch(spark, "lines")
    rows.select(F.when(F.col("n") % 2 == 0, one).otherwise(many)).write.text(path)
    return sinks.load_lines(spark, path).select("road", "part", "seg_no", "a_lat", "a_lon", "b_lat", "b_lon")


@query(f"""WITH {_SHAPES}, k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY n) AS m FROM p),
e AS (SELECT a.n, a.i, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon FROM k a JOIN k b ON a.n = b.n AND b.i = (a.i + 1) % a.m WHERE a.m >= 3),
c AS (SELECT n, min(lat) AS s, max(lat) AS t, min(lon) AS w, max(lon) AS x FROM k GROUP BY n)
SELECT 'T' || CAST(e.n AS VARCHAR) AS terc, CAST(0 AS INT) AS ring, CAST(i AS INT) AS edge, a_lat, a_lon, b_lat, b_lon, (s + t) / 2 AS c_lat, (w + x) / 2 AS c_lon FROM e JOIN c USING (n)""")
def polygon_load(spark: SparkSession, d: str) -> DataFrame:
    """Administrative units with a box, a centre and rings as JSON lines, loaded as an edge table."""
    ring = F.transform("points", lambda x: F.array(x[1], x[0]))
    lat, lon = F.transform("points", lambda x: x[1]), F.transform("points", lambda x: x[0])
    middle = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    path = scratch(spark, "units")
    unit = F.struct(F.concat(F.lit("T"), F.col("n").cast("string")).alias("terc"), F.lit("unit").alias("name"), F.array(middle(lat), middle(lon)).alias("centre"), F.array(ring).alias("rings"))
    _shapes(spark, d).select(F.to_json(unit)).write.text(path)
    return sinks.load_units(spark, path).select("terc", "ring", "edge", "a_lat", "a_lon", "b_lat", "b_lon", "c_lat", "c_lon")


@query(f"""WITH {CUR_SQL} SELECT {_ID} || ';' || source || ';' || kind || ';' || CASE WHEN listing_id % 4 = 0 THEN '"' || title || '; ""x""' || '"' ELSE title END || ';' || coalesce(CAST(price AS VARCHAR), '') || ';' || CASE WHEN is_private THEN 'tak' WHEN NOT is_private THEN 'nie' ELSE '' END
  || ';' || strftime(coalesce(CASE WHEN listing_id % 2 = 0 THEN observed_at END, first_seen_at), '%Y-%m-%d') AS line FROM cur""")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """The table's export, written as CSV and read back as lines, without the heading."""
    rows = current(spark, d).withColumn("title", F.when(F.col("listing_id") % 4 == 0, F.concat("title", F.lit('; "x"'))).otherwise(F.col("title"))).withColumn("source_created_at", F.when(F.col("listing_id") % 2 == 0, F.col("observed_at")))
    path = scratch(spark, "csv")
    sinks.write_csv(rows, path, ["listing_id", "source", "kind", "title", "price", "is_private", "created"])
    return spark.read.text(path).select(F.col("value").alias("line")).where("line not like 'listing_id;%'")


@query(f"""WITH {CUR_SQL} SELECT listing_id, '{{"id":' || {_ID} || ',"source":"' || source || '","kind":"' || kind || '",' || CASE WHEN price IS NULL THEN '' ELSE '"price":' || CAST(price AS VARCHAR) || ',' END
  || '"firstSeenAt":"' || strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') || '","lastSeenAt":"' || strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S') || '","seller":{{"name":"' || advertiser_name || '"' || CASE WHEN is_private IS NULL THEN '' ELSE ',"private":' || CAST(is_private AS VARCHAR) END || '}}}}' AS dto FROM cur""")
def listing_dto(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select("listing_id", sinks.listing_json().alias("dto"))


@query(f"WITH {CUR_SQL}, c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY listing_id) AS k FROM cur) SELECT source, count(*) AS rows FROM c GROUP BY source")
def append_history(spark: SparkSession, d: str) -> DataFrame:
    """The append-only history written source by source, as runs do, and read as one table."""
    path, cur = scratch(spark, "history"), staged(current(spark, d).select("listing_id", "source", "price", "observed_at"))
    for source in SOURCES:
        sinks.append(cur.where(F.col("source") == source), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("rows"))
