"""Filters, orders, labels, areas, links, re-resolution, manual changes and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.functions import geo, text
from parcelflow.operators import alerts, blocking, cdc, resolve, spatial, table
from parcelflow.plans.resolution_queries import _ALERT_NOW, _NEW, _golden, _matches, _new, _stored
from parcelflow.plans.resolution_queries import CLUSTERS_SQL, GOLDEN_SQL, PAIRS_SQL
from parcelflow.plans.space_queries import _DIST
from parcelflow.sources import sinks
from parcelflow.sources.fixtures import CENTRE, CUR_SQL, NOW, SEGMENTS_SQL, current, segments
from parcelflow.sources.shared import scratch, staged

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_PROPS = """props AS (SELECT CAST(source_id AS BIGINT) AS property_id, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, bool_or(is_private) AS is_private, max(last_seen_at) >= TIMESTAMP '1997-01-01' AS is_active,
  CAST(source_id AS BIGINT) % 5 = 0 AS hidden, CAST(source_id AS BIGINT) % 7 = 0 AS ignored, CAST(source_id AS BIGINT) % 3 = 0 AS favorite, min(price) AS price, max(area_m2) AS area_m2, min(first_seen_at) AS first_seen_at FROM cur GROUP BY source_id)"""


def _properties(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).groupBy(F.col("source_id").cast("long").alias("property_id")).agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.max("is_private").alias("is_private"), (F.max("last_seen_at") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("is_active"),
        F.min("price").alias("price"), F.max("area_m2").alias("area_m2"), F.min("first_seen_at").alias("first_seen_at"))
    flag = lambda k: F.col("property_id") % k == 0
    return rows.withColumns({"hidden": flag(5), "ignored": flag(7), "favorite": flag(3)})


_MODES = {
    "owners": (dict(owner="private", hidden="exclude"), "is_private AND NOT hidden"),
    "agencies": (dict(owner="agency", ignored="only"), "is_private = FALSE AND ignored"),
    "marked": (dict(favorites="only", active="only", hidden="only"), "favorite AND is_active AND hidden"),
    "two_sources": (dict(sources=("olx", "gratka"), ignored="exclude"), "(contains(sources, 'olx') OR contains(sources, 'gratka')) AND NOT ignored"),
    "everything": (dict(sources=()), "TRUE"),
}


@query(f"WITH {CUR_SQL}, {_PROPS} " + " UNION ALL ".join(f"SELECT '{name}' AS filter, property_id, sources FROM props WHERE {sql}" for name, (_, sql) in _MODES.items()))
def property_filters(spark: SparkSession, d: str) -> DataFrame:
    """Array overlap on sources, tri-state flags, favourites, active, and the owner filter, one set of bounds after another."""
    rows, out = staged(_properties(spark, d)), None
    for name, (bounds, _) in _MODES.items():
        kept = rows.where(table.predicate(table.Filters(**bounds), CENTRE, NOW, sources_column="sources")).select(F.lit(name).alias("filter"), "property_id", F.array_join("sources", "+").alias("sources"))
        out = kept if out is None else out.unionByName(kept)
    return out


_KEYS = ("price", "area_m2", "plot_area_m2", "first_seen_at", "last_seen_at", "title", "city", "district", "source", "kind", "advertiser_name")
_OFFERS = """o AS (SELECT *, listing_id % 17 = 0 AS ignored, last_seen_at >= TIMESTAMP '1996-06-01' AS is_active FROM cur),
f AS (SELECT * FROM o WHERE (contains(lower(title), 'd3') OR contains(lower(city), 'd3') OR contains(lower(district), 'd3') OR source_id = 'd3') AND is_active AND NOT ignored AND price <= 400000)"""


@query(f"WITH {CUR_SQL}, {_OFFERS} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{key} {way}' AS sort, row_number() OVER (ORDER BY {key} {way} NULLS LAST, listing_id DESC) AS place, listing_id FROM f) WHERE place BETWEEN 6 AND 25" for key in _KEYS for way in ("ASC", "DESC")))
def offers_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty by each of the table's keys, both ways, of the filtered offers."""
    rows = current(spark, d).withColumn("ignored", F.col("listing_id") % 17 == 0).withColumn("is_active", F.col("last_seen_at") >= F.lit("1996-06-01").cast("timestamp_ntz"))
    rows = staged(rows.where(table.matches("d3") & F.col("is_active") & ~F.col("ignored") & (F.col("price") <= 400000)).select("listing_id", *_KEYS))
    out = None
    for key in _KEYS:
        for falling in (False, True):
            page = table.page(rows, key, falling, 5, 20)
            order = F.col(key).desc_nulls_last() if falling else F.col(key).asc_nulls_last()
            place = F.row_number().over(Window.partitionBy("sort").orderBy(order, F.desc("listing_id"))) + 5  # a page of twenty rows
            page = page.withColumn("sort", F.lit(f"{key} {'DESC' if falling else 'ASC'}")).select("sort", place.cast("long").alias("place"), "listing_id")
            out = page if out is None else out.unionByName(page)
    return out


_KM = f"round({geo.cosine_sql(*CENTRE)}, 6)"
_VIEW_SQL = {"price_up": "price ASC", "price_down": "price DESC", "area_down": "area_m2 DESC", "price_per_m2_up": "price_per_m2 ASC", "distance_up": "km ASC", "newest": "first_seen_at DESC"}


@query(f"WITH {CUR_SQL}, v AS (SELECT *, floor(price/area_m2*100+0.5)/100 AS price_per_m2, CASE WHEN lat IS NOT NULL THEN {_KM} END AS km FROM cur) " + " UNION ALL ".join(
    f"(SELECT '{name}' AS view, listing_id FROM v ORDER BY {order} NULLS LAST, first_seen_at DESC, listing_id DESC LIMIT 30)" for name, order in _VIEW_SQL.items())
    + " UNION ALL (SELECT 'active_first', listing_id FROM v ORDER BY last_seen_at >= TIMESTAMP '1998-10-01' DESC, last_seen_at DESC, listing_id DESC LIMIT 30)")
def view_orders(spark: SparkSession, d: str) -> DataFrame:
    """The six orders of the list, and active listings first: the top thirty of each."""
    km = F.when(F.col("lat").isNotNull(), F.round(geo.cosine_km(*CENTRE, F.col("lat"), F.col("lon")), 6))
    rows = current(spark, d).withColumns({"price_per_m2": geo.round2(F.col("price") / F.col("area_m2")), "km": km, "is_active": F.col("last_seen_at") >= F.lit("1998-10-01").cast("timestamp_ntz")})
    rows, out = staged(rows), None
    for name in table.VIEWS:
        top = table.view(rows, name, 30).select(F.lit(name).alias("view"), "listing_id")
        out = top if out is None else out.unionByName(top)
    return out.unionByName(table.active_first(rows, 30).select(F.lit("active_first").alias("view"), "listing_id"))


@query("""(SELECT 'runs' AS list, event_id FROM events ORDER BY event_id DESC LIMIT 20) UNION ALL (SELECT 'jobs', event_id FROM events ORDER BY user_id % 3, event_id LIMIT 200)""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("priority", F.col("user_id") % 3)
    return table.latest(events, 20).select(F.lit("runs").alias("list"), "event_id").unionByName(table.latest(events, 200, "priority").select(F.lit("jobs").alias("list"), "event_id"))


_CLOSE = PAIRS_SQL[: PAIRS_SQL.index("slim AS (")] + f"""act AS (SELECT *, CAST(floor(lat / 0.02) AS INT) AS y FROM cur WHERE lat IS NOT NULL),
sus AS (SELECT a.listing_id AS a_id, b.listing_id AS b_id, {geo.HAVERSINE_SQL.format(a='a.', b='b.')} AS km FROM act a JOIN (SELECT *, unnest([y - 1, y, y + 1]) AS yy FROM act) b ON a.kind = b.kind AND a.y = b.yy AND a.source <> b.source AND a.listing_id < b.listing_id
  AND a.listing_id // 10 <> b.listing_id // 10 AND abs(a.price - b.price) <= CAST(0.1 AS DOUBLE) * greatest(a.price, b.price) AND abs(a.area_m2 - b.area_m2) <= CAST(0.1 AS DOUBLE) * greatest(a.area_m2, b.area_m2) AND abs(a.lon - b.lon) <= 0.05)"""


@query(f"WITH {_CLOSE} SELECT a_id, b_id, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS metres FROM sus WHERE km <= 2 ORDER BY floor(km * 1000 + 0.5), a_id, b_id LIMIT 100")
def closest_suspects(spark: SparkSession, d: str) -> DataFrame:
    cur = current(spark, d).withColumn("property_id", F.floor(F.col("listing_id") / 10))
    metres = F.floor(F.col("dist_km") * 1000 + 0.5)
    return blocking.closest(blocking.suspects(cur).withColumn("dist_km", metres), 100).select("a_id", "b_id", F.col("dist_km").alias("metres"))


@query(f"""WITH {_CLOSE}, both_ AS (SELECT a_id AS probe, b_id AS candidate FROM sus WHERE km <= 2 UNION ALL SELECT b_id, a_id FROM sus WHERE km <= 2)
SELECT probe, candidate FROM both_ QUALIFY row_number() OVER (PARTITION BY probe ORDER BY candidate) <= 3""")
def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The report's cap of candidates a probe."""
    return blocking.capped_suspects(current(spark, d).withColumn("property_id", F.floor(F.col("listing_id") / 10)), 3)


@query(f"WITH {CUR_SQL}, {SEGMENTS_SQL}{_DIST} SELECT listing_id, string_agg(variant || ':' || road, ',' ORDER BY metres, variant) AS routes FROM near GROUP BY listing_id")
def nearest_routes(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest_first(spatial.nearest_lines(current(spark, d), segments(spark)))
    return near.select("listing_id", F.array_join(F.transform("routes", lambda x: F.concat_ws(":", x.variant, x.road)), ",").alias("routes"))


_BOXES = """b AS (SELECT city, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM cur WHERE lat IS NOT NULL GROUP BY city),
c AS (SELECT *, floor((s + n) / 2 * 100000 + 0.5) / 100000 AS lat, floor((w + e) / 2 * 100000 + 0.5) / 100000 AS lon FROM b),
k AS (SELECT *, greatest(CAST(0.2 AS DOUBLE), cos(radians(lat))) AS f FROM c)"""
_HAV4 = "2*6371.0*asin(least(1.0, sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))"


@query(f"""WITH {CUR_SQL}, {_BOXES} SELECT city, lat, lon, CAST(greatest(1, ceil({_HAV4.format(a='lat', b='lon', c='n', d='e')})) AS INT) AS radius_km,
  round({_HAV4.format(a='lat', b='w', c='lat', d='e')}, 6) AS width_km, round({_HAV4.format(a='s', b='lon', c='n', d='lon')}, 6) AS height_km,
  floor((lat - 15/CAST(111.32 AS DOUBLE)) * 100000 + 0.5) / 100000 AS around_south, floor((lon + 15/(CAST(111.32 AS DOUBLE)*f)) * 100000 + 0.5) / 100000 AS around_east,
  round(s - 3/CAST(111.32 AS DOUBLE), 9) AS wide_south, round(e + 3/(CAST(111.32 AS DOUBLE)*f), 9) AS wide_east,
  coalesce(list_min(list_filter([5, 10, 15, 25, 50], lambda v: v >= greatest(1, ceil({_HAV4.format(a='lat', b='lon', c='n', d='e')})))), 50) AS allowed_km FROM k""")
def area_measures(spark: SparkSession, d: str) -> DataFrame:
    """Centre, covering radius, size, square around, margin, and the allowed radius above, of each town's rectangle."""
    box = current(spark, d).where("lat is not null").groupBy("city").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    area = [F.col(c) for c in ("s", "w", "n", "e")]
    lat, lon = geo.centre(*area)
    width, height = geo.size_km(*area)
    around, wide, radius = geo.around(lat, lon, F.lit(15.0)), geo.expand(*area, F.lit(3.0)), geo.covering_radius_km(*area)
    return box.select(
        "city", lat.alias("lat"), lon.alias("lon"), radius.alias("radius_km"), F.round(width, 6).alias("width_km"), F.round(height, 6).alias("height_km"), around[0].alias("around_south"), around[3].alias("around_east"),
        F.round(wide[0], 9).alias("wide_south"), F.round(wide[3], 9).alias("wide_east"), geo.snap_up(radius, [5, 10, 15, 25, 50]).alias("allowed_km"))


@query(f"""WITH {CUR_SQL}, x AS (SELECT *, CAST(CAST(source_id AS BIGINT) % 17 * 2 + 2 AS VARCHAR) AS r, coalesce(district, '') AS dd FROM cur)
SELECT listing_id, city || CASE WHEN dd = '' THEN '' ELSE '/' || dd END AS places, CASE right('0' || r, 2) WHEN '02' THEN 'dolnoslaskie' WHEN '04' THEN 'kujawsko-pomorskie' WHEN '06' THEN 'lubelskie' WHEN '08' THEN 'lubuskie' WHEN '10' THEN 'lodzkie' WHEN '12' THEN 'malopolskie'
  WHEN '14' THEN 'mazowieckie' WHEN '16' THEN 'opolskie' WHEN '18' THEN 'podkarpackie' WHEN '20' THEN 'podlaskie' WHEN '22' THEN 'pomorskie' WHEN '24' THEN 'slaskie' WHEN '26' THEN 'swietokrzyskie' WHEN '28' THEN 'warminsko-mazurskie' WHEN '30' THEN 'wielkopolskie' WHEN '32' THEN 'zachodniopomorskie' ELSE 'malopolskie' END AS region,
  CASE WHEN listing_id % 3 = 0 THEN 'house' WHEN listing_id % 3 = 1 THEN 'plot' ELSE kind END AS kind, CASE WHEN price IS NULL THEN NULL ELSE regexp_replace(CAST(price AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1 \\2') || ' zł' END AS money,
  CASE WHEN length(title) > 20 THEN substring(title, 1, 17) || '…' ELSE title END AS short, CASE WHEN kind = 'plot' AND area_m2 * 20 >= 10000 THEN replace(printf('%.2f', area_m2 * 20 / 10000), '.', ',') || ' ha' ELSE regexp_replace(CAST(CAST(area_m2 * 20 AS BIGINT) AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1 \\2') || ' m²' END AS area,
  '&lt;' || replace(kind, '&', '&amp;') || '&gt;' AS escaped FROM x""")
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    """Locations split, regions by code, kinds by label, amounts, shortened and escaped texts."""
    code = F.lpad((F.col("source_id").cast("long") % 17 * 2 + 2).cast("string"), 2, "0")
    label = F.when(F.col("listing_id") % 3 == 0, "Dom wolnostojący").when(F.col("listing_id") % 3 == 1, "działka rolna").otherwise("inne")
    return current(spark, d).select(
        "listing_id", F.array_join(text.split_location(F.concat("city", F.lit(" ,, "), F.coalesce("district", F.lit("")))), "/").alias("places"), text.region(code).alias("region"), text.kind_of_label(label, F.col("kind")).alias("kind"),
        text.money(F.col("price")).alias("money"), text.shortened(F.col("title"), 20).alias("short"), text.area_text(F.col("area_m2") * 20, F.col("kind")).alias("area"), text.escape_html(F.concat(F.lit("<"), "kind", F.lit(">"))).alias("escaped"))


@query("""WITH e AS (SELECT event_id, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Warsaw') AS h FROM events)
SELECT event_id, h >= 7 AND h < 22 AS by_day, h >= 22 OR h < 6 AS by_night, TRUE AS always FROM e""")
def active_hours(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event lies in the active hours of its zone, by day, past midnight, and with equal ends."""
    ts, events = F.col("ts").cast("timestamp"), spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", text.active_hour(ts, 7, 22).alias("by_day"), text.active_hour(ts, 22, 6).alias("by_night"), text.active_hour(ts, 5, 5).alias("always"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS campaign, coalesce(regexp_matches(url, '^https?://\S+$'), FALSE) AS is_link FROM pages""")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.query_parameter(url, "page").alias("page"), text.query_parameter(url, "utm_source").alias("campaign"), text.https_url(url).alias("is_link"))


@query("""WITH n AS (SELECT DISTINCT s_nationkey, s_suppkey % 17 * 2 + 2 AS r FROM supplier), x AS (SELECT n_name, n_nationkey, CASE r WHEN 2 THEN 'dolnoslaskie' WHEN 4 THEN 'kujawsko-pomorskie' WHEN 6 THEN 'lubelskie' WHEN 8 THEN 'lubuskie' WHEN 10 THEN 'lodzkie' WHEN 12 THEN 'malopolskie' WHEN 14 THEN 'mazowieckie' WHEN 16 THEN 'opolskie'
  WHEN 18 THEN 'podkarpackie' WHEN 20 THEN 'podlaskie' WHEN 22 THEN 'pomorskie' WHEN 24 THEN 'slaskie' WHEN 26 THEN 'swietokrzyskie' WHEN 28 THEN 'warminsko-mazurskie' WHEN 30 THEN 'wielkopolskie' WHEN 32 THEN 'zachodniopomorskie' ELSE 'malopolskie' END AS reg,
  trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation JOIN n ON s_nationkey = n_nationkey)
SELECT DISTINCT n_name, reg || '/' || CASE WHEN n_nationkey % 2 = 0 THEN slug ELSE 'county-' || slug END || '/' || slug AS path FROM x""")
def location_paths(spark: SparkSession, d: str) -> DataFrame:
    """region/county/unit of every nation and its suppliers' codes; every second is its own county."""
    s, n = spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    units = s.select("s_nationkey", F.lpad((F.col("s_suppkey") % 17 * 2 + 2).cast("string"), 2, "0").alias("code")).distinct().join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.col("n_nationkey") % 2 == 0
    county = F.when(own, F.col("n_name")).otherwise(F.concat(F.lit("County "), "n_name"))
    return units.select("n_name", text.location_path(F.col("code"), county, F.col("n_name"), own).alias("path")).distinct()


@query(f"""WITH {CUR_SQL} SELECT listing_id, 'area=' || CASE WHEN listing_id % 2 = 0 THEN 'new' ELSE 'old' END || ',city=' || city || CASE WHEN listing_id % 2 = 0 THEN ',fresh=yes' ELSE '' END AS attributes FROM cur""")
def attribute_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Stored attributes under newly given ones; every second listing is given some."""
    stored = F.create_map(F.lit("area"), F.lit("old"), F.lit("city"), F.col("city"))
    given = F.when(F.col("listing_id") % 2 == 0, F.create_map(F.lit("area"), F.lit("new"), F.lit("fresh"), F.lit("yes")))
    pairs = F.transform(F.array_sort(F.map_entries(cdc.overlay(stored, given))), lambda x: F.concat_ws("=", x.key, x.value))
    return current(spark, d).select("listing_id", F.array_join(pairs, ",").alias("attributes"))


@query(f"""WITH {CUR_SQL}, l AS (SELECT CAST(source_id AS BIGINT) AS property_id, listing_id, source, 'u' || CAST(CAST(price AS BIGINT) % 3 AS VARCHAR) AS url FROM cur WHERE price IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY property_id, url ORDER BY listing_id) AS rn FROM l) SELECT property_id, string_agg(source || ':' || url, ',' ORDER BY listing_id) AS links FROM f WHERE rn = 1 GROUP BY property_id""")
def distinct_links(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).where("price is not null").select(F.col("source_id").cast("long").alias("property_id"), F.struct("listing_id", "source", F.concat(F.lit("u"), (F.col("price") % 3).cast("string")).alias("url")).alias("x"))
    grouped = rows.groupBy("property_id").agg(F.sort_array(F.collect_list("x")).alias("links"))
    return grouped.select("property_id", F.array_join(F.transform(cdc.distinct_links(F.col("links")), lambda x: F.concat_ws(":", x.source, x.url)), ",").alias("links"))


@query(f"WITH {CUR_SQL} SELECT DISTINCT CASE WHEN listing_id % 4 <> 0 THEN CAST(source_id AS BIGINT) END AS property_id FROM cur WHERE price > 150000 AND listing_id % 4 <> 0")
def touched_properties(spark: SparkSession, d: str) -> DataFrame:
    changed = current(spark, d).where("price > 150000").withColumn("property_id", F.when(F.col("listing_id") % 4 != 0, F.col("source_id").cast("long")))
    return cdc.touched(changed)


@query(f"""WITH {CUR_SQL}, w AS (SELECT *, lat IS NULL AND CAST(source_id AS BIGINT) % 20 <> 0 AND source IN ('olx', 'otodom', 'gratka') AS wait FROM cur)
SELECT source, count(*) FILTER (WHERE NOT wait) AS assigned, count(*) FILTER (WHERE wait) AS waiting FROM w GROUP BY source""")
def wait_for_details(spark: SparkSession, d: str) -> DataFrame:
    """Listings to assign now, and those that wait for their ad page, by source."""
    rows = current(spark, d).withColumn("property_id", F.when(F.col("source_id").cast("long") % 20 == 0, F.col("source_id").cast("long")))
    now, later = cdc.waits_for_details(rows, ["olx", "otodom", "gratka"])
    both = now.select("source", F.lit(True).alias("now")).unionByName(later.select("source", F.lit(False).alias("now")))
    return both.groupBy("source").agg(F.count_if("now").alias("assigned"), F.count_if(~F.col("now")).alias("waiting"))


_PASSES = 2
_REASSIGN = "WITH RECURSIVE " + PAIRS_SQL + f""",
part AS MATERIALIZED (SELECT listing_id, CASE listing_id % 5 WHEN 0 THEN listing_id // 70 WHEN 1 THEN NULL ELSE listing_id // 10 END AS before, (listing_id % 13 = 0 AND listing_id % 5 <> 1) OR (lat IS NULL AND city IS NULL) AS still, md5(CAST(listing_id AS VARCHAR)) AS place FROM cur),
base AS (SELECT max(before) + 1 AS b FROM part),
m AS (SELECT a_id, b_id, round(score, 9) AS score FROM decided WHERE matched AND (a_id + b_id) % 9 <> 0),
arcs AS MATERIALIZED (SELECT x.me, x.other, x.score, NOT o.still AND o.place < p.place AS waits FROM (SELECT a_id AS me, b_id AS other, score FROM m UNION ALL SELECT b_id, a_id, score FROM m) x JOIN part p ON p.listing_id = x.me AND NOT p.still JOIN part o ON o.listing_id = x.other),
lv(me, level) AS (SELECT DISTINCT me, 0 FROM arcs UNION SELECT a.me, l.level + 1 FROM arcs a JOIN lv l ON a.other = l.me WHERE a.waits),
levels AS MATERIALIZED (SELECT me, max(level) AS level FROM lv GROUP BY me), top AS MATERIALIZED (SELECT max(level) + 2 AS n FROM levels),
st(step, listing_id, property_id, voted) AS (SELECT 0, listing_id, before, FALSE FROM part UNION ALL
  SELECT s.step + 1, s.listing_id, CASE WHEN p.still THEN s.property_id WHEN s.step % top.n < top.n - 1 THEN coalesce(w.target, CASE WHEN l.level = s.step % top.n AND s.property_id IS NULL THEN base.b + s.listing_id ELSE s.property_id END)
    WHEN s.property_id IS NOT NULL AND (s.voted OR (g.alone AND p.place = g.keeps)) THEN s.property_id ELSE base.b + s.listing_id END,
    CASE WHEN s.step % top.n < top.n - 1 THEN s.voted OR w.target IS NOT NULL ELSE FALSE END
  FROM st s JOIN part p USING (listing_id) CROSS JOIN top CROSS JOIN base LEFT JOIN levels l ON l.me = s.listing_id
  LEFT JOIN (SELECT me, arg_max(target, (n, best, -target)) AS target FROM (SELECT a.me, o.property_id AS target, count(*) AS n, max(a.score) AS best FROM arcs a JOIN levels v ON v.me = a.me JOIN st o ON o.listing_id = a.other CROSS JOIN top t
    WHERE v.level = o.step % t.n AND o.property_id IS NOT NULL GROUP BY 1, 2) GROUP BY me) w ON w.me = s.listing_id
  LEFT JOIN (SELECT o.property_id, bool_and(NOT q.still AND NOT o.voted) AS alone, max(CASE WHEN NOT q.still AND NOT o.voted THEN q.place END) AS keeps FROM st o JOIN part q USING (listing_id) WHERE o.property_id IS NOT NULL GROUP BY 1) g ON g.property_id = s.property_id
  WHERE s.step < {_PASSES} * top.n),
moved AS (SELECT listing_id, before, property_id FROM st JOIN part USING (listing_id) WHERE step = (SELECT max(step) FROM st))"""


@query(_REASSIGN + " SELECT listing_id, before, property_id FROM moved")
def reassigned(spark: SparkSession, d: str) -> DataFrame:
    """Stored assignments, some wrong and some missing, looked at anew by votes; every thirteenth listing is pinned and some pairs are excluded."""
    cur, found = _matches(spark, d)
    k = F.col("listing_id")
    stored = cur.withColumns({"property_id": F.when(k % 5 == 0, F.floor(k / 70)).when(k % 5 != 1, F.floor(k / 10)), "pinned": k % 13 == 0})
    matched = staged(found.select("a_id", "b_id", F.round("score", 9).alias("score")))
    return resolve.reassign(stored, matched, matched.where((F.col("a_id") + F.col("b_id")) % 9 == 0), passes=_PASSES)


@query(_REASSIGN + " SELECT DISTINCT before AS property_id FROM moved WHERE before NOT IN (SELECT property_id FROM moved WHERE property_id IS NOT NULL)")
def emptied_properties(spark: SparkSession, d: str) -> DataFrame:
    moved = staged(reassigned(spark, d))
    return resolve.without_listings(moved.where("before is not null").select(F.col("before").alias("property_id")).distinct(), moved)


def _golden_sql(listings: str) -> str:
    """The golden records of ``listings``, SQL text of a query of listing rows with property_id, is_active, ignored and url."""
    start = GOLDEN_SQL.index("l1 AS (SELECT *, bool_and(ignored)")
    return f"WITH {CUR_SQL}, l AS ({listings}), " + GOLDEN_SQL[start:]


_STORED = "SELECT c.*, listing_id // 10 AS property_id, valid_to >= TIMESTAMP '1997-01-01' AS is_active, listing_id % 17 = 0 AS ignored, 'https://' || source || '/' || source_id AS url FROM cur c"
_PICK = " SELECT property_id, listing_count, price, price_min, price_max, sources, title, city, is_active, ignored FROM golden"


@query(_golden_sql(f"{_STORED} WHERE NOT (listing_id % 6 = 0 OR source_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 19 = 0))") + _PICK)
def incremental_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Listings pruned, their properties made anew, the others kept, those without listings gone; equal to all made anew."""
    stored = staged(_stored(current(spark, d)).withColumn("property_id", F.floor(F.col("listing_id") / 10)))
    before = staged(resolve.golden(stored))
    gone = (F.col("listing_id") % 6 == 0) | (F.col("source_id").cast("long") % 19 == 0)
    after = resolve.recompute(before, stored.where(~gone), cdc.touched(stored.where(gone)))
    return after.withColumn("sources", F.array_join("sources", "+")).select("property_id", "listing_count", "price", "price_min", "price_max", "sources", "title", "city", "is_active", "ignored")


_FLAGS = """p AS (SELECT CAST(p_partkey AS BIGINT) AS property_id, p_size % 3 = 0 AS hidden, p_size % 4 = 0 AS favorite, CASE WHEN p_size % 4 = 0 THEN TIMESTAMP '2024-01-01' + CAST(p_partkey AS INT) * INTERVAL 1 MINUTE END AS favorite_at, CASE WHEN p_partkey % 5 = 1 THEN 'note ' || CAST(p_partkey AS VARCHAR) END AS note FROM part),
m AS (SELECT property_id - property_id % 4 AS target, property_id AS source FROM p WHERE property_id % 4 IN (1, 2) AND property_id > 4)"""


@query(f"""WITH {_FLAGS}, r AS (SELECT coalesce(m.target, p.property_id) AS into_, p.*, m.target IS NOT NULL AS later FROM p LEFT JOIN m ON m.source = p.property_id)
SELECT into_ AS property_id, bool_or(hidden) AS hidden, bool_or(favorite) AS favorite, arg_min(favorite_at, (later, property_id)) FILTER (WHERE favorite_at IS NOT NULL) AS favorite_at, arg_min(note, (later, property_id)) FILTER (WHERE note IS NOT NULL) AS note FROM r GROUP BY into_""")
def merged_flags(spark: SparkSession, d: str) -> DataFrame:
    """Manual merges of two properties into every fourth: flags, time and note."""
    k, size = F.col("p_partkey").cast("long"), F.col("p_size")
    at = F.when(size % 4 == 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("p_partkey").cast("int")))
    rows = spark.read.parquet(f"{d}/part.parquet").select(k.alias("property_id"), (size % 3 == 0).alias("hidden"), (size % 4 == 0).alias("favorite"), at.alias("favorite_at"), F.when(k % 5 == 1, F.concat(F.lit("note "), k.cast("string"))).alias("note"))
    merges = rows.where("property_id % 4 in (1, 2) and property_id > 4").select((F.col("property_id") - F.col("property_id") % 4).alias("target"), F.col("property_id").alias("source"))
    return resolve.merge_flags(rows, merges)


@query(f"""WITH {CUR_SQL}, s AS (SELECT listing_id, source_id FROM cur WHERE listing_id % 21 = 0)
SELECT DISTINCT least(s.listing_id, c.listing_id) AS a_id, greatest(s.listing_id, c.listing_id) AS b_id FROM s JOIN cur c USING (source_id) WHERE c.listing_id <> s.listing_id""")
def split_exclusions(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d).select("listing_id", F.col("source_id").alias("property_id"))
    return resolve.split_exclusions(rows, rows.where("listing_id % 21 = 0"))


_ALERTS_SQL = _NEW + """, n AS (SELECT *, count(*) OVER (PARTITION BY spec_id) AS total FROM cut),
k AS (SELECT *, CASE WHEN total > 40 THEN 0 ELSE (rn-1)//10 END AS chunk FROM n), c AS (SELECT spec_id, chunk, (spec_id + chunk) % 3 = 2 AS fails, count(*) AS properties FROM k GROUP BY 1, 2),
t AS (SELECT *, coalesce(bool_or(fails) OVER (PARTITION BY spec_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stopped FROM c)"""


@query(_ALERTS_SQL + " SELECT spec_id, chunk, CASE WHEN fails THEN 'failed' ELSE 'sent' END AS status, properties FROM t WHERE NOT stopped")
def notification_log(spark: SparkSession, d: str) -> DataFrame:
    """The append-only log of a run: every chunk tried and how it went; written, and read back."""
    tried = alerts.send(alerts.chunks(_new(spark, d)), (F.col("spec_id") + F.col("chunk")) % 3 == 2)
    path = scratch(spark, "log")
    sinks.append(alerts.log(tried, F.col("ok"), _ALERT_NOW), path)
    return spark.read.parquet(path).select("spec_id", F.col("chunk").cast("long").alias("chunk"), "status", F.size("property_ids").cast("long").alias("properties"))


@query(_ALERTS_SQL + " SELECT DISTINCT property_id FROM k JOIN t USING (spec_id, chunk) WHERE NOT stopped AND NOT fails")
def notified_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties that count as notified after the run: only those of chunks sent; the rest stay for the next run."""
    tried = alerts.send(alerts.chunks(_new(spark, d)), (F.col("spec_id") + F.col("chunk")) % 3 == 2)
    return alerts.notified(alerts.log(tried, F.col("ok"), _ALERT_NOW))


@query(GOLDEN_SQL + """, r AS (SELECT property_id, CASE property_id % 3 WHEN 0 THEN 'backfill' WHEN 1 THEN 'incremental' ELSE 'sweep' END AS mode, property_id % 10 = 4 AS first_fill FROM golden)
SELECT property_id, mode = 'backfill' OR first_fill AS suppressed FROM r""")
def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("property_id")
    mode = F.when(k % 3 == 0, "backfill").when(k % 3 == 1, "incremental").otherwise("sweep")
    return _golden(spark, d).select("property_id", alerts.suppressed(mode, k % 10 == 4).alias("suppressed"))


@query(_NEW.replace("property_id % 7 <> 0 AND", "property_id % 7 <> 0 AND property_id % 5 <> 0 AND") + " SELECT spec_id, property_id FROM cut")
def shown_alerts(spark: SparkSession, d: str) -> DataFrame:
    """New properties that no user has hidden; every fifth is hidden."""
    golden = _golden(spark, d).withColumn("hidden", F.col("property_id") % 5 == 0)
    from parcelflow.sources.fixtures import saved_searches

    return alerts.eligible(alerts.match(golden, saved_searches(spark)), golden.where("property_id % 7 = 0").select("property_id"), _ALERT_NOW, max_days=400).select("spec_id", "property_id")


def _thousands(x: str) -> str:
    return f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', ' ')"


_KM0 = geo.cosine_sql(*CENTRE)


@query(f"""WITH {CUR_SQL}, d AS (SELECT *, floor(price/area_m2*100+0.5)/100 AS each, CASE WHEN lat IS NOT NULL THEN {_KM0} END AS km, CASE WHEN lat IS NULL THEN 'unknown' ELSE location_precision END AS prec FROM cur)
SELECT listing_id AS property_id, '<b>' || CASE WHEN kind = 'plot' THEN 'Działka' ELSE 'Dom' END || ' · ' || {_thousands('area_m2')} || ' m²</b>' || chr(10) || '<i>' || CASE WHEN length(title) > 90 THEN substring(title, 1, 87) || '…' ELSE title END || '</i>' || chr(10)
  || CASE WHEN price IS NULL THEN 'cena do uzgodnienia' ELSE {_thousands('price')} || ' zł' || ' · ' || {_thousands('floor(each + 0.5)')} || ' zł/m²' END || chr(10)
  || city || CASE WHEN district IS NULL THEN '' ELSE ', ' || district END || CASE WHEN km IS NULL THEN '' ELSE ' · ' || replace(printf('%.1f', floor(km * 10 + 0.5) / 10), '.', ',') || ' km' END
  || CASE prec WHEN 'approx' THEN ' (lokalizacja przybliżona)' WHEN 'unknown' THEN ' (brak współrzędnych)' ELSE '' END || chr(10)
  || CASE WHEN listing_id % 2 = 0 THEN '<a href="https://' || source || '">' || source || '</a>' ELSE '<a href="https://' || source || '">Oferta</a>' END || ' · dodano ' || strftime(first_seen_at, '%d.%m.%Y') AS message FROM d""")
def digest_messages(spark: SparkSession, d: str) -> DataFrame:
    """The message of every listing taken as a property of its own; every second has an active link."""
    km = F.when(F.col("lat").isNotNull(), geo.cosine_km(*CENTRE, F.col("lat"), F.col("lon")))
    url = F.concat(F.lit("https://"), "source")
    rows = current(spark, d).withColumns({
        "property_id": F.col("listing_id"), "price_per_m2": geo.round2(F.col("price") / F.col("area_m2")), "url": url, "location_precision": F.when(F.col("lat").isNull(), "unknown").otherwise(F.col("location_precision")),
        "links": F.array(F.struct(F.col("source").alias("source"), url.alias("url"), (F.col("listing_id") % 2 == 0).alias("active")))})
    return alerts.digest_lines(rows, km)
