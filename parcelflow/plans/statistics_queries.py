"""Counts, coverage, logs, rates and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.operators import spatial, stats
from parcelflow.plans.space_queries import _DIST
from parcelflow.sources.fixtures import CUR_SQL, SEGMENTS_SQL, SOURCES, current, segments
from parcelflow.sources.shared import staged
from parcelflow.streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.col("user_id").alias("source"), "event_type", (F.col("event_type") == "error").alias("failed"))


_EVENTS = "e AS (SELECT event_id, ts, user_id AS source, event_type, event_type = 'error' AS failed FROM events)"


@query(f"WITH {CUR_SQL}, p AS (SELECT source_id, string_agg(DISTINCT source, '+' ORDER BY source) AS combo, count(DISTINCT source) AS n FROM cur GROUP BY source_id) SELECT combo, count(*) AS properties FROM p WHERE n >= 2 GROUP BY combo")
def source_combos(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_combinations(current(spark, d), "source_id")


@query(f"WITH {CUR_SQL} SELECT source, count(*) AS listings, count(lat) AS located, count(price) AS priced, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS in_multi_source FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM cur) GROUP BY source")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    cur = current(spark, d)
    multi = stats.multi_source(cur, "source_id")
    rows = cur.join(multi, "source_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("listings"), F.count("lat").alias("located"), F.count("price").alias("priced"), F.count_if(F.coalesce("several", F.lit(False))).alias("in_multi_source"))


@query(f"WITH {CUR_SQL} SELECT source, count(*) FILTER (WHERE kind='plot') AS plot, count(*) FILTER (WHERE kind='house') AS house, count(*) AS everything FROM cur WHERE last_seen_at >= TIMESTAMP '1997-01-01' GROUP BY source")
def count_by_source_kind(spark: SparkSession, d: str) -> DataFrame:
    active = current(spark, d).where(F.col("last_seen_at") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return active.groupBy("source").pivot("kind", ["plot", "house"]).count().na.fill(0, ["plot", "house"]).withColumn("everything", F.col("plot") + F.col("house"))


@query(f"WITH {CUR_SQL}, {SEGMENTS_SQL}{_DIST} SELECT count(*) FILTER (WHERE kind='plot') AS plots, count(*) FILTER (WHERE kind='house') AS houses, count(*) FILTER (WHERE first_seen_at > TIMESTAMP '1995-01-01') AS new, count(*) FILTER (WHERE lat IS NULL) AS unlocated, count(*) FILTER (WHERE is_private IS NULL) AS unknown_owner, count(*) FILTER (WHERE listing_id IN (SELECT listing_id FROM near WHERE variant = 'A' AND metres <= 500)) AS near_corridor FROM cur")
def facets(spark: SparkSession, d: str) -> DataFrame:
    cur = staged(current(spark, d))
    near = spatial.near_corridor(spatial.nearest_lines(cur, segments(spark)), ["A"], spatial.NEAR_M).select("listing_id", F.lit(True).alias("near"))
    return cur.join(near, "listing_id", "left").agg(
        F.count_if(F.coalesce("near", F.lit(False))).alias("near_corridor"), F.count_if(F.col("kind") == "plot").alias("plots"), F.count_if(F.col("kind") == "house").alias("houses"), F.count_if(F.col("first_seen_at") > F.lit("1995-01-01").cast("timestamp_ntz")).alias("new"),
        F.count_if(F.col("lat").isNull()).alias("unlocated"), F.count_if(F.col("is_private").isNull()).alias("unknown_owner"))


@query(f"""WITH {CUR_SQL}, k AS (SELECT listing_id, CAST(floor(lat*10000+0.5) AS BIGINT) AS y, CAST(floor(lon*10000+0.5) AS BIGINT) AS x FROM cur WHERE lat IS NOT NULL)
SELECT listing_id, count(*) OVER (PARTITION BY y, x) AS members, row_number() OVER (PARTITION BY y, x ORDER BY listing_id) AS place FROM k""")
def colocated(spark: SparkSession, d: str) -> DataFrame:
    return stats.colocated(current(spark, d)).select("listing_id", "members", "place")


@query(f"""WITH RECURSIVE {CUR_SQL}, p AS (SELECT price FROM cur WHERE price IS NOT NULL), e(low, high) AS (VALUES (0, 100000), (100000, 200000), (200000, 300000), (300000, 500000), (500000, NULL)),
b AS (SELECT CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, count(price) AS n FROM e LEFT JOIN p ON price >= low AND (high IS NULL OR price < high) GROUP BY 1, 2
  UNION ALL
  SELECT h.low, h.high, count(price) FROM (SELECT CASE WHEN side = 0 THEN low ELSE middle END AS low, CASE WHEN side = 0 THEN middle ELSE high END AS high
    FROM (SELECT *, CASE WHEN high IS NULL THEN greatest(2*low, low+1000000) ELSE (low+high)//2 END AS middle FROM b WHERE n > 950 AND (high IS NULL OR high-low >= 40000)) s, (VALUES (0), (1)) t(side)) h
  LEFT JOIN p ON price >= h.low AND (h.high IS NULL OR price < h.high) GROUP BY 1, 2)
SELECT low, high, n AS rows FROM b WHERE n <= 950 OR high-low < 40000""")
def price_histogram_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return stats.adaptive_histogram(current(spark, d).where("price is not null").select("price"), [0, 100000, 200000, 300000, 500000], most=950)


@query(f"""WITH {CUR_SQL}, own AS (SELECT source, kind, count(*) AS own FROM cur WHERE last_seen_at >= TIMESTAMP '1997-06-01' GROUP BY source, kind),
rep AS (SELECT o_orderkey, list_extract({SOURCES}, CAST(o_orderkey%7+1 AS INT)) AS source, CASE WHEN o_custkey%3=0 THEN 'house' ELSE 'plot' END AS kind, o_custkey % 20 AS place, CAST(floor(o_totalprice/100) AS BIGINT) AS total, o_orderdate AS stamp FROM orders),
last AS (SELECT source, kind, place, arg_max(total, row(stamp, o_orderkey)) AS total FROM rep WHERE place <> 19 GROUP BY source, kind, place), sums AS (SELECT source, kind, sum(total) AS total FROM last GROUP BY source, kind)
SELECT source, kind, coalesce(own, 0) AS own, CAST(coalesce(total, 0) AS BIGINT) AS reported, CASE WHEN coalesce(total,0) > 0 THEN least(100, CAST(floor(coalesce(own,0)*CAST(100 AS DOUBLE)/total+0.5) AS BIGINT)) END AS percent FROM own FULL JOIN sums USING (source, kind)""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    own = current(spark, d).where(F.col("last_seen_at") >= F.lit("1997-06-01").cast("timestamp_ntz")).groupBy("source", "kind").agg(F.count("*").alias("own"))
    reports = spark.read.parquet(f"{d}/orders.parquet").select(
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("source"), F.when(F.col("o_custkey") % 3 == 0, "house").otherwise("plot").alias("kind"),
        (F.col("o_custkey") % 20).alias("place"), F.floor(F.col("o_totalprice") / 100).alias("total"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    places = spark.range(19).select(F.col("id").alias("place"))
    return stats.coverage(own, stats.latest_totals(reports, places))


@query(f"""WITH {_EVENTS}, w AS (SELECT event_id, source, ts, count(*) OVER k AS recent, min(ts) OVER k AS oldest FROM e WINDOW k AS (PARTITION BY source ORDER BY ts RANGE BETWEEN INTERVAL '9 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW))
SELECT event_id, source, recent, recent > 2 AS over_limit, CASE WHEN recent > 2 THEN oldest + INTERVAL 10 MINUTE END AS retry_at FROM w""")
def request_rate_10min(spark: SparkSession, d: str) -> DataFrame:
    return stats.trailing_rate(_events(spark, d), limit=2)


@query(ORACLES["request_rate_10min"])
def stream_trailing_rate(spark: SparkSession, d: str) -> DataFrame:
    """The exact trailing rate of every request as a stream; the rows of the batch query."""
    return ingest.run_trailing(_events(spark, d), limit=2)


@query(f"""WITH {_EVENTS}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT *, row_number() OVER (PARTITION BY source, island ORDER BY ts, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM g)
SELECT event_id, source, streak, least(360, CAST(45*pow(2, streak-1) AS BIGINT)) AS backoff_minutes FROM s WHERE failed""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return stats.failure_streaks(_events(spark, d))


@query(f"""WITH {_EVENTS}, l AS (SELECT source, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source ORDER BY ts, event_id)) AS gap FROM e) SELECT source, count(gap) AS gaps, min(gap) AS least_us, count(*) FILTER (WHERE gap < 60000000) AS too_soon FROM l GROUP BY source""")
def min_gap(spark: SparkSession, d: str) -> DataFrame:
    return stats.gaps(_events(spark, d), least_us=60_000_000)


@query(f"""WITH p AS (SELECT user_id AS walk, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS page, date_trunc('month', ts) AS m, CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE 1 END AS new_count FROM events),
g AS (SELECT *, sum(CASE WHEN new_count > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY walk, m ORDER BY page) AS island FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY walk, m, island ORDER BY page) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS streak FROM g),
x AS (SELECT walk, m, min(page) FILTER (WHERE new_count = 0 AND streak >= 2) AS empty_at, max(page) AS last FROM s GROUP BY walk, m)
SELECT walk, CAST(m AS TIMESTAMP) AS m, least(coalesce(empty_at, last), 5, last) AS stop_page FROM x""")
def stop_page(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("m", month)
    order = Window.partitionBy("user_id", "m").orderBy("ts", "event_id")
    pages = events.select(F.col("user_id").alias("walk"), "m", F.row_number().over(order).alias("page"), F.when(F.col("event_type").isin("view", "error"), 0).otherwise(1).alias("new_count"))
    return stats.stop_pages(pages, ["walk", "m"])


_RUNS = "r AS (SELECT strftime(ts, '%Y-%m-%d') AS run, event_id, event_type, value, CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' WHEN 2 THEN 'done' WHEN 3 THEN 'queued' WHEN 4 THEN 'done' ELSE 'running' END AS status, ts FROM events)"
_STATUSES = ["queued", "running", "done", "failed", "cancelled"]


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    status = F.when(k == 0, "failed").when(k == 3, "queued").when(k == 5, "running").otherwise("done")
    return spark.read.parquet(f"{d}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_id", "event_type", "value", status.alias("status"), "ts")


@query(f"""WITH {_RUNS} SELECT run, {", ".join(f"count(*) FILTER (WHERE status='{s}') AS {s}" for s in _STATUSES)}, {", ".join(f"CAST(coalesce(sum(floor(value)) FILTER (WHERE event_id % 8 = {k}), 0) AS BIGINT) AS {c}" for k, c in enumerate(stats.COUNTERS))},
coalesce(array_to_string(list_reverse(list_slice(list_reverse(list(event_id ORDER BY event_id) FILTER (WHERE event_type='error')), 1, 50)), ','), '') AS errors FROM r GROUP BY run""")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    return stats.run_statistics(jobs.withColumns({c: F.when(F.col("event_id") % 8 == k, F.floor("value")) for k, c in enumerate(stats.COUNTERS)}), _STATUSES)


@query(f"WITH {_RUNS} SELECT run, CASE WHEN count(*) FILTER (WHERE status IN ('queued','running')) > 2 THEN 'open' WHEN count(*) FILTER (WHERE status='failed') > 0 THEN 'partial' ELSE 'done' END AS outcome FROM r GROUP BY run")
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_outcomes(_jobs(spark, d), open_allowed=2)


@query("""WITH m AS (SELECT event_type AS mode, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY event_type), n AS (SELECT max(ts) AS now FROM events)
SELECT mode, last_id, last_at, CASE WHEN mode = 'purchase' THEN last_at <= now - INTERVAL 7 DAY ELSE last_at <= now - INTERVAL 29 MINUTE END AS due FROM m, n""")
def due_runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.due(spark.read.parquet(f"{d}/events.parquet"), full_mode="purchase")


@query(f"""WITH {CUR_SQL}, p AS (SELECT source_id, bool_and(lat IS NULL) AS hidden FROM cur GROUP BY source_id)
SELECT (SELECT count(*) FROM cur) AS listings, (SELECT count(*) FROM p) AS properties, (SELECT count(*) FROM p WHERE hidden) AS hidden, (SELECT count(*) FROM events WHERE event_id % 6 = 3) AS queued""")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    cur = current(spark, d)
    by_property = cur.groupBy("source_id").agg(F.bool_and(F.col("lat").isNull()).alias("hidden"), F.count("*").alias("n"))
    own = by_property.agg(F.sum("n").alias("listings"), F.count("*").alias("properties"), F.count_if("hidden").alias("hidden"))
    return own.crossJoin(_jobs(spark, d).agg(F.count_if(F.col("status") == "queued").alias("queued")))  # one row each


@query(f"""WITH {CUR_SQL}, h AS (SELECT *, bool_and(lat IS NULL) OVER (PARTITION BY source_id) AS hidden FROM cur)
SELECT source, count(*) AS listings, count(DISTINCT source_id) AS properties, count(*) FILTER (WHERE hidden) AS hidden, max(last_seen_at) AS last_seen_at FROM h GROUP BY source""")
def status_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The status summary's part for each source."""
    cur = current(spark, d)
    hidden = cur.groupBy("source_id").agg(F.bool_and(F.col("lat").isNull()).alias("hidden"))
    rows = cur.join(hidden, "source_id")
    return rows.groupBy("source").agg(F.count("*").alias("listings"), F.countDistinct("source_id").alias("properties"), F.count_if("hidden").alias("hidden"), F.max("last_seen_at").alias("last_seen_at"))
