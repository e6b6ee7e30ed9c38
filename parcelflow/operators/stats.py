"""Aggregates and ordered computations over listings and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_source(listings: DataFrame, prop: str) -> DataFrame:
    return listings.groupBy(prop).agg((F.countDistinct("source") > 1).alias("several"))


def source_combinations(listings: DataFrame, prop: str) -> DataFrame:
    """How many properties stand on each combination of two or more sources."""
    sets = listings.groupBy(prop).agg(F.sort_array(F.collect_set("source")).alias("s")).where(F.size("s") >= 2)
    return sets.groupBy(F.array_join("s", "+").alias("combo")).agg(F.count("*").alias("properties")).orderBy(F.desc("properties"), "combo")


def colocated(listings: DataFrame) -> DataFrame:
    """Members and places of listings that share a spot of four decimals (about 11 m)."""
    rows = listings.where("lat is not null and lon is not null").select("listing_id", F.floor(F.col("lat") * 10000 + 0.5).alias("y"), F.floor(F.col("lon") * 10000 + 0.5).alias("x"))
    spot = Window.partitionBy("y", "x")
    return rows.withColumn("members", F.count("*").over(spot)).withColumn("place", F.row_number().over(spot.orderBy("listing_id")))


def adaptive_histogram(prices: DataFrame, edges: list[int], most: int, narrowest: int = 20_000) -> DataFrame:
    """Buckets (low, high, rows) where a bucket of more than ``most`` rows is halved until it is small or narrow.

    A round counts the rows of the open buckets in one aggregated pass; only bucket counts come to the driver, and a
    round halves the widths, so rounds grow with the logarithm of the widest bucket. The last bucket has no end and
    splits at twice its start, a million above it at least.
    """
    prices = prices.groupBy("price").agg(F.count("*").alias("n"))
    open_, done = [(a, b) for a, b in zip(edges, [*edges[1:], None], strict=True)], []
    while open_:
        counts = prices.agg(*[F.sum(F.when((F.col("price") >= a) & (F.lit(True) if b is None else F.col("price") < b), F.col("n"))).alias(f"b{k}") for k, (a, b) in enumerate(open_)]).first()
        nxt = []
        for (a, b), n in zip(open_, counts, strict=True):
            if (n or 0) <= most or (b is not None and b - a < 2 * narrowest):
                done.append((a, b, n or 0))
            else:
                middle = max(2 * a, a + 1_000_000) if b is None else (a + b) // 2
                nxt += [(a, middle), (middle, b)]
        open_ = nxt
    return prices.sparkSession.createDataFrame(sorted(done, key=lambda x: x[0]), "low long, high long, rows long")


def latest_totals(reports: DataFrame, places: DataFrame) -> DataFrame:
    """Sum over configured places of the latest total reported per (source, kind, place)."""
    last = reports.join(places, "place", "left_semi").groupBy("source", "kind", "place").agg(F.max_by("total", "at").alias("total"))  # places of the settings
    return last.groupBy("source", "kind").agg(F.sum("total").alias("reported"))


def coverage(own: DataFrame, reported: DataFrame) -> DataFrame:
    """Own share of what each portal reports, in whole percent, 100 at most."""
    rows = own.join(reported, ["source", "kind"], "full").select("source", "kind", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("reported", F.lit(0)).cast("long").alias("reported"))
    return rows.withColumn("percent", F.when(F.col("reported") > 0, F.least(F.lit(100), F.floor(F.col("own") * 100.0 / F.col("reported") + 0.5))))


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def trailing_rate(events: DataFrame, limit: int, minutes: int = 10) -> DataFrame:
    """Requests of the last ``minutes`` per source, the far end excluded; when over the limit, the time to retry.

    A source's log is cut into slices as long as the window; an event is also shown to the slice after its own, so that
    no group is longer than two slices.
    """
    width = minutes * 60_000_000
    sliced = events.withColumn("at", _micros()).withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("slice", F.floor(F.col("at") / width) + F.col("shift"))
    span = Window.partitionBy("source", "slice").orderBy("at").rangeBetween(-(width - 1), 0)
    rows = sliced.withColumn("recent", F.count("*").over(span)).withColumn("oldest", F.min("ts").over(span)).where("shift = 0")
    over = F.col("recent") > limit
    return rows.select("event_id", "source", "recent", over.alias("over_limit"), F.when(over, F.col("oldest") + F.expr(f"interval {minutes} minutes")).alias("retry_at"))


def _streaks(rows: DataFrame, by: list[str], order: list[str], breaks) -> DataFrame:
    """island and streak: how many rows in a row, up to this one, don't break."""
    within = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*by, "island").orderBy(*order))
    return rows.withColumn("streak", place - F.when(F.col("island") > 0, 1).otherwise(0))


HOUR = 3_600_000_000


def failure_streaks(events: DataFrame) -> DataFrame:
    """Consecutive failures per source and the pause they ask for: 45 minutes doubled each time, six hours at most.

    Streaks are counted within an hour's slice; the failures that a slice ends with are carried into the next ones by a
    window over the slices alone.
    """
    rows = _streaks(events.withColumn("slice", F.floor(_micros() / HOUR)), ["source", "slice"], ["ts", "event_id"], ~F.col("failed"))
    ends = rows.groupBy("source", "slice").agg(F.max("island").alias("breaks"), F.max_by("streak", F.struct("ts", "event_id")).alias("tail"))
    order = Window.partitionBy("source").orderBy("slice")
    ends = ends.withColumn("run", F.sum((F.col("breaks") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = F.sum("tail").over(Window.partitionBy("source", "run").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    carried = ends.withColumn("so_far", so_far).select("source", "slice", F.coalesce(F.lag("so_far").over(order), F.lit(0)).alias("carried"))
    rows = rows.where("failed").join(carried, ["source", "slice"])
    streak = F.col("streak") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)
    pause = F.least(F.lit(360), (F.lit(45) * F.pow(F.lit(2.0), F.least(streak, F.lit(10)) - 1)).cast("long"))
    return rows.select("event_id", "source", streak.cast("long").alias("streak"), pause.alias("backoff_minutes"))


def gaps(events: DataFrame, least_us: int) -> DataFrame:
    """Pauses between a source's events: within slices of an hour, and from slice to slice."""
    rows = events.select("source", "event_id", _micros().alias("at")).withColumn("slice", F.floor(F.col("at") / HOUR))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("source", "slice").orderBy("at", "event_id"))
    sums = [F.count("gap").alias("gaps"), F.min("gap").alias("least_us"), F.count_if(F.col("gap") < least_us).alias("too_soon")]
    slices = rows.withColumn("gap", gap).groupBy("source", "slice").agg(*sums, F.min("at").alias("first"), F.max("at").alias("last"))
    between = slices.select("source", (F.col("first") - F.lag("last").over(Window.partitionBy("source").orderBy("slice"))).alias("gap"))
    parts = slices.select("source", "gaps", "least_us", "too_soon").unionByName(between.groupBy("source").agg(*sums))
    return parts.groupBy("source").agg(F.sum("gaps").alias("gaps"), F.min("least_us").alias("least_us"), F.sum("too_soon").alias("too_soon"))


def stop_pages(pages: DataFrame, walk: list[str], empty: int = 2, most: int = 5) -> DataFrame:
    """The page where an incremental walk ends: the second of ``empty`` pages in a row without news, page ``most``, or the last."""
    rows = _streaks(pages, walk, ["page"], F.col("new_count") > 0)
    ends = rows.groupBy(*walk).agg(F.min(F.when((F.col("new_count") == 0) & (F.col("streak") >= empty), F.col("page"))).alias("empty_at"), F.max("page").alias("last"))
    return ends.select(*walk, F.least(F.coalesce("empty_at", "last"), F.lit(most), "last").cast("long").alias("stop_page"))


COUNTERS = ("requests", "pages", "new_listings", "updated_listings", "new_properties", "deactivated", "enriched", "outside_area")  # fixed values


def run_statistics(jobs: DataFrame, statuses: list[str], errors: int = 50) -> DataFrame:
    """Jobs by status, the eight counters summed, and the last errors of each run, in job order."""
    last = F.slice(F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id"))), asc=False), 1, errors)
    grouped = jobs.groupBy("run").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS], last.alias("e"))
    return grouped.select("run", *statuses, *COUNTERS, F.array_join(F.transform(F.reverse("e"), lambda x: x.cast("string")), ",").alias("errors"))


def run_outcomes(jobs: DataFrame, open_allowed: int = 0) -> DataFrame:
    still = F.count_if(F.col("status").isin("queued", "running")) > open_allowed
    return jobs.groupBy("run").agg(F.when(still, "open").when(F.count_if(F.col("status") == "failed") > 0, "partial").otherwise("done").alias("outcome"))


def due(runs: DataFrame, full_mode: str, minutes: int = 30, days: int = 7) -> DataFrame:
    """The latest run of each mode and whether the next is due: full walks every ``days``, others every ``minutes`` less one."""
    last = runs.groupBy(F.col("event_type").alias("mode")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.max("ts").alias("last_at"))
    rows = last.withColumn("now", F.max("last_at").over(Window.partitionBy()))  # a row a mode
    return rows.select("mode", "last_id", "last_at", F.when(F.col("mode") == full_mode, F.col("last_at") <= F.col("now") - F.expr(f"interval {days} days")).otherwise(F.col("last_at") <= F.col("now") - F.expr(f"interval {minutes - 1} minutes")).alias("due"))


def parse_quality(parsed: DataFrame) -> DataFrame:
    """Items and unparsable items of each source."""
    return parsed.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("source_id").isNull()).alias("errors"))
