"""Change data: first per key, price changes, upserts, sweeps, enrichment and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import geo

KEY = ["source", "source_id"]
#: Fields of a stored listing: taken as they come, kept where the new one is missing, and taken with a pair of coordinates.
OVERWRITTEN = ["title", "price", "price_negotiable", "price_per_m2"]
COALESCED = [
    "area_m2", "plot_area_m2", "rooms", "plot_type", "city", "district", "region", "is_private", "external_id", "internal_id", "offer_number", "advertiser_name", "advertiser_id", "description_excerpt",
    "source_refreshed_at", "valid_to",
]
PLACED = ["lat", "lon", "location_precision", "location_radius_km"]


def first_per_key(rows: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """The first row of each key in arrival order: portals repeat promoted ads inside a batch."""
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return picked.select("row.*")


def price_changes(obs: DataFrame) -> DataFrame:
    """First sightings and sightings whose price isn't the one before, where there is a price."""
    order = Window.partitionBy(*KEY).orderBy("observed_at", "obs_id")
    rows = obs.select("obs_id", "listing_id", *KEY, "price", "observed_at", F.lag("price").over(order).alias("previous_price"), F.row_number().over(order).alias("rn"))
    changed = (F.col("rn") == 1) | ~F.col("price").eqNullSafe(F.col("previous_price"))
    return rows.where(F.col("price").isNotNull() & changed).select("obs_id", "listing_id", "price", "previous_price", "observed_at")


def price_paths(changes: DataFrame) -> DataFrame:
    """Prices of a listing in time order, for those with more than one."""
    points = F.sort_array(F.collect_list(F.struct("observed_at", "obs_id", "price")))
    grouped = changes.groupBy("listing_id").agg(F.count("*").alias("points"), points.alias("p")).where("points > 1")
    return grouped.select("listing_id", "points", F.array_join(F.transform("p", lambda x: x.price.cast("string")), ">").alias("path"))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's new stored rows with inserted, changed, price_changed, previous_price and needs_assignment.

    ``batch`` has one row a key. A listing changes if its price or title differs, it was inactive, it states another area,
    place or advertiser id, or it was refreshed since; only then are its stored fields replaced: title and price as they
    come, missing values keep what is stored, a place with its precision and radius only as a pair of coordinates. Kind and
    creation time never change. A listing needs a property if it is new, changed other than by a refresh, or has none.
    """
    n, o = batch.alias("n"), current.alias("o")
    joined = n.join(o, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in KEY], "left")
    in_old, in_new = set(current.columns), set(batch.columns)
    was = lambda c: F.col(f"o.{c}") if c in in_old else F.lit(None)
    now = lambda c: F.col(f"n.{c}") if c in in_new else F.lit(None)
    new, paired = F.col("o.listing_id").isNull(), F.col("n.lat").isNotNull() & F.col("n.lon").isNotNull()
    price = _differs(F.col("n.price"), F.col("o.price"))
    stated = lambda c: now(c).isNotNull() & _differs(now(c), was(c))
    moved = paired & (_differs(F.col("n.lat"), F.col("o.lat")) | _differs(F.col("n.lon"), F.col("o.lon")))
    idle = ~F.coalesce(F.col("o.is_active"), F.lit(True)) if "is_active" in in_old else F.lit(False)
    relevant = price | idle | _differs(F.col("n.title"), F.col("o.title")) | stated("area_m2") | moved | stated("advertiser_id")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    refreshed = F.coalesce(now("source_refreshed_at").cast("timestamp_ntz"), epoch) > F.coalesce(was("source_refreshed_at").cast("timestamp_ntz"), epoch)
    changed = relevant | refreshed
    take = lambda c, cond, value: F.when(new, now(c)).when(changed & cond, value).otherwise(was(c)).alias(c)
    fields = [take(c, F.lit(True), now(c)) for c in OVERWRITTEN if c in in_new] + [take(c, paired, now(c)) for c in PLACED if c in in_new]
    fields += [take(c, F.lit(True), F.coalesce(now(c), was(c))) for c in COALESCED if c in in_new]
    if "source_created_at" in in_new:
        fields.append(F.when(new, now("source_created_at")).otherwise(was("source_created_at")).alias("source_created_at"))
    if "attributes" in in_new:
        fields.append(take("attributes", F.lit(True), overlay(was("attributes"), now("attributes")) if "attributes" in in_old else now("attributes")))
    homeless = F.col("o.property_id").isNull() if "property_id" in in_old else F.lit(False)
    return joined.select(
        F.coalesce("o.listing_id", "n.listing_id").alias("listing_id"), *[F.col(f"n.{k}").alias(k) for k in KEY], F.coalesce("o.kind", "n.kind").alias("kind"), *fields,
        F.col("n.observed_at").alias("last_seen_at"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("deactivated_at"), new.alias("inserted"), (new | changed).alias("changed"),
        (~new & price).alias("price_changed"), F.col("o.price").alias("previous_price"), (new | relevant | homeless).alias("needs_assignment"),
    )


def sweep(rows: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Deactivate what a full walk of its (source, kind) has not seen; a strict comparison with the walk's start."""
    out = rows.join(sweeps, ["source", "kind"], "left")
    return out.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.col("last_seen_at") < F.col("started"), F.lit(False)))


def expire(rows: DataFrame, now: str) -> DataFrame:
    return rows.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.col("valid_to") < F.lit(now).cast("timestamp_ntz"), F.lit(False)))


#: What an ad may add to its listing.
DETAILS = [*PLACED, "area_m2", "plot_area_m2", "plot_type", "city", "attributes"]


def enrich(stored: DataFrame, patch: DataFrame, now: str) -> DataFrame:
    """Stored listings with the details of their ads (source, source_id, status, some of ``DETAILS``), and the attempt counted.

    Given values replace stored ones, a place with its precision and radius as a pair of coordinates only; attributes are
    laid over the stored ones. ``status`` is ok, gone or skip: gone ads are deactivated, all but skipped ones are enriched.
    The place that the ad itself gives stays beside as given_lat, given_lon and given_radius_km.
    """
    s, p = stored.alias("s"), patch.alias("p")
    joined = s.join(p, [F.col(f"s.{k}") == F.col(f"p.{k}") for k in KEY])
    given = lambda c: F.col(f"p.{c}") if c in patch.columns else F.lit(None)
    paired = given("lat").isNotNull() & given("lon").isNotNull()
    gone, at = F.col("p.status") == "gone", F.lit(now).cast("timestamp_ntz")
    own = {c: F.col(f"s.{c}") for c in stored.columns}
    own |= {c: F.when(paired, F.coalesce(given(c), own[c])).otherwise(own[c]) for c in PLACED if c in own and c in patch.columns}
    own |= {c: F.coalesce(given(c), own[c]) for c in DETAILS if c in own and c in patch.columns and c not in (*PLACED, "attributes")}
    if "attributes" in own and "attributes" in patch.columns:
        own["attributes"] = overlay(own["attributes"], given("attributes"))
    own |= {"attempts": F.col("s.attempts") + 1, "enriched_at": F.when(F.col("p.status") != "skip", at).otherwise(own.get("enriched_at", F.lit(None)).cast("timestamp_ntz"))}
    own |= {"is_active": own.get("is_active", F.lit(True)) & ~gone, "deactivated_at": F.when(gone, at).otherwise(own.get("deactivated_at", F.lit(None)).cast("timestamp_ntz"))}
    place = {"given_lat": given("lat").cast("double"), "given_lon": given("lon").cast("double"), "given_radius_km": given("location_radius_km").cast("double"), "status": F.col("p.status")}
    return joined.select(*[v.alias(c) for c, v in {**own, **place}.items()])


def route(enriched: DataFrame, area: tuple[float, float, float, float], attempts: int = 3) -> DataFrame:
    """outcome: delete what its ad places outside the area (with its radius, 1 km at least, as slack), deactivate gone ads,
    assign read and exhausted ones, else wait."""
    inside = geo.in_area(F.col("given_lat"), F.col("given_lon"), F.col("given_radius_km"), area)
    outcome = F.when(F.col("given_lat").isNotNull() & F.col("given_lon").isNotNull() & ~inside, "delete").when(F.col("status") == "gone", "deactivate").when((F.col("status") == "ok") | (F.col("attempts") >= attempts), "assign").otherwise("wait")
    return enriched.withColumn("outcome", outcome)


def set_ignored(rows: DataFrame, cond: Column, value: bool) -> DataFrame:
    """Only the rows whose flag changes."""
    return rows.where(cond & (F.col("ignored") != value)).withColumn("ignored", F.lit(value))


def latest_flags(events: DataFrame) -> DataFrame:
    """Flags of each property by its latest event of each kind, since when they stand, and its latest note."""
    order = F.struct("ts", "event_id")
    last = lambda kind, value="on": F.max_by(value, F.when(F.col("action") == kind, order))
    at = lambda kind: F.when(last(kind), F.max(F.when(F.col("action") == kind, F.col("ts"))))
    note = [last("note", "note").alias("note")] if "note" in events.columns else []
    return events.groupBy("property_id").agg(
        F.coalesce(last("hide"), F.lit(False)).alias("hidden"), at("hide").alias("hidden_at"), F.coalesce(last("favorite"), F.lit(False)).alias("favorite"), at("favorite").alias("favorite_at"), *note)


def waits_for_details(rows: DataFrame, with_details: list[str]) -> tuple[DataFrame, DataFrame]:
    """(assign now, wait): rows without coordinates or property, of sources that have ad pages, wait."""
    wait = F.col("lat").isNull() & F.col("property_id").isNull() & F.col("source").isin(with_details)
    return rows.where(~wait), rows.where(wait)


def overlay(stored: Column, given: Column) -> Column:
    """Keys of both attribute maps; where both have one, the given value."""
    kept = F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(given, F.create_map().cast("map<string,string>")))


def distinct_links(links: Column) -> Column:
    """The first link of every URL, in order."""
    urls = F.transform(links, lambda x: x.url)
    return F.filter(links, lambda x, k: F.array_position(urls, x.url) == k + 1)


def touched(changed: DataFrame) -> DataFrame:
    """Distinct properties of changed rows; rows without one touch none."""
    return changed.select("property_id").where("property_id is not null").distinct()
