"""Entity resolution: normal forms, blocking, pair decisions, clusters and golden records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import geo, text
from parcelflow.operators import graph, pairs
from parcelflow.sources.shared import staged

AREA_STEP, PRICE_STEP = math.log(1.25), -math.log(1 - 0.03)
SLIM = ("listing_id", "kind", "lat", "lon", "location_precision", "location_radius_km", "area_m2", "price", "city", "keys")


def normal_forms(listings: DataFrame) -> DataFrame:
    """What the pair rules need of each listing, worked out once per listing."""
    tokens = text.title_tokens(F.col("title"))
    given = lambda c: F.col(c) if c in listings.columns else F.lit(None).cast("string")
    return listings.select(
        "listing_id", "kind", "lat", "lon", "location_precision", "location_radius_km", "area_m2", "plot_area_m2", "price", "city",
        tokens.alias("tokens"), text.bigrams(tokens).alias("bigrams"),
        text.advertiser_key(F.col("advertiser_name"), given("advertiser_id")).alias("advertiser"),
        text.seller_tokens(F.col("advertiser_name")).alias("seller"),
        text.identity_keys(given("internal_id"), F.col("external_id"), given("offer_number")).alias("keys"),
    )


def _located(side: str = "") -> Column:
    return F.col(f"{side}lat").isNotNull() & F.col(f"{side}lon").isNotNull()


def _within(a: Column, b: Column, tolerance: float) -> Column:
    """Three-valued: relative difference of at most ``tolerance``; null if a side is null."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(larger == 0, True).otherwise(F.abs(a - b) / larger <= tolerance))


def _dist() -> Column:
    return geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], residual: Column) -> DataFrame:
    equal = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cond = F.col("a.listing_id") < F.col("b.listing_id")
    for e in equal:
        cond = cond & e
    return left.alias("a").join(right.alias("b"), cond & residual).select(F.col("a.listing_id").alias("a_id"), F.col("b.listing_id").alias("b_id"))


def matchable_pairs(forms: DataFrame) -> DataFrame:
    """Pairs (a_id < b_id) that the rules can still match: four blocked equi-joins over narrow rows.

    Located pairs meet in a grid as wide as the larger match radius of both and in area buckets of ratio 1.25; pairs with a
    missing area only match within 150 m; unlocated ones need the same city, area and price, so a town is dealt by buckets of
    both; a shared key needs nothing.
    """
    slim = forms.select(*SLIM)
    radius = F.greatest(F.lit(2.0), F.coalesce("location_radius_km", F.lit(0.0)))
    reach = F.greatest(F.lit(0), F.ceil(F.log2(radius / 2))).cast("int")  # a listing of class c matches within 2 * 2**c km
    located = slim.where(_located()).withColumn("reach", reach)
    bounds = located.agg(F.collect_set("reach"), F.max(F.abs("lat"))).first()
    classes, narrowing = sorted(bounds[0]), max(0.2, math.cos(math.radians(float(bounds[1] or 0.0))))
    tolerance = F.when(F.col("a.kind") == "house", 0.2).otherwise(0.03)
    close = _dist() <= F.when((F.col("a.location_precision") == "exact") & (F.col("b.location_precision") == "exact"), 1.0).otherwise(
        F.greatest(F.lit(2.0), F.coalesce(F.col("a.location_radius_km"), F.lit(0.0)), F.coalesce(F.col("b.location_radius_km"), F.lit(0.0))))
    areas = _within(F.col("a.area_m2"), F.col("b.area_m2"), 0.2) & (F.abs(F.col("a.area_m2") - F.col("b.area_m2")) / F.greatest("a.area_m2", "b.area_m2") <= tolerance)

    def gridded(df: DataFrame, km) -> DataFrame:
        step = km / F.lit(geo.KM_A_DEGREE)
        return df.withColumn("y", F.floor(F.col("lat") / step)).withColumn("x", F.floor(F.col("lon") / (step / narrowing)))

    bucket = F.floor(F.log("area_m2") / AREA_STEP)
    known = located.where("area_m2 > 0").withColumn("size", bucket)
    width = F.lit(2.0) * F.pow(F.lit(2.0), F.col("grid"))
    # A pair meets in the grid of its wider reach: the wider one asks around, all of its reach or less are there.
    asking = gridded(known.withColumn("grid", F.col("reach")), width)
    asking = asking.withColumn("y", geo.neighbours(F.col("y"))).withColumn("x", geo.neighbours(F.col("x"))).withColumn("size", geo.neighbours(F.col("size")))
    grids = F.filter(F.array(*[F.lit(c) for c in classes]).cast("array<int>"), lambda g: g >= F.col("reach"))
    there = gridded(known.withColumn("grid", F.explode(grids)), width)
    once = (F.col("b.reach") < F.col("a.reach")) | (F.col("a.listing_id") < F.col("b.listing_id"))
    meet = once & close & areas & (F.col("a.listing_id") != F.col("b.listing_id"))
    for k in ("kind", "grid", "y", "x", "size"):
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    by_place = asking.alias("a").join(there.alias("b"), meet).select(F.least("a.listing_id", "b.listing_id").alias("a_id"), F.greatest("a.listing_id", "b.listing_id").alias("b_id"))
    fine = gridded(located, 0.15)
    by_spot = _join(fine, fine.withColumn("y", geo.neighbours(F.col("y"))).withColumn("x", geo.neighbours(F.col("x"))), ["kind", "y", "x"],
                    (F.col("a.area_m2").isNull() | F.col("b.area_m2").isNull()) & (_dist() <= 0.15))
    town = slim.where("city is not null and area_m2 > 0 and price > 0").withColumn("town", F.lower(F.trim("city"))).withColumn("size", bucket)
    town = town.withColumn("dear", F.floor(F.log("price") / PRICE_STEP))
    asked = town.withColumn("size", geo.neighbours(F.col("size"))).withColumn("dear", geo.neighbours(F.col("dear")))
    by_town = _join(town, asked, ["kind", "town", "size", "dear"],
                    ~(_located("a.") & _located("b.")) & areas & _within(F.col("a.price"), F.col("b.price"), 0.03))
    keyed = slim.withColumn("key", F.explode("keys"))
    by_key = _join(keyed, keyed, ["kind", "key"], F.lit(True))
    return by_place.unionByName(by_spot).unionByName(by_town).unionByName(by_key).distinct()


def matched_in_blocks(forms: DataFrame, out, schema: str) -> DataFrame:
    """``out`` (of ``pairs``) of all pairs that the rules match, formed and decided block by block: the pairs of ``matchable_pairs``.

    A pair is formed once: with a shared key there; else by place, if both are located and have areas; within 150 m, if an
    area is missing; in its town, if a place is.
    """
    slim = staged(pairs.rule_columns(forms))
    reach = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(2.0), F.col("radius")) / 2))).cast("int")  # a listing of class c matches within 2 * 2**c km
    located, n = slim.where(_located()).withColumn("reach", reach), slim.count()
    bounds = located.agg(F.collect_set("reach"), F.max(F.abs("lat"))).first()
    classes, narrowing = sorted(bounds[0]), max(0.2, math.cos(math.radians(float(bounds[1] or 0.0))))

    def gridded(df: DataFrame, km) -> DataFrame:
        step = km / F.lit(geo.KM_A_DEGREE)
        return df.withColumn("y", F.floor(F.col("lat") / step)).withColumn("x", F.floor(F.col("lon") / (step / narrowing)))

    around = lambda df: df.withColumn("y", geo.neighbours(F.col("y"))).withColumn("x", geo.neighbours(F.col("x")))
    known, width = located.where("area_m2 > 0"), F.lit(2.0) * F.pow(F.lit(2.0), F.col("grid"))
    grids = F.filter(F.array(*[F.lit(c) for c in classes]).cast("array<int>"), lambda g: g >= F.col("reach"))
    # A pair meets in the grid of its wider reach: the wider one asks around, all of its reach or less are there.
    by_place = pairs.dealt(around(gridded(known.withColumn("grid", F.col("reach")), width)), gridded(known.withColumn("grid", F.explode(grids)), width), ["kind", "grid", "y", "x"], 10 * n)
    fine = gridded(located, 0.15)
    on_spot = pairs.dealt(around(fine.where("area_m2 is null")), fine, ["kind", "y", "x"], n)
    town = slim.where("town is not null and area_m2 > 0 and price > 0").withColumn("dear", F.floor(F.log("price") / PRICE_STEP))
    in_town = pairs.dealt(town.where(~_located()).withColumn("dear", geo.neighbours(F.col("dear"))), town, ["kind", "town", "dear"], n)
    keyed = slim.withColumn("key", F.explode("keys"))
    by_key = pairs.dealt(keyed, keyed, ["kind", "key"], n)
    found = pairs.in_blocks(by_key, pairs.by_key, out, schema)
    for blocks, chunks in ((by_place, pairs.at_place), (on_spot, pairs.on_spot), (in_town, pairs.in_town)):
        found = found.unionByName(pairs.in_blocks(blocks, pairs.without_keys(chunks), out, schema))
    return found


def matches(forms: DataFrame) -> DataFrame:
    """(a_id, b_id, reason, score) of all matching pairs."""
    return matched_in_blocks(forms, pairs.matches_out, pairs.MATCHES)


def links(forms: DataFrame) -> DataFrame:
    """(a_id, b_id): as many links as it takes to connect what all matches connect, few a listing."""
    return matched_in_blocks(forms, pairs.forest_out, "a long, b long").toDF("a_id", "b_id")


def decisions(found: DataFrame, forms: DataFrame) -> DataFrame:
    """(a_id, b_id, dist_km, title_sim, reason, matched, score) of given pairs (a_id, b_id)."""
    slim = pairs.rule_columns(forms).select(*pairs.COLUMNS)
    side = lambda name: slim.select(*[F.col(c).alias(f"{name}_{c}") for c in pairs.COLUMNS])
    joined = found.select("a_id", "b_id").join(side("a"), F.col("a_id") == F.col("a_listing_id")).join(side("b"), F.col("b_id") == F.col("b_listing_id"))
    return joined.drop("a_id", "b_id").mapInArrow(pairs.decide, pairs.DECIDED)


def clusters(nodes: DataFrame, edges: DataFrame, exclusions: DataFrame | None = None, most: int = graph.EDGES_A_TASK) -> DataFrame:
    """(listing_id, property_id): connected components of matched pairs; the smallest listing_id names a cluster.

    ``exclusions`` (a_id, b_id) hold for whole clusters: no cluster has both listings of a pair. Pairs join in the order of
    their scores (then ids), and one that would bring an excluded pair together is refused. Only components that hold an
    excluded pair are looked at that way, those of up to ``most`` pairs in one task each, larger ones in rounds.
    """
    found = graph.components(edges.select("a_id", "b_id").toDF("a", "b")).withColumnRenamed("node", "listing_id")
    if exclusions is not None:
        apart = exclusions.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
        found = _kept_apart(staged(found), edges, apart, most)
    return nodes.select("listing_id").join(found, "listing_id", "left").select("listing_id", F.coalesce("component", "listing_id").alias("property_id"))


def _kept_apart(found: DataFrame, edges: DataFrame, apart: DataFrame, most: int) -> DataFrame:
    """``found`` (listing_id, component) with the components that hold an excluded pair made anew."""
    own = lambda side: F.coalesce(F.col(f"{side}.component"), F.col({"x": "a", "y": "b"}[side]))
    of = lambda df: df.join(found.alias("x"), F.col("a") == F.col("x.listing_id"), "left").join(found.alias("y"), F.col("b") == F.col("y.listing_id"), "left")
    held = staged(of(apart).where(own("x") == own("y")).select("a", "b", own("x").alias("component")))
    torn = staged(held.select("component").distinct())
    if torn.isEmpty():
        return found
    score = F.col("score").cast("double") if "score" in edges.columns else F.lit(0.0)
    links = edges.select(F.least("a_id", "b_id").cast("long").alias("a"), F.greatest("a_id", "b_id").cast("long").alias("b"), score.alias("score"))
    links = of(links).withColumn("group", own("x")).join(torn.withColumnRenamed("component", "group"), "group", "left_semi").select("a", "b", "score", "group")
    labels = graph.merge_apart(staged(links), held.select("a", "b", F.col("component").alias("group")), most)
    return found.join(torn, "component", "left_anti").select("listing_id", "component").unionByName(labels.select(F.col("node").alias("listing_id"), "component"))


def golden(listings: DataFrame) -> DataFrame:
    """One canonical record per property_id of ``listings`` (with property_id, is_active, ignored, url).

    One partially aggregated pass: ordered picks are minima and maxima of structs whose last field is the listing_id.
    """
    recency = F.coalesce(F.col("source_refreshed_at"), F.col("last_seen_at")) if "source_refreshed_at" in listings.columns else F.col("last_seen_at")
    flags = listings.groupBy("property_id").agg(
        F.min("ignored").alias("all_ignored"), F.max("is_active").alias("any"), F.max(F.when(~F.col("ignored"), F.col("is_active"))).alias("any_kept"))
    flags = flags.select("property_id", "all_ignored", F.coalesce(F.when(F.col("all_ignored"), F.col("any")).otherwise(F.col("any_kept")), F.lit(False)).alias("any_active"))
    rows = listings.join(flags, "property_id").withColumn("in_pool", F.col("all_ignored") | ~F.col("ignored"))
    rows = rows.withColumn("in_base", F.col("in_pool") & (F.col("is_active") | ~F.col("any_active"))).withColumn("recency", recency)
    newest = [F.col("recency"), -F.col("listing_id")]
    pick = lambda value, cond, *order: F.max_by(value, F.when(F.col("in_base") & cond, F.struct(*order, *newest)))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    district = F.col("district") if "district" in listings.columns else F.lit(None).cast("string").alias("district")
    exact = F.when(F.col("location_precision") == "exact", 1).otherwise(0).alias("exact")
    private = F.when(F.col("is_private"), 1).otherwise(0).alias("private")
    best = pick(F.struct("kind", "title", "url", "city", district), F.lit(True), private)
    at = pick(F.struct("lat", "lon", "location_precision", "location_radius_km"), located, exact)
    in_pool, in_base = F.col("in_pool"), F.col("in_base")
    links = F.collect_list(F.when(in_pool, F.struct(F.when(F.col("is_active"), 0).otherwise(1).alias("idle"), (-F.unix_micros(F.col("recency").cast("timestamp"))).alias("age"), "listing_id", "source", "url", F.col("is_active").alias("active"))))
    out = rows.groupBy("property_id").agg(
        best.alias("best"), pick(F.col("city"), F.col("city").isNotNull()).alias("any_city"), pick(district, district.isNotNull()).alias("any_district"), at.alias("place"),
        pick(F.col("area_m2"), F.col("area_m2").isNotNull()).alias("area_m2"), pick(F.col("plot_area_m2"), F.col("plot_area_m2").isNotNull()).alias("plot_area_m2"),
        F.min(F.when(in_base, F.col("price"))).alias("price"), F.min(F.when(in_pool, F.col("price"))).alias("price_min"), F.max(F.when(in_pool, F.col("price"))).alias("price_max"),
        F.max(F.when(in_base, F.col("is_private"))).alias("is_private"), F.array_sort(F.collect_set(F.when(in_pool, F.col("source")))).alias("sources"), links.alias("links"),
        F.count("*").alias("listing_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max(F.when(in_pool, F.col("is_active"))).alias("is_active"), F.min("ignored").alias("ignored"),
    )
    return out.select(
        "property_id", "best.kind", "best.title", "best.url", F.coalesce("best.city", "any_city").alias("city"), F.coalesce("best.district", "any_district").alias("district"), "place.lat", "place.lon",
        F.coalesce("place.location_precision", F.lit("unknown")).alias("location_precision"), "place.location_radius_km", "area_m2", "plot_area_m2", "price", "price_min", "price_max",
        F.when(F.col("area_m2") > 0, geo.round2(F.col("price") / F.col("area_m2"))).alias("price_per_m2"), "is_private", "sources",
        F.transform(F.array_sort("links"), lambda x: F.struct(x.source.alias("source"), x.url.alias("url"), x.active.alias("active"))).alias("links"),
        "listing_count", "first_seen_at", "last_seen_at", "is_active", "ignored",
    )


def recompute(properties: DataFrame, listings: DataFrame, touched: DataFrame) -> DataFrame:
    """``properties`` with the touched ones made anew; touched ones without listings go."""
    fresh = golden(listings.join(touched, "property_id", "left_semi"))
    return properties.join(touched, "property_id", "left_anti").unionByName(fresh)


def assign(batch: DataFrame, candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """(listing_id, property_id, reason): the property with most matches, then best score, then smallest id; else a new one.

    ``matched`` holds (listing_id, candidate_id, reason, score); ``candidates`` maps candidate_id to property_id.
    """
    votes = matched.join(candidates, "candidate_id").groupBy("listing_id", "property_id").agg(
        F.count("*").alias("votes"), F.max("score").alias("best"), F.max_by("reason", F.struct("score", -F.col("candidate_id"))).alias("reason"))
    order = Window.partitionBy("listing_id").orderBy(F.desc("votes"), F.desc("best"), "property_id")
    winners = votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("listing_id", "property_id", "reason")
    return batch.select("listing_id").join(winners, "listing_id", "left").select(
        "listing_id", F.coalesce("property_id", "listing_id").alias("property_id"), F.coalesce("reason", F.lit("new")).alias("reason"))


def apply_overrides(computed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual merges and splits pin a listing: its latest override's property wins, an unpinned listing keeps its own.

    ``overrides`` has (listing_id, action, property_id, at); a split opens a property of the listing's own.
    """
    last = overrides.groupBy("listing_id").agg(F.max_by(F.struct("action", "property_id"), F.struct("at", "action")).alias("o"))
    pinned = last.select("listing_id", F.when(F.col("o.action") == "split", F.col("listing_id")).otherwise(F.col("o.property_id")).alias("pinned"))
    return computed.join(pinned, "listing_id", "left").select("listing_id", F.coalesce("pinned", "property_id").alias("property_id"), F.col("pinned").isNotNull().alias("is_pinned"))


def reassign(listings: DataFrame, matched: DataFrame, exclusions: DataFrame | None = None, passes: int = 2, order: Column | None = None) -> DataFrame:
    """(listing_id, before, property_id): stored assignments looked at anew by votes, pass after pass until nothing moves.

    One after the other, each listing goes to the property that most of its matches are in at that moment, then the one of
    the best score, then the smallest; excluded pairs don't count. Pinned listings with a property, and listings without
    place and city, stay. A listing without a vote opens a property if it has none. Listings with one but no vote come last
    in a pass: they leave it for one of their own, but for the last one of a property that has no other listing left.
    New properties are numbered above all others by listing. ``order`` is the listings' order, by id or, by default, by a
    hash of it, ties by id: a listing waits for its earlier matches only, so all that wait for none move at once, and a
    hash keeps such chains short (in the order of a logarithm of the listings).
    """
    place = order if order is not None else F.md5(F.col("listing_id").cast("string").cast("binary"))
    still = (F.coalesce(F.col("pinned"), F.lit(False)) & F.col("property_id").isNotNull()) | (F.col("lat").isNull() & F.col("city").isNull())
    rows = staged(listings.select("listing_id", F.col("property_id").cast("long").alias("property_id"), still.alias("still"), F.struct(place.alias("place"), "listing_id").alias("place")))
    base = max(rows.agg(F.coalesce(F.max("property_id"), F.lit(0))).first()[0], 0) + 1
    counted = matched.select("a_id", "b_id", "score")
    if exclusions is not None:
        counted = counted.join(exclusions.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")), ["a_id", "b_id"], "left_anti")
    both = counted.select(F.col("a_id").alias("me"), F.col("b_id").alias("other"), "score").unionAll(counted.select("b_id", "a_id", "score"))
    side = lambda name: rows.select(F.col("listing_id").alias(name), F.col("still").alias(f"{name}_still"), F.col("place").alias(f"{name}_place"))
    arcs = both.join(side("me").where("not me_still"), "me").join(side("other"), "other")
    arcs = staged(arcs.select("me", "other", "score", (~F.col("other_still") & (F.col("other_place") < F.col("me_place"))).alias("waits")))
    levels = _levels(arcs)
    last = levels.agg(F.max("level")).first()[0] or 0
    voters = staged(arcs.join(levels, "me").select("me", "other", "score", "level"))
    held, own = rows.select("listing_id", "property_id", "still", "place"), F.lit(base) + F.col("listing_id")
    for _ in range(passes):
        before, voted = held, None
        for level in range(last + 1):
            now = held.where("property_id is not null").select(F.col("listing_id").alias("other"), F.col("property_id").alias("to"))
            votes = voters.where(F.col("level") == level).join(now, "other").groupBy("me", "to").agg(F.count("*").alias("n"), F.max("score").alias("best"))
            won = staged(votes.groupBy("me").agg(F.max_by("to", F.struct("n", "best", -F.col("to"))).alias("to")).withColumnRenamed("me", "listing_id"))
            voted = won if voted is None else voted.unionAll(won)
            due = voters.where(F.col("level") == level).select(F.col("me").alias("listing_id")).distinct().withColumn("due", F.lit(True))
            fresh = F.when(F.col("due") & F.col("property_id").isNull(), own).otherwise(F.col("property_id"))
            held = staged(held.join(won, "listing_id", "left").join(due, "listing_id", "left").select("listing_id", F.coalesce("to", fresh).alias("property_id"), "still", "place"))
        held = staged(_alone(held, voted, own))
        if held.alias("a").join(before.alias("b"), "listing_id").where(~F.col("a.property_id").eqNullSafe(F.col("b.property_id"))).isEmpty():
            break
    return rows.select("listing_id", F.col("property_id").alias("before")).join(held.select("listing_id", "property_id"), "listing_id")


def _levels(arcs: DataFrame) -> DataFrame:
    """(me, level): 0 for a listing that waits for no other, else one above the highest that it waits for."""
    left, done, level = staged(arcs.select("me").distinct()), None, 0
    waits = staged(arcs.where("waits").select("me", "other"))
    while not left.isEmpty():
        held = waits.select("me").distinct()
        ready = staged(left.join(held, "me", "left_anti").withColumn("level", F.lit(level)))
        done = ready if done is None else done.unionAll(ready)
        left = staged(left.join(held, "me", "left_semi"))
        waits = staged(waits.join(ready.select(F.col("me").alias("other")), "other", "left_anti"))
        level += 1
    return done if done is not None else arcs.select("me", F.lit(0).alias("level")).limit(0)


def _alone(held: DataFrame, voted: DataFrame | None, own: Column) -> DataFrame:
    """``held`` after its listings without a vote have left their properties, or opened one."""
    has_vote = voted.select("listing_id").withColumn("vote", F.lit(True)) if voted is not None else held.select("listing_id", F.lit(True).alias("vote")).limit(0)
    rows = held.join(has_vote, "listing_id", "left").withColumn("lone", ~F.col("still") & F.col("vote").isNull())
    of = rows.where("property_id is not null").groupBy("property_id").agg(F.min("lone").alias("only"), F.max(F.when(F.col("lone"), F.col("place"))).alias("keeps"))
    joined = rows.join(of, "property_id", "left")
    stays = ~F.col("lone") | (F.col("only") & (F.col("place") == F.col("keeps")))
    return joined.select("listing_id", F.when(F.col("property_id").isNotNull() & stays | F.col("still"), F.col("property_id")).otherwise(own).alias("property_id"), "still", "place")


def without_listings(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Properties that no listing stands for any more."""
    return properties.join(listings.select("property_id"), "property_id", "left_anti")


def merge_flags(properties: DataFrame, merges: DataFrame) -> DataFrame:
    """Properties after manual merges (target, source): flags of both, the target's note and time first; sources go.

    Several sources of one target count in order of their ids.
    """
    sides = merges.select(F.col("target").alias("into"), F.col("source").alias("property_id"), F.lit(1).alias("later")).unionByName(
        merges.select(F.col("target").alias("into"), F.col("target").alias("property_id"), F.lit(0).alias("later")).distinct())
    rows = properties.join(sides, "property_id", "left").withColumn("into", F.coalesce("into", "property_id"))
    order = F.struct("later", "property_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return rows.groupBy(F.col("into").alias("property_id")).agg(F.max("hidden").alias("hidden"), F.max("favorite").alias("favorite"), first("favorite_at"), first("note"))


def split_exclusions(listings: DataFrame, splits: DataFrame) -> DataFrame:
    """(a_id, b_id): a listing split off is kept apart from every sibling it had; each pair once."""
    left = splits.select(F.col("listing_id").alias("split_id")).distinct().join(listings.select(F.col("listing_id").alias("split_id"), "property_id"), "split_id")
    both = left.join(listings.select("listing_id", "property_id"), "property_id").where("listing_id <> split_id")
    return both.select(F.least("split_id", "listing_id").alias("a_id"), F.greatest("split_id", "listing_id").alias("b_id")).distinct()
