"""Filters, sorts and pages over listings and properties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.sources.fixtures import SOURCES

KINDS = ("plot", "house")


@dataclass(frozen=True)
class Filters:
    """Bounds that are None, and sets that are empty or full, don't filter. Flags: "exclude", "only" or "include"."""

    kinds: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    price_per_m2_max: float | None = None
    sources: tuple[str, ...] = ()
    owner: str = "all"
    added_within_days: int | None = None
    distance_km: float | None = None
    hidden: str = "include"
    ignored: str = "include"
    favorites: str = "include"
    active: str = "include"


def predicate(f: Filters, centre: tuple[float, float], now: str, sources_column: str | None = None) -> Column:
    """One condition; a null value satisfies no bound."""
    out = F.lit(True)
    col = F.col
    if f.kinds and len(f.kinds) < len(KINDS):
        out = out & col("kind").isin(*f.kinds)
    for name, bound, above in (("price", f.price_min, True), ("price", f.price_max, False), ("area_m2", f.area_min, True), ("area_m2", f.area_max, False), ("price_per_m2", f.price_per_m2_max, False)):
        if bound is not None:
            out = out & ((col(name) >= bound) if above else (col(name) <= bound))
    if f.sources and len(f.sources) < len(SOURCES):
        out = out & (F.arrays_overlap(sources_column, F.array(*map(F.lit, f.sources))) if sources_column else col("source").isin(*f.sources))
    if f.owner != "all":
        out = out & (col("is_private") == (f.owner == "private"))
    if f.added_within_days is not None:
        out = out & (col("first_seen_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {f.added_within_days} days"))
    if f.distance_km is not None:
        lat, lon = centre
        d_lat = f.distance_km * 1.01 / geo.KM_A_DEGREE  # a box first: cheap, and pushed to the scan
        out = out & col("lat").isNotNull() & col("lat").between(lat - d_lat, lat + d_lat) & (geo.cosine_km(lat, lon, col("lat"), col("lon")) <= f.distance_km)
    for name, mode in (("hidden", f.hidden), ("ignored", f.ignored)):
        if mode != "include":
            out = out & (col(name) == (mode == "only"))
    if f.favorites == "only":
        out = out & col("favorite")
    if f.active == "only":
        out = out & col("is_active")
    return out


def matches(q: str, columns: tuple[str, ...] = ("title", "city", "district")) -> Column:
    """Literal substring of title, city or district in any case, or the exact source_id."""
    out = F.col("source_id") == q
    for column in columns:
        out = out | F.coalesce(F.contains(F.lower(column), F.lit(q.lower())), F.lit(False))
    return out


def newest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("first_seen_at"), F.desc("listing_id")).limit(n)


def page(rows: DataFrame, key: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """A page of the sorted table; nulls come last either way, ties by falling id."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return rows.orderBy(order, F.desc("listing_id")).offset(offset).limit(limit)


#: Orders of the list: value, whether it falls; all put missing values last, then the newest.
VIEWS = {"price_up": ("price", False), "price_down": ("price", True), "area_down": ("area_m2", True), "price_per_m2_up": ("price_per_m2", False), "distance_up": ("km", False), "newest": ("first_seen_at", True)}


def view(rows: DataFrame, order: str, n: int) -> DataFrame:
    key, falling = VIEWS[order]
    first = F.col(key).desc_nulls_last() if falling else F.col(key).asc_nulls_last()
    return rows.orderBy(first, F.desc("first_seen_at"), F.desc("listing_id")).limit(n)


def active_first(rows: DataFrame, n: int) -> DataFrame:
    """Active listings first, then the last seen."""
    return rows.orderBy(F.desc("is_active"), F.desc("last_seen_at"), F.desc("listing_id")).limit(n)


def latest(rows: DataFrame, n: int, *first: str) -> DataFrame:
    """The latest runs by id, or the next jobs by ``first`` and id."""
    return rows.orderBy(*(F.col(c) for c in first), F.col("event_id") if first else F.desc("event_id")).limit(n)


def backlog(rows: DataFrame, n: int, attempts: int = 3) -> DataFrame:
    """Active listings without coordinates that may still be looked up, newest first."""
    return newest(rows.where(F.col("lat").isNull() & F.col("is_active") & F.col("enriched_at").isNull() & (F.col("attempts") < attempts)), n)
