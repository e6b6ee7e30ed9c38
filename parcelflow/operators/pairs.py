"""Pairs of listings looked at in blocks: a task holds the listings of some cells, forms their pairs a bounded number at a
time and lets out what is asked for. No pair is shuffled with its listings' titles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import graph
from parcelflow.sources.shared import staged

PAIRS_AT_ONCE, ROWS_A_CELL, ROWS_A_TASK, MOST_WORDS = 1 << 20, 4096, 100_000, 64
REASONS = (
    "kind", "identity_key_far", "area", "plot_area", "far", "same_point+figures", "exact+area+price", "exact+area+title", "exact+price+title", "exact_but_different",
    "approx+area+price+evidence", "approx+area+strong_title", "approx_insufficient", "unknown+area+price+title+city", "unknown_insufficient",
)
COLUMNS = ("listing_id", "kind", "lat", "lon", "exact", "radius", "area_m2", "plot_area_m2", "price", "town", "advertiser", "seller", "tokens", "keys")
Chunks = Iterator[tuple[np.ndarray, np.ndarray]]


def rule_columns(forms: DataFrame) -> DataFrame:
    """What the rules look at, of the normal forms: ``COLUMNS`` and whatever else ``forms`` hold."""
    given = forms.withColumns({
        "exact": F.coalesce(F.col("location_precision") == "exact", F.lit(False)), "radius": F.coalesce(F.col("location_radius_km").cast("double"), F.lit(0.0)),
        "price": F.col("price").cast("double"), "town": F.lower(F.trim("city"))})
    return given.select(*COLUMNS, *[c for c in forms.columns if c not in (*COLUMNS, "location_precision", "location_radius_km", "city", "bigrams")])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].cast(pa.float64()).fill_null(np.nan), dtype=np.float64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal numbers; a null has -1."""
    return np.asarray(pa.concat_arrays(column.chunks).dictionary_encode().indices.fill_null(-1), dtype=np.int64)


class Sets:
    """A small set a row; rows of equal sets have the same number in ``row``."""

    def __init__(self, row: np.ndarray, n: int, owner: np.ndarray, codes: np.ndarray, most: int):
        """``codes`` below ``most`` are held by set ``owner``, in the order of the sets."""
        self.row, self.size = row, np.bincount(owner, minlength=n)
        self.places = np.full((int(self.size.max(initial=0)), n), -1, dtype=np.int32)
        self.places[np.arange(len(codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size), owner] = codes
        words = -(-most // 64)
        self.bits = np.zeros((words if words <= MOST_WORDS else 0, n), dtype=np.uint64)
        for place in self.places if len(self.bits) else ():
            at = np.flatnonzero(place >= 0)
            self.bits[place[at] // 64, at] |= np.uint64(1) << (place[at] % 64).astype(np.uint64)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values the sets of rows ``i`` and ``j`` have in common, by bits or, where values are many, one by one."""
        i, j = self.row[i], self.row[j]
        n = np.zeros(len(i), dtype=np.int64)
        if len(self.bits):
            for word in self.bits:
                n += np.bitwise_count(word[i] & word[j])
            return n
        for k in range(len(self.places)):
            own = self.places[k][i]
            for other in self.places:
                n += (own == other[j]) & (own >= 0)
        return n

    def first_shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The first value of row ``i``'s list that row ``j`` has too, as its number; -1 for none."""
        out, i, j = np.full(len(i), -1, dtype=np.int64), self.row[i], self.row[j]
        some = np.flatnonzero((self.size[i] > 0) & (self.size[j] > 0))
        i, j = i[some], j[some]
        for k in reversed(range(len(self.places))):
            own, hit = self.places[k][i], np.zeros(len(i), dtype=bool)
            for other in self.places:
                hit |= own == other[j]
            hit &= own >= 0
            out[some[hit]] = own[hit]
        return out


def _lists(column: pa.ChunkedArray) -> tuple[Sets, pa.Array, pa.Array]:
    """Lists of distinct words as sets, the words by number, and the distinct lists."""
    lists = pa.concat_arrays(column.chunks).cast(pa.list_(pa.string()))
    _, first, row = np.unique(_codes(pa.chunked_array([pc.binary_join(lists, "\x1f")])), return_index=True, return_inverse=True)
    kept = lists.take(pa.array(first))
    held, sizes = kept.flatten().dictionary_encode(), np.asarray(pc.fill_null(pc.list_value_length(kept), 0), dtype=np.int64)
    return Sets(row, len(first), np.repeat(np.arange(len(first)), sizes), np.asarray(held.indices, dtype=np.int64), len(held.dictionary)), held.dictionary, kept


def _letter_pairs(tokens: Sets, lists: pa.Array) -> Sets:
    """As ``text.bigrams`` of the words of ``tokens``, which are ASCII."""
    joined = pc.fill_null(pc.binary_join(lists, ""), "").cast(pa.binary())
    length = np.asarray(pc.binary_length(joined), dtype=np.int64)
    letters = np.frombuffer(b"".join(joined.to_pylist()), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(joined)), length)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = np.unique(owner[inner] << 14 | letters[inner] * 128 + letters[inner + 1])
    kinds, codes = np.unique(pairs & 0x3FFF, return_inverse=True)
    return Sets(tokens.row, len(joined), pairs >> 14, codes, len(kinds))


class Points:
    """Ids, kinds, places, areas and prices of a task's rows as arrays."""

    def __init__(self, table: pa.Table):
        self.n, self.id = table.num_rows, np.asarray(table["listing_id"], dtype=np.int64)
        self.kind, self.house = _codes(table["kind"]), np.asarray(pc.fill_null(pc.equal(table["kind"], "house"), False))
        for name in ("lat", "lon", "area_m2", "price"):
            setattr(self, name, _numbers(table, name))
        self.located = ~(np.isnan(self.lat) | np.isnan(self.lon))

    def km(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``geo.haversine_km``."""
        lat1, lat2 = np.radians(self.lat[i]), np.radians(self.lat[j])
        half = np.sin(np.radians(self.lat[j] - self.lat[i]) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(self.lon[j] - self.lon[i]) / 2) ** 2
        return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(half)))


class Listings(Points):
    """The rule columns too."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        self.radius, self.plot_area_m2 = _numbers(table, "radius"), _numbers(table, "plot_area_m2")
        self.exact = np.asarray(table["exact"]) & self.located
        self.town, self.advertiser = _codes(table["town"]), _codes(table["advertiser"])
        self.tokens, _, titles = _lists(table["tokens"])
        self.bigrams = _letter_pairs(self.tokens, titles)
        self.seller, _, names = _lists(table["seller"])
        self.letters = np.asarray(pc.fill_null(pc.utf8_length(pc.binary_join(names, "")), 0), dtype=np.int64)
        self.keys, self.references, _ = _lists(table["keys"])
        self.prefix = [k.split(":")[0] for k in self.references.to_pylist()]

    def same_words(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``text.same_seller``."""
        s, a, b = self.seller, self.seller.row[i], self.seller.row[j]
        small = np.where(s.size[a] <= s.size[b], a, b)
        strong = (s.size[small] >= 2) | (self.letters[small] >= 4) | (s.size[a] == s.size[b])
        return (s.size[small] > 0) & strong & (s.shared(i, j) == s.size[small])

    def title(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``text.title_similarity``, 0 for a title of fewer than two words."""
        out, both = np.zeros(len(i)), np.flatnonzero((self.tokens.size[self.tokens.row[i]] >= 2) & (self.tokens.size[self.tokens.row[j]] >= 2))
        i, j = i[both], j[both]
        for s in (self.tokens, self.bigrams):
            total = s.size[s.row[i]] + s.size[s.row[j]]
            some = (s.size[s.row[i]] > 0) & (s.size[s.row[j]] > 0)
            out[both] = np.maximum(out[both], np.where(some, 2 * s.shared(i, j).astype(np.float64) / np.maximum(total, 1), 0.0))
        return out


def within(a: np.ndarray, b: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(yes, no): whether the relative difference is at most ``tolerance``; neither if a side is null."""
    known, larger = ~(np.isnan(a) | np.isnan(b)), np.maximum(np.abs(a), np.abs(b))
    with np.errstate(invalid="ignore", divide="ignore"):
        near = (larger == 0) | (np.abs(a - b) / larger <= tolerance)
    return known & near, known & ~near


class Decided:
    """The rule tree over pairs (``i``, ``j``) of ``of``: reason, match and score."""

    def __init__(self, of: Listings, i: np.ndarray, j: np.ndarray):
        self.of, self.i, self.j = of, i, j
        located, house = of.located[i] & of.located[j], of.house[i]
        exact = of.exact[i] & of.exact[j]
        self.dist = dist = np.where(located, of.km(i, j), 0.0)
        self.key = key = of.keys.first_shared(i, j)
        self.t = t = of.title(i, j)
        seller = ((of.advertiser[i] == of.advertiser[j]) & (of.advertiser[i] >= 0)) | of.same_words(i, j)
        price, price_no = within(of.price[i], of.price[j], 0.03)
        yes3, no3 = within(of.area_m2[i], of.area_m2[j], 0.03)
        yes5, no5 = within(of.area_m2[i], of.area_m2[j], 0.05)
        area, area_no = np.where(house, yes5, yes3), np.where(house, no5, no3)
        loose = area_no & house & price & (seller | (t >= 0.6)) & within(of.area_m2[i], of.area_m2[j], 0.2)[0]
        area, area_no = area | loose, area_no & ~loose
        limit = np.maximum(2.0, np.maximum(of.radius[i], of.radius[j]))
        same_exact = exact & (dist <= 0.15)
        near = located & ~same_exact & (dist <= np.where(exact, 1.0, limit))
        plot_no = house & within(of.plot_area_m2[i], of.plot_area_m2[j], 0.05)[1]
        figures = price & (of.price[i] == of.price[j]) & within(of.area_m2[i], of.area_m2[j], 0.01)[0]
        city = (of.town[i] == of.town[j]) & (of.town[i] >= 0)
        rules = [
            (of.kind[i] != of.kind[j], "kind"), ((key >= 0) & located & (dist > 5), "identity_key_far"), (key >= 0, "identity"), (area_no, "area"),
            (plot_no & ~(loose | (same_exact & price & area)), "plot_area"), (located & ~same_exact & ~near, "far"), (located & (dist <= 0.1) & figures & area, "same_point+figures"),
            (same_exact & area & ~price_no, "exact+area+price"), (same_exact & area & (t >= 0.6), "exact+area+title"), (same_exact & ~area & ~area_no & price & (t >= 0.5), "exact+price+title"),
            (same_exact, "exact_but_different"), (near & area & price & ((t >= 0.5) | seller | (figures & (t >= 0.3))), "approx+area+price+evidence"), (near & area & (t >= 0.75), "approx+area+strong_title"),
            (near, "approx_insufficient"), (area & price & city & ((t >= 0.6) | (seller & (t >= 0.3))), "unknown+area+price+title+city"),
        ]
        self.names = [*REASONS, *(f"{r}+area_loose" for r in REASONS), *(f"identity:{p}" for p in of.prefix)]
        number = {r: k for k, r in enumerate(REASONS)} | {"identity": -1}
        code = np.select([c for c, _ in rules], [number[r] for _, r in rules], number["unknown_insufficient"])
        by_key = code < 0
        self.matched = by_key | np.array(["+" in r for r in REASONS])[code]
        self.code = np.where(by_key, 2 * len(REASONS) + key, code + np.where(loose & self.matched, len(REASONS), 0))
        score = 1 + t + 0.5 * price + 0.25 * seller - np.minimum(dist, 10.0) / 10 - 0.3 * loose
        self.score = np.where(by_key, 5 - np.minimum(dist, 5.0) / 10, np.where(self.matched, score, 0.0))

    def reasons(self, kept: np.ndarray | slice = slice(None)) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.code[kept]))


def possible(of: Listings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs without a shared key that the rules on area and price don't refuse already."""
    house, price = of.house[i], within(of.price[i], of.price[j], 0.03)[0]
    refused = np.where(house, within(of.area_m2[i], of.area_m2[j], 0.05)[1] & ~price, within(of.area_m2[i], of.area_m2[j], 0.03)[1])
    return ~refused & (of.keys.first_shared(i, j) < 0)


def meeting(cell: np.ndarray, asks: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, by: np.ndarray | None = None) -> Chunks:
    """Chunks (i, j) of rows that ask and rows of the same cell that are there, whose ``value`` lies in the asking row's
    [low, high]. The rows there come in the order of ``value``."""
    there, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    levels = np.unique(value[there])
    there = there[np.lexsort((value[there], cell[there]))]
    step = len(levels) + 1
    place = cell[there] * step + np.searchsorted(levels, value[there])
    first = np.searchsorted(place, cell[asking] * step + np.searchsorted(levels, low[asking], "left"))
    last = np.maximum(first, np.searchsorted(place, cell[asking] * step + np.searchsorted(levels, high[asking], "right")))
    count = last - first
    ends, at = np.cumsum(count), 0
    while at < len(asking):
        begun = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + PAIRS_AT_ONCE, "right")))
        n = count[at:to]
        if n.sum():
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(asking[at:to], n), there[np.repeat(first[at:to], n) + offset]
        at = to


def dealt(asking: DataFrame, there: DataFrame, keys: list[str], rows: int, split: bool = True) -> DataFrame:
    """Rows that ask and rows that are there, flagged and dealt by cell.

    If ``split``, the asking rows of a cell with many rows there are dealt over several tasks, and the rows there are
    copied to each. ``rows`` is about how many rows there are in all.
    """
    cell = F.concat_ws(":", *keys).alias("cell")
    asking, there = (df.select("*", cell).drop(*[k for k in keys if k not in (*COLUMNS, "key")]) for df in (asking, there))
    asking, there = asking.withColumn("asks", F.lit(True)), there.withColumn("asks", F.lit(False))
    if split:
        sizes = staged(there.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_A_CELL).cast("int").alias("parts")).where("parts > 1"))
        parts = F.coalesce("parts", F.lit(1))
        asking = asking.join(sizes, "cell", "left").withColumn("part", F.pmod(F.xxhash64("listing_id"), parts).cast("int")).drop("parts")
        there = there.join(sizes, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        asking, there = asking.withColumn("part", F.lit(0)), there.withColumn("part", F.lit(0))
    tasks = max(int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
    return asking.unionByName(there).repartition(tasks, "cell", "part")


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A task's rows; None for none."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def in_blocks(blocks: DataFrame, chunks: Callable[..., Chunks], out: Callable[..., Iterator[pa.RecordBatch]], schema: str, of: type[Points] = Listings) -> DataFrame:
    """``out`` of the pairs that ``chunks`` forms in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gather(batches)
        if table is not None:
            rows = of(table)
            yield from out(rows, chunks(table, rows))

    return blocks.mapInArrow(run, schema)


def cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's cell and part, and whether it asks."""
    part = np.asarray(table["part"], dtype=np.int64)
    return _codes(table["cell"]) * (part.max() + 1) + part, np.asarray(table["asks"])


def at_place(table: pa.Table, of: Listings) -> Chunks:
    """Located pairs with areas that the rules can match, in grids as wide as the wider reach of both."""
    cell, asks = cells(table)
    reach, tolerance = np.asarray(table["reach"], dtype=np.int64), np.where(of.house, 0.2, 0.03)
    for i, j in meeting(cell, asks, of.area_m2, of.area_m2 * (1 - tolerance) * (1 - 1e-9), of.area_m2 / (1 - tolerance) * (1 + 1e-9)):
        kept = (reach[j] < reach[i]) | (of.id[i] < of.id[j])
        limit = np.where(of.exact[i] & of.exact[j], 1.0, np.maximum(2.0, np.maximum(of.radius[i], of.radius[j])))
        kept &= np.abs(of.lat[i] - of.lat[j]) * geo.KM_A_DEGREE <= limit * 1.01
        i, j, limit = i[kept], j[kept], limit[kept]
        kept = (of.id[i] != of.id[j]) & within(of.area_m2[i], of.area_m2[j], 0.2)[0] & (np.abs(of.area_m2[i] - of.area_m2[j]) / np.maximum(of.area_m2[i], of.area_m2[j]) <= tolerance[i])
        i, j, limit = i[kept], j[kept], limit[kept]
        kept = of.km(i, j) <= limit
        yield i[kept], j[kept]


def on_spot(table: pa.Table, of: Listings) -> Chunks:
    """Pairs within 150 m of which the asking side, or both, lacks an area."""
    cell, asks = cells(table)
    whole, bare = np.zeros(of.n), np.isnan(of.area_m2)
    for i, j in meeting(cell, asks, whole, whole, whole):
        kept = (~bare[j] | (of.id[i] < of.id[j])) & (of.km(i, j) <= 0.15)
        yield i[kept], j[kept]


def in_town(table: pa.Table, of: Listings) -> Chunks:
    """Pairs of one town of which the asking side, or both, lacks a place."""
    cell, asks = cells(table)
    tolerance = np.where(of.house, 0.2, 0.03)
    for i, j in meeting(cell, asks, of.area_m2, of.area_m2 * (1 - tolerance) * (1 - 1e-9), of.area_m2 / (1 - tolerance) * (1 + 1e-9)):
        kept = (of.located[j] | (of.id[i] < of.id[j])) & within(of.price[i], of.price[j], 0.03)[0] & within(of.area_m2[i], of.area_m2[j], 0.2)[0]
        kept &= np.abs(of.area_m2[i] - of.area_m2[j]) / np.maximum(of.area_m2[i], of.area_m2[j]) <= tolerance[i]
        yield i[kept], j[kept]


def by_key(table: pa.Table, of: Listings) -> Chunks:
    """Pairs of one kind with a shared key, each at the first that they share."""
    cell, asks = cells(table)
    whole = np.zeros(of.n)
    own = np.asarray(pc.index_in(table["key"], value_set=of.references).fill_null(-1), dtype=np.int64)
    for i, j in meeting(cell, asks, whole, whole, whole):
        kept = of.id[i] < of.id[j]
        i, j = i[kept], j[kept]
        kept = of.keys.first_shared(i, j) == own[i]
        yield i[kept], j[kept]


def alike(table: pa.Table, of: Points, km: float, tolerance: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs are of different sources and properties, near, and alike in price and area."""
    source, owner = _codes(table["source"]), _codes(table["property_id"])

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        kept = (source[i] != source[j]) & (owner[i] != owner[j]) & (owner[i] >= 0) & (owner[j] >= 0) & (np.abs(of.lat[i] - of.lat[j]) * geo.KM_A_DEGREE <= km * 1.01)
        for v in (of.area_m2, of.price):
            kept &= np.abs(v[i] - v[j]) / np.maximum(v[i], v[j]) <= tolerance
        some = np.flatnonzero(kept)
        kept[some] = of.km(i[some], j[some]) <= km
        return kept

    return run


def suspected(km: float, tolerance: float) -> Callable[..., Chunks]:
    """Pairs that are ``alike``, each once."""

    def run(table: pa.Table, of: Points) -> Chunks:
        cell, asks = cells(table)
        same = alike(table, of, km, tolerance)
        for i, j in meeting(cell, asks, of.area_m2, of.area_m2 * (1 - tolerance) * (1 - 1e-9), of.area_m2 / (1 - tolerance) * (1 + 1e-9)):
            kept = of.id[i] < of.id[j]
            i, j = i[kept], j[kept]
            kept = same(i, j)
            yield i[kept], j[kept]

    return run


def least(km: float, tolerance: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(probe, candidate): of every row that asks the ``most`` smallest ids of its cell that are ``alike``.

    The rows there are looked at in the order of their ids, more and more at once, until a row that asks has its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gather(batches)
        if table is None:
            return
        of = Points(table)
        cell, asks = cells(table)
        same, asking, there = alike(table, of, km, tolerance), np.flatnonzero(asks), np.flatnonzero(~asks)
        there = there[np.lexsort((of.id[there], cell[there]))]
        at, end = np.searchsorted(cell[there], cell[asking], "left"), np.searchsorted(cell[there], cell[asking], "right")
        best, found = np.full((len(asking), most), -1, dtype=np.int64), np.zeros(len(asking), dtype=np.int64)
        going, width = np.flatnonzero(at < end), 64
        while len(going):
            for part in np.array_split(going, -(-len(going) * width // PAIRS_AT_ONCE)):
                n = np.minimum(end[part] - at[part], width)
                own, offset = np.repeat(part, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                other = there[at[own] + offset]
                hit = same(asking[own], other)
                own, other = own[hit], of.id[other[hit]]
                place = found[own] + np.arange(len(own)) - np.searchsorted(own, own)
                kept = place < most
                best[own[kept], place[kept]] = other[kept]
                found += np.bincount(own, minlength=len(found))
            at[going] += width
            going, width = going[(found[going] < most) & (at[going] < end[going])], min(2 * width, ROWS_A_CELL)
        has = best >= 0
        if has.any():
            yield _batch(probe=np.repeat(of.id[asking], has.sum(axis=1)), candidate=best[has])

    return run


def _counted(of: Points, asking: np.ndarray, there: np.ndarray, boxed: bool) -> pa.RecordBatch:
    """Of every asking row the rows there that are its candidates: their number, smallest and largest id.

    The asking rows are taken by area, some at once, against all rows there that some of them can have.
    """
    high, wide = 10.0 / geo.KM_A_DEGREE, 10.0 / (geo.KM_A_DEGREE * np.maximum(0.2, np.cos(np.radians(of.lat))))
    below, above = np.where(of.house, 0.75, 0.94), np.where(of.house, 1.25, 1.06)
    low, top = (np.where(np.isnan(of.area_m2), far, of.area_m2 * f) for far, f in ((-np.inf, below), (np.inf, above)))
    asking, there = asking[np.argsort(of.area_m2[asking])], there[np.argsort(of.area_m2[there])]
    area, n = of.area_m2[there], np.zeros(len(asking), dtype=np.int64)
    known, first, last = int(np.isfinite(area).sum()), np.zeros(len(asking), dtype=np.int64), np.zeros(len(asking), dtype=np.int64)
    for k in range(0, len(asking), 256):
        a = asking[k : k + 256]
        b = there[np.r_[np.searchsorted(area[:known], low[a].min()) : np.searchsorted(area[:known], top[a].max(), "right"), known : len(there)]]
        b = b[np.argsort(of.id[b])]
        if boxed:
            b = b[(of.lat[b] >= of.lat[a].min() - high * 1.01) & (of.lat[b] <= of.lat[a].max() + high * 1.01)]
        if not len(b):
            continue
        bare, values = np.isnan(of.area_m2[b]), of.area_m2[b][None, :]
        met = (values >= low[a][:, None]) & (values <= top[a][:, None])
        met[:, bare] = True
        if boxed:
            met &= np.abs(of.lat[b][None, :] - of.lat[a][:, None]) <= high
            met &= np.abs(of.lon[b][None, :] - of.lon[a][:, None]) <= wide[a][:, None]
        own = np.minimum(np.searchsorted(of.id[b], of.id[a]), len(b) - 1)
        met[np.arange(len(a)), own] &= of.id[b][own] != of.id[a]
        n[k : k + 256] = np.count_nonzero(met, axis=1)
        first[k : k + 256], last[k : k + 256] = of.id[b][met.argmax(axis=1)], of.id[b][len(b) - 1 - met[:, ::-1].argmax(axis=1)]
    has = n > 0
    return _batch(probe=of.id[asking[has]], n=n[has], first=first[has], last=last[has])


def candidates_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(probe, n, first, last) of every asking row and cell; ``boxed`` cells are places, the others towns."""
    table = gather(batches)
    if table is None:
        return
    of, boxed = Points(table), np.asarray(table["boxed"])
    cell, asks = cells(table)
    order = np.argsort(cell, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        asking, there = rows[asks[rows]], rows[~asks[rows]]
        if len(asking) and len(there):
            yield _counted(of, asking, there, bool(boxed[rows[0]]))


MATCHES = "a_id long, b_id long, reason string, score double"
DECIDED = "a_id long, b_id long, dist_km double, title_sim double, reason string, matched boolean, score double"


def _batch(**columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _decided(of: Listings, chunks: Chunks) -> Iterator[Decided]:
    """The rules on every chunk, the smaller id first; pairs that have a shared key are left to ``by_key``."""
    for i, j in chunks:
        if len(i):
            yield Decided(of, np.where(of.id[i] < of.id[j], i, j), np.where(of.id[i] < of.id[j], j, i))


def without_keys(chunks: Callable[..., Chunks]) -> Callable[..., Chunks]:
    """``chunks`` without pairs that ``by_key`` forms and those that the rules refuse at a glance."""

    def run(table: pa.Table, of: Listings) -> Chunks:
        for i, j in chunks(table, of):
            kept = possible(of, i, j)
            yield i[kept], j[kept]

    return run


def matches_out(of: Listings, chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """Rows of ``MATCHES``."""
    for d in _decided(of, chunks):
        m = np.flatnonzero(d.matched)
        if len(m):
            yield _batch(a_id=of.id[d.i[m]], b_id=of.id[d.j[m]], reason=d.reasons(m), score=d.score[m])


def forest_out(of: Listings, chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """(a, b): links that connect the listings that a task's matches connect, one a listing at most."""
    nodes, at = np.unique(of.id, return_inverse=True)
    member, root = graph.forest(len(nodes), ((at[d.i[d.matched]], at[d.j[d.matched]]) for d in _decided(of, chunks)))
    if len(member):
        yield _batch(a=nodes[root], b=nodes[member])


def reasons_out(of: Listings, chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """(reason, n): how many pairs each rule decides."""
    counts: dict[str, int] = {}
    for d in _decided(of, chunks):
        for code, n in zip(*(x.tolist() for x in np.unique(d.code, return_counts=True)), strict=True):
            counts[d.names[code]] = counts.get(d.names[code], 0) + n
    if counts:
        yield _batch(reason=pa.array(list(counts), pa.string()), n=np.array(list(counts.values()), dtype=np.int64))


def distances_out(of: Points, chunks: Chunks) -> Iterator[pa.RecordBatch]:
    """(a_id, b_id, dist_km), the smaller id first."""
    for i, j in chunks:
        if len(i):
            yield _batch(a_id=np.minimum(of.id[i], of.id[j]), b_id=np.maximum(of.id[i], of.id[j]), dist_km=of.km(i, j))


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs, the sides' rule columns as a_ and b_, to ``DECIDED``."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            of = Listings(pa.concat_tables([pa.table({c: table[f"{side}_{c}"] for c in COLUMNS}) for side in ("a", "b")]))
            d = Decided(of, np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows)
            yield _batch(a_id=table["a_listing_id"].combine_chunks(), b_id=table["b_listing_id"].combine_chunks(), dist_km=d.dist, title_sim=d.t, reason=d.reasons(), matched=d.matched, score=d.score)
