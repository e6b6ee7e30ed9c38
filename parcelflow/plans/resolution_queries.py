"""Normal forms, candidate pairs, decisions, clusters, golden records and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geo, text
from parcelflow.operators import alerts, blocking, resolve
from parcelflow.sources.shared import staged
from parcelflow.sources.fixtures import CUR_SQL, NOW, SEARCHES_SQL, current, observations, saved_searches

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _quoted(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _tokens_sql(column: str, least: int, drop) -> str:
    """Distinct words in order; list_distinct loses the order, so positions keep it."""
    split = f"string_split(trim(regexp_replace(translate(lower({column}), '{text.MARKED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    kept = f"list_filter({split}, lambda w: length(w) >= {least} AND NOT list_contains({_quoted(drop)}, w))"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


FORMS_SQL = CUR_SQL + f""",
f0 AS (SELECT *, {_tokens_sql('title', 3, text.TITLE_STOPWORDS)} AS tokens, {_tokens_sql('advertiser_name', 2, text.SELLER_NOISE)} AS seller FROM cur),
forms AS (SELECT *, array_to_string(tokens, '') AS joined, coalesce(lower(trim(advertiser_id)), lower(trim(advertiser_name))) AS advertiser,
  list_filter(['mg:' || internal_id, CASE WHEN length(external_id) >= 5 THEN 'ref:' || lower(external_id) END, 'ref:' || replace(offer_number, ' ', '')], lambda k: k IS NOT NULL) AS keys FROM f0),
g AS (SELECT *, CASE WHEN length(joined) >= 2 THEN list_distinct(list_transform(range(1, length(joined)), lambda k: substring(joined, CAST(k AS INT), 2))) ELSE [] END AS bigrams FROM forms)"""


def _dice_sql(a: str, b: str) -> str:
    return f"(2*CAST(len(list_intersect({a},{b})) AS DOUBLE)/(len({a})+len({b})))"


_T = f"CASE WHEN len(a.tokens)>=2 AND len(b.tokens)>=2 THEN greatest({_dice_sql('a.tokens','b.tokens')},{_dice_sql('a.bigrams','b.bigrams')}) ELSE 0 END"
_HAV = geo.HAVERSINE_SQL.format(a="a.", b="b.")


def _tol(c: str, t: float) -> str:
    return f"CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN NULL WHEN greatest(abs(a.{c}),abs(b.{c}))=0 THEN TRUE ELSE CAST(abs(a.{c}-b.{c}) AS DOUBLE)/greatest(abs(a.{c}),abs(b.{c})) <= CAST({t} AS DOUBLE) END"


_SELLER = """(coalesce(a.advertiser = b.advertiser, FALSE) OR (len(a.seller) > 0 AND len(b.seller) > 0 AND len(list_intersect(a.seller, b.seller)) = least(len(a.seller), len(b.seller))
  AND (least(len(a.seller), len(b.seller)) >= 2 OR length(array_to_string(CASE WHEN len(a.seller) <= len(b.seller) THEN a.seller ELSE b.seller END, '')) >= 4 OR len(a.seller) = len(b.seller))))"""
# Pairs no rule can match are left out first: same shape of conditions as the blocks, as one theta join.
PAIRS_SQL = FORMS_SQL + f""",
slim AS (SELECT listing_id, kind, lat, lon, location_precision, location_radius_km, area_m2, price, lower(trim(city)) AS town, keys, CAST(floor(lat/0.02) AS INT) AS y FROM g),
keys_of AS (SELECT listing_id, kind, unnest(keys) AS ref FROM slim),
near AS (SELECT a.listing_id AS a_id, b.listing_id AS b_id FROM slim a JOIN (SELECT *, unnest([y-1,y,y+1]) AS yy FROM slim) b ON a.kind=b.kind AND a.y=b.yy AND a.listing_id<b.listing_id
  WHERE abs(a.area_m2-b.area_m2)/greatest(a.area_m2,b.area_m2) <= CASE WHEN a.kind='house' THEN 0.2 ELSE 0.03 END AND abs(a.lon-b.lon) <= 0.05
    AND {_HAV} <= CASE WHEN a.location_precision='exact' AND b.location_precision='exact' THEN 1 ELSE greatest(2, a.location_radius_km, b.location_radius_km) END),
town AS (SELECT a.listing_id AS a_id, b.listing_id AS b_id FROM slim a JOIN slim b ON a.kind=b.kind AND a.town=b.town AND a.listing_id<b.listing_id
  WHERE (a.lat IS NULL OR b.lat IS NULL) AND abs(a.area_m2-b.area_m2)/greatest(a.area_m2,b.area_m2) <= CASE WHEN a.kind='house' THEN 0.2 ELSE 0.03 END AND {_tol('price', 0.03)}),
keyed AS (SELECT a.listing_id AS a_id, b.listing_id AS b_id FROM keys_of a JOIN keys_of b ON a.kind=b.kind AND a.ref=b.ref AND a.listing_id<b.listing_id),
pairs AS (SELECT * FROM near UNION SELECT * FROM town UNION SELECT * FROM keyed),
p1 AS (SELECT a_id, b_id, a.kind='house' AS house, a.lat IS NOT NULL AND b.lat IS NOT NULL AS located, a.location_precision='exact' AND b.location_precision='exact' AS pins,
    CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN {_HAV} ELSE 0 END AS dist, list_filter(a.keys, lambda k: list_contains(b.keys, k))[1] AS same_ref, {_SELLER} AS seller, {_tol('price', 0.03)} AS price_ok, a.price=b.price AS price_equal,
    CASE WHEN a.kind='house' THEN {_tol('area_m2', 0.05)} ELSE {_tol('area_m2', 0.03)} END AS area_raw, {_tol('area_m2', 0.2)} AS area20, {_tol('area_m2', 0.01)} AS area1,
    CASE WHEN a.kind='house' THEN {_tol('plot_area_m2', 0.05)} END AS plot_ok, coalesce(lower(trim(a.city))=lower(trim(b.city)),FALSE) AS same_city,
    greatest(a.location_radius_km,b.location_radius_km,2) AS lim, {_T} AS t
  FROM pairs JOIN g a ON a_id=a.listing_id JOIN g b ON b_id=b.listing_id),
p2 AS (SELECT *, coalesce(NOT area_raw,FALSE) AND house AND coalesce(price_ok,FALSE) AND (seller OR t>=0.6) AND coalesce(area20,FALSE) AS loose, located AND pins AS exact FROM p1),
p3 AS (SELECT *, CASE WHEN loose THEN TRUE ELSE area_raw END AS area_ok, coalesce(price_ok,FALSE) AS price,
  CASE WHEN NOT located THEN 'unknown' WHEN exact THEN CASE WHEN dist<=0.15 THEN 'same_exact' WHEN dist<=1 THEN 'near_approx' ELSE 'far' END WHEN dist<=lim THEN 'near_approx' ELSE 'far' END AS geo FROM p2),
p4 AS (SELECT *, coalesce(area_ok,FALSE) AS area, price AND coalesce(price_equal,FALSE) AND coalesce(area1,FALSE) AS figures FROM p3),
p5 AS (SELECT *, CASE WHEN same_ref IS NOT NULL THEN CASE WHEN located AND dist>5 THEN 'identity_key_far' ELSE 'identity:' || split_part(same_ref, ':', 1) END
  WHEN coalesce(NOT area_ok,FALSE) THEN 'area'
  WHEN coalesce(NOT plot_ok,FALSE) AND NOT (loose OR (exact AND dist<=0.15 AND price AND area)) THEN 'plot_area'
  WHEN geo='far' THEN 'far'
  WHEN located AND dist<=0.1 AND figures AND area THEN 'same_point+figures'
  WHEN geo='same_exact' THEN CASE WHEN area AND coalesce(price_ok,TRUE) THEN 'exact+area+price' WHEN area AND t>=0.6 THEN 'exact+area+title' WHEN area_ok IS NULL AND price AND t>=0.5 THEN 'exact+price+title' ELSE 'exact_but_different' END
  WHEN geo='near_approx' THEN CASE WHEN area AND price AND (t>=0.5 OR seller OR (figures AND t>=0.3)) THEN 'approx+area+price+evidence' WHEN area AND t>=0.75 THEN 'approx+area+strong_title' ELSE 'approx_insufficient' END
  WHEN area AND price AND same_city AND (t>=0.6 OR (seller AND t>=0.3)) THEN 'unknown+area+price+title+city' ELSE 'unknown_insufficient' END AS r FROM p4),
decided AS (SELECT a_id, b_id, dist, t, loose, (r LIKE '%+%' OR r LIKE 'identity:%') AS matched, CASE WHEN r LIKE '%+%' AND loose THEN r || '+area_loose' ELSE r END AS reason,
  CASE WHEN r LIKE 'identity:%' THEN 5-least(dist,5)/10 WHEN r LIKE '%+%' THEN 1+t+CASE WHEN price THEN 0.5 ELSE 0 END+CASE WHEN seller THEN 0.25 ELSE 0 END-least(dist,10)/10-CASE WHEN loose THEN 0.3 ELSE 0 END ELSE 0 END AS score FROM p5)"""
CLUSTERS_SQL = "WITH RECURSIVE " + PAIRS_SQL + """,
e AS MATERIALIZED (SELECT a_id AS x, b_id AS y FROM decided WHERE matched UNION SELECT b_id, a_id FROM decided WHERE matched),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
comp AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
clusters AS (SELECT listing_id, coalesce(m, listing_id) AS property_id FROM cur LEFT JOIN comp ON x = listing_id)"""


def _forms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cur = staged(current(spark, d))
    return cur, resolve.normal_forms(cur)


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cur, forms = _forms(spark, d)
    return cur, resolve.matches(forms)


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cur, forms = _forms(spark, d)
    return cur, resolve.clusters(cur, resolve.links(forms))


@query(f"WITH {FORMS_SQL} SELECT listing_id, array_to_string(tokens, ' ') AS title_norm, len(bigrams) AS n_bigrams FROM g")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    forms = resolve.normal_forms(current(spark, d))
    return forms.select("listing_id", F.array_join("tokens", " ").alias("title_norm"), F.size("bigrams").alias("n_bigrams"))


@query(f"""WITH {FORMS_SQL} SELECT a.listing_id AS a_id, b.listing_id AS b_id, round({_T}, 9) AS title_sim FROM g a JOIN g b ON a.source_id = b.source_id AND a.listing_id < b.listing_id""")
def title_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    forms = resolve.normal_forms(current(spark, d)).withColumn("part", F.floor(F.col("listing_id") / 10))
    a, b = forms.alias("a"), forms.alias("b")
    sim = F.coalesce(text.title_similarity(F.col("a.tokens"), F.col("b.tokens"), F.col("a.bigrams"), F.col("b.bigrams")), F.lit(0.0))
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.listing_id") < F.col("b.listing_id")))
    return pairs.select(F.col("a.listing_id").alias("a_id"), F.col("b.listing_id").alias("b_id"), F.round(sim, 9).alias("title_sim"))


@query(f"""WITH s AS (SELECT s_suppkey, {_tokens_sql("CASE WHEN s_suppkey % 2 = 0 THEN n_name || ' real estate' ELSE n_name || ' Team' || CAST(s_suppkey % 7 AS VARCHAR) END", 2, text.SELLER_NOISE)} AS seller FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT a.s_suppkey AS a_id, b.s_suppkey AS b_id FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey AND len(a.seller) > 0 AND len(b.seller) > 0
  AND len(list_intersect(a.seller, b.seller)) = least(len(a.seller), len(b.seller))
  AND (least(len(a.seller), len(b.seller)) >= 2 OR len(a.seller) = len(b.seller) OR length(CASE WHEN len(a.seller) < len(b.seller) THEN a.seller[1] ELSE b.seller[1] END) >= 4)""")
def seller_match(spark: SparkSession, d: str) -> DataFrame:
    s, n = spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    team = F.concat(F.lit("Team"), (F.col("s_suppkey") % 7).cast("string"))
    name = F.concat_ws(" ", "n_name", F.when(F.col("s_suppkey") % 2 == 0, "real estate").otherwise(team))
    named = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", text.seller_tokens(name).alias("seller"))
    return blocking.same_sellers(named, "s_suppkey")


@query(f"""WITH {FORMS_SQL} , k AS (SELECT listing_id, source, unnest(keys) AS ref FROM g) SELECT a.listing_id AS a_id, b.listing_id AS b_id, a.ref AS key FROM k a JOIN k b ON a.ref = b.ref AND a.listing_id < b.listing_id WHERE NOT (a.source = 'olx' AND b.source = 'gratka') AND NOT (a.source = 'gratka' AND b.source = 'olx')""")
def identity_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    keys = text.identity_keys(F.col("internal_id"), F.col("external_id"), F.col("offer_number"))
    forms = staged(current(spark, d).select("listing_id", "source", keys.alias("keys")))
    pairs = blocking.shared_keys(forms)
    sides = forms.where("source in ('olx', 'gratka')").select("listing_id", "source", F.explode("keys").alias("key"))
    olx, gratka = sides.where("source = 'olx'"), sides.where("source = 'gratka'")
    excluded = olx.join(gratka.select(F.col("listing_id").alias("other"), "key"), "key").select(F.least("listing_id", "other").alias("a_id"), F.greatest("listing_id", "other").alias("b_id"))
    return pairs.join(excluded, ["a_id", "b_id"], "left_anti").select("a_id", "b_id", "key")


_BOX = "abs(b.lat-a.lat) <= CAST(10 AS DOUBLE)/111.32 AND abs(b.lon-a.lon) <= CAST(10 AS DOUBLE)/(CAST(111.32 AS DOUBLE)*greatest(CAST(0.2 AS DOUBLE),cos(radians(a.lat))))"


@query(f"""WITH {FORMS_SQL}, c AS (SELECT a.listing_id AS probe, b.listing_id AS candidate FROM g a JOIN g b ON a.kind=b.kind AND a.listing_id<>b.listing_id AND b.valid_to >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY
  AND ((a.lat IS NOT NULL AND b.lat IS NOT NULL AND {_BOX}) OR ((a.lat IS NULL OR b.lat IS NULL) AND lower(a.city)=lower(b.city)))
  AND b.area_m2 BETWEEN a.area_m2*CASE WHEN a.kind='house' THEN 0.75 ELSE 0.94 END AND a.area_m2*CASE WHEN a.kind='house' THEN 1.25 ELSE 1.06 END
  UNION SELECT a.listing_id, b.listing_id FROM g a JOIN g b ON a.kind=b.kind AND a.listing_id<>b.listing_id AND list_has_any(a.keys, b.keys) AND b.valid_to >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY)
SELECT probe, count(*) AS candidates, min(candidate) AS first_candidate, max(candidate) AS last_candidate FROM c GROUP BY probe""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    cur = staged(current(spark, d))
    forms = resolve.normal_forms(cur).join(cur.select("listing_id", "valid_to"), "listing_id")
    return blocking.candidate_counts(forms, forms.where(F.col("valid_to") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 180 days")))


@query(f"WITH {PAIRS_SQL} SELECT a_id, b_id, reason, round(score, 6) AS score FROM decided WHERE matched")
def pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)[1].withColumn("score", F.round("score", 6))


_SUSPECTS_SQL = f"""act AS (SELECT *, CAST(floor(lat / 0.02) AS INT) AS y FROM cur WHERE lat IS NOT NULL),
pairs AS (SELECT a.listing_id AS a_id, b.listing_id AS b_id FROM act a JOIN (SELECT *, unnest([y - 1, y, y + 1]) AS yy FROM act) b ON a.kind = b.kind AND a.y = b.yy AND a.source <> b.source AND a.listing_id < b.listing_id
  AND a.valid_to >= TIMESTAMP '1997-01-01' AND b.valid_to >= TIMESTAMP '1997-01-01' AND a.listing_id // 10 <> b.listing_id // 10
  AND abs(a.lat - b.lat) <= 0.02 AND abs(a.lon - b.lon) <= 0.05 AND {_HAV} <= 2 AND abs(a.price - b.price) <= CAST(0.1 AS DOUBLE) * greatest(a.price, b.price) AND abs(a.area_m2 - b.area_m2) <= CAST(0.1 AS DOUBLE) * greatest(a.area_m2, b.area_m2)),"""


# The listings' properties are those of an earlier run, here one a part; active listings only.
@query("WITH " + PAIRS_SQL[: PAIRS_SQL.index("slim AS (")] + _SUSPECTS_SQL + PAIRS_SQL[PAIRS_SQL.index("p1 AS (") :] + " SELECT reason, count(*) AS pairs FROM decided GROUP BY reason")
def rejected_reasons(spark: SparkSession, d: str) -> DataFrame:
    cur = staged(current(spark, d))
    active = cur.where(F.col("valid_to") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("property_id", F.floor(F.col("listing_id") / 10))
    return blocking.suspect_reasons(active, resolve.normal_forms(active)).orderBy(F.desc("pairs"), "reason")


@query(CLUSTERS_SQL + " SELECT listing_id, property_id FROM clusters")
def property_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[1]


_APART_SQL = CLUSTERS_SQL.replace("FROM decided WHERE matched", "FROM decided WHERE matched AND round(score, 9) >= 2.4") + """,
ex AS MATERIALIZED (SELECT a_id AS a, b_id AS b FROM decided WHERE matched AND round(score, 9) >= 2.4 AND (a_id + b_id) % 4 = 1),
torn AS (SELECT DISTINCT property_id FROM ex JOIN clusters ON listing_id = a),
k AS MATERIALIZED (SELECT a_id, b_id, row_number() OVER (ORDER BY round(score, 9) DESC, a_id, b_id) AS rn FROM decided JOIN clusters ON listing_id = a_id JOIN torn USING (property_id) WHERE matched AND round(score, 9) >= 2.4),
grown(step, listing_id, label, going) AS (SELECT 0, listing_id, listing_id, TRUE FROM clusters JOIN torn USING (property_id) UNION ALL
  SELECT * FROM (WITH f AS (SELECT least(x.label, y.label) AS lo, greatest(x.label, y.label) AS hi, min(rn) AS rn FROM k JOIN grown x ON x.listing_id = a_id JOIN grown y ON y.listing_id = b_id
      LEFT JOIN (SELECT DISTINCT least(u.label, v.label) AS p, greatest(u.label, v.label) AS q FROM ex JOIN grown u ON u.listing_id = a JOIN grown v ON v.listing_id = b) n ON p = least(x.label, y.label) AND q = greatest(x.label, y.label)
      WHERE x.label <> y.label AND p IS NULL GROUP BY 1, 2),
    t AS (SELECT part, min(rn) AS rn FROM (SELECT lo AS part, rn FROM f UNION ALL SELECT hi, rn FROM f) GROUP BY part),
    j AS (SELECT f.lo, f.hi FROM f JOIN t p ON p.part = f.lo AND p.rn = f.rn JOIN t q ON q.part = f.hi AND q.rn = f.rn)
    SELECT g.step + 1, g.listing_id, coalesce(j.lo, g.label), (SELECT count(*) FROM j) > 0 FROM grown g LEFT JOIN j ON j.hi = g.label WHERE g.going)),
apart AS (SELECT listing_id, label FROM grown WHERE step = (SELECT max(step) FROM grown))"""


@query(_APART_SQL + " SELECT listing_id, coalesce(label, property_id) AS property_id FROM clusters LEFT JOIN apart USING (listing_id)")
def clusters_kept_apart(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the surest matches under exclusions: every fourth pair or so was split by hand and stays apart, through third listings too."""
    cur, found = _matches(spark, d)
    matched = staged(found.select("a_id", "b_id", F.round("score", 9).alias("score")).where("score >= 2.4"))
    return resolve.clusters(cur, matched, matched.where((F.col("a_id") + F.col("b_id")) % 4 == 1))


@query("WITH " + PAIRS_SQL + """, m AS (SELECT CASE WHEN a_id % 3 = 0 THEN a_id ELSE b_id END AS listing_id, CASE WHEN a_id % 3 = 0 THEN b_id ELSE a_id END AS candidate_id, reason, score FROM decided WHERE matched AND (a_id % 3 = 0) <> (b_id % 3 = 0)),
v AS (SELECT listing_id, candidate_id // 10 AS property_id, count(*) AS votes, max(round(score, 9)) AS best, arg_max(reason, (round(score, 9), -candidate_id)) AS reason FROM m GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY votes DESC, best DESC, property_id) = 1)
SELECT listing_id, coalesce(property_id, listing_id) AS property_id, coalesce(reason, 'new') AS reason FROM cur LEFT JOIN w USING (listing_id) WHERE listing_id % 3 = 0""".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def assign_batch(spark: SparkSession, d: str) -> DataFrame:
    cur, found = _matches(spark, d)
    matched = found.where((F.col("a_id") % 3 == 0) != (F.col("b_id") % 3 == 0))
    first = F.col("a_id") % 3 == 0
    matched = matched.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("listing_id"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("candidate_id"), "reason", F.round("score", 9).alias("score"))
    held = cur.where("listing_id % 3 <> 0").select(F.col("listing_id").alias("candidate_id"), F.floor(F.col("listing_id") / 10).alias("property_id"))
    return resolve.assign(cur.where("listing_id % 3 = 0"), held, matched)


def _stored(cur: DataFrame) -> DataFrame:
    return cur.withColumns({
        "is_active": F.col("valid_to") >= F.lit("1997-01-01").cast("timestamp_ntz"), "ignored": F.col("listing_id") % 17 == 0,
        "url": F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("source_id")),
    })


GOLDEN_SQL = CLUSTERS_SQL + """,
l AS (SELECT c.*, property_id, valid_to >= TIMESTAMP '1997-01-01' AS is_active, listing_id % 17 = 0 AS ignored, 'https://' || source || '/' || source_id AS url FROM cur c JOIN clusters USING (listing_id)),
l1 AS (SELECT *, bool_and(ignored) OVER (PARTITION BY property_id) AS all_ignored FROM l),
l2 AS (SELECT *, all_ignored OR NOT ignored AS in_pool FROM l1),
l3 AS (SELECT *, coalesce(bool_or(is_active) FILTER (WHERE in_pool) OVER (PARTITION BY property_id), FALSE) AS any_active FROM l2),
l4 AS (SELECT *, in_pool AND (is_active OR NOT any_active) AS in_base FROM l3),
golden AS (SELECT property_id, count(*) AS listing_count, bool_and(ignored) AS ignored, bool_or(is_active) FILTER (WHERE in_pool) AS is_active, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at,
  min(price) FILTER (WHERE in_base) AS price, min(price) FILTER (WHERE in_pool) AS price_min, max(price) FILTER (WHERE in_pool) AS price_max, bool_or(is_private) FILTER (WHERE in_base) AS is_private,
  array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE in_pool)), '+') AS sources,
  first(kind ORDER BY CASE WHEN is_private THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base) AS kind,
  first(title ORDER BY CASE WHEN is_private THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base) AS title,
  first(url ORDER BY CASE WHEN is_private THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base) AS url,
  first(city ORDER BY CASE WHEN is_private THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base) AS city,
  coalesce(first(district ORDER BY CASE WHEN is_private THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base), first(district ORDER BY last_seen_at DESC, listing_id) FILTER (WHERE in_base AND district IS NOT NULL)) AS district,
  first(lat ORDER BY CASE WHEN location_precision='exact' THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base AND lat IS NOT NULL) AS lat,
  first(lon ORDER BY CASE WHEN location_precision='exact' THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_base AND lat IS NOT NULL) AS lon,
  first(area_m2 ORDER BY last_seen_at DESC, listing_id) FILTER (WHERE in_base) AS area_m2,
  string_agg(source || ':' || CAST(is_active AS VARCHAR), ',' ORDER BY CASE WHEN is_active THEN 0 ELSE 1 END, last_seen_at DESC, listing_id) FILTER (WHERE in_pool) AS links
  FROM l4 GROUP BY property_id)"""


def _golden(spark: SparkSession, d: str) -> DataFrame:
    cur, clusters = _clusters(spark, d)
    return resolve.golden(_stored(cur).join(clusters, "listing_id"))


@query(GOLDEN_SQL + " SELECT *, floor(price/area_m2*100+0.5)/100 AS price_per_m2 FROM golden")
def golden_properties(spark: SparkSession, d: str) -> DataFrame:
    out = _golden(spark, d).withColumn("sources", F.array_join("sources", "+"))
    out = out.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x.source, x.active.cast("string"))), ","))
    return out.select("property_id", "listing_count", "ignored", "is_active", "first_seen_at", "last_seen_at", "price", "price_min", "price_max", "is_private", "sources", "kind", "title", "url", "city", "district", "lat", "lon", "area_m2", "links", "price_per_m2")


_ALERTS = GOLDEN_SQL + f""", {SEARCHES_SQL},
q AS (SELECT *, floor(price/area_m2*100+0.5)/100 AS price_per_m2 FROM golden),
hit AS (SELECT spec_id, q.* FROM specs JOIN q ON (len(kinds) = 0 OR list_contains(kinds, kind)) AND (price_max IS NULL OR price <= specs.price_max) AND (area_min IS NULL OR area_m2 >= area_min)
  AND (price_per_m2_max IS NULL OR price_per_m2 <= price_per_m2_max) AND (private_only IS NULL OR NOT private_only OR is_private) WHERE is_active AND NOT ignored)""".replace("price_max IS NULL OR price <= specs", "specs.price_max IS NULL OR price <= specs")


@query(_ALERTS + " SELECT spec_id, property_id, price, area_m2 FROM hit")
def saved_search_match(spark: SparkSession, d: str) -> DataFrame:
    return alerts.match(_golden(spark, d), saved_searches(spark)).select("spec_id", "property_id", "price", "area_m2")


_ALERT_NOW = "1998-08-15 00:00:00"
_NEW = _ALERTS + f""", new AS (SELECT * FROM hit WHERE property_id % 7 <> 0 AND first_seen_at >= TIMESTAMP '{_ALERT_NOW}' - INTERVAL 400 DAY AND (lat IS NOT NULL OR first_seen_at <= TIMESTAMP '{_ALERT_NOW}' - INTERVAL 2 HOUR)),
cut AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY first_seen_at, property_id) AS rn FROM new QUALIFY rn <= 200)"""


def _new(spark: SparkSession, d: str) -> DataFrame:
    golden = _golden(spark, d)
    sent = golden.where("property_id % 7 = 0").select("property_id")
    return alerts.eligible(alerts.match(golden, saved_searches(spark)), sent, _ALERT_NOW, max_days=400)


@query(_NEW + " SELECT spec_id, property_id, first_seen_at FROM cut")
def new_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d).select("spec_id", "property_id", "first_seen_at")


@query(_NEW + """, n AS (SELECT *, count(*) OVER (PARTITION BY spec_id) AS total FROM cut)
SELECT spec_id, CASE WHEN total > 40 THEN 0 ELSE (rn-1)//10 END AS chunk, max(total) > 40 AS summary, count(*) AS properties, string_agg(CAST(property_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM n GROUP BY 1, 2""")
def digest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return alerts.chunks(_new(spark, d)).select("spec_id", "chunk", "summary", "properties", "ids")


@query(CLUSTERS_SQL + """, o AS (SELECT * FROM (SELECT event_id, ts, event_id % 5 = 0 AS split, (SELECT count(*) FROM part) AS n FROM events) ),
ranked AS (SELECT min(listing_id) AS listing_id, CAST(source_id AS BIGINT) - 1 AS k FROM cur GROUP BY source_id),
ov AS (SELECT r.listing_id, split, t.listing_id AS target, ts, event_id FROM o JOIN ranked r ON r.k = (event_id * 7) % n JOIN ranked t ON t.k = (event_id * 13) % n),
pin AS (SELECT listing_id, CASE WHEN split THEN listing_id ELSE target END AS pinned FROM ov QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT listing_id, coalesce(pinned, property_id) AS property_id, pinned IS NOT NULL AS is_pinned FROM clusters LEFT JOIN pin USING (listing_id)""")
def manual_overrides(spark: SparkSession, d: str) -> DataFrame:
    cur, clusters = _clusters(spark, d)
    ranked = staged(cur.groupBy((F.col("source_id").cast("long") - 1).alias("k")).agg(F.min("listing_id").alias("listing_id")))  # a fixture: parts name listings
    n = spark.read.parquet(f"{d}/part.parquet").count()
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", ((F.col("event_id") * 7) % n).alias("k"), ((F.col("event_id") * 13) % n).alias("t"))
    made = events.join(ranked, "k").drop("k").join(ranked.withColumnsRenamed({"listing_id": "property_id", "k": "t"}), "t")
    overrides = made.select("listing_id", F.when(F.col("event_id") % 5 == 0, "split").otherwise("merge").alias("action"), "property_id", F.struct("ts", "event_id").alias("at"))
    return resolve.apply_overrides(clusters, overrides)


@query(GOLDEN_SQL + """, h AS (SELECT listing_id, count(*) AS points, string_agg(CAST(price AS VARCHAR), '>' ORDER BY observed_at, obs_id) AS path FROM obs WHERE price IS NOT NULL GROUP BY listing_id)
SELECT g.property_id, g.price, count(*) AS n, string_agg(CAST(l.listing_id AS VARCHAR) || '=' || coalesce(h.path, '') , ' ' ORDER BY l.listing_id) AS history FROM golden g JOIN l USING (property_id) LEFT JOIN h ON h.listing_id = l.listing_id GROUP BY 1, 2""")
def property_detail(spark: SparkSession, d: str) -> DataFrame:
    cur, clusters = _clusters(spark, d)
    listings = _stored(cur).join(clusters, "listing_id")
    points = F.sort_array(F.collect_list(F.struct("observed_at", "obs_id", "price")))
    history = observations(spark, d).where("price is not null").groupBy("listing_id").agg(points.alias("points"))
    history = history.select("listing_id", F.array_join(F.transform("points", lambda x: x.price.cast("string")), ">").alias("path"))
    nested = listings.join(history, "listing_id", "left").groupBy("property_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("listing_id", F.coalesce("path", F.lit("")).alias("path")))).alias("rows"))
    nested = nested.select("property_id", "n", F.array_join(F.transform("rows", lambda x: F.concat_ws("=", x.listing_id.cast("string"), x.path)), " ").alias("history"))
    return resolve.golden(listings).select("property_id", "price").join(nested, "property_id").select("property_id", "price", "n", "history")
