"""Lines that many documents share are dropped from all of them, with DataFrame operations alone.

A line's key is the line without white space at both ends, A-Z in lower case. Lines are exploded, their keys hashed to
128 bits, and the documents of each hash counted; lines whose hash reaches the threshold go, the others are put together
again in their places.

Only hashes and places are shuffled for the counting and the look-up. A line that a third of all documents hold is dealt
over ``SALTS`` sub-keys, counted per sub-key first, and the common hashes are copied to the sub-keys that occur. Texts are
shuffled once, to meet the places of their own lines that go: a document is known by a digest of its id and text, so rows
without an id or of equal ids stay apart, and equal rows, for which the decision is the same, share it.

Defined results: a null or empty text is one empty line, whose key is empty; keys shorter than ``min_points`` code points
are neither counted nor dropped; every row is a document, also where ids repeat or are null; a line that repeats inside a
document counts once; a document that loses all lines keeps an empty text; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

MIN_DOCS, MIN_POINTS, SALTS = 10, 1, 64
SPACE, UPPER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _hashes(text: Column, min_points: int) -> Column:
    """The hash of each line's key, null for a key that is too short."""
    keys = F.transform(lines_of(text), key_of)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_points, F.unhex(F.md5(k.cast("binary")))))


def _known(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is a digest of id and text."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(F.unhex(F.md5(named.cast("binary"))).alias("row"), "doc_id", "text")


def _salt() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """(line, salt): hashes found in ``min_docs`` documents at least, once for each sub-key where they occur."""
    found = _known(docs).select(_salt(), F.explode(F.array_distinct(_hashes(F.col("text"), min_points))).alias("line")).where("line is not null")
    counted = staged(found.groupBy("line", "salt").agg(F.count("*").alias("docs")))
    common = counted.groupBy("line").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("line")
    return counted.select("line", "salt").join(common, "line")


def dropped_places(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """(row, places): the places, in order, of the lines that a document loses."""
    placed = _known(docs).select("row", _salt(), F.posexplode(_hashes(F.col("text"), min_points)).alias("place", "line")).where("line is not null")
    lost = placed.join(common_lines(docs, min_docs, min_points), ["line", "salt"])
    return lost.groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _flags(places: Column) -> Column:
    """A true for each place and a false for each one between, from the first line to the last place."""
    gap = lambda p, k: p - F.when(k > 0, F.get(places, k - 1)).otherwise(-1) - 1
    return F.flatten(F.transform(places, lambda p, k: F.concat(F.array_repeat(F.lit(False), gap(p, k)), F.array(F.lit(True)))))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), a row for each row of ``docs``."""
    joined = _known(docs).join(staged(dropped_places(docs, min_docs, min_points)), "row", "left")
    joined = joined.select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    flagged = joined.withColumn("flags", _flags(F.col("places")))
    kept = F.filter("lines", lambda line, k: ~F.coalesce(F.get("flags", k), F.lit(False)))
    return flagged.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), '') AS kept
      FROM k LEFT JOIN c ON k.key = c.key GROUP BY r)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM m JOIN d USING (r)
"""
