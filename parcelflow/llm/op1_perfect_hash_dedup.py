"""Exact deduplication through a minimal perfect hash over the digests already seen.

The history's distinct SHA-256 digests are dealt to buckets. Each bucket gets a minimal perfect hash: levels of bit
arrays, each with the keys that land alone there, so that the rank of a key's bit is its slot number. A slot holds the
full digest, the winner's doc_id and the number of rows. A batch digest is looked up by its slot and compared byte by
byte; members merge into the slot, the others form groups of their own.

Defined results: a null text counts as empty; a null doc_id is below every other and wins only where a group has no
other; of rows that repeat both doc_id and text one is kept; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread_join, staged, unused

INDEX = "bucket int, n long, sizes array<long>, bits binary, digests binary, winners binary, counts binary"
FOUND = "digest binary, keep_id long, group_size long, member boolean"
NONE = np.iinfo(np.int64).min
PER_BUCKET = 40_000


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels of a minimal perfect hash over distinct keys."""
    levels, left = [], words
    while len(left):
        size = 2 * len(left) + 1
        at = _position(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots_of(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot of every key that the hash was built over; an arbitrary slot, or -1, for any other."""
    out, left, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        at = _position(words[left], k, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = before + rank[at[hit]]
        left, before = left[~hit], before + int(bits.sum())
    return out


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf.digest)
    levels = build_hash(words)
    at = slots_of(levels, words)
    digests, winners, counts = np.empty_like(words), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    digests[at], winners[at], counts[at] = words, pdf.winner.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
    return pd.DataFrame([{
        "bucket": int(pdf.bucket.iloc[0]), "n": len(at), "sizes": [len(x) for x in levels],
        "bits": b"".join(np.packbits(x).tobytes() for x in levels),
        "digests": digests.tobytes(), "winners": winners.tobytes(), "counts": counts.tobytes(),
    }])


def _levels(sizes, bits: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for size in sizes:
        end = at + (int(size) + 7) // 8
        out.append(np.unpackbits(np.frombuffer(bits[at:end], np.uint8), count=int(size)).astype(bool))
        at = end
    return out


def _lookup(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    asked = _words(batch.digest)
    winner, count = batch.winner.to_numpy(np.int64).copy(), batch.n.to_numpy(np.int64).copy()
    member, rest = np.zeros(len(asked), bool), []
    if len(index):
        row = index.iloc[0]
        held, winners, counts = _words([row.digests]), np.frombuffer(row.winners, np.int64), np.frombuffer(row.counts, np.int64)
        at = slots_of(_levels(row.sizes, row.bits), asked)
        safe = np.maximum(at, 0)
        member = (at >= 0) & (held[safe] == asked).all(axis=1)
        winner = np.where(member, np.maximum(winner, winners[safe]), winner)
        count = count + np.where(member, counts[safe], 0)
        idle = np.ones(len(held), bool)
        idle[at[member]] = False
        rest = [(held[idle], winners[idle], counts[idle], np.zeros(int(idle.sum()), bool))]
    out = [(asked, winner, count, member), *rest]
    frames = [pd.DataFrame({
        "digest": [x.tobytes() for x in w], "keep_id": pd.array(np.where(k == NONE, 0, k), "Int64"), "group_size": n, "member": m,
    }).assign(keep_id=lambda f, k=k: f.keep_id.mask(k == NONE)) for w, k, n, m in out]
    return pd.concat(frames, ignore_index=True)


def build_index(seen: DataFrame, buckets: int) -> DataFrame:
    """One index row a bucket over ``seen`` (digest, winner, n; digests distinct)."""
    return seen.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_index, INDEX)


def look_up(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups of the history and of ``batch`` (digest, winner, n) together; member tells which batch digests were known."""
    dealt = batch.withColumn("bucket", _bucket(buckets))
    return dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup, FOUND)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def digests_of(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): a row for each distinct pair of text and id."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return docs.select(digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


def dedup_digests(rows: DataFrame, seen: DataFrame | None = None, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Winner and size of each digest's group, for ``rows`` (digest, doc_id, copies) against those of ``seen``."""
    one = lambda x: x.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NONE)).alias("winner"), F.sum("copies").alias("n"))
    rows_n = rows.count() + (seen.count() if seen is not None else 0)
    buckets = max(1, -(-rows_n // per_bucket))
    history = one(seen if seen is not None else rows.limit(0))
    return look_up(one(rows), build_index(history, buckets), buckets)


def grouped(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies, keep_id, group_size). The lower half of the id range is the history."""
    rows = staged(digests_of(docs))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    older = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    groups = dedup_digests(rows.where(~older), rows.where(older)).select("digest", "keep_id", "group_size")
    return spread_join(rows, groups, "digest", "doc_id")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = grouped(docs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without repeats, whole rows and columns."""
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))
    digest, number, copies = (unused(docs, name) for name in ("digest", "id", "copies"))
    won = staged(grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias(digest), id_of.alias(number), F.col("copies").alias(copies)))
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))).withColumn(number, id_of)
    kept = marked.join(won, [digest, number])
    if won.where(F.col(copies) > 1).isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(copies) > 1).dropDuplicates([digest, number])
    return kept.where(F.col(copies) == 1).select(*docs.columns).unionAll(once.select(*docs.columns))


def op1_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
