"""SimHash near-duplicates by a binary trie self-join.

Fingerprints follow the words' three-word shingles: a bit is 1 if it is set in over half of the shingles' XXH64 values.
Two fingerprints are linked at ``BUDGET`` = 2 or fewer differing bits.

The 64 bits are cut into three blocks; linked fingerprints agree in one block at least, so three tries are made, each
with another block on top and dealt by that block: a fingerprint travels three times, whatever the table's size. Inside
a task the sorted fingerprints are a trie whose nodes are intervals. The join walks pairs of nodes down from (root,
root), adds a differing bit where it goes to opposite children, and drops a pair beyond the budget. Links are merged
within the task at once, and only a spanning forest leaves it (a fingerprint lies within 2 bits of 2080 others at most,
so links grow with the table, not with its square). Components grow by repeated minima over the remaining forest edges.

Defined results: null and empty texts have fingerprint zero; a text of one or two words has one shingle; a null doc_id
is reported but names no component unless all of its component's ids are null (then null); repeated rows repeat; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators.graph import components, forest

from .common import SPLIT_OF_TEXT, by_row, by_text, documents, parts, spread_join, staged, unused

SHINGLE, SEED, BUDGET = 3, 42, 2
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit from the top, length
FRONTIER = 100_000
_WORDS = re.compile(SPLIT_OF_TEXT)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TO_64 = np.uint64


def fingerprint(text: str | None) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    words = _WORDS.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return 0
    whole = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return whole(" ".join(words).encode(), SEED)
    half = (len(words) - SHINGLE + 1) / 2
    counts = np.zeros(64, np.int64)
    for at in range(0, len(words) - SHINGLE + 1, 20_000):  # blocks of a long text
        some = words[at : at + 20_000 + SHINGLE - 1]
        h = np.array([whole(f"{a} {b} {c}".encode(), SEED) for a, b, c in zip(some, some[1:], some[2:])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts > half).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""
    return by_text(docs, lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))], "doc_id long, fp long")


def rotate(fp: np.ndarray, block: int) -> np.ndarray:
    """The bits with that block on top; the same for every value, so differing bits stay as many."""
    first = BLOCKS[block][0]
    if not first:
        return fp
    return (fp << _TO_64(first)) | (fp >> _TO_64(64 - first))


def trie_pairs(values: np.ndarray, top: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted distinct ``values`` that share their ``top`` first bits and differ in ``budget`` at most."""
    if len(values) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], (values[1:] ^ values[:-1]) >> _TO_64(64 - top) != 0]))
    ends = np.append(starts[1:], len(values))
    some = ends - starts > 1
    stack = [(top, starts[some], ends[some], starts[some], ends[some], np.zeros(int(some.sum()), np.int8))]
    while stack:
        depth, al, ah, bl, bh, spent = stack.pop()
        if len(al) > FRONTIER:  # go on with a part at a time: memory stays bounded
            half = len(al) // 2
            stack += [(depth, al[half:], ah[half:], bl[half:], bh[half:], spent[half:]), (depth, al[:half], ah[:half], bl[:half], bh[:half], spent[:half])]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, spent = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf], spent[~leaf]
        if not len(al):
            continue
        bit = _TO_64(63 - depth)
        am, bm = _middle(values, al, ah, bit), _middle(values, bl, bh, bit)
        same = (al == bl) & (ah == bh)
        kids = []
        for x, y, z, w, more, which in (
            (al, am, bl, bm, 0, slice(None)), (am, ah, bm, bh, 0, slice(None)), (al, am, bm, bh, 1, slice(None)), (am, ah, bl, bm, 1, ~same),
        ):
            x, y, z, w, s = x[which], y[which], z[which], w[which], spent[which] + np.int8(more)
            ok = (y > x) & (w > z) & (s <= budget) & ~((x == z) & (y - x == 1) & (w - z == 1))
            kids.append((x[ok], y[ok], z[ok], w[ok], s[ok]))
        nxt = [np.concatenate(c) for c in zip(*kids, strict=True)]
        if len(nxt[0]):
            stack.append((depth + 1, *nxt))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where each node's one-child begins."""
    one = ((values[low] >> bit) | _TO_64(1)) << bit
    at = np.searchsorted(values, one)
    return np.clip(at, low, high)


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = [[] for _ in BLOCKS]
    for pdf in frames:
        block, fp = pdf.block.to_numpy(), pdf.fp.to_numpy(np.int64).view(np.uint64)
        for k in range(len(BLOCKS)):
            kept[k].append(fp[block == k])
    for k, (_, length) in enumerate(BLOCKS):
        values = np.unique(rotate(np.concatenate(kept[k]), k)) if kept[k] else np.empty(0, np.uint64)
        member, root = forest(len(values), trie_pairs(values, length))
        first = BLOCKS[k][0]
        back = (values >> _TO_64(first)) | (values << _TO_64(64 - first)) if first else values
        yield pd.DataFrame({"a": back[member].view(np.int64), "b": back[root].view(np.int64)})


def links(distinct: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges (a, b) between the distinct ``fp`` that connect just what links of BUDGET bits connect."""
    top = lambda first, length: F.shiftrightunsigned(F.shiftleft("fp", first), 64 - length)
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), top(*b).alias("top")) for k, b in enumerate(BLOCKS)])).alias("x"))
    dealt = dealt.select("fp", "x.block", "x.top").repartition(tasks or parts(distinct.sparkSession), "block", "top")
    return dealt.select("fp", "block").mapInPandas(_join, "a long, b long")


def _grouped(rows: DataFrame) -> DataFrame:
    """Staged ``rows`` (doc_id, fp, ...) with group, a fingerprint that names the component, and component_id."""
    first = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    labels = staged(first.join(found, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("group")))
    ids = labels.groupBy("group").agg(F.min("low").alias("component_id"))
    return spread_join(rows, spread_join(labels.drop("low"), ids, "group", "fp"), "fp", "doc_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return _grouped(staged(fingerprints(docs))).drop("group")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id; whole rows and columns.

    A row is known by doc_id and text, so an id that repeats with another text is a row of its own. Of rows of a group
    that share its smallest doc_id the one of the least text digest stays; a null doc_id stays only where there is no other.
    """
    number, key = unused(docs, "id"), unused(docs, "digest")
    marked = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).withColumn(number, F.col("doc_id").cast("long"))
    texts = marked.select(F.struct(F.col(number).alias("id"), F.col(key).alias("digest")).alias("row"), "text")
    prints = by_row(texts, lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))], "row struct<id:bigint,digest:string>, fp long")
    rows = _grouped(staged(prints.select(F.col("row.id").alias("doc_id"), "row.digest", "fp")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    counted = staged(rows.groupBy("group", "doc_id", "digest").agg(F.count("*").alias("copies")))
    first = counted.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    lost = spread_join(counted, first, "group", "digest").withColumn("wins", order == F.col("first")).where("not wins or copies > 1")
    lost = staged(lost.select(F.col("doc_id").alias("a"), F.col("digest").alias("b"), "wins"))
    same = marked[number].eqNullSafe(lost["a"]) & (marked[key] == lost["b"])
    kept = marked.join(lost, same, "left_anti").select(*docs.columns)
    if lost.where("wins").isEmpty():
        return kept
    repeated = marked.join(lost.where("wins"), same, "left_semi").dropDuplicates([number, key])
    return kept.unionAll(repeated.select(*docs.columns))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
