"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelflow.sources.shared import shared_dir, staged

__all__ = ["SPLIT_OF_TEXT", "by_row", "by_text", "documents", "fold", "parts", "shared_dir", "spread_join", "staged", "staged_alone", "unused"]

SPLIT_OF_TEXT = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged_alone(df: DataFrame) -> DataFrame:
    """``staged``, with the shuffle files of ``df`` dropped at once: nothing but the written table is read later."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staged(df)
    finally:
        conf.set(key, before)


def spread_join(rows: DataFrame, labels: DataFrame, key: str, salt_of: str, salts: int = 16) -> DataFrame:
    """``rows`` left-joined to ``labels`` (one row a key) where one key may hold a third of all rows.

    A key's rows are dealt over ``salts`` sub-keys; a label is copied only to the sub-keys that occur.
    """
    salt = unused(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    copies = salted.select(key, salt).distinct().join(labels, key)
    return salted.join(copies, [key, salt], "left").drop(salt)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"{name}_"
    return name


def by_row(rows: DataFrame, columns: Callable[[list[str]], list[pa.Array]], schema: str, at_once: int = 500) -> DataFrame:
    """The first column and what ``columns`` makes of the second, a text (null: empty), in ``schema``'s order.

    The first column passes untouched, as Arrow: a null among 64-bit ids doesn't turn the others into floats.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                yield pa.RecordBatch.from_arrays([some.column(0), *columns([t or "" for t in some.column(1).to_pylist()])], names=names)

    return rows.mapInArrow(run, schema)


def by_text(docs: DataFrame, columns: Callable[[list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what ``columns`` makes of each text."""
    return by_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), columns, schema)


def fold(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id has none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))
