"""Helpers the operators share: written intermediate tables, batches of texts, folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.streaming.workdir import work_dir


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, with the folder's path.

    Cuts the lineage with a table that outlives any executor.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def runs_of(texts: Iterable[str | None], limit: int) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch with about ``limit`` characters each, nulls as empty texts.

    A single text above the limit is a slice of its own: texts are never cut.
    """
    start, size, part = 0, 0, []
    for at, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > limit:
            yield start, part
            start, size, part = at, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def maybe_among(df: DataFrame, key: Column, members: DataFrame, member: Column, *, out: str, bits: int = 1 << 27) -> DataFrame:
    """Adds ``out``: False only where ``key`` is surely not among the members.

    A hashed bitmap of ``bits`` bits (16 MB, whatever the number of members) is broadcast. More
    members than bits only make it useless, never wrong. It spares a join the rows
    that cannot match.
    """

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(bits))

    maps = members.groupBy(F.bitmap_bucket_number(place(member)).alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place(member))).alias("_map")
    )
    at = F.bitmap_bit_position(place(key))
    octet = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("_page"), "left")
    return joined.withColumn(out, found).drop("_page", "_map")
