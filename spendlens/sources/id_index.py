"""The ids of a stored table, in hash buckets beside it.

An append has to know which of its ids the table has. Reading all stored ids for that costs
more with every append; with the index it reads only the buckets its own ids fall in, and the
data files that are newer than the index. A bucket holds about ``BUCKET_IDS`` ids whatever the
size of the table: when there are more, a new generation with more buckets is written.

The data files are the truth. A generation (``_ids/ids-N`` below the table, hidden from readers) has
the ids of the files its manifest names, and counts once its manifest is complete; other
files are read themselves. So a job that ends half-way leaves nothing wrong: at
worst ids of files that are read as well. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_IDS = 250_000
#: Rows in files newer than the index above which they are added to it.
RECENT_ROWS = 1_000_000
RECENT_FILES = 256


def bucket_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def _children(spark: SparkSession, folder: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(x.getPath().toString()) for x in files.listStatus(target)] if files.exists(target) else []


def _complete(spark: SparkSession, folder: str) -> bool:
    return any(x.endswith("/_SUCCESS") for x in _children(spark, folder))


@dataclass(frozen=True)
class IdIndex:
    """A generation: where it is, how many buckets it has, and the data files it covers."""

    table: str
    number: int
    bits: int
    covered: frozenset[str]
    ids: int

    @property
    def folder(self) -> str:
        return f"{self.table}/_ids/ids-{self.number}"

    @classmethod
    def open(cls, spark: SparkSession, table: str) -> IdIndex:
        """The newest complete generation, or one without ids."""
        numbers = sorted((int(x.rpartition("-")[2]) for x in _children(spark, f"{table}/_ids")), reverse=True)
        for number in numbers:
            manifests = [x for x in _children(spark, f"{table}/_ids/ids-{number}") if "/files-" in x and _complete(spark, x)]
            if manifests:
                rows = spark.read.schema("file string, rows bigint, bits int").parquet(*manifests).collect()
                return cls(table, number, rows[0].bits, frozenset(r.file for r in rows), sum(r.rows for r in rows))
        return cls(table, numbers[0] + 1 if numbers else 0, 0, frozenset(), 0)

    def stored(self, spark: SparkSession, buckets: list[int] | None) -> DataFrame:
        """The ids of the covered files, of all buckets or those named."""
        if not self.covered:
            return spark.createDataFrame([], "id string")
        ids = spark.read.schema("id string, bucket int").parquet(f"{self.folder}/buckets")
        return (ids if buckets is None else ids.where(F.col("bucket").isin(buckets))).select("id")

    def newer(self, spark: SparkSession) -> list[str]:
        """The table's data files the index does not cover; a listing, no data is read."""
        return sorted(set(spark.read.parquet(self.table).inputFiles()) - self.covered)

    def extended(self, spark: SparkSession, files: list[str]) -> IdIndex:
        """The index with ``files`` added; a new generation where its buckets would become too full."""
        added = spark.read.schema("id string").parquet(*files).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
        sizes = {r.file: r.rows for r in added.collect()}
        total = self.ids + sum(sizes.values())
        bits = max(0, (total // BUCKET_IDS).bit_length())
        fresh = spark.read.schema("id string").parquet(*files)
        if self.covered and bits <= self.bits + 1:
            number, bits, covered, counts, ids = self.number, self.bits, self.covered, {f: sizes.get(f, 0) for f in files}, fresh
        else:
            number = self.number + 1 if self.covered else self.number
            ids = self.stored(spark, None).unionByName(fresh) if self.covered else fresh
            covered = self.covered
            counts = {f: sizes.get(f, 0) for f in files} | ({f: 0 for f in self.covered} | {min(self.covered): self.ids} if self.covered else {})
        into = IdIndex(self.table, number, bits, covered | frozenset(files), total)
        (
            ids.withColumn("bucket", bucket_of(F.col("id"), bits))
            .repartition("bucket")
            .sortWithinPartitions("bucket", "id")
            .write.mode("append")
            .partitionBy("bucket")
            .parquet(f"{into.folder}/buckets")
        )
        rows = [(f, n, bits) for f, n in counts.items()]
        manifest = f"{into.folder}/files-{len(into.covered)}"
        spark.createDataFrame(rows, "file string, rows bigint, bits int").coalesce(1).write.mode("overwrite").parquet(manifest)
        return into


def stored_ids(batch: DataFrame, table: str) -> DataFrame:
    """Ids of the table among which all are that ``batch`` (with a column ``id``) shares with it."""
    spark = batch.sparkSession
    index = IdIndex.open(spark, table)
    newer = index.newer(spark)
    if len(newer) > RECENT_FILES or (newer and spark.read.parquet(*newer).count() > RECENT_ROWS):
        index, newer = index.extended(spark, newer), []
    if not index.covered:
        return spark.read.parquet(table).select("id")
    met = [r[0] for r in batch.select(bucket_of(F.col("id"), index.bits)).distinct().collect()] if index.bits else [0]
    ids = index.stored(spark, None if len(met) == 1 << index.bits else sorted(met))
    return ids.unionByName(spark.read.schema("id string").parquet(*newer)) if newer else ids
