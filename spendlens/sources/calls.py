"""The calls table: reading, schema evolution and replay-safe appends."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.normalize import backfill
from spendlens.operators.quality import decode_lenient, decode_strict
from spendlens.schemas import CALL_COLUMNS, CALLS, STORED, USAGE_COLUMNS
from spendlens.sources.id_index import stored_ids


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_calls(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """The calls stored at ``path``; columns that old files lack are NULL.

    Tables written by ``append_calls`` also have the order of insertion,
    ``ingest_seq``, and are partitioned by the UTC date ``dt``, which time bounds
    prune on.
    """
    fields = list(CALLS.fields)
    if format == "parquet":
        present = spark.read.parquet(path).columns
        fields += [f for f in STORED if f.name in present]
    return spark.read.schema(T.StructType(fields)).options(**options).format(format).load(path)


def read_export(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Calls exported as CSV with a header, such as from a SQLite ``calls`` table.

    All cells are text and decoded: a bad one fails the job when ``strict`` and
    drops its row otherwise. Columns the export lacks are NULL. An ``ingest_seq``
    in it, such as the rowid, is kept.
    """
    raw = spark.read.option("header", True).csv(path)
    decoded = (decode_strict if strict else decode_lenient)(raw)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in CALLS if f.name not in raw.columns]
    order = [F.col(c).cast("bigint") for c in ("ingest_seq",) if c in raw.columns]
    return decoded.select("*", *missing).select(*CALL_COLUMNS, *order)


def union_calls(*tables: DataFrame) -> DataFrame:
    """Calls of tables of different age as one; columns a table lacks are NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_per_id(batch: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row per id, the one that came first; copies are reduced before the shuffle."""
    arrival = F.struct(F.col(order).isNull(), F.col(order))
    first = batch.groupBy("id").agg(F.min_by(F.struct(*batch.columns), arrival).alias("first"))
    return first.select("first.*")


def new_calls(batch: DataFrame, stored: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The rows of ``batch`` to be added to ``stored``: ids it has are left as they are."""
    return first_per_id(batch, order).join(stored.select("id"), "id", "left_anti").select(
        *batch.columns
    )


def write_back(spark: SparkSession, path: str) -> list[date]:
    """Derive the usage columns of the stored calls anew from their raw usage, and store what changed.

    Only dates on which a value differs are written (and returned); other dates keep their
    files, and a second run finds nothing. A call without raw usage stays as it is.
    """
    filled = backfill(read_calls(spark, path))
    derived = {c: F.when(F.col("raw_usage").isNotNull(), F.col(f"raw_{c}")).otherwise(F.col(c)) for c in USAGE_COLUMNS}
    differs = F.lit(False)
    for c, value in derived.items():
        differs = differs | ~F.col(c).eqNullSafe(value)
    dates = sorted(r.dt for r in filled.where(differs).select("dt").distinct().collect())
    if dates:
        kept = [c for c in filled.columns if c in CALL_COLUMNS or c in ("ingest_seq", "dt")]
        changed = filled.where(F.col("dt").isin(dates)).select(*[derived.get(c, F.col(c)).alias(c) for c in kept])
        (
            changed.hint("rebalance", F.col("dt"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt")
            .parquet(path)
        )
    return dates


def append_calls(
    batch: DataFrame, path: str, order: str = "ingest_seq", same_dates: bool = False
) -> None:
    """Add calls to the table at ``path``; replayed calls change nothing.

    ``order`` is a number that grows with the arrival of the calls.

    The ids of the whole table are compared, by an index beside it of which only the
    buckets that the batch's ids fall in are read. With ``same_dates`` the ids of the dates the
    batch spans are read instead, which is enough where a replay keeps its time.
    Rows are rebalanced by date, which keeps the number of files per date low and
    still splits a date that holds most of the batch.
    """
    spark = batch.sparkSession
    if not path_exists(spark, path):
        fresh = first_per_id(batch, order)
    elif same_dates:
        days = batch.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
        stored = read_calls(spark, path).where(F.col("dt").between(*map(F.lit, days)))
        fresh = new_calls(batch, stored, order)
    else:
        fresh = new_calls(batch, stored_ids(batch, path), order)
    dated = fresh.select(
        *[F.col(c).cast(CALLS[c].dataType) for c in CALL_COLUMNS if c in fresh.columns],
        F.col(order).cast("bigint").alias("ingest_seq"),
        F.to_date("ts").alias("dt"),
    )
    dated.hint("rebalance", F.col("dt")).write.mode("append").partitionBy("dt").parquet(path)
