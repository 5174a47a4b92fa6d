"""Exact deduplication by a stateful stream over a content store.

1. The rows are written to a content store in the shared folder with the SHA-256 of their
   text. A row's locator is its file in the store and its place in that file.
2. A stream reads digests and locators from the store. Its keyed state (RocksDB on disk,
   checkpointed to the shared folder, never expiring) retains for each digest the stable
   identifier and the locator of the row that stays, and the number of rows.
3. On hits (digests of two or more rows) the full bytes are checked against the text at the
   retained locator. Rows that differ from it despite an equal digest form groups by text.

Equal texts are identical ones; null counts as empty. The row with the largest key stays, a
null key below all others; of several rows with that key the last in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spendlens.llm.common import maybe_among, remove, written
from spendlens.streaming.workdir import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a group of copies compared with one copy of the text that stays.
SALT_ROWS = 500


def content_store(docs: DataFrame, *, text: str) -> tuple[DataFrame, str]:
    """``docs`` as struct ``doc`` with ``digest``, written to the shared folder."""
    body = F.coalesce(F.col(text), F.lit(""))
    return written(docs.select(F.struct("*").alias("doc"), F.sha2(body, 256).alias("digest")), "content")


def _locator():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def retained_state(
    spark: SparkSession, store: DataFrame, path: str, *, key: str, max_bytes: str | None = None
) -> DataFrame:
    """One row per digest: ``digest``, ``stays`` (key and locator), ``copies``.

    ``max_bytes`` limits a micro-batch. The stream runs in a session of its own, so that the
    caller's state-store settings stay as they are.
    """
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    # An open store holds 4 MB of local disk, however little it keeps: close each when its task commits.
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    reader = session.readStream.schema(store.schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    rows = reader.parquet(path).select("digest", F.struct(F.col(f"doc.{key}").alias("key"), _locator().alias("at")).alias("row"))
    groups = rows.groupBy("digest").agg(F.max("row").alias("stays"), F.count("*").alias("copies"))
    out, checkpoint = work_dir(spark, "digests"), work_dir(spark, "digest-state")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        groups.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*groups.schema, StructField("batch", IntegerType())])
    changes = spark.read.schema(schema).parquet(out) if _any(spark, out) else spark.createDataFrame([], schema)
    last = changes.groupBy("digest").agg(F.max_by(F.struct("stays", "copies"), "batch").alias("last"))
    # The stream has ended: its state and the changes it wrote are no longer needed.
    state, _ = written(last.select("digest", "last.stays", "last.copies"), "groups")
    remove(spark, out, checkpoint)
    return state


def _any(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_bytes: str | None = None) -> DataFrame:
    """Every row as struct ``doc`` with ``digest``, ``keep_id``, ``group_size`` and ``kept``.

    All rows come back, dropped ones too; exactly one of each group of equal texts is kept.
    Columns of any name are safe inside ``doc``. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store, path = content_store(docs, text=text)
    groups = retained_state(spark, store, path, key=key, max_bytes=max_bytes)
    body = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    hits = groups.where("copies > 1").withColumn("salts", F.ceil(F.col("copies") / SALT_ROWS))
    salted = hits.select("digest", "stays", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"))
    # Texts of digests seen once stay where they are.
    located = store.select("digest", body.alias("body"), _locator().alias("at"))
    located = maybe_among(located, F.col("digest"), hits, F.col("digest"), out="hit").where("hit").drop("hit")
    reference = located.join(
        salted.select(F.col("digest").alias("d"), "stays", "salt"),
        (F.col("digest") == F.col("d")) & (F.col("at") == F.col("stays.at")),
    ).select("digest", "salt", F.col("body").alias("kept_body"))
    copies = located.join(hits.select("digest", "salts"), "digest").withColumn(
        "salt", F.pmod(F.xxhash64("at"), F.col("salts")).cast("int")
    )
    # Only rows whose bytes differ despite an equal digest: none, unless SHA-256 is broken.
    unlike = copies.join(reference, ["digest", "salt"]).where(F.col("body") != F.col("kept_body"))
    unlike, _ = written(unlike.select("digest", "at", "body"), "unlike")
    rows = store.select("doc", "digest", _locator().alias("at"))
    out = ("doc", "digest", "keep_id", "group_size", "kept")
    if unlike.isEmpty():
        joined = rows.join(groups, "digest")
        return joined.select(
            "doc",
            "digest",
            F.col("stays.key").alias("keep_id"),
            F.col("copies").alias("group_size"),
            (F.col("at") == F.col("stays.at")).alias("kept"),
        )
    keyed = rows.select("digest", "at", F.struct(F.col(f"doc.{key}").alias("key"), "at").alias("row"))
    exact = keyed.join(unlike, ["digest", "at"], "left")
    true_groups = exact.groupBy("digest", "body").agg(F.max("row").alias("stays"), F.count("*").alias("copies"))
    by_row = exact.select("digest", "at", "body").join(
        true_groups.withColumnsRenamed({"digest": "d", "body": "b"}),
        F.col("digest").eqNullSafe(F.col("d")) & F.col("body").eqNullSafe(F.col("b")),
    )
    return (
        rows.join(by_row.select("digest", "at", "stays", "copies"), ["digest", "at"])
        .withColumn("keep_id", F.col("stays.key"))
        .withColumn("group_size", F.col("copies"))
        .withColumn("kept", F.col("at") == F.col("stays.at"))
        .select(*out)
    )


def distinct_docs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns unchanged."""
    return deduplicate(docs, key=key, text=text).where("kept").select("doc.*")
