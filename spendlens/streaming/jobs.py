"""Streaming jobs: normalisation and replay-safe storing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens.operators.normalize import CLIENT_HEADER, NO_LIMITS, Limits, normalize
from spendlens.sources.calls import append_calls


def normalize_stream(
    exchanges: DataFrame, client_header: str = CLIENT_HEADER, limits: Limits = NO_LIMITS
) -> DataFrame:
    """A stream of exchanges as a stream of calls. There is no state in it."""
    return normalize(exchanges, client_header, limits)


def drop_replays(calls: DataFrame, within: str | None = None) -> DataFrame:
    """Drop copies of a call, however late; a first copy is kept, however late.

    The state holds every id (use the RocksDB state store for many of them), because any
    watermark over the times of calls would also drop first copies that are behind it.

    ``within`` bounds it: an id is held that long after its first copy arrived (by the clock, so no
    row is late), and copies that come afterwards pass. Before ``store_calls``, whose index of
    ids catches those, the stored table is as without it, and most replays never reach the index.
    """
    if within is None:
        return calls.dropDuplicates(["id"])
    stamped = calls.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return stamped.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")


def store_calls(
    calls: DataFrame,
    path: str,
    checkpoint: str,
    order: str = "ingest_seq",
    same_dates: bool = False,
    **trigger,
) -> StreamingQuery:
    """Append a stream of calls to the table at ``path``, each id once, also after a restart.

    A batch is compared with the ids of all stored calls. Where replays are known to keep their
    date, ``same_dates=True`` compares it with those of its own dates only.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                append_calls(batch, path, order, same_dates)
        finally:
            batch.unpersist()

    return (
        calls.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
