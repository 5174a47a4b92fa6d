"""Appends by the id index, and the log of running spend."""

import frames
import pytest
from pyspark.sql import functions as F

from spendlens.sources import calls as store
from spendlens.sources import id_index
from spendlens.streaming import spend_log


def _calls(spark, first, last):
    # One file for an append: many dates would be many files.
    ids = spark.range(first, last).selectExpr("CAST(id AS STRING) AS id", "id AS ingest_seq")
    return ids.selectExpr(
        "*", "TIMESTAMP '2026-07-20 10:00:00' AS ts", "'openai' AS provider", "'m' AS model", "'first' AS client"
    )


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(id_index, "BUCKET_IDS", 200)
    monkeypatch.setattr(id_index, "RECENT_ROWS", 300)


def test_index_grows_and_no_id_is_stored_twice(spark, tmp_path, small):
    path = str(tmp_path / "calls")
    generations = set()
    for first in range(0, 4000, 500):
        store.append_calls(_calls(spark, max(0, first - 250), first + 500), path)
        generations.add(id_index.IdIndex.open(spark, path).number)
    stored = store.read_calls(spark, path)
    assert stored.count() == stored.select("id").distinct().count() == 4000
    index = id_index.IdIndex.open(spark, path)
    assert len(generations) > 1 and index.bits >= 3
    assert index.stored(spark, None).distinct().count() == index.ids >= 3500
    store.append_calls(_calls(spark, 0, 4000), path)
    assert store.read_calls(spark, path).count() == 4000


def test_a_small_append_reads_as_much_of_a_large_table(spark, tmp_path, small):
    batch = _calls(spark, 7, 8)

    def read(rows):
        path = str(tmp_path / str(rows))
        _calls(spark, 0, rows).withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(path)
        ids = id_index.stored_ids(batch, path)
        assert [r.id for r in ids.where("id = '7'").collect()] == ["7"]
        files = ids.inputFiles()
        assert files and all("/_ids/" in f for f in files)
        return ids.count()

    few, many = read(1_000), read(16_000)
    assert few < 1_000 and many < 2 * few


def test_index_left_half_written_changes_nothing(spark, tmp_path, small):
    path = str(tmp_path / "calls")
    store.append_calls(_calls(spark, 0, 1000), path)
    index = id_index.IdIndex.open(spark, path)
    files = index.newer(spark)
    _calls(spark, 0, 1000).selectExpr("id", "0 AS bucket").write.partitionBy("bucket").parquet(f"{index.folder}/buckets")
    assert id_index.IdIndex.open(spark, path).newer(spark) == files
    store.append_calls(_calls(spark, 500, 1500), path)
    stored = store.read_calls(spark, path)
    assert stored.count() == stored.select("id").distinct().count() == 1500


def _spend(spark, rows):
    schema = "hour int, provider string, model string, input_tokens long, output_tokens long, cost double"
    filled = [(h, p, "gpt-4o", 1_000_000 if c is None else 0, 0, c) for h, p, c in rows]
    return spark.createDataFrame(filled, schema).selectExpr(
        "timestampadd(HOUR, hour, TIMESTAMP '2026-07-20 00:30:00') AS ts", "*",
        "CAST(NULL AS BIGINT) AS cache_read_input_tokens", "CAST(NULL AS BIGINT) AS cache_creation_input_tokens",
    )


def test_spend_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spend_log, "COMPACT_AFTER", 3)
    path, prices = str(tmp_path / "log"), frames.prices(spark)
    batches = [
        [(0, "a", 1.0), (0, "b", 0.5), (30, "a", None)],
        [(1, "a", 2.0)],
        [(2, "c", 0.25), (0, "b", 0.25)],
        [(30, "a", 4.0)],
        [(31, "a", None)],
        [(0, None, 1.0)],
    ]
    expected = {}
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that is run again counts once
            spend_log.fold(_spend(spark, rows), number, prices, path)
        for hour, provider, cost in rows:
            key = (hour // 24, provider)
            calls, spent = expected.get(key, (0, 0.0))
            expected[key] = (calls + 1, spent + (2.4 if cost is None else cost))
        state = spend_log.read_spend(spark, path)
        got = {(r.period.day - 20, r.provider): (r.calls, r.spent) for r in state.collect()}
        assert got == expected
    folders = spend_log._folders(spark, path)
    assert folders["base"] and len(folders["batch"]) < len(batches)


def test_a_reader_skips_folders_being_written(spark, tmp_path):
    path, prices = str(tmp_path / "log"), frames.prices(spark)
    spend_log.fold(_spend(spark, [(0, "a", 1.0)]), 0, prices, path)
    spend_log.fold(_spend(spark, [(0, "a", 1.0)]), 1, prices, path)
    (tmp_path / "log" / "batch-1" / "_SUCCESS").unlink()
    assert [r.spent for r in spend_log.read_spend(spark, path).collect()] == [1.0]
    assert spend_log.read_spend(spark, str(tmp_path / "none")).count() == 0


def test_rolling_budget(spark):
    hourly = spend_log.totals(_spend(spark, [(0, "a", 1.0), (5, "a", 1.0), (6, "a", 1.0), (6, "b", 9.0)]), frames.prices(spark), "hour")
    spend = hourly.withColumn("spent", spend_log._spent("micro", "rest"))
    rows = spend_log.rolling_budget(spend, 2.0, 6).orderBy("provider", "hour").collect()
    assert [(r.provider, r.spent, r.status) for r in rows] == [("a", 1.0, "ok"), ("a", 2.0, "over"), ("a", 2.0, "over"), ("b", 9.0, "over")]
