import json
from datetime import datetime, timedelta, timezone

import frames
import pytest
from pyspark.sql import functions as F

from spendlens.operators.normalize import normalize
from spendlens.operators.tail import tail
from spendlens.plans import fixtures, stores
from spendlens.plans.stores import silent, state_settings
from spendlens.sources import calls as store
from spendlens.sources import prices as price_source
from spendlens.sources.output import write_json
from spendlens.streaming import assembly, jobs
from spendlens.streaming.workdir import work_dir


def test_first_row_of_an_id_wins_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "calls")
    batch = frames.calls(
        spark,
        [{"id": "a", "client": "first"}, {"id": "a", "client": "second"}, {"id": "b"}]
        + [{"id": "hot", "client": str(i)} for i in range(50)],
    ).withColumn("ingest_seq", F.monotonically_increasing_id())
    for _ in range(2):
        store.append_calls(batch, path)
    later = frames.calls(spark, [{"id": "a", "client": "third"}, {"id": "c", "ts": "2026-07-21 00:00:00"}])
    store.append_calls(later.withColumn("ingest_seq", F.lit(1)), path)
    stored = store.read_calls(spark, path)
    assert {r.id: r.client for r in stored.collect()} == {"a": "first", "b": None, "hot": "0", "c": None}
    assert stored.count() == 4
    assert {str(r.dt) for r in stored.select("dt").collect()} == {"2026-07-20", "2026-07-21"}


def test_a_stored_table_keeps_the_order_of_insertion(spark, tmp_path):
    path = str(tmp_path / "calls")
    calls = frames.calls(spark, [{"ts": f"2026-07-{20 - d} 10:00:00"} for d in range(9)])
    store.append_calls(calls.withColumn("ingest_seq", F.col("id").cast("bigint")), path)
    got = tail(store.read_calls(spark, path), frames.no_prices(spark), n=3).collect()
    assert [r.ingest_seq for r in got] == [6, 7, 8]


def test_appends_of_the_same_dates_read_only_those(spark, tmp_path):
    path = str(tmp_path / "calls")
    days = frames.calls(spark, [{"ts": f"2026-07-{d:02d} 10:00:00"} for d in range(1, 5)])
    days = days.withColumn("ingest_seq", F.lit(1))
    store.append_calls(days, path)
    store.append_calls(days.where("id >= '2'"), path, same_dates=True)
    assert store.read_calls(spark, path).count() == 4


def test_old_files_gain_the_later_columns(spark, tmp_path):
    path = str(tmp_path / "old")
    old = frames.calls(spark, [{"id": "x", "model": "m"}])
    old.drop("client", "endpoint", "anomaly", "raw_usage", "peer_exe").write.parquet(path)
    row = store.read_calls(spark, path).first()
    assert (row.model, row.client, row.peer_exe) == ("m", None, None)


@pytest.mark.parametrize("format", ["json", "csv"])
def test_other_formats(spark, tmp_path, format):
    path = str(tmp_path / format)
    frames.calls(spark, [{"id": "x", "input_tokens": 5, "cost": 0.5}]).write.format(format).save(path)
    row = store.read_calls(spark, path, format).first()
    assert (row.id, row.input_tokens, row.cost, row.stream) == ("x", 5, 0.5, False)


def test_exported_tables(spark, tmp_path):
    header = "id,ts,provider,model,status,latency_ms,ttft_ms,stream,input_tokens,cost"
    path = _write(
        tmp_path / "calls.csv",
        f"{header}\n"
        "a,2026-07-20T10:00:00.123456789Z,openai,m,200,5,,1,100,0.25\n"
        "b,2026-07-20T10:00:00Z,openai,,,5,,0,not-an-integer,\n",
    )
    row = store.read_export(spark, path).collect()
    assert [r.id for r in row] == ["a"]
    assert (row[0].stream, row[0].input_tokens, row[0].cost, row[0].peer_exe) == (True, 100, 0.25, None)
    assert row[0].ts.microsecond == 123456
    with pytest.raises(Exception, match="not-an-integer"):
        store.read_export(spark, path, strict=True).collect()


def test_time_bounds_prune_dates(spark, tmp_path):
    path = str(tmp_path / "calls")
    days = [{"ts": f"2026-07-{d:02d} 10:00:00"} for d in range(1, 11)]
    store.append_calls(frames.calls(spark, days).withColumn("ingest_seq", F.lit(1)), path)
    from spendlens.timebounds import from_bound

    bound = datetime(2026, 7, 8, 11, tzinfo=timezone.utc)
    recent = from_bound(store.read_calls(spark, path), bound)
    assert recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(ts" in plan


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_prices_missing_or_malformed_are_none(spark, tmp_path):
    assert price_source.read_prices(spark, str(tmp_path / "nothing.json")).count() == 0
    base = '{"m": {"input_per_m": 1, "output_per_m": %s, "tiers": [%s]}}'
    malformed = [
        "{not json", "[]", '{"m": {"input_per_m": 1}}', "", base % ("NaN", ""), base % ('"NaN"', ""),
        base % (2, '{"input_per_m": 1, "output_per_m": 2}'),
        base % (2, '{"above_input_tokens": 5, "output_per_m": 2}'),
        base % (2, '{"above_input_tokens": 5, "input_per_m": 1}'),
    ]
    for i, text in enumerate(malformed):
        path = _write(tmp_path / f"{i}.json", text)
        assert price_source.read_prices(spark, path).count() == 0, text


def test_prices_defaults_and_case(spark, tmp_path):
    path = _write(
        tmp_path / "p.json",
        json.dumps({"GPT-X": {"input_per_m": 1, "output_per_m": 2.5}, "b": {
            "input_per_m": 1, "output_per_m": 1, "cache_in_input": True,
            "tiers": [{"above_input_tokens": 5, "input_per_m": 9, "output_per_m": 9}]}}, indent=2),
    )
    got = {r.model_key: r for r in price_source.read_prices(spark, path).collect()}
    assert set(got) == {"gpt-x", "b"}
    assert (float(got["gpt-x"].output_per_m), got["gpt-x"].cache_in_input, got["gpt-x"].tiers) == (2.5, False, [])
    assert float(got["b"].tiers[0].cache_read_per_m) == 0
    shown = price_source.show_prices(spark, path, datetime.now(timezone.utc) + timedelta(days=3, hours=1)).first()
    assert (shown.models, shown.age_days) == (2, 3)


def test_report_as_json(spark, tmp_path):
    path = str(tmp_path / "report")
    write_json(frames.rows(spark, [{"model": "m", "cost": None}], "model string, cost double"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"model":"m","cost":null}']


def _message(seq, outcome="chunk", data=None, second=0, call="c", content="text/event-stream", **more):
    return {
        "call_id": call, "ts": f"2026-07-20 10:{second // 60:02d}:{second % 60:02d}", "seq": seq,
        "outcome": outcome, "elapsed_ms": seq * 10, "data": data, "provider": "openai",
        "path": "/v1/chat/completions", "status": 200, "content_type": content,
    } | more


def _assemble(spark, batches, **options):
    """Each batch is a file, read in order of writing."""
    folder = work_dir(spark, "test")
    schema = ", ".join(
        f"{f.name} {'string' if f.name == 'ts' else f.dataType.simpleString()}" for f in assembly.MESSAGES
    )
    for batch in batches:
        frame = frames.rows(spark, batch, schema).withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream_schema = frame.schema
    with state_settings(spark):
        stream = spark.readStream.schema(stream_schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        calls = jobs.normalize_stream(assembly.assemble(stream, **options))
        run = (
            calls.writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        )
        run.awaitTermination()
        return {r.id: r for r in spark.read.schema(calls.schema).parquet(f"{folder}/out").collect()}


def test_assembly(spark):
    usage = b'data: {"model":"m\xc3\xa9","usage":{"prompt_tokens":12}}\n\ndata: [DONE]\n\n'
    body = '{"model":"é","usage":{"prompt_tokens":3}}'.encode()
    cut, middle = usage.index(b"\xc3") + 1, body.index(b"\xc3") + 1
    batches = [
        [
            _message(0, data=b"", call="late"), _message(2, data=usage[cut:], call="late"),
            _message(3, "finish", call="late"),
            _message(0, data=body[:middle], call="json", content="application/json"),
            _message(0, data=usage, call="open"),
            _message(0, data=b"data: " + b"x" * 300, call="big"),
        ],
        [
            _message(1, data=usage[:cut], call="late"),
            _message(1, data=body[middle:], call="json", content="application/json"),
            _message(2, "client_disconnect", call="json", content="application/json"),
            _message(1, data=b"x\n\n" + usage, call="big"), _message(2, "finish", call="big"),
        ],
        # Later batches find the open call's timer expired; a call much older by its own time is kept.
        [_message(0, "finish", call="other", second=3000)],
        [_message(0, data=usage, call="old", ts="2026-06-01 10:00:00")],
        [_message(1, "finish", call="old", ts="2026-06-01 10:00:01")],
    ]
    got = _assemble(spark, batches, timeout_ms=1, clock_skew="0 seconds", max_event_bytes=200)
    assert got.keys() == {"late", "json", "open", "big", "other", "old"}
    assert got["old"].input_tokens == 12
    late, whole, left, big = (got[k] for k in ("late", "json", "open", "big"))
    assert (late.model, late.input_tokens, late.ttft_ms, late.latency_ms) == ("mé", 12, 10, 30)
    assert (whole.model, whole.input_tokens, whole.error_kind) == ("é", 3, "client_disconnect")
    assert (left.anomaly, left.input_tokens) == ("observation_dropped", None)
    assert (big.anomaly, big.input_tokens) == ("sse_overflow", None)


def test_a_silent_stream_emits_its_open_calls(spark):
    usage = b'data: {"model":"m","usage":{"prompt_tokens":12}}\n\n'
    rows = [
        _message(0, data=usage, call="open"), _message(1, data=usage, call="open"),
        _message(0, data=usage, call="ended"), _message(1, "finish", call="ended"),
        _message(3, "finish", call="gap"),
    ]
    schema = ", ".join(
        f"{f.name} {'string' if f.name == 'ts' else f.dataType.simpleString()}" for f in assembly.MESSAGES
    )
    folder = work_dir(spark, "test")
    frame = frames.rows(spark, rows, schema).withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"{folder}/in")
    with state_settings(spark):
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
        calls = jobs.normalize_stream(assembly.assemble(stream, timeout_ms=1_500, idle=True))
        got = {r.id: r for r in silent(calls, folder, seconds=60).collect()}
    assert got.keys() == {"open", "ended", "gap"}
    assert (got["ended"].anomaly, got["ended"].input_tokens) == (None, 12)
    assert got["open"].anomaly == got["gap"].anomaly == "observation_dropped"
    assert got["open"].latency_ms == 10


def test_stream_and_batch_normalise_alike(spark):
    from spendlens.plans import fixtures
    from spendlens.plans.stores import drained, staged

    exchanges = fixtures.streams(spark, "/root/testdata/sf0.001")
    folder = work_dir(spark, "test")
    streamed = drained(jobs.normalize_stream(staged(exchanges, f"{folder}/in")), folder)
    batch = normalize(exchanges)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


@pytest.mark.parametrize(("files", "by"), [(4, ()), (2, ()), (4, ("seq",))])
def test_staged_files_and_batches_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch, files, by):
    monkeypatch.setattr(stores, "FILE_ROWS", 25)
    monkeypatch.setattr(stores, "BATCH_FILES", 6)
    rows = spark.range(2_000).selectExpr("id", "CAST(id % 4 AS INT) AS seq")
    stream = stores.staged(rows, str(tmp_path / "in"), files, *by)
    sizes = []
    run = stream.writeStream.foreachBatch(lambda batch, n: sizes.append(batch.count())).trigger(availableNow=True).start()
    run.awaitTermination()
    found = [r["n"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == sum(found) == 2_000 and len(sizes) >= 7
    assert max(found) <= (250 if by else 40)


def test_staged_rows_of_a_large_frame_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FILE_ROWS", 25)
    stores.staged(spark.range(0, 2_000, 1, 4), str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).agg(F.min("id"), F.max("id"), F.count("*")).collect()
    assert sum(n for *_, n in files) == 2_000
    assert all(n <= 25 and last - first == n - 1 for _, first, last, n in files)


def test_stream_records_store_no_bodies(spark, tmp_path, monkeypatch):
    """The bodies grow with the user; what the query stores does not."""
    events = spark.range(2_000).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-05 10:00:00' AS ts", "CASE WHEN id % 7 > 0 THEN 20000 + id END AS user_id",
        "CASE WHEN id % 11 > 0 THEN 'view' ELSE 'error' END AS event_type", "1.5D AS value", "'{}' AS props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stores, "work_dir", lambda spark, purpose: str(tmp_path / purpose))
    got = stores.stream_records(spark, str(tmp_path))
    want = normalize(fixtures.captures(spark, str(tmp_path)))
    assert got.count() > 1_500 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "body" not in spark.read.parquet(str(tmp_path / "normalize" / "in")).columns
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    assert size(tmp_path / "normalize") < 4 * size(tmp_path / "events.parquet")
