"""Queries over stores: appends, schema evolution, price files, JSON reports, streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens.operators import stats, tail
from spendlens.operators.budget import budget_check, parse_budget, period_hours
from spendlens.operators.normalize import normalize
from spendlens.operators.pricing import attach_rates
from spendlens.plans import analytics, capture, fixtures
from spendlens.plans.registry import query
from spendlens.schemas import ADDED_COLUMNS, CALL_COLUMNS, USAGE_COLUMNS
from spendlens.sources import prices as price_source
from spendlens.sources.calls import append_calls, new_calls, read_calls, union_calls, write_back
from spendlens.sources.output import TIME_FORMATS, json_lines
from spendlens.streaming import assembly, jobs, spend_log
from spendlens.streaming.workdir import work_dir

_MID = "2024-01-16 00:00:00"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """RocksDB state; in local mode also no more state partitions than there are cores."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        )
    }
    if spark.sparkContext.master.startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a staged file, and files of a batch, at most.
FILE_ROWS = 200_000
BATCH_FILES = 32


def staged(df: DataFrame, folder: str, files: int = 4, *by: str) -> DataFrame:
    """A frame written to files and read back as a stream, half of the files a batch.

    A frame of many rows gets more files, so that neither a file nor a batch grows with it; they are
    written where the rows are, without a shuffle. Columns ``by`` that deal the rows then deal them to several
    files a value.
    """
    times = max(1, -(-df.count() // (files * FILE_ROWS)))
    salt = [F.floor(F.rand(0) * times)] if by and times > 1 else []
    files *= times
    dealt = df.repartition(files, *by, *salt) if by or times == 1 else df
    dealt.write.option("compression", "zstd").option("maxRecordsPerFile", 0 if by else FILE_ROWS).parquet(folder)
    return (
        df.sparkSession.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", min(max(1, files // 2), BATCH_FILES))
        .parquet(folder)
    )


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """The rows a stream of available files writes."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("compression", "zstd")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


# --- the calls table -------------------------------------------------------------------------


@query(
    "s1_read_calls",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT provider, status, count(*) AS calls,
      CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM calls
    WHERE ts >= TIMESTAMP '{_MID}' GROUP BY 1, 2""",
)
def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a table and read back with a bound that prunes its dates."""
    folder = work_dir(spark, "calls")
    append_calls(fixtures.calls(spark, sf_dir), folder)
    bound = datetime(2024, 1, 16, tzinfo=timezone.utc)
    return (
        analytics.from_bound(read_calls(spark, folder), bound)
        .groupBy("provider", "status")
        .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    )


@query(
    "s2_new_calls",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT id, ingest_seq, provider, client FROM calls
    WHERE ts >= TIMESTAMP '{_MID}'""",
)
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all calls, each replayed with a later client name, onto the first half."""
    calls = fixtures.calls(spark, sf_dir).select("id", "ingest_seq", "ts", "provider", "client")
    stored = calls.where(f"ts < TIMESTAMP_NTZ '{_MID}'")
    replays = calls.selectExpr(
        "id", "ingest_seq + 1000000000000 AS ingest_seq", "ts", "provider", "'replayed' AS client"
    )
    return new_calls(replays.unionByName(calls), stored).drop("ts")


@query(
    "s2_append_twice",
    f"WITH calls AS ({fixtures.CALLS_SQL}) SELECT {', '.join(CALL_COLUMNS)} FROM calls",
)
def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "calls")
    calls = fixtures.calls(spark, sf_dir)
    append_calls(calls.where(f"ts < TIMESTAMP_NTZ '{_MID}'"), folder)
    append_calls(calls, folder)
    append_calls(calls, folder)
    stored = read_calls(spark, folder).select(*CALL_COLUMNS)
    return stored.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_EVOLVED = ", ".join(
    f"CASE WHEN ts >= TIMESTAMP '{_MID}' THEN {c} END AS {c}" for c in ADDED_COLUMNS
)


@query(
    "s3_schema_evolution",
    f"WITH calls AS ({fixtures.CALLS_SQL}) SELECT id, provider, {_EVOLVED} FROM calls",
)
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fixtures.calls(spark, sf_dir)
    old = calls.where(f"ts < TIMESTAMP_NTZ '{_MID}'").drop(*ADDED_COLUMNS)
    new = calls.where(f"ts >= TIMESTAMP_NTZ '{_MID}'")
    return union_calls(old, new).select("id", "provider", *ADDED_COLUMNS)


@query(
    "s3_mixed_files",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT id, provider, latency_ms, input_tokens, {_EVOLVED}
    FROM calls""",
)
def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of old files, which lack columns and have narrower ones, and of new files, in one scan."""
    folder = work_dir(spark, "mixed")
    calls = fixtures.calls(spark, sf_dir)
    old = calls.where(f"ts < TIMESTAMP_NTZ '{_MID}'").drop(*ADDED_COLUMNS)
    narrow = {c: F.col(c).cast("int") for c in ("latency_ms", "input_tokens", "output_tokens")}
    old.withColumns(narrow).write.parquet(folder)
    calls.where(f"ts >= TIMESTAMP_NTZ '{_MID}'").write.mode("append").parquet(folder)
    return read_calls(spark, folder).select("id", "provider", "latency_ms", "input_tokens", *ADDED_COLUMNS)


@query("s10_write_back", capture.expected_streams(capture.STORED_AS_TYPED))
def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table whose typed counts were lost on one of three days, filled in again, twice."""
    folder = work_dir(spark, "write-back")
    records = normalize(fixtures.streams(spark, sf_dir))
    day = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))
    dated = records.withColumn("ts", F.timestamp_add("DAY", day.cast("int"), F.col("ts").cast("timestamp")))
    lost = dated.withColumn("input_tokens", F.when(day == 1, None).otherwise(F.col("input_tokens")))
    append_calls(lost.withColumn("ingest_seq", F.crc32(F.col("id").cast("binary"))), folder)
    write_back(spark, folder)
    write_back(spark, folder)
    return read_calls(spark, folder).select("id", *USAGE_COLUMNS)


# --- price files -----------------------------------------------------------------------------

# One price text per part: an upper-case key, and fields that some rows leave out. Texts of sizes 3
# to 8 are malformed: tiers without threshold or rate, no numbers, no JSON, no output rate.
_MALFORMED = "(3, 4, 5, 6, 7, 8)"
_PRICE_FILES = {
    "source": "CAST(p_partkey AS STRING)",
    "modified": """CASE WHEN p_size < 25 THEN TIMESTAMP '2024-01-01 13:00:00'
        ELSE TIMESTAMP '2024-01-20 11:30:00' END""",
    "value": """CASE
        WHEN p_size = 3 THEN '{"x":{"input_per_m":1,"output_per_m":2,"tiers":[{"input_per_m":1,"output_per_m":2}]}}'
        WHEN p_size = 4 THEN '{"x":{"input_per_m":1,"output_per_m":2,"tiers":[{"above_input_tokens":5,"output_per_m":2}]}}'
        WHEN p_size = 5 THEN '{"x":{"input_per_m":"NaN","output_per_m":2}}'
        WHEN p_size = 6 THEN '{"x":{"input_per_m":1,"output_per_m":true}}'
        WHEN p_size = 7 THEN 'not json' WHEN p_size = 8 THEN '{"x":{"input_per_m":1}}'
        ELSE '{"Model-' || CAST(p_partkey AS STRING) || '":{"input_per_m":' || CAST(p_size AS STRING)
        || ',"output_per_m":' || CAST(p_size * 4 AS STRING)
        || CASE WHEN p_size < 20 THEN ',"cache_read_per_m":0.25,"cache_in_input":true' ELSE '' END
        || CASE WHEN p_size < 10 THEN ',"tiers":[{"above_input_tokens":200000,"input_per_m":9,"output_per_m":18}]'
          ELSE '' END || '},"other-' || CAST(p_partkey AS STRING)
        || '":{"input_per_m":0.5,"output_per_m":1.5}}' END""",
}
_PRICE_FILES_SQL = fixtures.columns_sql(_PRICE_FILES | {"p_partkey": "p_partkey", "p_size": "p_size"}, "part")


def _price_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.derive(fixtures.table(spark, sf_dir, "part"), _PRICE_FILES)


def _flat(prices: DataFrame) -> DataFrame:
    """Price rows with the tiers as text, to be compared."""
    return prices.selectExpr(
        "model_key", "input_per_m", "output_per_m", "cache_read_per_m", "cache_creation_per_m",
        "cache_in_input",
        """array_join(transform(tiers, t -> concat_ws('/', t.above_input_tokens, t.input_per_m,
            t.output_per_m, t.cache_read_per_m, t.cache_creation_per_m)), ';') AS tiers""",
    )


_D = "AS DECIMAL(18,6))"
_LOADED_SQL = f"""WITH files AS ({_PRICE_FILES_SQL})
    SELECT 'model-' || source AS model_key, CAST(p_size {_D} AS input_per_m,
      CAST(p_size * 4 {_D} AS output_per_m,
      CAST(CASE WHEN p_size < 20 THEN 0.25 ELSE 0 END {_D} AS cache_read_per_m,
      CAST(0 {_D} AS cache_creation_per_m, p_size < 20 AS cache_in_input,
      CASE WHEN p_size < 10 THEN '200000/9.000000/18.000000/0.000000/0.000000' ELSE '' END AS tiers
    FROM files WHERE p_size NOT IN {_MALFORMED}
    UNION ALL SELECT 'other-' || source, CAST(0.5 {_D}, CAST(1.5 {_D}, CAST(0 {_D}, CAST(0 {_D},
      FALSE, '' FROM files WHERE p_size NOT IN {_MALFORMED}"""


@query("s4_load_prices", _LOADED_SQL)
def load_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(price_source.parse_price_documents(_price_files(spark, sf_dir)))


@query("s4_store_and_load_prices", _LOADED_SQL)
def store_and_load_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "prices")
    loaded = price_source.parse_price_documents(_price_files(spark, sf_dir))
    price_source.write_prices(loaded, folder)
    return _flat(price_source.read_prices(spark, folder, per_line=True))


# One catalogue text per part: two or three providers list its model at different costs.
_CATALOGUE_SQL_TEXT = """'{"zeta":{"models":{"m-' || CAST(p_partkey AS STRING)
    || '":{"cost":{"input":9,"output":9}},"free-' || CAST(p_partkey AS STRING)
    || '":{"cost":{"input":"n/a","output":1}}}},"beta":{"models":{"m-' || CAST(p_partkey AS STRING)
    || '":{"cost":{"input":8,"output":8.5,"cache_write":2}},"claude-' || CAST(p_partkey AS STRING)
    || '":{"cost":{"input":3,"output":15}},"none":{"cost":null}}},"empty":{"name":"x"}'
    || CASE WHEN p_size < 20 THEN ',"openai":{"models":{"m-' || CAST(p_partkey AS STRING)
      || '":{"cost":{"input":' || CAST(p_size AS STRING) || ',"output":40,"cache_read":0.5,"tiers":['
      || '{"output":60,"tier":{"type":"context","size":272000}},'
      || '{"input":7,"tier":{"type":"speed","size":1}},'
      || '{"input":6,"cache_read":1,"tier":{"type":"context","size":128000}}]}}}}' ELSE '' END
    || CASE WHEN p_size < 10 THEN ',"anthropic":{"models":{"m-' || CAST(p_partkey AS STRING)
      || '":{"cost":{"input":1,"output":2}}}}' ELSE '' END || '}'"""


@query(
    "s5_prices_from_catalogue",
    f"""SELECT 'm-' || CAST(p_partkey AS VARCHAR) AS model_key,
      CAST(CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN p_size ELSE 8 END {_D} AS input_per_m,
      CAST(CASE WHEN p_size < 10 THEN 2 WHEN p_size < 20 THEN 40 ELSE 8.5 END {_D} AS output_per_m,
      CAST(CASE WHEN p_size >= 10 AND p_size < 20 THEN 0.5 ELSE 0 END {_D} AS cache_read_per_m,
      CAST(CASE WHEN p_size >= 20 THEN 2 ELSE 0 END {_D} AS cache_creation_per_m,
      p_size >= 10 AS cache_in_input,
      CASE WHEN p_size >= 10 AND p_size < 20 THEN '128000/6.000000/40.000000/1.000000/0.000000;272000/'
        || CAST(CAST(p_size {_D} AS VARCHAR) || '/60.000000/0.500000/0.000000' ELSE '' END AS tiers
    FROM part
    UNION ALL SELECT 'claude-' || CAST(p_partkey AS VARCHAR), CAST(3 {_D}, CAST(15 {_D},
      CAST(0 {_D}, CAST(0 {_D}, FALSE, '' FROM part""",
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixtures.derive(fixtures.table(spark, sf_dir, "part"), {"value": _CATALOGUE_SQL_TEXT})
    return _flat(price_source.prices_from_catalogue(texts))


_NUMBER = "CAST(p_partkey AS VARCHAR)"


@query(
    "p1_rate_lookup_by_catalogue",
    f"""WITH keys AS (SELECT 'm-' || {_NUMBER} AS model_key FROM part
      UNION ALL SELECT 'claude-' || {_NUMBER} FROM part)
    SELECT p_partkey, max_by(model_key, length(model_key)) AS model_key
    FROM part LEFT JOIN keys ON starts_with('m-' || {_NUMBER} || CAST(p_size AS VARCHAR), model_key)
    GROUP BY p_partkey""",
)
def rate_lookup_by_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys for each part, with two beginnings; most names meet several nested keys."""
    parts = fixtures.table(spark, sf_dir, "part")
    texts = fixtures.derive(parts, {"value": _CATALOGUE_SQL_TEXT})
    calls = parts.selectExpr(
        "p_partkey", "'M-' || CAST(p_partkey AS STRING) || CAST(p_size AS STRING) AS model",
        "CAST(1 AS BIGINT) AS input_tokens", "CAST(0 AS BIGINT) AS cache_read_input_tokens",
        "CAST(0 AS BIGINT) AS cache_creation_input_tokens",
    )
    rated = attach_rates(calls, price_source.prices_from_catalogue(texts))
    return rated.select("p_partkey", "model_key")


@query(
    "s4_malformed_prices",
    f"""WITH files AS ({_PRICE_FILES_SQL}) SELECT source, 'ignoring malformed ' || source AS warning
    FROM files WHERE p_size IN {_MALFORMED}""",
)
def malformed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_source.malformed_prices(_price_files(spark, sf_dir))


@query(
    "s6_price_summary",
    f"""WITH files AS ({_PRICE_FILES_SQL}) SELECT source,
      CASE WHEN p_size NOT IN {_MALFORMED} THEN 2 END AS models,
      CAST(CASE WHEN p_size < 25 THEN 29 ELSE 11 END AS BIGINT) AS age_days FROM files""",
)
def price_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_source.price_summary(_price_files(spark, sf_dir), analytics.NOW)


# --- JSON reports ----------------------------------------------------------------------------


def _read_back(report: DataFrame) -> DataFrame:
    row = F.from_json("value", report.schema, TIME_FORMATS).alias("r")
    return json_lines(report).select(row).select("r.*")


@query("s7_grouped_json", analytics.stats_sql("client"))
def grouped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(
        stats.grouped_stats(fixtures.calls(spark, sf_dir), analytics.card(spark), "client")
    )


@query(
    "s8_listing_json",
    analytics.with_priced(
        f"SELECT ingest_seq, {analytics.LISTED_SQL} FROM sourced", analytics.SOURCED_SQL
    ),
)
def listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(
        tail.priced_listing(fixtures.calls(spark, sf_dir), analytics.card(spark))
    )


@query(
    "s9_budget_json",
    analytics.with_priced(
        analytics.verdict_sql(analytics.at_utc(2024, 1, 22, 8), "week", "50.0")
    ),
)
def budget_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fixtures.calls(spark, sf_dir)
    return _read_back(
        budget_check(calls, analytics.card(spark), "50/week", analytics.IN_DATA, analytics.ZONE)
    )


# --- streams ---------------------------------------------------------------------------------


@query(
    "h1_stream_records",
    f"{capture.RECORDS_SQL} SELECT id, {', '.join(capture.RECORD_COLUMNS)} FROM records",
)
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows captures are made of are staged; the captures, with their bodies, are only streamed."""
    folder = work_dir(spark, "normalize")
    events = staged(fixtures.table(spark, sf_dir, "events").select(*fixtures.CAPTURED), f"{folder}/in")
    return drained(jobs.normalize_stream(fixtures.captures_of(events)), folder)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event streams cut into three chunks each, and their terminal messages."""
    turns = fixtures.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    cut = fixtures.derive(turns, fixtures.STREAMS | {"turn": "turn"}).selectExpr(
        "*",
        """CASE WHEN first_bytes = 0 THEN 0
            ELSE CAST(length(body) * (turn % 7 + 1) / 9 AS INT) END AS a""",
        "CAST(length(body) * (turn % 5 + 14) / 19 AS INT) AS b",
    )
    return cut.selectExpr(
        "call_id", "provider", "path", "content_type",
        """stack(4,
            0, 'chunk', first_ms, encode(left(body, a), 'UTF-8'),
            1, 'chunk', second_ms, encode(substring(body, a + 1, b - a), 'UTF-8'),
            2, 'chunk', second_ms + 1, encode(substring(body, b + 1), 'UTF-8'),
            3, outcome, elapsed_ms, CAST(NULL AS BINARY)) AS (seq, outcome, elapsed_ms, data)""",
    ).selectExpr(
        "call_id", # Days apart, and the last messages to come are the oldest by their own time.
        "timestampadd(DAY, pmod(hash(call_id), 20) - 10 * seq, TIMESTAMP '2024-02-01 00:00:00') AS ts", "seq", "outcome", "elapsed_ms", "data",
        "CAST(NULL AS STRING) AS error_message", "provider", "path",
        "map('user-agent', 'agent/1') AS headers", "CAST(NULL AS STRING) AS request_body",
        "CAST(NULL AS STRING) AS request_url", "200 AS status", "content_type",
        "CAST(NULL AS STRING) AS peer_exe",
    )


@query(
    "h2_assembled_streams",
    capture.expected_streams(
        """call_id AS id, provider, model, elapsed_ms AS latency_ms, ttft_ms, input_tokens,
        output_tokens, cache_read_input_tokens, reasoning_output_tokens, cost, error_kind,
        CAST(NULL AS VARCHAR) AS anomaly, raw_usage"""
    ),
)
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a call are spread over the batches, not in order."""
    folder = work_dir(spark, "assemble")
    with state_settings(spark):
        stream = staged(messages(spark, sf_dir), f"{folder}/in", 4, "seq")
        records = drained(jobs.normalize_stream(assembly.assemble(stream)), folder)
    return records.select(
        "id", "provider", "model", "latency_ms", "ttft_ms", "input_tokens", "output_tokens",
        "cache_read_input_tokens", "reasoning_output_tokens", "cost", "error_kind", "anomaly",
        "raw_usage",
    )


def _at_rest(run: StreamingQuery) -> bool:
    """Whether the last batch found nothing to read and left no state."""
    last = run.lastProgress
    return (
        last is not None
        and last.batchId > 0
        and last.numInputRows == 0
        and not any(held.numRowsTotal for held in last.stateOperators)
    )


def silent(stream: DataFrame, folder: str, seconds: float = 600) -> DataFrame:
    """The rows a stream writes until it has read all there is and holds no state any more."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(processingTime="1 second")
        .start()
    )
    end = monotonic() + seconds
    try:
        # Timers keep such a query in batches, so that it never counts as having processed all.
        while not _at_rest(run):
            if monotonic() > end:
                raise TimeoutError(f"still state after {seconds} seconds")
            run.awaitTermination(0.2)
    finally:
        run.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "h2_silent_stream",
    capture.expected_streams(
        """call_id AS id, provider,
        CASE WHEN turn % 3 = 0 THEN 41 + turn * 2 ELSE elapsed_ms END AS latency_ms,
        CASE WHEN turn % 3 <> 0 THEN input_tokens END AS input_tokens,
        CASE WHEN turn % 3 = 0 THEN 'observation_dropped' END AS anomaly"""
    ),
)
def silent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn never ends, and no message comes after it; its timer ends it."""
    folder = work_dir(spark, "silent")
    ended = "seq < 3 OR CAST(element_at(split(call_id, '-'), -1) AS INT) % 3 <> 0"
    messages(spark, sf_dir).where(ended).write.parquet(f"{folder}/in")
    with state_settings(spark):
        source = spark.readStream.schema(assembly.MESSAGES).parquet(f"{folder}/in")
        records = silent(jobs.normalize_stream(assembly.assemble(source, timeout_ms=2_000, idle=True)), folder)
    return records.select("id", "provider", "latency_ms", "input_tokens", "anomaly")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fixtures.calls(spark, sf_dir)
    return calls.unionByName(calls).withColumn("ts", F.col("ts").cast("timestamp"))


_IDS_SQL = f"WITH calls AS ({fixtures.CALLS_SQL}) SELECT id, provider, input_tokens FROM calls"


@query("h3_store_stream", _IDS_SQL)
def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call twice, stored once."""
    folder = work_dir(spark, "store")
    stream = staged(_replayed(spark, sf_dir), f"{folder}/in")
    jobs.store_calls(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return read_calls(spark, f"{folder}/table").select("id", "provider", "input_tokens")


@query("h3_store_behind_recent_ids", _IDS_SQL)
def store_behind_recent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are held for a millisecond only, so copies in later batches are left to the index."""
    folder = work_dir(spark, "recent")
    with state_settings(spark):
        recent = jobs.drop_replays(staged(_replayed(spark, sf_dir), f"{folder}/in"), "1 millisecond")
        jobs.store_calls(recent, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return read_calls(spark, f"{folder}/table").select("id", "provider", "input_tokens")


@query("h3_drop_replays", _IDS_SQL)
def drop_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "replays")
    with state_settings(spark):
        stream = staged(_replayed(spark, sf_dir), f"{folder}/in", 2)
        kept = drained(jobs.drop_replays(stream), folder)
    return kept.select("id", "provider", "input_tokens")


_RUNNING_SQL = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, provider, count(*) AS calls,
    count(*) - count(cost_pico) AS unpriced_calls,
    {analytics.usd_sql('coalesce(sum(cost_pico), 0)')} AS spent FROM priced GROUP BY 1, 2"""


def _kept(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """The state of the spend log after a stream of several batches."""
    folder = work_dir(spark, "spend")
    calls = fixtures.calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = staged(calls, f"{folder}/in")
    spend_log.keep_spend(stream, analytics.card(spark), f"{folder}/log", f"{folder}/checkpoint", period).awaitTermination()
    return spend_log.read_spend(spark, f"{folder}/log")


@query("h4_running_spend", analytics.with_priced(_RUNNING_SQL))
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = _kept(spark, sf_dir, "day").withColumn("day", F.date_format("period", "yyyy-MM-dd"))
    return spend.select("day", "provider", "calls", "unpriced_calls", "spent")


@query(
    "h4_budget_by_day",
    analytics.with_priced(
        f"""SELECT day, provider, calls, unpriced_calls, spent, 5.0e0 AS budget,
          spent / 5.0e0 * 100.0e0 AS pct, spent >= 5.0e0 AS over, 5.0e0 - spent AS remaining,
          CASE WHEN spent >= 5.0e0 THEN 'over' WHEN unpriced_calls > 0 THEN 'unknown' ELSE 'ok' END
            AS status FROM ({_RUNNING_SQL})"""
    ),
)
def budget_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend_log.budget_by_day(_kept(spark, sf_dir, "day"), 5.0)


@query(
    "h4_rolling_budget",
    analytics.with_priced(
        f"""SELECT hour, provider, calls, unpriced_calls, spent, 3.0e0 AS budget,
          spent / 3.0e0 * 100.0e0 AS pct, spent >= 3.0e0 AS over, 3.0e0 - spent AS remaining,
          CASE WHEN spent >= 3.0e0 THEN 'over' WHEN unpriced_calls > 0 THEN 'unknown' ELSE 'ok' END
            AS status
        FROM (SELECT hour, provider, CAST(sum(n) OVER span AS BIGINT) AS calls,
            CAST(sum(no_price) OVER span AS BIGINT) AS unpriced_calls,
            {analytics.usd_sql('sum(total) OVER span')} AS spent
          FROM (SELECT date_trunc('hour', ts) AS hour, provider, count(*) AS n,
              count(*) - count(cost_pico) AS no_price, coalesce(sum(cost_pico), 0) AS total
            FROM priced GROUP BY 1, 2)
          WINDOW span AS (PARTITION BY provider ORDER BY hour
            RANGE BETWEEN INTERVAL 167 HOURS PRECEDING AND CURRENT ROW))"""
    ),
)
def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of seven days, judged at every hour of the stream."""
    amount, period = parse_budget("3/7d")
    rolling = spend_log.rolling_budget(_kept(spark, sf_dir, "hour"), amount, period_hours(period))
    return rolling.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
