"""Queries over captured exchanges: splitting, reading, merging and normalising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import sse, text
from spendlens.functions.usage import family_of, usage_key_of
from spendlens.operators import normalize as norm
from spendlens.operators.review import uncached_reasoners
from spendlens.plans import fixtures
from spendlens.plans.registry import query
from spendlens.schemas import TOKEN_COLUMNS, USAGE_COLUMNS

EXCHANGES = f"exchanges AS ({fixtures.EXCHANGES_SQL})"
CAPTURES = f"captures AS ({fixtures.CAPTURES_SQL})"
STREAMS = f"streams AS ({fixtures.STREAMS_SQL})"
SSE = f"sse AS ({fixtures.SSE_EXCHANGES_SQL})"

_NULL_COUNT = "CAST(NULL AS BIGINT)"


def _count(path: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'UBIGINT' THEN CAST(json_extract({j}, '{path}') AS BIGINT) END"


def _either(first: str, second: str, then: str = "") -> str:
    return f"""CASE WHEN json_type(j, '{first}') IS NOT NULL THEN {_count(first + then)}
        ELSE {_count(second + then)} END"""


# Whole bodies read by the oracle: j is the body where it counts, as valid JSON.
_READ_SQL = f"""readable AS (SELECT *,
    CASE provider WHEN 'anthropic' THEN 'anthropic' WHEN 'gemini' THEN 'gemini' ELSE 'openai' END
      AS family,
    CASE WHEN status BETWEEN 200 AND 299 AND contains(content_type, 'json') AND json_valid(body)
      THEN body ELSE '{{}}' END AS j FROM source),
  fields AS (SELECT *,
    CASE family WHEN 'anthropic' THEN {_count('$.usage.input_tokens')}
      WHEN 'gemini' THEN {_count('$.usageMetadata.promptTokenCount')}
      ELSE {_either('$.usage.input_tokens', '$.usage.prompt_tokens')} END AS input_tokens,
    CASE family WHEN 'anthropic' THEN {_count('$.usage.output_tokens')}
      WHEN 'gemini' THEN CASE
        WHEN json_type(j, '$.usageMetadata.candidatesTokenCount') = 'UBIGINT'
          OR json_type(j, '$.usageMetadata.thoughtsTokenCount') = 'UBIGINT'
        THEN coalesce({_count('$.usageMetadata.candidatesTokenCount')}, 0)
          + coalesce({_count('$.usageMetadata.thoughtsTokenCount')}, 0) END
      ELSE {_either('$.usage.output_tokens', '$.usage.completion_tokens')} END AS reported_output,
    CASE family WHEN 'anthropic' THEN {_count('$.usage.cache_read_input_tokens')}
      WHEN 'gemini' THEN {_count('$.usageMetadata.cachedContentTokenCount')}
      ELSE coalesce({_either('$.usage.input_tokens_details', '$.usage.prompt_tokens_details', '.cached_tokens')},
        {_count('$.usage.prompt_cache_hit_tokens')}, {_count('$.usage.cached_tokens')}) END
      AS cache_read_input_tokens,
    CASE family WHEN 'anthropic' THEN {_count('$.usage.cache_creation_input_tokens')} END
      AS cache_creation_input_tokens,
    CASE family WHEN 'gemini' THEN {_count('$.usageMetadata.thoughtsTokenCount')}
      WHEN 'openai' THEN {_either('$.usage.output_tokens_details', '$.usage.completion_tokens_details', '.reasoning_tokens')}
      END AS reasoning_output_tokens,
    CASE family WHEN 'openai' THEN {_count('$.usage.total_tokens')} END AS total,
    CASE WHEN family = 'openai' THEN CASE
      WHEN json_type(j, '$.usage.cost') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
        THEN CAST(json_extract(j, '$.usage.cost') AS DOUBLE)
      ELSE CAST({_count('$.usage.cost_in_usd_ticks')} AS DOUBLE) / 10000000000e0 END END AS cost,
    CASE WHEN json_type(j, '$.model') = 'VARCHAR' THEN nullif(j ->> '$.model', '') END AS root_model,
    CASE WHEN json_type(j, '$.modelVersion') = 'VARCHAR' THEN nullif(j ->> '$.modelVersion', '') END
      AS version_model,
    CASE WHEN json_type(j, CASE WHEN family = 'gemini' THEN '$.usageMetadata' ELSE '$.usage' END)
      = 'OBJECT' THEN TRUE ELSE FALSE END AS has_usage
    FROM readable),
  parsed AS (SELECT *, CASE WHEN reasoning_output_tokens > 0 AND family = 'openai'
      AND total = input_tokens + reported_output + reasoning_output_tokens
      THEN reported_output + reasoning_output_tokens ELSE reported_output END AS output_tokens
    FROM fields)"""


def _parsed(select: str, source: str) -> str:
    name = source.split(" ", 1)[0]
    return f"WITH {source}, source AS (SELECT * FROM {name}), {_READ_SQL} {select}"


def _whole(exchanges: DataFrame) -> DataFrame:
    """Bare exchanges (status, content type, body) with the columns reading needs."""
    return exchanges.selectExpr("*", "'finish' AS outcome", "false AS observation_dropped")


def _usage_rows(exchanges: DataFrame) -> DataFrame:
    read = norm.with_usage(norm.with_documents(_whole(exchanges)))
    return read.select("call_id", "provider", *[f"usage.{c}" for c in USAGE_COLUMNS])


@query(
    "n1_provider_dispatch",
    f"""WITH {CAPTURES} SELECT provider,
      CASE provider WHEN 'anthropic' THEN 'anthropic' WHEN 'gemini' THEN 'gemini' ELSE 'openai' END
        AS family,
      CASE provider WHEN 'gemini' THEN 'usageMetadata' ELSE 'usage' END AS usage_key,
      count(*) AS calls FROM captures GROUP BY ALL""",
)
def provider_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.captures(spark, sf_dir)
        .selectExpr(
            "provider", f"{family_of('provider')} AS family", f"{usage_key_of('provider')} AS usage_key"
        )
        .groupBy("provider", "family", "usage_key")
        .agg(F.count("*").alias("calls"))
    )


@query(
    "n2_top_level_usage",
    _parsed("SELECT call_id, has_usage FROM parsed", EXCHANGES),
)
def top_level_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = norm.with_documents(_whole(fixtures.exchanges(spark, sf_dir)))
    return docs.selectExpr(
        "call_id", f"{norm.body_object(norm.LIVE_LIMITS)} IS NOT NULL AS has_usage"
    )


@query(
    "n3_json_gating",
    f"""WITH {CAPTURES} SELECT status, content_type,
      status BETWEEN 200 AND 299 AND contains(content_type, 'json')
        AND outcome <> 'send_failure' AND NOT observation_dropped AS is_read,
      count(*) AS calls FROM captures GROUP BY ALL""",
)
def json_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.captures(spark, sf_dir)
        .selectExpr("status", "content_type", f"{norm.is_json()} AS is_read")
        .groupBy("status", "content_type", "is_read")
        .agg(F.count("*").alias("calls"))
    )


def _family_query(key: str, providers: str, columns: list[str], source: str, build) -> None:
    names = ", ".join(["call_id", *columns])

    @query(key, _parsed(f"SELECT {names} FROM parsed WHERE provider {providers}", source))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _usage_rows(build(spark, sf_dir).where(f"provider {providers}"))
        return rows.select("call_id", *columns)


def _bare_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.captures(spark, sf_dir).select(
        "call_id", "provider", "status", "content_type", "body"
    )


_family_query("n4_openai_usage", "= 'openai'", USAGE_COLUMNS, EXCHANGES, fixtures.exchanges)
_family_query(
    "n4_openai_like_usage",
    "NOT IN ('anthropic', 'gemini')",
    ["input_tokens", "output_tokens", "cache_read_input_tokens"],
    CAPTURES,
    _bare_captures,
)
_family_query(
    "n5_additive_reasoning",
    "NOT IN ('anthropic', 'gemini')",
    ["output_tokens", "reasoning_output_tokens"],
    CAPTURES,
    _bare_captures,
)
_family_query(
    "n6_reported_cost", "NOT IN ('anthropic', 'gemini')", ["cost"], CAPTURES, _bare_captures
)
_family_query("n7_anthropic_usage", "= 'anthropic'", USAGE_COLUMNS, CAPTURES, _bare_captures)
_family_query("n8_gemini_usage", "= 'gemini'", USAGE_COLUMNS, CAPTURES, _bare_captures)


# --- event streams ---------------------------------------------------------------------------

_EVENTS_SQL = """pieces AS (SELECT call_id, provider,
    string_split_regex(body, '\\r\\n\\r\\n|\\n\\n') AS p FROM source),
  numbered AS (SELECT call_id, provider, unnest(p[1:len(p) - 1]) AS piece,
    unnest(range(1, len(p))) AS pos FROM pieces),
  lined AS (SELECT call_id, provider, pos,
    list_transform(string_split(piece, chr(10)), lambda x: rtrim(x, chr(13))) AS lines FROM numbered),
  split AS (SELECT call_id, provider, pos,
    coalesce(trim(list_filter(lines, lambda x: starts_with(x, 'event:'))[-1][7:]), '') AS event_type,
    array_to_string(list_transform(list_filter(lines, lambda x: starts_with(x, 'data:')),
      lambda x: ltrim(x[6:])), chr(10)) AS data FROM lined),
  events AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos) - 1 AS seq
    FROM split WHERE data <> '' AND data IS NOT NULL AND data <> '[DONE]')"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = fixtures.sse_exchanges(spark, sf_dir).unionByName(
        fixtures.streams(spark, sf_dir).select("call_id", "provider", "body")
    )
    split = streams.withColumn("pieces", F.expr(sse.pieces_of("body")))
    return split.selectExpr(
        "call_id", "provider", f"posexplode({sse.events_of(sse.complete('pieces'))}) AS (seq, e)"
    ).selectExpr("call_id", "provider", "CAST(seq AS BIGINT) AS seq", "e.event_type", "e.data")


_BOTH = f"""WITH {SSE}, {STREAMS}, source AS (SELECT call_id, provider, body FROM sse
    UNION ALL SELECT call_id, provider, body FROM streams), {_EVENTS_SQL}"""


@query("n9_sse_events", f"{_BOTH} SELECT call_id, provider, seq, event_type, data FROM events")
def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@query(
    "n10_event_gate",
    f"""{_BOTH} SELECT call_id, seq FROM events
    WHERE event_type IN ('message_start', 'message_delta') OR contains(data, '"usage"')
      OR contains(data, '"usageMetadata"')""",
)
def event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).selectExpr("*", "struct(event_type, data) AS e")
    return events.where(sse.carries_usage("e")).select("call_id", "seq")


# Expected results per stream family, from the numbers the streams were written with.
_EXPECTED_SQL = f"""expected AS (SELECT call_id, provider, turn, chars,
  CAST(chars AS BIGINT) AS input_tokens,
  CAST(CASE provider WHEN 'anthropic' THEN turn * 10 + 5 WHEN 'openai' THEN turn + 9
    WHEN 'groq' THEN turn + 7 WHEN 'gemini' THEN turn + 7 ELSE 12 END AS BIGINT) AS output_tokens,
  CAST(CASE provider WHEN 'anthropic' THEN 20 WHEN 'openai' THEN 7 WHEN 'gemini' THEN 2 END
    AS BIGINT) AS cache_read_input_tokens,
  {_NULL_COUNT} AS cache_creation_input_tokens,
  CAST(CASE provider WHEN 'openai' THEN 3 WHEN 'gemini' THEN 4 WHEN 'xai' THEN 11 END AS BIGINT)
    AS reasoning_output_tokens,
  CASE provider WHEN 'xai' THEN 3150000e0 / 10000000000e0 END AS cost,
  CASE provider WHEN 'anthropic' THEN 'claude-sonnet-4-5' WHEN 'groq' THEN 'llama-3'
    WHEN 'gemini' THEN 'gemini-2.0-flash' WHEN 'xai' THEN 'grok-4.5' END AS model,
  CASE provider
    WHEN 'anthropic' THEN '[{{"input_tokens":' || CAST(chars AS VARCHAR)
      || ',"cache_read_input_tokens":20,"output_tokens":1}},{{"output_tokens":'
      || CAST(turn * 10 + 5 AS VARCHAR) || '}}]'
    WHEN 'openai' THEN '{{"input_tokens":' || CAST(chars AS VARCHAR)
      || ',"input_tokens_details":{{"cached_tokens":7}},"output_tokens":'
      || CAST(turn + 9 AS VARCHAR) || ',"output_tokens_details":{{"reasoning_tokens":3}}}}'
    WHEN 'groq' THEN '{{"prompt_tokens":1,"completion_tokens":2}}'
    WHEN 'gemini' THEN '[{{"promptTokenCount":' || CAST(chars AS VARCHAR)
      || ',"cachedContentTokenCount":2}},{{"promptTokenCount":' || CAST(chars AS VARCHAR)
      || ',"candidatesTokenCount":' || CAST(turn + 3 AS VARCHAR) || ',"thoughtsTokenCount":4}}]'
    ELSE '{{"prompt_tokens":' || CAST(chars AS VARCHAR)
      || ',"completion_tokens":1,"total_tokens":' || CAST(chars + 12 AS VARCHAR)
      || ',"completion_tokens_details":{{"reasoning_tokens":11}},"cost_in_usd_ticks":3150000}}' END
    AS raw_usage,
  CASE WHEN turn % 3 = 1 THEN 40 + turn * 2 ELSE 20 + turn END AS ttft_ms, elapsed_ms, path, ts,
  CASE WHEN turn % 4 = 3 THEN 'client_disconnect' END AS error_kind
  FROM streams)"""


def expected_streams(select: str, where: str = "TRUE") -> str:
    return f"WITH {STREAMS}, {_EXPECTED_SQL} SELECT {select} FROM expected WHERE {where}"


def _stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.with_usage(norm.with_documents(fixtures.streams(spark, sf_dir)))


def _stream_query(key: str, condition: str) -> None:
    @query(key, expected_streams(", ".join(["call_id", *USAGE_COLUMNS]), condition))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = norm.with_usage(
            norm.with_documents(fixtures.streams(spark, sf_dir).where(condition))
        )
        return read.select("call_id", *[f"usage.{c}" for c in USAGE_COLUMNS])


_stream_query("n11_openai_stream_usage", "provider IN ('openai', 'groq', 'xai')")
_stream_query("n12_anthropic_stream_usage", "provider = 'anthropic'")
_stream_query("n13_gemini_stream_usage", "provider = 'gemini'")


@query(
    "n14_merge_events",
    f"""WITH {SSE} SELECT s.call_id, CAST(length(c.text) AS BIGINT) AS input_tokens,
      CAST(CASE WHEN s.provider = 'anthropic' THEN c.turn * 10 + 5 ELSE c.turn + 1 END AS BIGINT)
        AS output_tokens,
      CAST(CASE WHEN s.provider = 'anthropic' THEN 20 END AS BIGINT) AS cache_read_input_tokens
    FROM sse s JOIN conversations c
      ON s.call_id = CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR)""",
)
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = fixtures.sse_exchanges(spark, sf_dir).selectExpr(
        "*", "200 AS status", "'text/event-stream' AS content_type"
    )
    read = norm.with_usage(norm.with_documents(_whole(streams)))
    return read.select(
        "call_id", "usage.input_tokens", "usage.output_tokens", "usage.cache_read_input_tokens"
    )


@query("n15_raw_usage", expected_streams("call_id, raw_usage"))
def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _stream_usage(spark, sf_dir)
    return read.selectExpr("call_id", f"{norm.raw_usage(norm.LIVE_LIMITS)} AS raw_usage")


# --- whole records ---------------------------------------------------------------------------

_ENDPOINT_SQL = "CASE WHEN contains(path, '?') THEN left(path, strpos(path, '?') - 1) ELSE path END"
_INFERENCE_SQL = " OR ".join(
    f"contains(lower({_ENDPOINT_SQL}), '{m}')" for m in text.INFERENCE_MARKERS
)
_REDACTED_SQL = """replace(error_message, request_url, 'https://api.example.com/v1/messages')"""
_KIND_SQL = """CASE
    WHEN regexp_matches(m, 'tls|ssl|certificate|handshake') THEN 'upstream_tls'
    WHEN regexp_matches(m, 'timeout|timed out|deadline') THEN 'upstream_timeout'
    WHEN regexp_matches(m, 'client disconnect|connection reset|broken pipe') THEN 'client_disconnect'
    WHEN regexp_matches(m, 'connect|refused|unreachable|no route|dns') THEN 'upstream_connect'
    ELSE 'other' END"""
_CLIENT_SQL = """nullif(trim(CASE WHEN client_header IS NOT NULL THEN client_header
    ELSE user_agent END), '')"""
_PATH_MODEL_SQL = """CASE WHEN provider = 'gemini'
    THEN nullif(regexp_extract(path, '/models/([^:/?]*)', 1), '') END"""
_REQUEST_MODEL_SQL = "CASE WHEN event_body = 0 THEN request_body ->> '$.model' END"

RECORDS_SQL = f"""WITH {CAPTURES},
  source AS (SELECT * REPLACE (CASE WHEN outcome = 'send_failure' OR observation_dropped
      THEN 'none' ELSE content_type END AS content_type),
      CASE WHEN starts_with(request_body, '{{"model":"') THEN 0 ELSE 1 END AS event_body
    FROM captures WHERE {_INFERENCE_SQL}), {_READ_SQL},
  records AS (SELECT call_id AS id, ts, provider,
    coalesce({_PATH_MODEL_SQL}, {_REQUEST_MODEL_SQL}, root_model, version_model) AS model,
    CASE WHEN outcome <> 'send_failure' THEN status END AS status,
    elapsed_ms AS latency_ms, {_NULL_COUNT} AS ttft_ms, FALSE AS stream,
    {', '.join(TOKEN_COLUMNS)}, cost,
    CASE WHEN outcome = 'client_disconnect' THEN 'client_disconnect'
      WHEN outcome <> 'finish' THEN (SELECT {_KIND_SQL} FROM (SELECT lower(error_message) AS m))
      END AS error_kind,
    CASE WHEN outcome = 'client_disconnect' THEN 'downstream client disconnected'
      WHEN outcome <> 'finish' THEN {_REDACTED_SQL} END AS error_message,
    {_CLIENT_SQL} AS client, {_ENDPOINT_SQL} AS endpoint,
    CASE WHEN outcome = 'send_failure' THEN NULL WHEN observation_dropped THEN 'observation_dropped'
      WHEN outcome = 'finish' AND status BETWEEN 200 AND 299 AND input_tokens IS NULL
        AND output_tokens IS NULL AND cache_read_input_tokens IS NULL
        AND cache_creation_input_tokens IS NULL AND reasoning_output_tokens IS NULL
        AND cost IS NULL THEN 'no_usage' END AS anomaly,
    CASE WHEN has_usage THEN j -> CASE WHEN family = 'gemini' THEN '$.usageMetadata' ELSE '$.usage' END
      END::VARCHAR AS raw_usage,
    peer_exe FROM parsed)"""


def _record_query(key: str, columns: list[str]) -> None:
    names = ", ".join(["id", *columns])

    @query(key, f"{RECORDS_SQL} SELECT {names} FROM records")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = norm.normalize(fixtures.captures(spark, sf_dir))
        return records.select("id", *columns)


_record_query("n16_model_resolution", ["provider", "model"])


@query(
    "n17_request_model",
    f"""WITH {CAPTURES} SELECT call_id, CASE WHEN content_length IN ('512', '262144')
      AND starts_with(request_body, '{{"model":"') THEN request_body ->> '$.model' END
      AS request_model FROM captures""",
)
def request_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = norm.with_request_model(fixtures.captures(spark, sf_dir), norm.LIVE_LIMITS)
    return sent.select("call_id", "request_model")


@query(
    "n18_oversized_model",
    _parsed(
        """SELECT call_id, CASE WHEN length(root_model) <= 254 THEN root_model END AS model,
        input_tokens FROM parsed WHERE provider = 'anthropic'""",
        CAPTURES,
    ),
)
def oversized_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = _bare_captures(spark, sf_dir).where("provider = 'anthropic'")
    read = norm.with_usage(norm.with_documents(_whole(bare)), norm.LIVE_LIMITS)
    return read.selectExpr("call_id", "seen_model AS model", "usage.input_tokens")


@query(
    "n19_inference_filter",
    f"""WITH {CAPTURES} SELECT path, ({_INFERENCE_SQL}) AS recorded, count(*) AS calls
    FROM captures GROUP BY ALL""",
)
def inference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.captures(spark, sf_dir)
        .select("path", text.is_inference(text.endpoint_of(F.col("path"))).alias("recorded"))
        .groupBy("path", "recorded")
        .agg(F.count("*").alias("calls"))
    )


@query(
    "n20_endpoint",
    f"WITH {CAPTURES} SELECT path, {_ENDPOINT_SQL} AS endpoint, count(*) AS calls FROM captures GROUP BY ALL",
)
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.captures(spark, sf_dir)
        .select("path", text.endpoint_of(F.col("path")).alias("endpoint"))
        .groupBy("path", "endpoint")
        .agg(F.count("*").alias("calls"))
    )


@query("n21_client", f"WITH {CAPTURES} SELECT call_id, left({_CLIENT_SQL}, 128) AS client FROM captures")
def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = text.client_of(F.col("headers"), norm.CLIENT_HEADER, norm.LIVE_LIMITS.client_chars).alias("client")
    return fixtures.captures(spark, sf_dir).select("call_id", client)


@query(
    "n22_error_kind",
    f"""WITH {CAPTURES} SELECT kind, count(*) AS calls FROM (SELECT {_KIND_SQL} AS kind
    FROM (SELECT lower(error_message) AS m FROM captures)) GROUP BY kind""",
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.captures(spark, sf_dir)
        .groupBy(text.error_kind_of(F.col("error_message")).alias("kind"))
        .agg(F.count("*").alias("calls"))
    )


@query(
    "n23_redacted_error",
    f"WITH {CAPTURES} SELECT call_id, {_REDACTED_SQL} AS message FROM captures",
)
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = text.redact_error(F.col("error_message"), F.col("request_url")).alias("message")
    return fixtures.captures(spark, sf_dir).select("call_id", message)


_record_query("n24_outcome_errors", ["status", "error_kind", "error_message"])


@query(
    "n25_degraded_capture",
    f"""WITH {STREAMS}, {_EXPECTED_SQL}, longest AS (SELECT call_id,
      list_max(list_transform(string_split_regex(body, '\\r\\n\\r\\n|\\n\\n'),
        lambda p: octet_length(encode(p)))) > 150 AS overflow FROM streams)
    SELECT call_id AS id, CASE WHEN overflow THEN 'sse_overflow' END AS anomaly,
      CASE WHEN NOT overflow THEN input_tokens END AS input_tokens,
      CASE WHEN NOT overflow THEN raw_usage END AS raw_usage
    FROM expected JOIN longest USING (call_id)""",
)
def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event limit of 150 bytes, which some of the streams outgrow."""
    records = norm.normalize(fixtures.streams(spark, sf_dir), limits=norm.Limits(event_bytes=150))
    return records.select("id", "anomaly", "input_tokens", "raw_usage")


_record_query("n26_missing_usage", ["anomaly"])


@query("n27_timings", expected_streams("call_id AS id, ttft_ms, elapsed_ms AS latency_ms"))
def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.normalize(fixtures.streams(spark, sf_dir)).select("id", "ttft_ms", "latency_ms")


RECORD_COLUMNS = [c for c in norm.CALL_COLUMNS if c != "id"]
_record_query("n28_records", RECORD_COLUMNS)


@query(
    "n28_stream_records",
    expected_streams(
        f"""call_id AS id, ts, provider, model, 200 AS status, elapsed_ms AS latency_ms, ttft_ms,
        TRUE AS stream, {', '.join(TOKEN_COLUMNS)}, error_kind,
        CASE WHEN error_kind IS NOT NULL THEN 'downstream client disconnected' END AS error_message,
        cost, 'agent/1' AS client, path AS endpoint, CAST(NULL AS VARCHAR) AS anomaly,
        raw_usage, CAST(NULL AS VARCHAR) AS peer_exe"""
    ),
)
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.normalize(fixtures.streams(spark, sf_dir))


_RAW_COLUMNS = ", ".join(f"{c} AS raw_{c}" for c in USAGE_COLUMNS)


# The groq streams keep the first of their two usage objects.
_STORED = {"input_tokens": 1, "output_tokens": 2}
_STORED_COLUMNS = ", ".join(
    f"CASE WHEN provider = 'groq' THEN {_STORED[c]} ELSE {c} END AS raw_{c}"
    if c in _STORED
    else f"{c} AS raw_{c}"
    for c in USAGE_COLUMNS
)


STORED_AS_TYPED = "call_id AS id, " + _STORED_COLUMNS.replace(" AS raw_", " AS ").replace("cost AS cost", "cost")


@query("s10_backfill_streams", expected_streams(f"call_id AS id, {_STORED_COLUMNS}"))
def backfill_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = norm.backfill(norm.normalize(fixtures.streams(spark, sf_dir)))
    return filled.select("id", *[f"raw_{c}" for c in USAGE_COLUMNS])


@query("s10_backfill_bodies", f"{RECORDS_SQL} SELECT id, {_RAW_COLUMNS} FROM records")
def backfill_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = norm.normalize(fixtures.captures(spark, sf_dir))
    filled = norm.backfill(records)
    return filled.select("id", *[f"raw_{c}" for c in USAGE_COLUMNS])


@query(
    "v4_uncached_reasoners",
    _parsed(
        """SELECT model, count(*) AS calls,
          CAST(coalesce(sum(cache_read_input_tokens), 0) AS BIGINT) AS cache_read_tokens,
          CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          CAST(sum(reasoning_output_tokens) AS BIGINT) AS reasoning_tokens,
          CAST(sum(reasoning_output_tokens) AS DOUBLE) / sum(output_tokens) AS reasoning_share
        FROM (SELECT *, coalesce(root_model, version_model) AS model FROM parsed) GROUP BY model
        HAVING coalesce(sum(cache_read_input_tokens), 0) = 0
          AND CAST(sum(reasoning_output_tokens) AS DOUBLE) / sum(output_tokens) > 0.2""",
        EXCHANGES,
    ),
)
def reasoners(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = norm.with_usage(norm.with_documents(_whole(fixtures.exchanges(spark, sf_dir))))
    calls = read.selectExpr("seen_model AS model", "usage.*")
    return uncached_reasoners(calls, min_share=0.2)
