"""Fixed schemas: the calls fact table, the price table and captured exchanges."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the original table; the five after them were added later, so old
# files lack them and read NULL there.
_BASE_CALLS = [
    T.StructField("id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("latency_ms", T.LongType(), False),
    T.StructField("ttft_ms", T.LongType()),
    T.StructField("stream", T.BooleanType(), False),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_read_input_tokens", T.LongType()),
    T.StructField("cache_creation_input_tokens", T.LongType()),
    T.StructField("reasoning_output_tokens", T.LongType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("cost", T.DoubleType()),
]
_ADDED_CALLS = [
    T.StructField("client", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("anomaly", T.StringType()),
    T.StructField("raw_usage", T.StringType()),
    T.StructField("peer_exe", T.StringType()),
]
CALLS = T.StructType(_BASE_CALLS + _ADDED_CALLS)
CALL_COLUMNS = CALLS.fieldNames()
ADDED_COLUMNS = [f.name for f in _ADDED_CALLS]

# Columns a stored table has besides: the order of insertion, and the UTC date it is
# partitioned by.
STORED = [T.StructField("ingest_seq", T.LongType()), T.StructField("dt", T.DateType())]

TOKEN_COLUMNS = [
    "input_tokens",
    "output_tokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
    "reasoning_output_tokens",
]
USAGE_COLUMNS = TOKEN_COLUMNS + ["cost"]

# Rates are USD per million tokens.
RATE_COLUMNS = ["input_per_m", "output_per_m", "cache_read_per_m", "cache_creation_per_m"]
_RATE_FIELDS = [T.StructField(c, T.DecimalType(18, 6)) for c in RATE_COLUMNS]
TIER = T.StructType([T.StructField("above_input_tokens", T.LongType())] + _RATE_FIELDS)
PRICES = T.StructType(
    [T.StructField("model_key", T.StringType(), False)]
    + _RATE_FIELDS
    + [
        T.StructField("cache_in_input", T.BooleanType()),
        T.StructField("tiers", T.ArrayType(TIER)),
    ]
)

# One captured exchange. ``outcome`` is one of finish, upstream_error,
# client_disconnect, send_failure; ``chunks`` are the response chunk timings in
# arrival order and ``elapsed_ms`` the time of the terminal message.
EXCHANGES = T.StructType(
    [
        T.StructField("call_id", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("request_body", T.StringType()),
        T.StructField("request_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField(
            "chunks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("elapsed_ms", T.LongType()),
                        T.StructField("bytes", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("elapsed_ms", T.LongType(), False),
        T.StructField("outcome", T.StringType(), False),
        T.StructField("error_message", T.StringType()),
        T.StructField("observation_dropped", T.BooleanType()),
        T.StructField("peer_exe", T.StringType()),
    ]
)
