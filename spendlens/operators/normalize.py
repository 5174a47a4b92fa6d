"""From captured exchanges to rows of the calls table.

Each exchange is one row, so splitting its event stream, reading the usage
objects and merging them all happen inside the row with array functions: the
whole normalisation is a narrow transformation without any shuffle, and works on
a stream as it does on a table. Exchanges that are not inference calls are
dropped before any body is read, and of a body only the few fields of
``DOCUMENT`` are parsed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import sse
from spendlens.functions.text import client_of, endpoint_of, error_kind_of, is_inference, redact_error
from spendlens.functions.usage import (
    ANTHROPIC,
    GEMINI,
    family_of,
    fields_of,
    folded,
    merged,
    parsed,
    text_of,
)
from spendlens.schemas import CALL_COLUMNS, USAGE_COLUMNS

CLIENT_HEADER = "x-client-name"


@dataclass(frozen=True)
class Limits:
    """What is not read because of its size; None, the default, reads everything."""

    request_bytes: int | None = None  # requests whose declared length is larger name no model
    usage_bytes: int | None = None  # usage objects of whole bodies
    model_bytes: int | None = None  # models in whole bodies
    raw_objects: int | None = None  # usage objects kept in ``raw_usage``, the first ones
    event_bytes: int | None = None  # a stream with a larger event has no usage
    client_chars: int | None = None  # client names are cut


NO_LIMITS = Limits()

# The limits of a live capture, which guard the memory of one process.
LIVE_LIMITS = Limits(256 * 1024, 64 * 1024, 254, 8, sse.MAX_EVENT_BYTES, 128)


def _within(size: str, limit: int | None) -> str:
    return "true" if limit is None else f"{size} <= {limit}"


# The only fields read from a response; everything else is skipped while parsing.
# A usage value stays text, to be stored as it is and parsed by itself.
DOCUMENT = """usage string, usageMetadata string, model variant, modelVersion variant,
    message struct<usage: string, model: variant>, response struct<usage: string>,
    x_groq struct<usage: string>"""

_USAGE_PATHS = ["usage", "usageMetadata", "message.usage", "response.usage", "x_groq.usage"]

_SEND_FAILURE = "outcome = 'send_failure'"
_SUCCESS = "status BETWEEN 200 AND 299"


def is_stream() -> str:
    return f"coalesce(contains(content_type, 'text/event-stream'), false) AND NOT {_SEND_FAILURE}"


def is_json() -> str:
    """Whether the body is read as one JSON text: success, JSON, fully observed."""
    return f"""coalesce({_SUCCESS} AND contains(content_type, 'json'), false)
        AND NOT ({is_stream()}) AND NOT {_SEND_FAILURE} AND NOT coalesce(observation_dropped, false)"""


def path_model() -> str:
    """The model named in the path, for providers that put it there."""
    return f"""CASE WHEN {family_of('provider')} = '{GEMINI}'
        THEN nullif(regexp_extract(path, r'^.*?/models/([^:/?]*)', 1), '') END"""


def _may_be_object(text: str) -> str:
    """Cheap test before parsing: an object starts with a brace, or with white space."""
    return f"left({text}, 1) IN ('{{', ' ', '\\n', '\\r', '\\t')"


def with_request_model(exchanges: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Add the model named in the request; under a limit, when its declared length keeps to it."""
    small = _may_be_object("request_body")
    if limits.request_bytes is not None:
        length = "try_element_at(headers, 'content-length')"
        small += rf""" AND {length} RLIKE r'^\+?[0-9]+$'
            AND try_cast({length} AS BIGINT) <= {limits.request_bytes}"""
    sent = exchanges.withColumn(
        "_sent", F.expr(f"CASE WHEN {small} THEN from_json(request_body, 'model variant').model END")
    )
    return sent.withColumn(
        "request_model",
        F.expr(
            """CASE WHEN schema_of_variant(_sent) = 'STRING'
                THEN try_variant_get(_sent, '$', 'string') END"""
        ),
    ).drop("_sent")


def with_documents(exchanges: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Add ``doc``, the parsed whole body, or ``docs``, the parsed usage-bearing events of a stream.

    Also ``is_sse`` and ``overflow``: whether a single event outgrew its limit.
    """
    split = exchanges.selectExpr(
        "*",
        f"{family_of('provider')} AS family",
        f"{is_stream()} AS is_sse",
        f"CASE WHEN {is_json()} AND {_may_be_object('body')} THEN from_json(body, '{DOCUMENT}') END AS doc",
        f"CASE WHEN {is_stream()} THEN {sse.pieces_of('body')} END AS pieces",
    )
    outgrown = (
        "false"
        if limits.event_bytes is None
        else f"""octet_length(body) > {limits.event_bytes}
            AND {sse.overflows('pieces', limits.event_bytes)}"""
    )
    seen = "sse_overflow" if "sse_overflow" in exchanges.columns else "false"
    mentions = f"filter({sse.complete('pieces')}, p -> {sse.maybe_usage('p')})"
    return split.selectExpr(
        "*",
        f"coalesce({seen} OR {outgrown}, false) AS overflow",
        f"""transform(filter({sse.events_of(mentions)}, e -> {sse.carries_usage('e')}
            AND {_may_be_object('e.data')}), e -> named_struct('event_type', e.event_type, 'data', e.data,
                'doc', from_json(e.data, '{DOCUMENT}'))) AS docs""",
    ).drop("pieces")


def _object(doc: str, path: str, source: str) -> str:
    """The usage text at ``path`` of a document, if it is an object there and not a string.

    The text of an object with keys stands in the source as it is, which that of a
    string cannot, as its quotes are escaped there. Only where the source is
    spaced out does the type have to be looked up.
    """
    text = f"{doc}.{path}"
    outer, _, inner = path.partition(".")
    typed = f"{outer} struct<{inner}: variant>" if inner else f"{outer} variant"
    looked_up = f"schema_of_variant(from_json({source}, '{typed}').{path})"
    return f"""CASE WHEN startswith({text}, '{{') AND (contains({source}, {text})
        OR startswith({looked_up}, 'OBJECT')) THEN {text} END"""


def body_object(limits: Limits = NO_LIMITS) -> str:
    """The usage object of a whole body; larger ones than the limit are not read."""

    def fitting(path: str) -> str:
        return f"""CASE WHEN {_within(f'octet_length(doc.{path})', limits.usage_bytes)}
            THEN {_object('doc', path, 'body')} END"""

    return f"""CASE WHEN family = '{GEMINI}' THEN {fitting('usageMetadata')}
        ELSE {fitting('usage')} END"""


def event_objects() -> str:
    """The usage objects of a stream's ``docs`` in the order they are merged."""

    def at(path: str) -> str:
        return _object("d.doc", path, "d.data")

    return f"""filter(flatten(transform(docs, d -> CASE family
        WHEN '{ANTHROPIC}' THEN array(CASE WHEN d.event_type = 'message_start'
            THEN {at('message.usage')} ELSE {at('usage')} END)
        WHEN '{GEMINI}' THEN array({at('usageMetadata')})
        ELSE array({at('usage')}, {at('response.usage')}, {at('x_groq.usage')}) END)),
        u -> u IS NOT NULL)"""


def event_texts() -> str:
    """The usage values of a stream's ``docs`` as sent, as JSON texts; null ones are left out."""
    value = ", ".join(f"d.doc.{p}" for p in _USAGE_PATHS)
    return f"filter(transform(docs, d -> coalesce({value})), r -> r IS NOT NULL)"


def response_model(limits: Limits = NO_LIMITS) -> str:
    """The first model a response names; in a whole body it must also fit its limit."""
    named = text_of("coalesce(d.doc.model, d.doc.message.model, d.doc.modelVersion)")

    def short(v: str) -> str:
        fits = _within(f"octet_length({text_of(v)})", limits.model_bytes)
        return f"CASE WHEN {fits} THEN {text_of(v)} END"

    return f"""CASE WHEN is_sse
        THEN try_element_at(filter(transform(docs, d -> {named}), m -> m IS NOT NULL), 1)
        ELSE coalesce({short('doc.model')}, {short('doc.modelVersion')}) END"""


def with_usage(documents: DataFrame, limits: Limits = NO_LIMITS) -> DataFrame:
    """Add the ``usage``, the ``raw_list`` of usage texts and ``seen_model``.

    A whole body has one usage object, read by plain expressions; those of a
    stream are merged.
    """
    read = (
        documents.selectExpr(
            "*",
            f"{body_object(limits)} AS object",
            f"{event_objects()} AS objects",
            f"{response_model(limits)} AS seen_model",
            f"{event_texts()} AS texts",
        )
        .drop("doc", "docs")
        .selectExpr(
            "*",
            "CASE WHEN is_sse THEN texts ELSE filter(array(object), o -> o IS NOT NULL) END AS raw_list",
            f"{parsed('object')} AS _body",
        )
        .drop("texts")
        .withColumn("_body", F.expr(fields_of("_body", "family")))
    )
    return (
        merge_usage(read, "objects")
        .withColumn("usage", F.expr(f"CASE WHEN is_sse THEN usage ELSE {folded('_body')} END"))
        .drop("object", "objects", "_body")
    )


def merge_usage(rows: DataFrame, texts: str) -> DataFrame:
    """Add ``usage``, merged from the array of usage texts in the column ``texts``."""
    read = rows.withColumn("_read", F.expr(f"transform({texts}, u -> {parsed('u')})"))
    fields = read.withColumn("_fields", F.expr(f"transform(_read, u -> {fields_of('u', 'family')})"))
    return fields.withColumn(
        "usage", F.expr(merged(f"transform(_fields, f -> {folded('f')})"))
    ).drop("_read", "_fields")


def with_outcome(usage: DataFrame) -> DataFrame:
    """Add ``anomaly``, and the error kind and text of exchanges that did not finish."""
    empty = " AND ".join(f"usage.{c} IS NULL" for c in USAGE_COLUMNS)
    failed = F.col("outcome").isin("send_failure", "upstream_error")
    left = F.col("outcome") == "client_disconnect"
    text = F.when(failed, redact_error(F.col("error_message"), F.col("request_url")))
    return (
        usage.withColumn("_text", text)
        .withColumn(
            "anomaly",
            F.expr(
                f"""CASE WHEN {_SEND_FAILURE} THEN NULL
                WHEN overflow THEN 'sse_overflow'
                WHEN observation_dropped THEN 'observation_dropped'
                WHEN outcome = 'finish' AND {_SUCCESS} AND {empty} THEN 'no_usage' END"""
            ),
        )
        .withColumn(
            "error_kind",
            F.when(failed, error_kind_of(F.coalesce("_text", F.lit("")))).when(
                left, F.lit("client_disconnect")
            ),
        )
        .withColumn(
            "error_message",
            F.when(left, F.lit("downstream client disconnected")).otherwise(F.col("_text")),
        )
        .drop("_text")
    )


def raw_usage(limits: Limits = NO_LIMITS) -> str:
    """One usage text as it is, several as a JSON array."""
    kept = "raw_list" if limits.raw_objects is None else f"slice(raw_list, 1, {limits.raw_objects})"
    return f"""CASE WHEN size(raw_list) = 1 THEN raw_list[0]
        WHEN size(raw_list) > 1 THEN '[' || array_join({kept}, ',') || ']' END"""


def normalize(
    exchanges: DataFrame,
    client_header: str = CLIENT_HEADER,
    limits: Limits = NO_LIMITS,
) -> DataFrame:
    """Rows of the calls table for the inference calls among ``exchanges``."""
    calls = exchanges.withColumn("endpoint", endpoint_of(F.col("path"))).where(
        is_inference(F.col("endpoint"))
    )
    read = with_usage(with_documents(with_request_model(calls, limits), limits), limits)
    done = with_outcome(read)
    sound = "(anomaly IS NULL OR anomaly = 'no_usage')"
    columns = {
        "id": "call_id",
        "model": f"coalesce({path_model()}, request_model, seen_model)",
        "status": f"CASE WHEN NOT {_SEND_FAILURE} THEN status END",
        "latency_ms": "elapsed_ms",
        "ttft_ms": """CASE WHEN is_sse THEN array_min(transform(
            filter(chunks, c -> c.bytes > 0), c -> c.elapsed_ms)) END""",
        "stream": "is_sse",
        "raw_usage": f"CASE WHEN {sound} THEN {raw_usage(limits)} END",
    } | {c: f"CASE WHEN {sound} THEN usage.{c} END" for c in USAGE_COLUMNS}
    return done.withColumn("client", client_of(F.col("headers"), client_header, limits.client_chars)).select(
        *[F.expr(columns.get(c, c)).alias(c) for c in CALL_COLUMNS]
    )


def backfill(calls: DataFrame) -> DataFrame:
    """Derive the usage columns anew from the stored ``raw_usage`` texts.

    Adds them as ``raw_<column>``; all are NULL where nothing was stored.
    """
    texts = calls.selectExpr(
        "*",
        f"{family_of('provider')} AS family",
        """CASE WHEN startswith(raw_usage, '[') THEN from_json(raw_usage, 'array<string>')
            ELSE array(raw_usage) END AS _texts""",
    )
    return merge_usage(texts, "_texts").select(
        *calls.columns, *[F.col(f"usage.{c}").alias(f"raw_{c}") for c in USAGE_COLUMNS]
    )
