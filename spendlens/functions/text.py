"""Small text functions: endpoints, clients, error texts and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A path is an inference call when, lower-cased, it contains one of these.
INFERENCE_MARKERS = [
    "/completions",
    "/embeddings",
    "/messages",
    "/responses",
    "/transcriptions",
    "/translations",
    "generatecontent",
]

# Error kinds in the order they are tried, with the substrings that mark them.
ERROR_RULES = [
    ("upstream_tls", ["tls", "ssl", "certificate", "handshake"]),
    ("upstream_timeout", ["timeout", "timed out", "deadline"]),
    ("client_disconnect", ["client disconnect", "connection reset", "broken pipe"]),
    ("upstream_connect", ["connect", "refused", "unreachable", "no route", "dns"]),
]

KEY_MAX_CHARS = 48
CLIENT_SHOWN_CHARS = 40

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as price keys are matched.

    For text of single-byte characters ``lower`` does the same and is faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def is_inference(endpoint: Column) -> Column:
    """Upper-case A-Z match as well; one pattern reads the path once."""
    return endpoint.rlike("(?i)" + "|".join(INFERENCE_MARKERS))


def endpoint_of(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def client_of(headers: Column, client_header: str, max_chars: int | None = None) -> Column:
    """The declared client: the dedicated header when present, else the User-Agent.

    A header that is present but blank, or not plain ASCII text, gives NULL without
    falling back. Header names are expected in lower case.
    """
    declared = F.when(
        F.map_contains_key(headers, client_header), headers[client_header]
    ).otherwise(F.try_element_at(headers, F.lit("user-agent")))
    plain = F.when(declared.rlike(r"^[\t -~]*$"), F.btrim(declared, F.lit(" \t")))
    named = F.nullif(plain, F.lit(""))
    return named if max_chars is None else F.left(named, F.lit(max_chars))


def error_kind_of(message: Column) -> Column:
    low = F.lower(message)
    kind = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, needles in ERROR_RULES:
        kind = kind.when(low.rlike("|".join(needles)), F.lit(name))
    return kind.otherwise(F.lit("other"))


def redact_error(message: Column, url: Column) -> Column:
    """Take user, password, query and fragment out of the URL quoted in a message."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*(?:@[^/@]*)*@", "$1")
    return F.when(url.isNull() | (url == ""), message).otherwise(F.replace(message, url, bare))


def display_key(key: Column) -> Column:
    return F.when(
        F.length(key) > KEY_MAX_CHARS, F.concat(F.left(key, F.lit(KEY_MAX_CHARS)), F.lit("…"))
    ).otherwise(key)


def short_client(client: Column) -> Column:
    """First whitespace-separated token, at most 40 characters; blank text stays as it is."""
    token = F.regexp_extract(client, r"(?U)(\S+)", 1)
    return F.left(F.when(token == "", client).otherwise(token), F.lit(CLIENT_SHOWN_CHARS))


def error_label(error_kind: Column, status: Column) -> Column:
    return (
        F.when(error_kind.isNotNull(), error_kind)
        .when(status == 429, F.lit("rate_limit"))
        .when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
    )


def status_label(status: Column) -> Column:
    return F.coalesce(status.cast("string"), F.lit("err"))


def tokens_label(input_tokens: Column, output_tokens: Column) -> Column:
    return F.when(
        input_tokens.isNotNull(),
        F.concat(
            input_tokens.cast("string"),
            F.lit("→"),
            F.coalesce(output_tokens.cast("string"), F.lit("?")),
        ),
    ).otherwise(F.lit("?"))
