"""Splitting event-stream texts into events, within the row."""

from __future__ import annotations

MAX_EVENT_BYTES = 1024 * 1024

_DELIMITER = r"r'\r\n\r\n|\n\n'"


def pieces_of(body: str) -> str:
    """All stretches between delimiters; the last one is unterminated."""
    return f"split({body}, {_DELIMITER}, -1)"


def complete(pieces: str) -> str:
    return f"slice({pieces}, 1, size({pieces}) - 1)"


def overflows(pieces: str, max_event_bytes: int) -> str:
    return f"exists({pieces}, p -> octet_length(p) > {max_event_bytes})"


def maybe_usage(piece: str) -> str:
    """Cheap test a piece must pass to be worth parsing; ``carries_usage`` is the exact one."""
    marks = ['"usage"', '"usageMetadata"', "message_start", "message_delta"]
    return "(" + " OR ".join(f"contains({piece}, '{m}')" for m in marks) + ")"


def carries_usage(event: str) -> str:
    return f"""({event}.event_type IN ('message_start', 'message_delta')
        OR contains({event}.data, '"usage"') OR contains({event}.data, '"usageMetadata"'))"""


def _event(piece: str) -> str:
    lines = rf"split(regexp_replace({piece}, r'\r\z', ''), r'\r?\n', -1)"
    kind = f"try_element_at(filter({lines}, l -> startswith(l, 'event:')), -1)"
    data = f"filter({lines}, l -> startswith(l, 'data:'))"
    return rf"""named_struct(
        'event_type', coalesce(regexp_replace(substring({kind}, 7), r'(?U)^\s+|\s+\z', ''), ''),
        'data', array_join(transform({data},
            l -> regexp_replace(substring(l, 6), r'(?U)^\s+', '')), '\n'))"""


def events_of(pieces: str) -> str:
    """(event_type, data) of each piece that has data other than the end marker."""
    return f"""filter(transform({pieces}, p -> {_event('p')}),
        e -> e.data <> '' AND e.data <> '[DONE]')"""
