"""Assembling calls from response chunks as they arrive.

Input rows are messages of a call, numbered by ``seq``: chunks of the response
and, last, a terminal one. The state of a call is what an event that is not yet
complete has sent so far, and the events that carry usage; everything else is
dropped on arrival. The result is an exchange whose body holds those events only,
to be normalised like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spendlens.schemas import EXCHANGES

CHUNK = "chunk"

# The part of an exchange known when the response starts; given on each message.
HEAD = [
    f
    for f in EXCHANGES
    if f.name
    not in ("call_id", "ts", "body", "chunks", "elapsed_ms", "outcome", "error_message",
            "observation_dropped")
]

# ``outcome`` is ``chunk``, or the outcome of the exchange on its terminal message.
MESSAGES = T.StructType(
    [
        EXCHANGES["call_id"],
        EXCHANGES["ts"],
        T.StructField("seq", T.IntegerType(), False),
        EXCHANGES["outcome"],
        EXCHANGES["elapsed_ms"],
        T.StructField("data", T.BinaryType()),
        EXCHANGES["error_message"],
        *HEAD,
    ]
)

# Times are passed to the processor and back as microseconds.
_TS_US = T.StructField("ts_us", T.LongType())
_EMITTED = T.StructType(
    [_TS_US if f.name == "ts" else f for f in EXCHANGES]
    + [T.StructField("sse_overflow", T.BooleanType())]
)

_DELIMITER = re.compile(rb"\r\n\r\n|\n\n")
_MARKS = (b'"usage"', b'"usageMetadata"', b"message_start", b"message_delta")

_PROGRESS = T.StructType(
    [
        T.StructField("next_seq", T.IntegerType()),
        T.StructField("rest", T.BinaryType()),
        T.StructField("overflow", T.BooleanType()),
        T.StructField("first_ms", T.LongType()),
        T.StructField("last_ms", T.LongType()),
        T.StructField("timer_ms", T.LongType()),
        T.StructField("gap", T.BooleanType()),
        _TS_US,
        *[T.StructField(f.name, f.dataType) for f in HEAD],
    ]
)
_WAITING = T.StructType([MESSAGES[n] for n in ("outcome", "elapsed_ms", "data", "error_message")])


def take_events(rest: bytes, chunk: bytes) -> tuple[list[bytes], bytes]:
    """Complete events of what was left over plus a new chunk, and what is left over now."""
    # The old part holds no whole delimiter, so only its last three bytes can begin one.
    old, seam = rest[:-3], rest[-3:]
    first, *others = _DELIMITER.split(seam + chunk)
    *events, rest = [old + first, *others]
    return events, rest


class CallAssembler(StatefulProcessor):
    """Keyed by call. Messages may arrive out of order; a gap waits for the missing one.

    A call without a terminal message ``timeout_ms`` after its last one came is emitted
    with ``observation_dropped``. Times are those of arrival, so no message is too late by
    its own time.
    """

    def __init__(self, timeout_ms: int, max_event_bytes: int | None = None) -> None:
        self.timeout_ms = timeout_ms
        self.max_event_bytes = max_event_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.kept = handle.getListState("kept", "text string")
        self.waiting = handle.getMapState("waiting", "seq int", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._load()
        arrived, latest = {}, 0
        for row in rows:
            latest = max(latest, row.arrived_us)
            if state["ts_us"] is None or row.ts_us < state["ts_us"]:
                state["ts_us"] = row.ts_us
            for f in HEAD:
                if state[f.name] is None:
                    state[f.name] = row[f.name]
            if row.seq >= state["next_seq"]:
                message = (row.outcome, row.elapsed_ms, row.data, row.error_message)
                arrived.setdefault(row.seq, message)
        while (message := self._next(state, arrived)) is not None:
            outcome, elapsed, data, error = message
            state["next_seq"] += 1
            state["last_ms"] = elapsed
            if outcome != CHUNK:
                yield self._result(key, state, outcome, error, dropped=False)
                self._forget(state)
                return
            self._observe(state, bytes(data or b""), elapsed)
        for seq, message in arrived.items():
            self.waiting.updateValue((seq,), message)
            state["gap"] = True
        self._restart_timer(state, latest // 1000)
        self.progress.update(tuple(state[f.name] for f in _PROGRESS))

    def _next(self, state: dict, arrived: dict) -> tuple | None:
        """The next message in order: of this batch, or waiting since an earlier one."""
        seq = state["next_seq"]
        if seq in arrived:
            return arrived.pop(seq)
        if state["gap"] and self.waiting.containsKey((seq,)):
            message = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            return message
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        state["timer_ms"] = None
        yield self._result(key, state, "finish", None, dropped=True)
        self._forget(state)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        if self.progress.exists():
            return dict(zip(_PROGRESS.fieldNames(), self.progress.get()))
        return {f.name: None for f in _PROGRESS} | {
            "next_seq": 0, "rest": b"", "overflow": False, "last_ms": 0, "gap": False,
        }

    def _observe(self, state: dict, data: bytes, elapsed: int) -> None:
        if state["overflow"] or not data:
            return
        if state["first_ms"] is None:
            state["first_ms"] = elapsed
        if "text/event-stream" not in (state["content_type"] or ""):
            self.kept.appendValue((data.decode("latin-1"),))
            return
        events, state["rest"] = take_events(bytes(state["rest"]), data)
        longest = max(map(len, [*events, state["rest"]]))
        if self.max_event_bytes is not None and longest > self.max_event_bytes:
            state["overflow"], state["rest"] = True, b""
        for event in events:
            if any(mark in event for mark in _MARKS):
                self.kept.appendValue((event.decode("utf-8", "replace") + "\n\n",))

    def _result(self, key, state: dict, outcome: str, error: str | None, dropped: bool) -> Row:
        body = "".join(text for (text,) in self.kept.get())
        if "text/event-stream" not in (state["content_type"] or ""):
            body = body.encode("latin-1").decode("utf-8", "replace")
        first = state["first_ms"]
        values = {f.name: state[f.name] for f in HEAD} | {
            "call_id": key[0],
            "ts_us": state["ts_us"],
            "body": body,
            "chunks": [] if first is None else [Row(elapsed_ms=first, bytes=1)],
            "elapsed_ms": state["last_ms"],
            "outcome": outcome,
            "error_message": error,
            "observation_dropped": dropped,
            "sse_overflow": state["overflow"],
        }
        return Row(**{f.name: values[f.name] for f in _EMITTED})

    def _restart_timer(self, state: dict, now_ms: int) -> None:
        if state["timer_ms"] is not None:
            self.handle.deleteTimer(state["timer_ms"])
        state["timer_ms"] = now_ms + self.timeout_ms
        self.handle.registerTimer(state["timer_ms"])

    def _forget(self, state: dict) -> None:
        if state["timer_ms"] is not None:
            self.handle.deleteTimer(state["timer_ms"])
        for held in (self.progress, self.kept, self.waiting):
            held.clear()


def assemble(
    messages: DataFrame,
    clock_skew: str = "1 minute",
    timeout_ms: int = 15 * 60 * 1000,
    max_event_bytes: int | None = None,
    idle: bool = False,
) -> DataFrame:
    """A stream of messages as a stream of exchanges, one per ended call.

    The watermark follows the times of the batches, which rows of a batch cannot be behind;
    ``clock_skew`` is how far the driver's clock may go back, as after a restart elsewhere.
    A call that times out is emitted in a batch after later messages have come.

    With ``idle`` timers follow the clock instead, and there is no watermark: batches without
    messages go on being run, so a call is emitted as soon as its time is up, also when the stream
    has fallen silent. It suits a query that keeps running: a restart after a pause longer
    than ``timeout_ms`` times out the calls that were open, though their messages may wait in
    the source, and a trigger that ends once all is read never ends.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    stamped = messages.withColumn("arrived", F.current_timestamp())
    emitted = (
        (stamped if idle else stamped.withWatermark("arrived", clock_skew))
        .withColumn("arrived_us", F.unix_micros("arrived"))
        .withColumn("ts_us", F.unix_micros("ts"))
        .groupBy("call_id")
        .transformWithState(
            CallAssembler(timeout_ms, max_event_bytes),
            outputStructType=_EMITTED,
            outputMode="Append",
            timeMode="ProcessingTime" if idle else "EventTime",
        )
    )
    return emitted.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
