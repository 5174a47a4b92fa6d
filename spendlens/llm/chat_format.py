"""Chat formatting by event sourcing, with DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence. Kinds of events:

- ``message``: a whole message with role and text,
- ``start``: opens the streamed message ``msg`` with a role,
- ``delta``: appends its text to message ``msg``,
- ``edit``: replaces the text of ``msg``; later deltas append to the new text,
- ``regenerate``: empties ``msg``; the deltas after it are the new answer,
- ``delete``: removes ``msg`` as it is then; a later edit or delta brings it back.

The events of one message are folded first, so that the parts of a long stream do not meet those
of other messages; then the messages of a conversation are put in order of their first event and
rendered:

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings inside roles and texts get a backslash after their first character, backslashes
are doubled; so none can occur inside, and reading back is exact. The loss mask is given by
``segments``, whose texts joined are the formatted text: those with ``loss`` are what the
assistant said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that open or close something in this or other templates.
CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """Drops one backslash of each pair and each one before another character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """``conv``, ``seq``, ``role`` and ``text`` of each final message.

    ``events`` has ``conv``, ``seq``, ``kind``, ``msg``, ``role`` and ``text``; nulls in role and
    text are empty, a null kind is a message. Events with equal sequence are sorted by kind,
    role and text, so repeated rows are repeated messages or deltas. Streamed messages
    without any start have the role of their first event. Unknown kinds change nothing.
    """
    event = F.struct(
        F.col("seq"),
        F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(event))
    by_message = events.groupBy(F.col(conv).alias("conv"), "msg").agg(log.alias("log"))
    whole = F.filter("log", lambda e: e.kind == "message")
    stream = F.filter("log", lambda e: e.kind.isin("start", "delta", "edit", "regenerate", "delete"))
    resets = F.filter(
        F.transform(F.col("stream"), lambda e, i: F.when(e.kind.isin("start", "edit", "regenerate", "delete"), i)),
        lambda i: i.isNotNull(),
    )
    after = F.slice("stream", F.col("reset") + 1, F.size("stream"))
    text = F.array_join(
        F.transform(after, lambda e: F.when(e.kind.isin("delta", "edit", "start"), e.text).otherwise("")), ""
    )
    opening = F.coalesce(F.try_element_at(F.filter("stream", lambda e: e.kind == "start"), F.lit(1)), F.col("stream")[0])
    gone = F.element_at("stream", -1).kind == "delete"
    streamed = F.when(
        (F.size("stream") > 0) & ~gone, F.array(F.struct(opening.seq.alias("seq"), opening.role.alias("role"), text.alias("text")))
    ).otherwise(F.array())
    messages = F.concat(F.transform("whole", lambda e: F.struct(e.seq.alias("seq"), e.role.alias("role"), e.text.alias("text"))), streamed)
    return (
        by_message.select("conv", whole.alias("whole"), stream.alias("stream"))
        .withColumn("reset", F.coalesce(F.array_max(resets), F.lit(0)))
        .select(F.col("conv").alias(conv), F.inline(messages))
    )


def render(messages: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """``conv``, ``formatted`` and ``segments`` (``text``, ``loss``) of each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))

    def parts(turn: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(TURN), escape(turn.role), F.lit(TEXT))
        return F.array(
            part(head, F.lit(False)),
            part(escape(turn.text), turn.role == ASSISTANT),
            part(F.lit(END), F.lit(False)),
        )

    folded = messages.groupBy(F.col(conv).alias(conv)).agg(turns.alias("turns"))
    cut = folded.select(conv, F.flatten(F.transform("turns", parts)).alias("segments"))
    return cut.select(conv, F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def format_chats(events: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """Folds the log and renders it; a row per conversation that has a message.

    A null conversation is one of its own. Columns other than those named in ``fold`` are
    ignored. An empty log gives an empty table.
    """
    return render(fold(events, conv=conv), conv=conv)


def events_of_turns(rows: DataFrame) -> DataFrame:
    """A log of whole messages from rows by turn, each its own event."""
    return rows.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        F.col("turn").cast("string").alias("msg"),
        "role",
        "text",
    )


def read_back(formatted: Column) -> Column:
    """Turns (``role``, ``text``) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|text\|>")
        role = F.substring(halves[0], F.lit(len(TURN) + 1), F.length(halves[0]))
        return F.struct(unescape(role).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)
