"""Decoding of loosely typed call rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.schemas import CALLS


def _typed(raw: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in CALLS if f.name in raw.columns}


def decode_strict(raw: DataFrame) -> DataFrame:
    """Cast text columns to the types of the calls table; a bad cell fails the job.

    Needs ANSI mode (the default of Spark 4).
    """
    types = _typed(raw)
    return raw.select(*[F.col(c).cast(types[c]) if c in types else F.col(c) for c in raw.columns])


def decode_lenient(raw: DataFrame) -> DataFrame:
    """As ``decode_strict``, but rows with a bad cell are left out."""
    types = _typed(raw)
    return raw.where(_sound(types)).select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns]
    )


def bad_rows(raw: DataFrame) -> DataFrame:
    """The rows ``decode_lenient`` leaves out."""
    return raw.where(~_sound(_typed(raw)))


def _sound(types: dict[str, str]):
    sound = F.lit(True)
    for column, name in types.items():
        sound = sound & (F.col(column).isNull() | F.col(column).try_cast(name).isNotNull())
    return sound


def bad_cells(raw: DataFrame, key: str = "id") -> DataFrame:
    """The error channel of decoding: a row per cell that does not decode, by ``key``, with its text."""
    types = _typed(raw)
    cells = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")))
        for c, t in types.items()
    ]
    return raw.select(F.col(key), F.inline(F.array_compact(F.array(*cells))))


def quarantined(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decoded rows, and apart from them the rows left out, as they came with their bad ``cells``."""
    types = _typed(raw)
    names = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]
    return decode_lenient(raw), bad_rows(raw).withColumn("cells", F.array_compact(F.array(*names)))


def strict_verdict(raw: DataFrame) -> DataFrame:
    """One row: rows, rows and cells that do not decode, and whether strict decoding would accept all."""
    types = _typed(raw)
    bad = [f"CAST({c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL AS INT)" for c, t in types.items()]
    return raw.selectExpr(f"{' + '.join(bad)} AS bad").selectExpr(
        "count(*) AS calls",
        "count_if(bad > 0) AS bad_calls",
        "coalesce(sum(bad), 0) AS bad_cells",
        "count_if(bad > 0) = 0 AS accepted",
    )
