"""Pricing calls from a rate table.

A model takes the rates of the longest price key that is a prefix of its name
(an exact match is the longest possible one), and of the highest context tier
its prompt exceeds. Calls name few models, so the search is done once for each name
and not for each call: the distinct names (one pruned column, partially aggregated)
meet the keys by equality, a probe for each length that keys have, and become a
dictionary from a name to its rates, a row per tier. The calls then meet the dictionary in one
hash join and are neither shuffled nor de-duplicated for it. The dictionary is measured:
up to ``MOST_MODELS`` rows and ``BROADCAST_BYTES`` it is broadcast, beyond that it is written to
``spark.checkpoint.dir`` and Spark chooses the join from its own sizes. On a stream, price each micro-batch: its own names
make its dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import reported_pico, usd
from spendlens.functions.text import ascii_lower
from spendlens.schemas import RATE_COLUMNS
from spendlens.streaming.workdir import work_dir

BROADCAST_BYTES = 64 * 1024 * 1024
MOST_MODELS = 200_000

_MAX_TOKENS = 2**63 - 1
UNIT_COLUMNS = ["input_units", "output_units", "cache_read_units", "cache_creation_units"]


def _units(row: str) -> str:
    units = ", ".join(
        f"'{u}', CAST({row}{r} * 1000000 AS BIGINT)" for r, u in zip(RATE_COLUMNS, UNIT_COLUMNS)
    )
    return f"named_struct({units})"


def rates_by_key(prices: DataFrame) -> DataFrame:
    """One row per key and band: the context sizes it holds for, and its rates.

    Rates become pico-USD per token. A band is for contexts above ``above`` and up to ``upto``; the
    first starts above -1, the last has no end. A tier without a threshold is none.
    """
    tiers = "filter(coalesce(tiers, array()), t -> t.above_input_tokens >= 0)"
    tier = f"named_struct('above', t.above_input_tokens, 'units', {_units('t.')})"
    banded = prices.selectExpr(
        "model_key",
        "coalesce(cache_in_input, false) AS cache_in_input",
        f"""concat(array(named_struct('above', CAST(-1 AS BIGINT), 'units', {_units('')})),
            array_sort(transform({tiers}, t -> {tier}))) AS bands""",
    )
    return banded.selectExpr("*", "posexplode(bands) AS (nth, band)").selectExpr(
        "model_key",
        "cache_in_input",
        "band.above AS above",
        "get(bands, nth + 1).above AS upto",
        *[f"band.units.{u} AS {u}" for u in UNIT_COLUMNS],
    )


@dataclass(frozen=True)
class Held:
    """A table, and its rows in memory where it is small; a large one is written to the shared folder."""

    frame: DataFrame
    rows: pa.Table | None

    @classmethod
    def of(cls, table: DataFrame) -> Held:
        """Derives ``table`` once, however often the result is read."""
        spark, kept = table.sparkSession, table.persist()
        try:
            rows = kept.limit(MOST_MODELS + 1).toArrow()
            if rows.num_rows <= MOST_MODELS and rows.nbytes <= BROADCAST_BYTES:
                return cls(spark.createDataFrame(rows, table.schema), rows)
            path = work_dir(spark, "rates")
            kept.write.parquet(path)
            return cls(spark.read.schema(table.schema).parquet(path), None)
        finally:
            kept.unpersist()

    def sized(self, frame: DataFrame) -> DataFrame:
        """``frame``, made of this table, to be broadcast where the table is small."""
        return frame if self.rows is None else F.broadcast(frame)

    def distinct(self, column: str) -> list:
        """The values of a column that has few of them, ascending."""
        if self.rows is not None:
            return sorted(set(self.rows[column].to_pylist()) - {None})
        found = self.frame.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
        return [r[0] for r in found.collect()]


@dataclass(frozen=True)
class RateCard:
    """A price table ready to be looked up: the key lengths there are, and rates by key and band."""

    lengths: list[int]
    rates: Held


def rate_card(prices: DataFrame | RateCard) -> RateCard:
    """Lay a price table out for look-ups, after measuring it.

    Build it once to price several frames, or every batch of a stream: a small table is then
    not read again. Empty keys are ignored; of rows with equal keys one stays.
    """
    if isinstance(prices, RateCard):
        return prices
    keyed = prices.where("length(model_key) > 0").dropDuplicates(["model_key"])
    rates = Held.of(rates_by_key(keyed).withColumn("key_length", F.length("model_key")))
    return RateCard(rates.distinct("key_length"), Held(rates.frame.drop("key_length"), rates.rows))


def model_rates(models: DataFrame, card: RateCard) -> Held:
    """The dictionary: rates by ``model``, a row per band.

    ``models`` has one column, the distinct names. Names that no key is a prefix of are left out.
    Prefixes of one text sort by length, so the greatest of them is the longest.
    """
    lengths = f"array({', '.join(map(str, card.lengths or [0]))})"
    probes = models.where("model IS NOT NULL").withColumn("name", ascii_lower(F.col("model"))).selectExpr(
        "model",
        f"explode(transform(filter({lengths}, n -> n <= length(name)), n -> left(name, n))) AS model_key",
    )
    keys = card.rates.frame.where("above = -1").select("model_key")
    owned = probes.join(card.rates.sized(keys), "model_key").groupBy("model").agg(F.max("model_key").alias("model_key"))
    return Held.of(owned.join(card.rates.sized(card.rates.frame), "model_key"))


def counted(column: str) -> str:
    """SQL of a token count where zero, negative and absent all mean none."""
    return f"greatest(coalesce({column}, 0), 0)"


_INPUT = counted("input_tokens")
_READ = counted("cache_read_input_tokens")
_CREATION = counted("cache_creation_input_tokens")
_OUTPUT = counted("output_tokens")

# Prompt size the tiers look at; cache tokens are added where they are counted apart.
# A size beyond BIGINT exceeds every tier like the largest one.
CONTEXT_TOKENS = f"""CASE WHEN cache_in_input THEN {_INPUT}
    ELSE coalesce(try_add(try_add({_INPUT}, {_READ}), {_CREATION}), {_MAX_TOKENS}) END"""

# Input tokens billed at the full rate.
UNCACHED_INPUT = f"CASE WHEN cache_in_input THEN greatest({_INPUT} - {_READ}, 0) ELSE {_INPUT} END"

# Price of the tokens at the attached rates, in pico-USD; NULL without rates, and
# where a count is too large for the arithmetic.
TOKENS_PICO = f"""try_add(try_add(
    try_multiply({UNCACHED_INPUT}, input_units), try_multiply({_READ}, cache_read_units)), try_add(
    try_multiply({_CREATION}, cache_creation_units), try_multiply({_OUTPUT}, output_units)))"""


def attach_rates(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Add ``model_key``, ``cache_in_input`` and the effective rates per token to each call.

    All added columns are NULL for a call whose model no price key matches. Each call gives one row.
    The names of the models are read at once, the calls when the result is.
    """
    rates = model_rates(calls.select("model").distinct(), rate_card(prices))
    named = rates.sized(rates.frame.toDF(*[f"_rate_{c}" for c in rates.frame.columns]))
    context = CONTEXT_TOKENS.replace("cache_in_input", "_rate_cache_in_input", 1)
    match = "model = _rate_model"
    if rates.rows is None or rates.distinct("upto"):
        match += f" AND {context} > _rate_above AND {context} <= coalesce(_rate_upto, {_MAX_TOKENS})"
    return calls.join(named, F.expr(match), "left").selectExpr(
        *[f"`{c}`" for c in calls.columns],
        *[f"_rate_{c} AS {c}" for c in ("model_key", "cache_in_input", *UNIT_COLUMNS)],
    )


def price_calls(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Add rates and two prices in pico-USD, each NULL where it is unknown.

    ``priced_pico``: the tokens at table rates, whatever the provider reported.
    ``cost_pico``: reported cost (NULL where it is too large for pico-USD), else table
    price, else NULL when the call has tokens, else zero.
    """
    return (
        attach_rates(calls, prices)
        .withColumn("priced_pico", F.expr(TOKENS_PICO))
        .withColumn(
            "cost_pico",
            F.when(F.col("cost").isNotNull(), reported_pico(F.col("cost"))).otherwise(
                F.coalesce(
                    F.col("priced_pico"),
                    F.expr(f"CASE WHEN {_INPUT} = 0 AND {_OUTPUT} = 0 THEN CAST(0 AS BIGINT) END"),
                )
            ),
        )
    )


def with_cost_source(priced: DataFrame) -> DataFrame:
    """Add ``cost_usd`` and ``cost_source`` (provider, computed or NULL) to priced calls.

    Unlike ``cost_pico`` an unpriced call without tokens stays NULL here.
    """
    stored = F.col("cost").isNotNull()
    return priced.withColumn(
        "cost_usd", F.when(stored, F.col("cost")).otherwise(usd(F.col("priced_pico")))
    ).withColumn(
        "cost_source",
        F.when(stored, F.lit("provider")).when(
            F.col("priced_pico").isNotNull(), F.lit("computed")
        ),
    )
