"""Price tables: reading the local JSON form and building it from a model catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.text import ascii_lower
from spendlens.schemas import PRICES, RATE_COLUMNS
from spendlens.sources.calls import path_exists

# Catalogue providers whose listing of a model id wins over any other, in order.
CANONICAL_PROVIDERS = ["anthropic", "openai", "google", "deepseek"]

_TIER_JSON = "above_input_tokens bigint, " + ", ".join(f"{c} double" for c in RATE_COLUMNS)
_RATES_JSON = (
    ", ".join(f"{c} double" for c in RATE_COLUMNS)
    + f", cache_in_input boolean, tiers array<struct<{_TIER_JSON}>>"
)


# Without it, NaN and Infinity would be read as numbers.
_STRICT = {"allowNonNumericNumbers": "false"}

# A model needs both plain rates; a tier needs them and its threshold.
_COMPLETE = """coalesce(forall(map_values(models),
    r -> r.input_per_m IS NOT NULL AND r.output_per_m IS NOT NULL
        AND forall(coalesce(r.tiers, array()), t -> coalesce(t.above_input_tokens >= 0, false)
            AND t.input_per_m IS NOT NULL AND t.output_per_m IS NOT NULL)), false)"""


def _rate(value: str) -> str:
    return f"CAST(coalesce({value}, 0) AS DECIMAL(18,6))"


def parse_price_documents(documents: DataFrame) -> DataFrame:
    """Price rows from JSON texts (column ``value``): model key -> rates.

    Keys are lower-cased (ASCII). Absent cache rates are zero, an absent
    accounting flag is false, absent tiers are none. A text that is not JSON, or
    in which a model lacks its input or output rate, or a tier one of these or its
    threshold, yields no rows. Where two spellings of a key meet, the alphabetically
    last spelling stays.
    """
    tier = ", ".join(f"{_rate(f't.{c}')} AS {c}" for c in RATE_COLUMNS)
    rows = (
        documents.select(
            F.from_json("value", f"map<string, struct<{_RATES_JSON}>>", _STRICT).alias("models")
        )
        .where(_COMPLETE)
        .select(F.explode("models").alias("spelling", "r"))
        .select(
            ascii_lower(F.col("spelling")).alias("model_key"),
            "spelling",
            *[F.expr(f"{_rate(f'r.{c}')} AS {c}") for c in RATE_COLUMNS],
            F.expr("coalesce(r.cache_in_input, false) AS cache_in_input"),
            F.expr(
                f"""transform(coalesce(r.tiers, array()), t -> struct(
                    t.above_input_tokens AS above_input_tokens, {tier})) AS tiers"""
            ),
        )
    )
    columns = ", ".join(PRICES.fieldNames())
    return (
        rows.groupBy("model_key")
        .agg(F.expr(f"max_by(struct({columns}), spelling) AS p"))
        .select("p.*")
    )


def read_prices(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """The price table stored at ``path``; an empty one when there is nothing.

    A text is a whole file, or with ``per_line`` each line, as ``write_prices`` writes them.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], PRICES)
    return parse_price_documents(spark.read.text(path, wholetext=not per_line))


def malformed_prices(documents: DataFrame) -> DataFrame:
    """The sources of price texts that are ignored as malformed, with a warning each.

    ``documents`` has ``source`` and the text ``value``.
    """
    models = F.from_json("value", f"map<string, struct<{_RATES_JSON}>>", _STRICT)
    rows = documents.select("source", models.alias("models")).where(f"NOT {_COMPLETE}")
    return rows.select("source", F.concat(F.lit("ignoring malformed "), "source").alias("warning"))


def price_documents(prices: DataFrame) -> DataFrame:
    """Price rows as JSON texts (column ``value``), one object with one model key each."""
    rates = [F.col(c).cast("double").alias(c) for c in RATE_COLUMNS]
    tiers = F.expr(
        "transform(tiers, t -> struct(t.above_input_tokens AS above_input_tokens, "
        + ", ".join(f"CAST(t.{c} AS DOUBLE) AS {c}" for c in RATE_COLUMNS)
        + ")) AS tiers"
    )
    return prices.select(
        F.to_json(
            F.create_map("model_key", F.struct(*rates, "cache_in_input", tiers))
        ).alias("value")
    )


def write_prices(prices: DataFrame, path: str) -> None:
    price_documents(prices).write.mode("overwrite").text(path)


_COST_JSON = """struct<input: double, output: double, cache_read: double, cache_write: double,
    tiers: array<struct<input: double, output: double, cache_read: double, cache_write: double,
        tier: struct<type: string, size: bigint>>>>"""
CATALOGUE = f"map<string, struct<models: map<string, struct<cost: {_COST_JSON}>>>>"


def prices_from_catalogue(documents: DataFrame) -> DataFrame:
    """Price rows from catalogue texts (column ``value``): provider -> models -> cost.

    Models without a numeric input and output cost are left out. Where several
    providers list a model id the canonical ones win, in their order, then the
    alphabetically first. Cache reads are part of the input for every provider
    but anthropic, and never for a ``claude-`` model. Only context tiers are kept;
    what a tier leaves out it takes from the base cost.
    """
    canonical = ", ".join(f"'{p}'" for p in CANONICAL_PROVIDERS)
    rank = f"array_position(array({canonical}), provider_id)"
    listed = (
        documents.select(
            F.explode(
                F.from_json("value", CATALOGUE, _STRICT)
            ).alias("provider_id", "provider")
        )
        .select("provider_id", F.explode("provider.models").alias("model_id", "model"))
        .select("provider_id", "model_id", "model.cost.*")
        .where("input IS NOT NULL AND output IS NOT NULL")
    )
    base = {
        "input_per_m": "input",
        "output_per_m": "output",
        "cache_read_per_m": "coalesce(cache_read, 0)",
        "cache_creation_per_m": "coalesce(cache_write, 0)",
    }
    own = {
        "input_per_m": "t.input",
        "output_per_m": "t.output",
        "cache_read_per_m": "t.cache_read",
        "cache_creation_per_m": "t.cache_write",
    }
    tier_rates = ", ".join(
        f"CAST(coalesce({own[c]}, {base[c]}) AS DECIMAL(18,6)) AS {c}" for c in RATE_COLUMNS
    )
    first = listed.groupBy("model_id").agg(
        F.expr(
            f"""min_by(struct(provider_id, input, output, cache_read, cache_write, tiers),
                struct(CASE WHEN {rank} > 0 THEN {rank} ELSE 99 END, provider_id)) AS l"""
        )
    )
    return first.select("model_id", "l.*").select(
        F.col("model_id").alias("model_key"),
        *[F.expr(f"CAST({base[c]} AS DECIMAL(18,6)) AS {c}") for c in RATE_COLUMNS],
        F.expr(
            """provider_id <> 'anthropic' AND NOT startswith(model_id, 'claude-')
                AS cache_in_input"""
        ),
        F.expr(
            f"""array_sort(transform(
                filter(coalesce(tiers, array()),
                    t -> t.tier.type = 'context' AND t.tier.size >= 0),
                t -> struct(t.tier.size AS above_input_tokens, {tier_rates}))) AS tiers"""
        ),
    )


def price_summary(documents: DataFrame, now: datetime) -> DataFrame:
    """Per price file: models it covers (NULL when it is malformed) and its age in whole days.

    ``documents`` has ``source``, ``modified`` and the text ``value``.
    """
    models = F.from_json("value", f"map<string, struct<{_RATES_JSON}>>", _STRICT)
    rows = documents.select("source", "modified", models.alias("models"))
    return rows.select(
        "source",
        F.expr(f"CASE WHEN {_COMPLETE} THEN CAST(size(models) AS BIGINT) END AS models"),
        F.floor(
            (F.lit(now.timestamp()).cast("bigint") - F.unix_seconds(F.col("modified").cast("timestamp")))
            / F.lit(86_400)
        ).alias("age_days"),
    )


def show_prices(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """``price_summary`` of the files at ``path``; no rows when there are none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "source string, models bigint, age_days bigint")
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "value",
    )
    return price_summary(files, now)
