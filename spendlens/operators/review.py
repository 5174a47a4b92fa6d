"""Spend review: where the money went, what was wasted, what a substitute would cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import join_parts, micro_part, pico_total, reported_pico, rest_part, usd
from spendlens.operators.gaps import idle_gaps
from spendlens.operators.pricing import (
    TOKENS_PICO,
    UNCACHED_INPUT,
    RateCard,
    attach_rates,
    counted,
    model_rates,
    price_calls,
    rate_card,
)

SOURCE = "coalesce(client, peer_exe, 'unknown')"
#: Tokens of a call above which its price at other rates may be too large to be known.
OUTSIZE = 2**30
BLOCK_SLICES = 1_024

_MOST = 2**63 - 1
_INPUT = counted("input_tokens")
_OUTPUT = counted("output_tokens")
_READ = counted("cache_read_input_tokens")
_CREATION = counted("cache_creation_input_tokens")


def _known_total(pico: Column) -> Column:
    """Sum in USD, NULL when no row has a value."""
    return F.when(F.count(pico) > 0, usd(pico_total(pico)))


def _total(column: str) -> str:
    """SQL of a sum that is zero over nothing, and unknown beyond BIGINT."""
    return f"CASE WHEN count({column}) = 0 THEN 0 ELSE try_sum({column}) END"


def spend_by_source_and_model(calls: DataFrame) -> DataFrame:
    """Paid cost and tokens per source and model; reported costs only, largest first."""
    return (
        calls.selectExpr(f"{SOURCE} AS src", "*")
        .groupBy("src", "model")
        .agg(
            F.count("*").alias("n"),
            _known_total(reported_pico(F.col("cost"))).alias("spent"),
            # A total beyond BIGINT is unknown.
            F.try_sum("input_tokens").alias("inp"),
            F.try_sum("cache_read_input_tokens").alias("hit"),
            F.try_sum("output_tokens").alias("out"),
            F.try_sum("reasoning_output_tokens").alias("think"),
        )
        .orderBy(F.desc_nulls_last("spent"), "src", "model")
    )


def cache_decay(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Cache-hit rate per idle gap of the provider before the call.

    ``hit_pct`` divides by ``input_tokens`` for every provider. ``prompt_hit_pct``
    divides by the whole prompt, which for additive accounting includes the
    cached tokens.
    """
    gaps = attach_rates(idle_gaps(calls), prices)
    prompt = f"""CASE WHEN NOT cache_in_input THEN try_add(try_add(input_tokens, {_READ}), {_CREATION})
        ELSE input_tokens END"""
    return (
        gaps.groupBy(F.col("gap_bucket").alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            F.expr(
                "round(100.0D * try_sum(cache_read_input_tokens) / try_sum(input_tokens), 1) AS hit_pct"
            ),
            F.expr(
                f"round(100.0D * try_sum(cache_read_input_tokens) / try_sum({prompt}), 1) AS prompt_hit_pct"
            ),
            F.min("gap_s").alias("min_gap_s"),
        )
        .orderBy("min_gap_s")
    )


def uncached_by_accounting(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Uncached input and whole prompts per provider, apart for each way of counting the cache.

    ``subset``: cache reads are part of the input; ``additive``: they come on
    top; ``unknown``: no price row says which, counted like ``subset``.
    """
    rated = attach_rates(calls, prices).selectExpr(
        "provider",
        """CASE WHEN cache_in_input THEN 'subset' WHEN NOT cache_in_input THEN 'additive'
            ELSE 'unknown' END AS accounting""",
        f"""CASE WHEN NOT cache_in_input THEN {counted('input_tokens')}
            ELSE greatest({counted('input_tokens')} - {_READ}, 0) END AS uncached""",
        f"{_READ} AS cache_read",
        f"""CASE WHEN NOT cache_in_input THEN try_add(try_add({counted('input_tokens')}, {_READ}), {_CREATION})
            ELSE {counted('input_tokens')} END AS prompt""",
    )
    return (
        rated.groupBy("provider", "accounting")
        .agg(
            F.count("*").alias("calls"),
            F.try_sum("uncached").alias("uncached_tokens"),
            F.try_sum("cache_read").alias("cache_read_tokens"),
            F.try_sum("prompt").alias("prompt_tokens"),
        )
        .orderBy("provider", "accounting")
    )


def repriced(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Per model: what was reported as paid, and the same tokens at current rates.

    The two are different quantities over different calls and are never added.
    """
    return (
        price_calls(calls, prices)
        .groupBy(F.expr("coalesce(model, 'unknown') AS model"))
        .agg(
            F.count("*").alias("calls"),
            F.count("cost").alias("reported_calls"),
            _known_total(reported_pico(F.col("cost"))).alias("paid_usd"),
            F.count("priced_pico").alias("repriced_calls"),
            _known_total(F.col("priced_pico")).alias("at_current_rates_usd"),
        )
        .orderBy("model")
    )


def avoidable_misses(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Per idle gap: uncached input tokens, and what they cost above the cache-read rate."""
    rated = attach_rates(idle_gaps(calls), prices).selectExpr(
        "gap_bucket",
        "gap_s",
        "model_key",
        f"CASE WHEN model_key IS NOT NULL THEN {UNCACHED_INPUT} END AS uncached",
        f"try_multiply({UNCACHED_INPUT}, input_units - cache_read_units) AS miss_pico",
    )
    return (
        rated.groupBy("gap_bucket")
        .agg(
            F.count("*").alias("calls"),
            F.expr("count(*) - count(miss_pico) AS unpriced_calls"),
            F.expr(f"{_total('uncached')} AS uncached_tokens"),
            usd(pico_total(F.col("miss_pico"))).alias("avoidable_usd"),
            F.min("gap_s").alias("min_gap_s"),
        )
        .orderBy("min_gap_s")
    )


def uncached_reasoners(calls: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Models that never read a cache and whose output is mostly reasoning."""
    return (
        calls.groupBy("model")
        .agg(
            F.count("*").alias("calls"),
            F.expr(f"{_total('cache_read_input_tokens')} AS cache_read_tokens"),
            F.try_sum("output_tokens").alias("output_tokens"),
            F.try_sum("reasoning_output_tokens").alias("reasoning_tokens"),
        )
        .withColumn(
            "reasoning_share",
            F.expr(
                """CASE WHEN output_tokens > 0
                THEN CAST(reasoning_tokens AS DOUBLE) / output_tokens END"""
            ),
        )
        .where((F.col("cache_read_tokens") == 0) & (F.col("reasoning_share") > min_share))
        .orderBy("model")
    )


# A call's tokens as each way of counting the cache sees them (subset: reads are part of the input).
_RESTATED = {
    "subset_input": f"""CASE WHEN cache_in_input THEN {_INPUT}
        ELSE coalesce(try_add(try_add({_INPUT}, {_READ}), {_CREATION}), {_MOST}) END""",
    "subset_creation": f"CASE WHEN cache_in_input THEN {_CREATION} ELSE 0 END",
    "apart_input": f"CASE WHEN cache_in_input THEN greatest({_INPUT} - {_READ}, 0) ELSE {_INPUT} END",
    "creation": _CREATION,
    "cache_read": _READ,
    "output": _OUTPUT,
}
_COUNTS = ["subset_uncached", "subset_creation", "apart_input", "creation", "cache_read", "output"]


def substitutions(
    calls: DataFrame, prices: DataFrame | RateCard, candidates: DataFrame, days: float
) -> DataFrame:
    """Estimated saving per 30 days of moving each source's model to a candidate.

    ``candidates`` has rows (model_key, candidate, task_class): models of the
    same class of work, keyed by price key. A call's price at a candidate's rates is linear in its
    tokens, restated in the candidate's way of counting the cache, within the
    tier its context falls in. So the calls are summed first, per source, key and band of
    contexts between any two tiers of the candidates, for both ways of counting; each
    candidate then meets the sums. Calls without a price on either side are only counted; a
    call with a count above ``OUTSIZE`` keeps a group of its own, since its price may be too
    large to be known. ``days`` is the time the calls span.
    """
    card = rate_card(prices)
    offers = candidates.select(F.col("model_key").alias("from_key"), "candidate", "task_class")
    rates = model_rates(offers.select(F.col("candidate").alias("model")).distinct(), card)
    tiers = [t for t in rates.distinct("above") if t >= 0]

    def band(context: str) -> str:
        """SQL of the largest context with the same tiers as ``context``."""
        starts = " ".join(f"WHEN {context} <= {t} THEN {t}" for t in tiers)
        return f"CAST(CASE {starts} ELSE {_MOST} END AS BIGINT)" if tiers else f"CAST({_MOST} AS BIGINT)"

    counted_calls = (
        attach_rates(calls, card)
        .where("model_key IS NOT NULL")
        .selectExpr(
            f"{SOURCE} AS src", "model_key AS from_key", f"{TOKENS_PICO} AS current_pico",
            *[f"{e} AS {c}" for c, e in _RESTATED.items()],
        )
        .selectExpr(
            "*",
            "greatest(subset_input - cache_read, 0) AS subset_uncached",
            f"coalesce(try_add(try_add(apart_input, cache_read), creation), {_MOST}) AS apart_context",
        )
    )
    outsize = " OR ".join(f"{c} > {OUTSIZE}" for c in ("subset_input", *_COUNTS))
    keyed = counted_calls.selectExpr(
        "src", "from_key", "current_pico", *_COUNTS,
        f"{band('subset_input')} AS subset_band", f"{band('apart_context')} AS apart_band",
        f"CASE WHEN {outsize} THEN struct({', '.join(_COUNTS)}, current_pico) END AS alone",
    )
    sums = keyed.groupBy("src", "from_key", "subset_band", "apart_band", "alone").agg(
        F.count("*").alias("calls"),
        F.count("current_pico").alias("current_calls"),
        F.sum(micro_part(F.col("current_pico"))).alias("micro"),
        F.sum(rest_part(F.col("current_pico"))).alias("rest"),
        # Calls that keep a group of their own have one value, which is not summed.
        *[F.expr(f"sum(CASE WHEN alone IS NULL THEN {c} END) AS {c}") for c in _COUNTS],
    )
    named = rates.sized(rates.frame.toDF(*[f"to_{c}" for c in rates.frame.columns]))
    tier = """candidate = to_model
        AND CASE WHEN to_cache_in_input THEN subset_band ELSE apart_band END > to_above
        AND (to_upto IS NULL OR CASE WHEN to_cache_in_input THEN subset_band ELSE apart_band END <= to_upto)"""
    offered = sums.join(offers, "from_key").join(named, F.expr(tier), "left")

    def parts(prefix: str) -> list[tuple[str, str]]:
        return [
            (f"CASE WHEN to_cache_in_input THEN {prefix}subset_uncached ELSE {prefix}apart_input END", "to_input_units"),
            (f"{prefix}cache_read", "to_cache_read_units"),
            (f"CASE WHEN to_cache_in_input THEN {prefix}subset_creation ELSE {prefix}creation END", "to_cache_creation_units"),
            (f"{prefix}output", "to_output_units"),
        ]

    wide = "CAST({} AS DECIMAL(19,0))".format
    together = " + ".join(f"{wide(tokens)} * {wide(units)}" for tokens, units in parts(""))
    one, *others = [f"try_multiply({tokens}, {units})" for tokens, units in parts("alone.")]
    for other in others:
        one = f"try_add({one}, {other})"
    priced = offered.withColumn(
        "to_pico",
        F.expr(
            f"""CASE WHEN alone IS NULL THEN CAST({together} AS DECIMAL(38,0))
                ELSE CAST({one} AS DECIMAL(38,0)) * CAST(calls AS DECIMAL(19,0)) END"""
        ),
    ).withColumn("both", F.expr("to_pico IS NOT NULL AND current_calls = calls"))
    current = join_parts(F.sum(F.when(F.col("both"), F.col("micro"))), F.sum(F.when(F.col("both"), F.col("rest"))))
    moved = F.coalesce(F.sum(F.when(F.col("both"), F.col("to_pico"))), F.lit(0)).cast("decimal(38,0)")
    return (
        priced.groupBy("src", F.col("from_key").alias("model_key"), "candidate", "task_class")
        .agg(
            F.sum("calls").alias("calls"),
            F.expr("sum(CASE WHEN both THEN 0 ELSE calls END) AS unpriced_calls"),
            usd(current).alias("current_usd"),
            usd(moved).alias("candidate_usd"),
            (usd(current - moved) * F.lit(30.0) / F.lit(float(days))).alias("saving_30d_usd"),
        )
        .orderBy(F.desc("saving_30d_usd"), "src", "model_key", "candidate")
    )


def evaluation_bursts(calls: DataFrame, idle_seconds: int = 300, min_models: int = 3) -> DataFrame:
    """Sessions of one client that call several models equally often: one-off evaluations.

    A session ends where the client is idle for more than ``idle_seconds``.
    Calls are first counted per client, model and slice of time no longer than
    that, and no session ends inside a slice. Sessions are then found in two levels: within
    blocks of ``BLOCK_SLICES`` slices, and over the edges of the blocks (times of the first
    and last call, last start of a session), one row per client and block. So a
    client that makes most of the calls is spread over its blocks.
    """
    slices = (
        calls.selectExpr(
            f"{SOURCE} AS src",
            "coalesce(model, 'unknown') AS model",
            "ts",
            f"""CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / {idle_seconds}) AS BIGINT)
                AS slice""",
        )
        .groupBy("src", "slice", "model")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumn("block", F.expr(f"floor(slice / {BLOCK_SLICES})"))
    )

    limit = idle_seconds * 1_000_000
    within = "PARTITION BY src, block ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND"
    spaced = slices.selectExpr(
        "*",
        "min(first_ts) OVER (PARTITION BY src, block, slice) AS slice_first",
        f"max(last_ts) OVER ({within} 1 PRECEDING) AS before",
    ).withColumn(
        "start", F.expr(f"CASE WHEN timestampdiff(MICROSECOND, before, slice_first) > {limit} THEN slice END")
    )
    # A session is named by its first slice. A block opens with the session that reaches into it, or a new one.
    edges = (
        spaced.groupBy("src", "block")
        .agg(
            F.min("slice").alias("first_slice"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.max("start").alias("last_start"),
        )
        .withColumn("before", F.expr("lag(last_ts) OVER (PARTITION BY src ORDER BY block)"))
        .withColumn(
            "opens",
            F.expr(
                f"CASE WHEN timestampdiff(MICROSECOND, before, first_ts) <= {limit} THEN NULL ELSE first_slice END"
            ),
        )
        .selectExpr(
            "src",
            "block",
            """coalesce(opens, max(coalesce(last_start, opens)) OVER (PARTITION BY src ORDER BY block
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS opening""",
        )
    )
    sessions = spaced.join(edges, ["src", "block"]).withColumn(
        "session", F.expr(f"coalesce(max(start) OVER ({within} CURRENT ROW), opening)")
    )
    return (
        sessions.groupBy("src", "session", "model")
        .agg(
            F.sum("n").alias("n"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        .groupBy("src", "session")
        .agg(
            F.min("first_ts").alias("started"),
            F.max("last_ts").alias("ended"),
            F.count("*").alias("models"),
            F.min("n").alias("calls_per_model"),
            F.max("n").alias("_most"),
        )
        .where((F.col("calls_per_model") == F.col("_most")) & (F.col("models") >= min_models))
        .select("src", "started", "ended", "models", "calls_per_model")
        .orderBy("started", "src")
    )


def coverage(calls: DataFrame) -> DataFrame:
    """Per UTC day: calls, and how many lack a cost, client, process or raw usage."""
    missing = ["cost", "client", "peer_exe", "raw_usage"]
    return (
        calls.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("calls"),
            *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in missing],
        )
        .orderBy("day")
    )


def union_hosts(tables: dict[str, DataFrame]) -> DataFrame:
    """The calls of several hosts as one table with a ``host`` column; absent columns are NULL."""
    tagged = [df.withColumn("host", F.lit(host)) for host, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
