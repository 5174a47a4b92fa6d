"""Reading usage objects: one SQL expression per provider family.

A usage object is parsed with the typed schema ``USAGE``. A count is a whole
non-negative JSON number; ``5.0``, ``"5"``, ``-5`` and null are no counts. Keys whose
mere presence matters are VARIANT fields: those are SQL NULL only when absent.
"""

from __future__ import annotations

from spendlens.schemas import USAGE_COLUMNS

OPENAI, ANTHROPIC, GEMINI = "openai", "anthropic", "gemini"

# The known providers, the family their usage is read by and the
# top-level key that carries it.
PROVIDERS = [
    ("anthropic", ANTHROPIC, "usage"),
    ("openai", OPENAI, "usage"),
    ("deepseek", OPENAI, "usage"),
    ("openrouter", OPENAI, "usage"),
    ("gemini", GEMINI, "usageMetadata"),
    ("kimi", OPENAI, "usage"),
    ("minimax", OPENAI, "usage"),
    ("glm", OPENAI, "usage"),
    ("xai", OPENAI, "usage"),
    ("groq", OPENAI, "usage"),
]

TICKS_PER_USD = 1e10


def family_of(provider: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN '{family}'" for name, family, _ in PROVIDERS)
    return f"CASE {provider} {whens} END"


def usage_key_of(provider: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN '{key}'" for name, _, key in PROVIDERS)
    return f"CASE {provider} {whens} END"


# All keys read from a usage object, over all families.
USAGE = """input_tokens variant, prompt_tokens bigint, output_tokens variant,
    completion_tokens bigint, total_tokens bigint, input_tokens_details variant,
    prompt_tokens_details struct<cached_tokens: bigint>, output_tokens_details variant,
    completion_tokens_details struct<reasoning_tokens: bigint>, prompt_cache_hit_tokens bigint,
    cached_tokens bigint, cost double, cost_in_usd_ticks bigint, cache_read_input_tokens bigint,
    cache_creation_input_tokens bigint, promptTokenCount bigint, candidatesTokenCount bigint,
    thoughtsTokenCount bigint, cachedContentTokenCount bigint"""


def parsed(text: str) -> str:
    return f"from_json({text}, '{USAGE}', map('allowNonNumericNumbers', 'false'))"


def count(number: str) -> str:
    return f"CASE WHEN {number} >= 0 THEN {number} END"


def count_of(v: str) -> str:
    whole = f"try_variant_get({v}, '$', 'bigint')"
    return f"CASE WHEN schema_of_variant({v}) = 'BIGINT' AND {whole} >= 0 THEN {whole} END"


def member_count(v: str, key: str) -> str:
    return count_of(f"try_variant_get({v}, '$.{key}', 'variant')")


def text_of(v: str) -> str:
    """A non-empty string."""
    return f"""CASE WHEN schema_of_variant({v}) = 'STRING'
        THEN nullif(try_variant_get({v}, '$', 'string'), '') END"""


def _struct(fields: dict[str, str], columns: list[str] = [*USAGE_COLUMNS, "total_tokens"]) -> str:
    types = {c: "DOUBLE" if c == "cost" else "BIGINT" for c in columns}
    return "named_struct(" + ", ".join(
        f"'{c}', {fields.get(c, f'CAST(NULL AS {t})')}" for c, t in types.items()
    ) + ")"


def openai_fields(u: str) -> str:
    """As reported, before ``folded``. Of two names, the one present decides, even when null."""

    def either(first: str, of_first: str, of_second: str) -> str:
        return f"CASE WHEN {u}.{first} IS NOT NULL THEN {of_first} ELSE {of_second} END"

    def tokens(first: str, second: str) -> str:
        return either(first, count_of(f"{u}.{first}"), count(f"{u}.{second}"))

    def detail(side: str, old_side: str, key: str) -> str:
        first = f"{side}_tokens_details"
        return either(
            first, member_count(f"{u}.{first}", key), count(f"{u}.{old_side}_tokens_details.{key}")
        )

    return _struct(
        {
            "input_tokens": tokens("input_tokens", "prompt_tokens"),
            "output_tokens": tokens("output_tokens", "completion_tokens"),
            "cache_read_input_tokens": f"""coalesce({detail('input', 'prompt', 'cached_tokens')},
                {count(f'{u}.prompt_cache_hit_tokens')}, {count(f'{u}.cached_tokens')})""",
            "reasoning_output_tokens": detail("output", "completion", "reasoning_tokens"),
            "cost": f"""coalesce({u}.cost,
                {count(f'{u}.cost_in_usd_ticks')} / {TICKS_PER_USD}D)""",
            "total_tokens": count(f"{u}.total_tokens"),
        }
    )


def anthropic_fields(u: str) -> str:
    return _struct(
        {
            "input_tokens": count_of(f"{u}.input_tokens"),
            "output_tokens": count_of(f"{u}.output_tokens"),
            "cache_read_input_tokens": count(f"{u}.cache_read_input_tokens"),
            "cache_creation_input_tokens": count(f"{u}.cache_creation_input_tokens"),
        }
    )


def gemini_fields(u: str) -> str:
    """Thinking tokens are counted apart from the candidates, so the output is their sum."""
    candidates = count(f"{u}.candidatesTokenCount")
    thoughts = count(f"{u}.thoughtsTokenCount")
    return _struct(
        {
            "input_tokens": count(f"{u}.promptTokenCount"),
            "output_tokens": f"""coalesce(try_add({candidates}, {thoughts}),
                {candidates}, {thoughts})""",
            "cache_read_input_tokens": count(f"{u}.cachedContentTokenCount"),
            "reasoning_output_tokens": thoughts,
        }
    )


def fields_of(u: str, family: str) -> str:
    return f"""CASE {family} WHEN '{OPENAI}' THEN {openai_fields(u)}
        WHEN '{ANTHROPIC}' THEN {anthropic_fields(u)} WHEN '{GEMINI}' THEN {gemini_fields(u)} END"""


def folded(f: str) -> str:
    """Add reasoning to the output where the total shows it is not part of it."""
    apart = f"""{f}.reasoning_output_tokens > 0 AND {f}.total_tokens =
        try_add(try_add({f}.input_tokens, {f}.output_tokens), {f}.reasoning_output_tokens)"""
    fields = {c: f"{f}.{c}" for c in USAGE_COLUMNS}
    fields["output_tokens"] = f"""CASE WHEN {apart}
        THEN {f}.output_tokens + {f}.reasoning_output_tokens ELSE {f}.output_tokens END"""
    return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in fields.items()) + ")"


def merged(array: str) -> str:
    """Field by field, the last non-null value over an array of usage structs."""
    nothing = _struct({}, USAGE_COLUMNS)
    fields = ", ".join(f"'{c}', coalesce(x.{c}, acc.{c})" for c in USAGE_COLUMNS)
    return f"aggregate(coalesce({array}, array()), {nothing}, (acc, x) -> named_struct({fields}))"
