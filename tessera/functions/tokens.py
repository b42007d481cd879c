"""Token estimates, size rules and repetition tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import WORD, WS, let, lines, strip

# The estimator, the chunk size rule and the output size rule.
CHARS_PER_TOKEN = 3
PROMPT_OVERHEAD_TOKENS = 2500
MESSAGE_OVERHEAD_TOKENS = 100
CHUNK_MAX_TOKENS = 20000
CHUNK_PROMPT_TOKENS = 2500
CHUNK_MESSAGE_TOKENS = 200
CHUNK_SAFETY = 0.85
OUTPUT_STEPS = ((3000, 900), (8000, 1400))
OUTPUT_TOP = 2200
LOOP_RETRY_FACTOR = 0.75


def estimate_tokens(c: Column, overhead: bool = False) -> Column:
    """Whole text length over three, plus the prompt overhead on request."""
    base = F.floor(F.length(c) / CHARS_PER_TOKEN)
    return (base + PROMPT_OVERHEAD_TOKENS if overhead else base).cast("long")


def message_tokens(total_chars: Column, messages: Column) -> Column:
    """Tokens of a conversation from its summed length and message count."""
    return F.greatest(
        F.lit(100),
        F.floor(total_chars / CHARS_PER_TOKEN) + messages * MESSAGE_OVERHEAD_TOKENS,
    ).cast("long")


def effective_max(
    max_tokens: int = CHUNK_MAX_TOKENS,
    prompt: int = CHUNK_PROMPT_TOKENS,
    message: int = CHUNK_MESSAGE_TOKENS,
    safety: float = CHUNK_SAFETY,
) -> int:
    """Tokens left for content in one chunk (14705 with the defaults)."""
    return int((max_tokens - prompt - message) * safety)


def max_output_tokens(tokens: Column, limit: Column, loop_retry: bool = False) -> Column:
    """Output budget by input size, cut by the provider limit and on loop retry."""
    rule = F
    for bound, budget in OUTPUT_STEPS:
        rule = rule.when(tokens < bound, F.lit(budget))
    budget = F.least(rule.otherwise(F.lit(OUTPUT_TOP)), limit)
    return (F.floor(budget * LOOP_RETRY_FACTOR) if loop_retry else budget).cast("long")


def repetition_rate(c: Column) -> Column:
    """Share of lines that repeat an earlier line."""
    return let(
        lines(c),
        lambda ls: F.when(F.size(ls) == 0, F.lit(0.0)).otherwise(
            (F.size(ls) - F.size(F.array_distinct(ls))) / F.size(ls)
        ),
    )


def _size_margin(tokens: Column) -> Column:
    return (
        F.when(tokens > 80000, 0.25)
        .when(tokens > 75000, 0.20)
        .when(tokens > 70000, 0.15)
        .when(tokens > 60000, 0.10)
        .when(tokens > 50000, 0.05)
        .otherwise(0.0)
    )


def _repetition_margin(rate: Column) -> Column:
    return F.when(rate > 0.9, 0.15).when(rate > 0.8, 0.10).when(rate > 0.7, 0.05).otherwise(0.0)


def safety_margin(rate: Column, tokens: Column, base: int) -> Column:
    """Struct (margin, limit): the tokens allowed after the content margin.

    The overflow branch is kept as it is defined: a text larger than the base
    gets a negative margin, which raises the limit.
    """
    plain = F.greatest(_repetition_margin(rate), _size_margin(tokens))
    needed = F.least(F.lit(1.0) - tokens / base + 0.05, F.lit(0.30))
    margin = F.when(tokens > _cut(base, plain), needed).otherwise(plain)
    return F.struct(margin.alias("margin"), _cut(base, margin).alias("limit"))


def _cut(base: int, margin: Column) -> Column:
    scaled = F.lit(float(base)) * (F.lit(1.0) - margin)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("long")


def _repeats_over(items: Column, times: int) -> Column:
    """True when some value occurs more than ``times`` times.

    Sorted equal values are adjacent, so a value occurs more than n times
    exactly when an element equals the one n places further on. No explode and
    no shuffle: the work stays in the row.
    """
    return let(
        F.sort_array(items),
        lambda s: F.exists(
            F.when(F.size(s) > times, F.sequence(F.lit(0), F.size(s) - times - 1)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.get(s, i) == F.get(s, i + times),
        ),
    )


def has_repeated_ngram(c: Column, n: int = 4, times: int = 20) -> Column:
    """Some run of ``n`` words occurs more than ``times`` times."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))

    def grams(w: Column, make, kind: str) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: make(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast(f"array<{kind}>"))

    def test(w: Column) -> Column:
        # Sorting numbers is cheap; texts are compared only where their hashes repeat.
        likely = _repeats_over(grams(w, F.xxhash64, "bigint"), times)
        exact = _repeats_over(grams(w, lambda *g: F.concat_ws(" ", *g), "string"), times)
        return F.when(likely, exact).otherwise(F.lit(False))

    return let(words, test)


def has_repeated_slice(c: Column, width: int = 30, step: int = 10, times: int = 15) -> Column:
    """Some stretch of ``width`` characters occurs more than ``times`` times.

    The text is cut once into pieces of ``step`` characters and stretches are
    joined from neighbouring pieces, which stays linear in the text length.
    """
    per_stretch = width // step
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def stretches(p: Column) -> Column:
        starts = F.ceil((F.length(c) - width) / step).cast("int")
        return F.filter(
            F.transform(
                F.sequence(F.lit(0), starts - 1),
                lambda i: strip(F.concat(*[F.get(p, i + k) for k in range(per_stretch)])),
            ),
            lambda s: F.length(s) >= 20,
        )

    def test(cuts: Column) -> Column:
        likely = _repeats_over(F.transform(cuts, lambda x: F.xxhash64(x)), times)
        return F.when(likely, _repeats_over(cuts, times)).otherwise(F.lit(False))

    return F.when(F.length(c) > width, let(let(pieces, stretches), test)).otherwise(F.lit(False))


def repetition_loop(c: Column) -> Column:
    """A degenerate answer: repeated words, repeated stretches, or unclosed JSON."""
    unclosed = (F.length(c) > 8000) & ~c.rlike(rf"\}}{WS}*\z")
    return F.coalesce(
        (F.length(c) >= 100) & (unclosed | has_repeated_ngram(c) | has_repeated_slice(c)),
        F.lit(False),
    )
