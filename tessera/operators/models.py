"""Prompts and model calls over rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.tokens import max_output_tokens, repetition_loop
from tessera.operators.profiles import merge_profiles
from tessera.session import staged

# Temperatures of the first call and of the call after a loop.
FIRST_TEMPERATURE = 0.1
LOOP_TEMPERATURE = 0.2

BatchCall = Callable[[pd.DataFrame], list[str | None]]


def fact_prompt(index: Column, total: Column, tokens: Column, pages: Column, content: Column) -> Column:
    """Prompt of the fact extraction for one chunk. The wording is fixed text."""
    quoted = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")
    return F.concat(
        F.lit("chunk_index="), index.cast("string"), F.lit(" / total_chunks="), total.cast("string"),
        F.lit("\ntoken_count="), tokens.cast("string"),
        F.lit("\npage_source=["), quoted, F.lit("]\n\nCONTEÚDO DO CHUNK:\n\n"), content,
    )


def _or_unknown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(F.lit("Não informado"))


def discovery_prompt(trade: Column, legal: Column, key: Column, city: Column, results: Column) -> Column:
    """Prompt that asks which search hit is the official site. The wording is fixed text."""
    return F.concat(
        F.lit("\nDados da Empresa:\n- Nome Fantasia: "), _or_unknown(trade),
        F.lit("\n- Razão Social: "), _or_unknown(legal),
        F.lit("\n- CNPJ: "), _or_unknown(key),
        F.lit("\n- E-mail: Não informado\n- Município: "), _or_unknown(city),
        F.lit("\n- CNAEs (Atividades): Não informado\n\nResultados da Busca (Consolidados):\n"),
        F.to_json(results), F.lit("\n"),
    )


def numbered_links(links: Column) -> Column:
    """The sorted links of a page as a numbered list for a prompt."""
    return F.array_join(
        F.transform(
            F.sort_array(F.array_distinct(links)),
            lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x),
        ),
        "\n",
    )


def model_map(
    rows: DataFrame, key: str, call: BatchCall, parse: Callable[[Column], Column] | None = None, schema: str | None = None
) -> DataFrame:
    """Send the prompts of a batch to a model and return (key, content, error, latency_ms).

    ``call`` gets a frame with ``prompt``, ``temperature`` and ``max_tokens`` and
    returns the answers in order, null for a failed one. It runs inside the tasks,
    on Arrow batches; a batch that fails as a whole gives its rows the error. A row's
    latency is that of the call it went out with. With ``parse``, a Column function over
    the content, or ``schema``, a DDL type the content is read as JSON by, there is one
    more column ``parsed``.
    """
    inputs = [key, "prompt", "temperature", "max_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            error, start = None, time.perf_counter()
            try:
                answers = list(call(batch))
            except Exception as exc:  # noqa: BLE001 - the caller's model may raise anything
                answers, error = [None] * len(batch), f"{type(exc).__name__}: {exc}"
            took = (time.perf_counter() - start) * 1000
            yield pd.DataFrame({key: batch[key], "content": answers, "error": error, "latency_ms": took})

    key_type = rows.schema[key].dataType.simpleString()
    answered = rows.select(*inputs).mapInPandas(run, f"{key} {key_type}, content string, error string, latency_ms double")
    if parse is None and schema is None:
        return answered
    return answered.withColumn("parsed", parse(F.col("content")) if parse else F.from_json("content", schema))


def with_call_settings(rows: DataFrame, tokens: Column, limit: int, loop_retry: bool = False) -> DataFrame:
    """Add temperature and output budget for a first call or for one after a loop."""
    temperature = LOOP_TEMPERATURE if loop_retry else FIRST_TEMPERATURE
    return rows.withColumns(
        {
            "temperature": F.lit(temperature),
            "max_tokens": max_output_tokens(tokens, F.lit(limit), loop_retry),
        }
    )


def degenerate_retry(rows: DataFrame, key: str, tokens: Column, limit: int, call: BatchCall) -> DataFrame:
    """Call a model, call once more for looping answers, report what is left.

    ``rows`` holds (key, prompt). Rows whose call failed are not repeated. The answers of
    the first pass are written once and both ways go on from the files: a model that
    answers differently when asked again can neither lose nor double a row.
    """
    first = model_map(with_call_settings(rows, tokens, limit), key, call)
    judged = staged(first.withColumn("looping", F.coalesce(repetition_loop(F.col("content")), F.lit(False))), "answers")
    good = judged.where(~F.col("looping"))
    looping = rows.join(judged.where("looping").select(key), key, "left_semi")
    second = model_map(with_call_settings(looping, tokens, limit, loop_retry=True), key, call)
    again = second.withColumn("looping", repetition_loop(F.col("content")))
    return good.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2))).select(
        key,
        F.when(~F.col("looping"), F.col("content")).alias("content"),
        F.when(F.col("looping"), "loop").when(F.col("content").isNull(), F.coalesce("error", F.lit("failed"))).alias("failure"),
        "attempt",
    )


def multi_chunk_profile(partials: DataFrame) -> DataFrame:
    """Partial profiles of the chunks of a company to one; failed chunks hold null.

    ``partials`` are read once a part of the merge: stage a model's answers first.
    """
    return merge_profiles(partials.where(F.col("profile").isNotNull()))
