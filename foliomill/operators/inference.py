"""Model calls over chunks as a distributed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.schemas import RAW_RESPONSE_COLUMNS
from foliomill.sources.prompts import PLACEHOLDER, load_prompts

# Words that mark an error no retry can cure.
FINAL_ERROR = "authentication|api_key"

# A model function gets the system text and the prompt; it returns the answer text, or a dict with
# "text" and optionally "input_tokens" and "output_tokens".
ModelFn = Callable[[str, str], Any]
KEY = ["paper_id", "chunk_no", "prompt_hash"]
GENERATION = "generation"


class ContentError(Exception):
    """Raised by a model function when the call went through but the answer is unusable."""


def key_of(df: DataFrame) -> list[str]:
    """What names an answer: the prompt of a paper's chunk and, where the table has one, the paper's generation."""
    return [*KEY, GENERATION] if GENERATION in df.columns else KEY


def build_prompt(chunks: DataFrame, template: str | None = None, chunk: str = "chunk") -> DataFrame:
    """Adds ``prompt`` (the template with the chunk put in literally) and ``prompt_hash``."""
    template = load_prompts()[1] if template is None else template
    head, _, tail = template.partition(PLACEHOLDER)
    prompt = F.concat(F.lit(head), F.col(chunk), F.lit(tail))
    return chunks.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))


def is_final_error(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(FINAL_ERROR), F.lit(False))


def classify_error(error: Column) -> Column:
    """``final`` for authentication and key errors, ``retryable`` for others, null without an error."""
    return F.when(error.isNull(), F.lit(None)).when(is_final_error(error), F.lit("final")).otherwise(F.lit("retryable"))


def retry_wait(tries: int) -> float:
    """Seconds to wait after the given number of failed tries."""
    wait = config.MODEL_WAIT_FACTOR * 2 ** (tries - 1)
    return float(min(max(wait, config.MODEL_WAIT_MIN), config.MODEL_WAIT_MAX))


def _is_final(failure: Exception) -> bool:
    return any(word in str(failure).lower() for word in FINAL_ERROR.split("|"))


def _call(model_fn: ModelFn, system: str, prompt: str, sleep: Callable[[float], None]) -> dict:
    """One prompt through the model with bounded retries; a failure becomes data."""
    began = time.monotonic()
    row: dict[str, Any] = {}
    for attempt in range(1, config.MODEL_TRIES + 1):
        row = {"attempts": attempt}
        try:
            answer = model_fn(system, prompt)
            row |= {"text": answer} if isinstance(answer, str) or answer is None else answer
            break
        except Exception as failure:  # noqa: BLE001 - any failure of a call is that chunk's outcome
            kind = "final" if _is_final(failure) else "content" if isinstance(failure, ContentError) else "retryable"
            row |= {"error": str(failure), "error_class": kind}
            if kind != "retryable" or attempt == config.MODEL_TRIES:
                break
            sleep(retry_wait(attempt))
    row["elapsed_s"] = time.monotonic() - began
    return row


def infer(
    prompts: DataFrame,
    model_fn: ModelFn,
    max_in_flight: int,
    system: str | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """The model's answer per prompt row (``paper_id, chunk_no, prompt_hash, prompt``).

    ``max_in_flight`` partitions bound the number of calls at a time.  The result repeats the calls
    each time it is evaluated: write it once, then work from the written table.
    """
    system = load_prompts()[0] if system is None else system
    key = key_of(prompts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([_call(model_fn, system, prompt, sleep) for prompt in batch["prompt"]])
            rows = rows.reindex(
                columns=["text", "error", "error_class", "attempts", "elapsed_s", "input_tokens", "output_tokens"]
            ).rename(columns={"text": "response"})
            for tokens in ("input_tokens", "output_tokens"):
                rows[tokens] = rows[tokens].astype("Int64")
            for words in ("response", "error", "error_class"):
                rows[words] = rows[words].astype(object).where(rows[words].notna(), None)
            yield pd.concat([batch[key].reset_index(drop=True), rows], axis=1)

    types = dict(prompts.dtypes)
    keys = ", ".join(f"{name} {types[name]}" for name in key)
    spread = prompts.select(*key, "prompt").repartition(max_in_flight, "paper_id", "chunk_no")
    called = spread.mapInPandas(run, f"{keys}, {RAW_RESPONSE_COLUMNS}")
    return called.withColumn("called_at", F.current_timestamp())


def pending(prompts: DataFrame, raw: DataFrame) -> DataFrame:
    """Prompts without a settled answer: never called, or only with errors worth a retry."""
    settled = raw.where(F.col("error").isNull() | (F.col("error_class") != "retryable"))
    key = key_of(prompts)
    return prompts.join(settled.select(*key).distinct(), key, "left_anti")


def latest_responses(raw: DataFrame) -> DataFrame:
    """One row per prompt from the append-only answers: a success before an error, then the newest."""
    key = key_of(raw)
    rest = [c for c in raw.columns if c not in key]
    order = F.struct(F.col("error").isNull(), F.col("called_at"), F.coalesce("response", F.lit("")))
    return raw.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_best")).select(*key, "_best.*")


def incomplete_papers(prompts: DataFrame, raw: DataFrame) -> DataFrame:
    """Papers that still wait for an answer; they are left for the next run."""
    return pending(prompts, raw).select("paper_id").distinct()
