"""Extraction: a user's extractor called for each chunk, with retries, and the log of its attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import FINAL_ERRORS

# A fixed value: attempts per chunk.
MAX_ATTEMPTS = 3
LOG = "attempt int, status string, error string, text string"

Extractor = Callable[[str], str]


def extract(chunks: DataFrame, make: Callable[[], Extractor], usable: Callable[[str], bool] | None = None, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """``chunks`` (any keys, and prompt) to one row per attempt: the keys, attempt, status (ok,
    call_error or parse_error), error, text.

    ``make`` is called once a task and gives the extractor, a function from prompt to reply. A call that
    raises is a call_error; a reply that is not ``usable`` a parse_error. Either is tried again, but for
    errors that another attempt can't cure. A lost task calls again: an extractor should be idempotent.
    A null prompt is an empty one."""
    keys = [c for c in chunks.columns if c != "prompt"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            rows = []
            for *key, prompt in b[[*keys, "prompt"]].itertuples(index=False, name=None):
                for n in range(1, attempts + 1):
                    status, error, text = "ok", None, None
                    try:
                        text = call(prompt or "")
                        if usable is not None and not usable(text):
                            status, error = "parse_error", "no usable reply"
                    except Exception as e:  # noqa: BLE001  whatever an extractor raises is logged
                        status, error = "call_error", str(e)
                    rows.append((*key, n, status, error, text))
                    if status == "ok" or status == "call_error" and any(x in error.lower() for x in FINAL_ERRORS):
                        break
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "attempt", "status", "error", "text"])

    return chunks.select(*keys, "prompt").mapInPandas(run, f"{fields}, {LOG}")


def fill(template: Column, fields: dict[str, Column]) -> Column:
    """A prompt template with its ``{name}`` places filled; other braces stay."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def variant(base: str, edits: list[tuple[str, str]]) -> str:
    """A prompt made from another by replacing passages, each of which must stand in it exactly once."""
    for old, new in edits:
        if base.count(old) != 1:
            raise ValueError(f"{base.count(old)} places of {old[:40]!r} instead of one")
        base = base.replace(old, new)
    return base


def prompts(chunks: DataFrame, templates: DataFrame) -> DataFrame:
    """``chunks`` (version, text, ...) with the prompt of their version: ``templates`` has version,
    template, with a place ``{text}``."""
    t = templates.select("version", "template")
    return chunks.join(t, "version").withColumn("prompt", fill(F.col("template"), {"text": F.col("text")})).drop("template")
