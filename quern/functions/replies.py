"""Replies of an extractor as rows: JSON found in prose, fences, lines or wrappers.

Decoding is incremental (any number of JSON values between words), which no built-in does, and
numbers keep the spelling that a JSON decoder gives them; so it is an Arrow-batched function.
Everything after it is Catalyst.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that wrap a row list.
WRAPPERS = ("rows", "data", "results", "extractions", "experiments")
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_OPEN = re.compile(r"[\[{]")

REPLY = "struct<form:string,rows:array<array<struct<key:string,value:string,nested:boolean>>>>"


def json_values(text: str) -> list:
    """The JSON arrays and objects in ``text``, left to right, none inside another."""
    decode, found, at = json.JSONDecoder().raw_decode, [], 0
    while m := _OPEN.search(text, at):
        try:
            value, at = decode(text, m.start())
        except (ValueError, RecursionError):
            at = m.end()
        else:
            found.append(value)
    return found


def rows_of(value) -> list[dict] | None:
    """The row objects of a list or of a wrapper's first list; None for anything else."""
    if isinstance(value, dict):
        value = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else None


def parse_reply(raw: str) -> tuple[list[dict], str] | None:
    """(rows, form), form one of bare, fenced, jsonl, extra; None if there is nothing to use."""
    text = raw.strip()
    fence = _FENCE.search(text)
    body = fence[1].strip() if fence else text
    try:
        whole = rows_of(json.loads(body))
    except (ValueError, RecursionError):
        whole = None
    if whole is not None:
        return whole, "fenced" if fence else "bare"
    values = json_values(body)
    for v in values:
        if (rows := rows_of(v)) is not None:
            return rows, "extra"
    objects = [v for v in values if isinstance(v, dict)]
    if not objects:
        return None
    dense = "".join(body.split())
    return objects, "jsonl" if dense[:1] == "{" and dense[-1:] == "}" else "extra"


def _entry(key: str, value) -> dict:
    nested = isinstance(value, (list, dict))
    shown = None if value is None else json.dumps(value, ensure_ascii=False) if nested else str(value)
    return {"key": key, "value": shown, "nested": nested}


def parsed(reply: Column) -> Column:
    """struct (form, rows); form is null for a reply that has no rows to parse. A row is its
    entries in order; of a repeated key the last value stands at the first place."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        forms, out = [], []
        for t in texts:
            got = parse_reply(t) if isinstance(t, str) else None
            forms.append(got[1] if got else None)
            out.append([[_entry(k, v) for k, v in r.items()] for r in got[0]] if got else [])
        return pd.DataFrame({"form": forms, "rows": out})

    return F.pandas_udf(batch, REPLY)(reply)


def prompt_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))
