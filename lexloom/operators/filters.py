"""Metadata filters: exact equality of every given key, on maps of JSON-encoded values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, functions as F


def encode(value: Any) -> str | None:
    """JSON with integral floats and truth values as integers, so that values equal in Python are equal as strings."""
    if value is None:
        return None
    if isinstance(value, bool) or isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def matches(metadata: Column, wanted: dict[str, Any] | None) -> Column:
    """A key asked to be None matches rows that lack it."""
    out = F.lit(True)
    for key, value in (wanted or {}).items():
        out = out & F.try_element_at(metadata, F.lit(key)).eqNullSafe(F.lit(encode(value)))
    return out
