"""Chunks of a bounded number of characters, cut at the coarsest boundary that serves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from ..errors import ConfigurationError

#: Boundaries from coarse to fine; those marked True stay at the end of the part before them.
BOUNDARIES = [("\n\n", False), ("\n", False), *((mark, True) for mark in "।.?!;"), (" ", False)]


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ConfigurationError(f"chunk_size {size} is not positive or chunk_overlap {overlap} not in [0, chunk_size)")


def _parts(text: str, mark: str, stays: bool) -> list[str]:
    found = text.split(mark)
    if stays:
        found = [p + mark for p in found[:-1]] + found[-1:]
    return [p for p in found if p]


def _pieces(text: str, size: int, level: int = 0) -> Iterator[str]:
    """Parts of at most ``size`` characters, where any boundary allows; blank ones left out."""
    if len(text) <= size:
        if text.strip():
            yield text
        return
    while level < len(BOUNDARIES):
        mark, stays = BOUNDARIES[level]
        level += 1
        found = _parts(text, mark, stays)
        if len(found) != 1:  # else the text, as it is, is tried at the next boundary
            for part in found:
                if part.strip():
                    yield from _pieces(part, size, level)
            return
    yield from (text[i : i + size] for i in range(0, len(text), size))


def split_text(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    chunks, held = [], ""
    for piece in _pieces(text, size):
        longer = f"{held} {piece}".strip() if held else piece.strip()
        if held and len(longer) > size:
            chunks.append(held)
            carried = held[-overlap:] if overlap else ""
            carried = carried.partition(" ")[2] if " " in carried else carried
            longer = f"{carried} {piece}".strip() if carried else piece.strip()
        held = longer
    return [c for c in [*chunks, held] if c.strip()]


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    check(size, overlap)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap), na_action="ignore")

    return F.coalesce(cut(text), F.array().cast("array<string>"))
