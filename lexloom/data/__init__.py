"""Word lists of romanised Bangla (language data under the Apache License 2.0), one file each."""

from __future__ import annotations

from functools import cache
from importlib.resources import files


@cache
def rows(name: str) -> tuple[tuple[str, ...], ...]:
    text = files(__package__).joinpath(f"{name}.tsv").read_text(encoding="utf-8")
    return tuple(tuple(line.split("\t")) for line in text.splitlines() if line)


def words(name: str) -> list[str]:
    return [r[0] for r in rows(name)]


def mapping(name: str) -> dict[str, str]:
    return {r[0]: r[1] for r in rows(name)}
