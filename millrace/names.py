"""Identifier quoting and checks."""

from __future__ import annotations

import re


def quote(name: str) -> str:
    """Backtick-quote one identifier, so that spaces and quotes are legal in names."""
    return "`" + name.replace("`", "``") + "`"


def dedupe(names: list[str]) -> list[str]:
    """Second and later uses of a header get ``_1``, ``_2`` …; a blank header gets
    ``column<i>``. Comparison ignores case, as Spark's name lookup does."""
    taken: set[str] = set()
    out: list[str] = []
    for i, raw in enumerate(names):
        base = raw if raw.strip() else f"column{i}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def default_names(width: int) -> list[str]:
    """Names for a file without a header row: ``column0`` …, zero-padded to equal length."""
    digits = len(str(max(width - 1, 0)))
    return [f"column{i:0{digits}d}" for i in range(width)]


def safe_path_part(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "table"
