"""Checks of report arguments."""

from __future__ import annotations

import re

from ..schemas import DEFAULT_HISTORY, DEFAULT_LIMIT

_WHOLE = re.compile(r"\s*[+-]?\d+\s*")


def report_limit(limit=None, max_history: int | None = DEFAULT_HISTORY) -> int:
    """Number of rows a report returns: 200 unless given, above zero, at most ``max_history``."""
    rows = DEFAULT_LIMIT
    if limit is not None:
        if not _WHOLE.fullmatch(str(limit)):
            raise ValueError(f"rows of a report are a whole number, not {limit!r}")
        rows = int(limit)
        if rows < 1:
            raise ValueError(f"a report has one row or more, not {rows}")
        rows = min(rows, max_history or rows)
    return rows
