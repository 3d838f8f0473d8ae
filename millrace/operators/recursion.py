"""Recursion over tables, round by round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import stored


def union_all(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first, what step makes of it, what step makes of that, and so on, until a round has no rows: WITH RECURSIVE ... UNION ALL.

    Each round is a table in the shared folder that only the next one reads, so neither rows nor plans are bounded or computed again. A step that
    never comes to an end, as on a cycle, runs on.
    """
    rows = stored(first, "round")
    out = rows
    while not rows.isEmpty():
        rows = stored(step(rows), "round")
        out = out.unionAll(rows)
    return out
