"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default row bound for lookup tables (people, rules, lemma and stop-word lists).
DEFAULT_MAX_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df`` unchanged.

    The check reads at most ``max_rows + 1`` rows (the limit is pushed into the scan), so a large
    table is never fully counted; above the bound the join falls back to a shuffle join, which AQE
    may still turn into a broadcast from runtime statistics.
    """
    n = df.limit(max_rows + 1).select(F.count(F.lit(1))).first()[0]
    return F.broadcast(df) if n <= max_rows else df
