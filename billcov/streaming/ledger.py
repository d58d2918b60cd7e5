"""Completion ledger: what has been collected for each site and year, and which years are done (B7, G10).

The reference lists a site's output files, counts the collected bills of a year and skips a year whose
count has reached the year's number of bills.  Here collected rows arrive as a stream; a stateful
operator keyed by (site, year) keeps the bills seen so far, lets each bill pass once, and lets nothing
pass for a year that is complete.  State and output are committed with the stream's checkpoint, so a
batch that was killed is repeated as a whole and a restart writes nothing twice.

State is bounded by the number of bills of a year (what completes it), not by the rows that arrive.

Defined cases: a row without site, year or bill is left out; a year that the totals don't have is
never complete; rows of one batch are taken in the order of the bills' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PASSED = "site string, year string, bill string, bills_done long, bills_total long, complete boolean"
_STATE = "bills array<string>, total long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bills of a (site, year) that are new, until the year is complete."""
    seen, total = state.get if state.exists else ([], None)
    seen = list(seen)
    known = set(seen)
    fresh: set[str] = set()
    for b in batches:
        fresh.update(x for x in b["bill"] if x not in known)
        if len(b) and not pd.isna(b["total"].iloc[0]):
            total = int(b["total"].iloc[0])
    rows = []
    for bill in sorted(fresh):
        if total is not None and len(seen) >= total:
            break
        seen.append(bill)
        rows.append((key[0], key[1], bill, len(seen), total, total is not None and len(seen) >= total))
    state.update((seen, total))
    yield pd.DataFrame(rows, columns=["site", "year", "bill", "bills_done", "bills_total", "complete"]).astype({"bills_total": "Int64"})


def gate(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Stream of newly collected (site, year, bill) with the year's progress; ``totals``: year, total (bills of the year)."""
    known = totals.select(F.col("year").cast("string").alias("t_year"), F.col("total").cast("long").alias("total"))
    clean = rows.select(F.col("site").cast("string").alias("site"), F.col("year").cast("string").alias("year"), F.col("bill").cast("string").alias("bill")).where("site is not null and year is not null and bill is not null")
    joined = clean.join(known, F.col("year") == F.col("t_year"), "left").drop("t_year")
    return joined.groupBy("site", "year").applyInPandasWithState(_advance, PASSED, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_ledger(spark: SparkSession, source: str, totals: DataFrame, out: str, checkpoint: str, max_files: int = 1) -> None:
    """Take in the files (parquet: site, year, bill) that have come since the last run, ``max_files`` at a time."""
    schema = "site string, year string, bill string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = gate(rows, totals).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress(ledger: DataFrame) -> DataFrame:
    """site, year, bills_done, bills_total, complete."""
    return ledger.groupBy("site", "year").agg(F.max("bills_done").alias("bills_done"), F.max("bills_total").alias("bills_total"), F.max("complete").alias("complete"))
