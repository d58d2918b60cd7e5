"""Global row numbers without a single-task window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.session import ensure_checkpoint_dir


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place (from 0, bigint) in the global order of ``order``.

    Rows are range-partitioned and sorted; a row gets its place inside its partition there, and the
    table is written to the shared folder, so that places stay as they are.  Partition sizes (one
    row for each partition) give the offsets.  Rows that tie in ``order`` get places of their own, in
    no fixed order.
    """
    spark = df.sparkSession
    mark = f"{name}_{uuid.uuid4().hex[:8]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    part, place = F.shiftright(mark, 33), F.col(mark).bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, f"{mark}_p long, {mark}_o long")
    return (
        rows.join(F.broadcast(offsets), part == F.col(f"{mark}_p"))  # one row for each partition
        .withColumn(name, place + F.col(f"{mark}_o"))
        .drop(mark, f"{mark}_p", f"{mark}_o")
    )
