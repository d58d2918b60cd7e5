"""Sinks and resume logic (B1–B7).

The reference writes one CSV per site/year (and one per bill for bill texts) and skips work whose
output file already exists.  Here outputs are partitioned tables and "resume" is a key-level
anti-join against what is already written, followed by an append – idempotent at row level, and
safe to re-run after a failed job.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from billcov.session import ensure_checkpoint_dir, stored


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite", dynamic: bool = True) -> None:
    """Partitioned write; with ``dynamic`` only the partitions present in ``df`` are replaced."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
        if dynamic and mode == "overwrite":
            w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)


#: Options under which any text survives a CSV file.
CSV = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_sessions(df: DataFrame, table: str, year_col: str = "year", root: str | None = None) -> str:
    """``<root>/<year>/csv/<table>.csv`` for each year of ``df`` (a legislature's session folders); returns the root.

    The rows are materialised once and written year by year (a handful).  Without ``root`` a new folder below ``spark.checkpoint.dir`` is taken."""
    root = root or new_folder(df.sparkSession, "sessions")
    rows = stored(df, "sessions")
    for r in rows.select(year_col).distinct().collect():
        mine = rows.where(rows[year_col].eqNullSafe(r[0])).drop(year_col)
        mine.write.mode("overwrite").options(**CSV).csv(f"{root}/{r[0]}/csv/{table}.csv")
    return root


def write_articles(df: DataFrame, root: str | None = None) -> str:
    """``<root>/<the site's file name><year>.csv`` for each site and year of ``df`` (site, Year and article columns)."""
    from billcov.sources.readers import ARTICLE_FILES

    root = root or new_folder(df.sparkSession, "articles")
    rows = stored(df, "articles")
    for r in rows.select("site", "Year").distinct().collect():  # sites times years
        mine = rows.where((rows["site"] == r["site"]) & rows["Year"].eqNullSafe(r["Year"])).drop("site")
        mine.write.mode("overwrite").options(**CSV).csv(f"{root}/{ARTICLE_FILES[r['site']]}{r['Year']}.csv")
    return root


def read_existing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(fmt).option("header", True).load(path)
    except AnalysisException:
        return None


def pending(df: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not yet in ``done`` (B7 resume check as a left anti-join)."""
    if done is None:
        return df
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (),
               fmt: str = "parquet") -> None:
    """Append only rows with unseen keys (re-running the same job writes nothing twice)."""
    spark = df.sparkSession
    new = pending(df, read_existing(spark, path, fmt), keys)
    w = new.write.mode("append").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def progress(written: DataFrame, bill_col: str = "Bill", year_col: str = "Year") -> DataFrame:
    """Bills already collected per year (``countDistinct``) – the reference's resume progress check,
    compared with the number of bills of the year to decide whether a year is complete (G10)."""
    from pyspark.sql import functions as F

    return written.groupBy(year_col).agg(F.countDistinct(bill_col).alias("bills_done"))


def union_bill_text(new: DataFrame, old: DataFrame) -> DataFrame:
    """New bill texts appended to the previously collected ones (rows, by column name) – the
    intended result of the reference's side-by-side concat (S2, Q2)."""
    return new.unionByName(old, allowMissingColumns=True)
