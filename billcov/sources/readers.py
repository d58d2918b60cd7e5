"""Readers for the reference's on-disk inputs (A1–A7): yearly legislative CSVs and article CSVs.

Every table has a fixed schema; CSV cells are read as text and cast to it (no inference).  CSV
index columns written by pandas/R (``Unnamed: 0``, ``X``, ``_c0``) are dropped.  The session year
comes from the path (``.../<year>/csv/<table>.csv``); a year range is turned into the file list, and a
filter on the ``year`` column reaches the scan as a filter on the file's path, so either way only the
files of the requested years are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "bills": T.StructType([
        T.StructField("bill_id", T.LongType()), T.StructField("bill_number", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("last_action", T.StringType()),
        T.StructField("last_action_date", T.DateType()),
    ]),
    "history": T.StructType([
        T.StructField("bill_id", T.LongType()), T.StructField("date", T.DateType()),
        T.StructField("sequence", T.IntegerType()), T.StructField("action", T.StringType()),
    ]),
    "documents": T.StructType([
        T.StructField("bill_id", T.LongType()), T.StructField("document_id", T.LongType()),
        T.StructField("url", T.StringType()),
    ]),
    "people": T.StructType([T.StructField("people_id", T.LongType()), T.StructField("party", T.StringType())]),
    "sponsors": T.StructType([T.StructField("bill_id", T.LongType()), T.StructField("people_id", T.LongType())]),
    "articles": T.StructType([
        T.StructField("Author", T.StringType()), T.StructField("Title", T.StringType()),
        T.StructField("Text", T.StringType()), T.StructField("URL", T.StringType()),
        T.StructField("Bill", T.StringType()), T.StructField("Year", T.IntegerType()),
    ]),
    "bill_text": T.StructType([
        T.StructField("Year", T.StringType()), T.StructField("Bill_Number", T.StringType()),
        T.StructField("Bill_Text", T.StringType()),
    ]),
}

INDEX_COLUMNS = ("", "_c0", "X", "Unnamed: 0")

# Article CSV file-name prefixes per site.
ARTICLE_FILES = {
    "azcentral": "azcen_articletext_",
    "phoenixnewtimes": "pnt_articletext_",
    "azdailystar": "azds_articletext_",
    "azcapitoltimes": "az_capitol_times",
}


def _csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # multiLine: article bodies contain newlines inside quoted cells
    return (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("inferSchema", False).csv(list(paths))
    )


def typed(df: DataFrame, schema: T.StructType, blank_text: str = "null") -> DataFrame:
    """Cast text cells to ``schema`` (columns by name), drop index columns.  ``blank_text='empty'``
    keeps blank string cells as '' (R ``read.csv``) instead of null (pandas/Spark)."""
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType) and blank_text == "empty":
            c = F.coalesce(c, F.lit(""))
        cols.append(c.cast(f.dataType).alias(f.name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in schema.fieldNames() and c not in INDEX_COLUMNS]
    return df.select(*cols, *extra)


def year_paths(root: str, table: str, years: Iterable[int] | None) -> list[str]:
    if years is None:
        return [f"{root}/*/csv/{table}.csv"]
    return [f"{root}/{y}/csv/{table}.csv" for y in years]


def read_session_table(
    spark: SparkSession, root: str, table: str, years: Iterable[int] | None = None, blank_text: str = "null"
) -> DataFrame:
    """One legislative table for all (or the given) years, with a string ``year`` column from the path."""
    raw = _csv(spark, year_paths(root, table, years))
    year = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4})/csv/", 1)
    return typed(raw, SCHEMAS[table], blank_text).withColumn("year", year)


def read_articles(spark: SparkSession, root: str, sites: Sequence[str] = tuple(ARTICLE_FILES),
                  blank_text: str = "null") -> DataFrame:
    """All sites' article CSVs in one read, with a ``site`` column from the name of the file (or of the
    folder that stands for it, as Spark writes CSV)."""
    paths = [f"{root}/{ARTICLE_FILES[s]}*.csv" for s in sites]
    raw = _csv(spark, paths)
    known = "|".join(re.escape(ARTICLE_FILES[s]) for s in sites)
    fname = F.regexp_extract(F.col("_metadata.file_path"), rf"/((?:{known})[^/]*)(?:/[^/]*)?$", 1)
    site = F.lit(None).cast("string")
    for s in sites:
        site = F.when(fname.startswith(ARTICLE_FILES[s]), F.lit(s)).otherwise(site)
    df = typed(raw, SCHEMAS["articles"], blank_text).withColumn("site", site)
    # the per-site "_all" file repeats the yearly files; read the yearly ones only
    return df.where(~fname.contains("_all"))
