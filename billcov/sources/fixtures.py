"""Bill-shaped views over the driver's generated tables.

The reference reads yearly bill/history/sponsor CSVs and per-site article CSVs.  The test data
ships TPC-H-like parquet tables instead, so each view below maps driver columns onto the
reference's table shape.  Every view exists twice: as a Spark DataFrame (used by the library and
the registered queries) and as SQL text (used as a CTE by the DuckDB oracle).  Both produce the
same rows; ``tests/test_fixtures.py`` checks that.

Text-heavy projections are applied *before* joins so that whole document texts are never
shuffled when only a few words of them are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.session import table_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _bill_number(key: Column) -> Column:
    prefix = F.when(key % 3 == 0, F.lit("SB")).otherwise(F.lit("HB"))
    return F.concat(prefix, (F.lit(1000) + key).cast("string"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, bill_number, year, last_action_date, last_action, title."""
    docs = _read(spark, sf_dir, "documents")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    # only the first three words of each document travel through the join, and only they are read of a text
    word, end = r"([^ .,\n]*)", r"[ .,\n]"
    first = rf"^{word}(?:{end}{word})?(?:{end}{word})?"
    words = docs.select("doc_id", *[F.regexp_extract("text", first, k).alias(f"w{k}") for k in (1, 2, 3)])
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", (F.col("o_orderkey") % n_docs).alias("doc_id")
    )
    key = F.col("o_orderkey")
    title = F.concat(
        F.col("w1"), F.lit("; "), F.col("w2"), F.lit(";"), F.col("w3"),
        F.when(key % 5 == 0, F.lit("; R&D 2020")).otherwise(F.lit("")),
    )
    last_action = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Chapter "), key.cast("string")))
        .when(F.col("o_orderstatus") == "O", F.lit("Held in committee"))
    )
    return orders.join(words, "doc_id").select(
        key.alias("bill_id"),
        _bill_number(key).alias("bill_number"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.col("o_orderdate").cast("date").alias("last_action_date"),
        last_action.alias("last_action"),
        title.alias("title"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, sequence, date, k1, k2, action.  Order key: (sequence, date, k1, k2)."""
    li = _read(spark, sf_dir, "lineitem")
    committee = (
        F.when(F.col("l_suppkey") % 4 == 0, "RULES")
        .when(F.col("l_suppkey") % 4 == 1, "JUDICIARY")
        .when(F.col("l_suppkey") % 4 == 2, "FINANCE")
        .otherwise("EDUCATION")
    )
    chamber = F.when(F.col("l_linestatus") == "O", F.lit("Senate ")).otherwise(F.lit("House "))
    action = (
        F.when(F.col("l_returnflag") == "A", F.lit("Introduced and first read"))
        .when(F.col("l_partkey") % 10 == 0, F.lit("Assigned to JOINT Committee"))
        .otherwise(F.concat(F.lit("Assigned to "), chamber, committee, F.lit(" Committee")))
    )
    return li.select(
        F.col("l_orderkey").alias("bill_id"),
        F.col("l_linenumber").alias("sequence"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_partkey").alias("k1"),
        F.col("l_suppkey").alias("k2"),
        action.alias("action"),
    )


HISTORY_ORDER = ("sequence", "date", "k1", "k2")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """people_id, party (null for some people)."""
    s = _read(spark, sf_dir, "supplier")
    party = (
        F.when(F.col("s_suppkey") % 17 == 5, F.lit(None).cast("string"))
        .when(F.col("s_nationkey") % 2 == 0, F.lit("R"))
        .otherwise(F.lit("D"))
    )
    return s.select(F.col("s_suppkey").alias("people_id"), party.alias("party"))


def sponsors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, people_id (distinct pairs)."""
    li = _read(spark, sf_dir, "lineitem")
    return (
        li.where(F.col("l_linestatus") == "O")
        .select(F.col("l_orderkey").alias("bill_id"), F.col("l_suppkey").alias("people_id"))
        .distinct()
    )


def bill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, document_id, url – many documents per bill."""
    li = _read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("bill_id"), F.col("l_partkey").alias("document_id")).agg(
        F.max(F.concat(F.lit("http://leg.test/"), F.col("l_partkey").cast("string"))).alias("url")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, Author, Title, Text, URL, Bill, Year (INT), published (DATE)."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    copies = docs.select("doc_id", "text", F.lit(0).alias("copy")).unionByName(
        docs.where(F.col("doc_id") % 5 == 0).select("doc_id", "text", F.lit(1).alias("copy"))
    )
    # only remainders can meet; so few orders that texts need no shuffle
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").where(F.col("o_orderkey").between(-39, 39))
    orders = sized_broadcast(orders)
    d = F.col("doc_id")
    site = F.concat(F.lit("site_"), (d % 4).cast("string"))
    author = (
        F.when(d % 13 == 0, F.lit("N/A"))
        .when(d % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("author "), (d % 7).cast("string")))
    )
    title = F.when(d % 13 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("title "), d.cast("string")))
    text = F.when(d % 13 == 0, F.lit("N/A")).when(d % 29 == 0, F.lit("")).otherwise(F.col("text"))
    path = (
        F.when(d % 9 == 0, "videos/").when(d % 9 == 1, "x-podcast/").when(d % 9 == 2, "campaign/")
        .when(d % 9 == 3, "picture-gallery/").otherwise("news/")
    )
    url = F.concat(
        F.lit("https://site_"), (d % 4).cast("string"), F.lit(".test/"), path,
        d.cast("string"), F.lit("/"), F.col("copy").cast("string"),
    )
    bill = F.concat(
        F.when((d % 40) % 3 == 0, F.lit("SB")).otherwise(F.lit("HB")), (F.lit(1000) + d % 40).cast("string")
    )
    return copies.join(orders, F.col("o_orderkey") == d % 40).select(
        site.alias("site"),
        author.alias("Author"),
        title.alias("Title"),
        text.alias("Text"),
        url.alias("URL"),
        bill.alias("Bill"),
        F.year("o_orderdate").cast("int").alias("Year"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((d * 37) % 2300).cast("int")).alias("published"),
    )


def bill_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_number, year, Topic1..Topic3 – fixed weights with ties."""
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        _bill_number(k).alias("bill_number"),
        F.year("o_orderdate").cast("string").alias("year"),
        ((k * 37) % 5).cast("double").__truediv__(10).alias("Topic1"),
        ((k * 41) % 7).cast("double").__truediv__(10).alias("Topic2"),
        ((k * 43) % 6).cast("double").__truediv__(10).alias("Topic3"),
    )


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, lemma – a stand-in dictionary: the first words of every third document, with English-like stems."""
    docs = _read(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 0).select(F.lower("text").alias("text"))
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}]+"), F.lit(0)), 1, 40)
    form = F.col("form")
    cut = lambda n, add="": F.concat(F.substring(form, F.lit(1), F.char_length(form) - n), F.lit(add))
    lemma = (
        F.when(form.endswith("ing") & (F.char_length(form) > 5), cut(3))
        .when(form.endswith("tion") & (F.char_length(form) > 6), cut(3, "e"))
        .when(form.endswith("ies") & (F.char_length(form) > 4), cut(3, "y"))
        .when(form.endswith("s") & ~form.endswith("ss") & (F.char_length(form) > 3), cut(1))
        .otherwise(form)
    )
    return docs.select(F.explode(words).alias("form")).distinct().select("form", lemma.alias("lemma"))


def bill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_number, year, text – the whole document each bill's title was drawn from."""
    return bill_text_keys(spark, sf_dir).join(document_texts(spark, sf_dir), "doc_id").select("bill_number", "year", "text")


def bill_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_number, year, doc_id – the document that has each bill's text."""
    docs = _read(spark, sf_dir, "documents")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    return bills(spark, sf_dir).select("bill_number", "year", (F.col("bill_id") % n_docs).alias("doc_id"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


# --------------------------------------------------------------------------------------------
# The same views as SQL (DuckDB dialect, also valid Spark SQL) for the oracle side.
# --------------------------------------------------------------------------------------------

VIEW_SQL: dict[str, str] = {
    "bills": """SELECT o.o_orderkey AS bill_id,
  concat(CASE WHEN o.o_orderkey % 3 = 0 THEN 'SB' ELSE 'HB' END, CAST(1000 + o.o_orderkey AS STRING)) AS bill_number,
  CAST(year(o.o_orderdate) AS STRING) AS year,
  CAST(o.o_orderdate AS DATE) AS last_action_date,
  CASE o.o_orderstatus WHEN 'F' THEN concat('Chapter ', CAST(o.o_orderkey AS STRING)) WHEN 'O' THEN 'Held in committee' END AS last_action,
  concat(split_part(translate(d.text, concat('.,', chr(10)), '   '), ' ', 1), '; ', split_part(translate(d.text, concat('.,', chr(10)), '   '), ' ', 2), ';', split_part(translate(d.text, concat('.,', chr(10)), '   '), ' ', 3), CASE WHEN o.o_orderkey % 5 = 0 THEN '; R&D 2020' ELSE '' END) AS title
FROM orders o CROSS JOIN (SELECT count(*) AS n FROM documents) c JOIN documents d ON d.doc_id = o.o_orderkey % c.n""",
    "history": """SELECT l_orderkey AS bill_id, l_linenumber AS sequence, CAST(l_shipdate AS DATE) AS date, l_partkey AS k1, l_suppkey AS k2,
  CASE WHEN l_returnflag = 'A' THEN 'Introduced and first read'
       WHEN l_partkey % 10 = 0 THEN 'Assigned to JOINT Committee'
       ELSE concat('Assigned to ', CASE WHEN l_linestatus = 'O' THEN 'Senate ' ELSE 'House ' END,
         CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'RULES' WHEN 1 THEN 'JUDICIARY' WHEN 2 THEN 'FINANCE' ELSE 'EDUCATION' END, ' Committee') END AS action
FROM lineitem""",
    "people": """SELECT s_suppkey AS people_id, CASE WHEN s_suppkey % 17 = 5 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'R' ELSE 'D' END AS party FROM supplier""",
    "sponsors": """SELECT DISTINCT l_orderkey AS bill_id, l_suppkey AS people_id FROM lineitem WHERE l_linestatus = 'O'""",
    "bill_documents": """SELECT l_orderkey AS bill_id, l_partkey AS document_id, max(concat('http://leg.test/', CAST(l_partkey AS STRING))) AS url FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "articles": """SELECT concat('site_', CAST(a.doc_id % 4 AS STRING)) AS site,
  CASE WHEN a.doc_id % 13 = 0 THEN 'N/A' WHEN a.doc_id % 11 = 0 THEN NULL ELSE concat('author ', CAST(a.doc_id % 7 AS STRING)) END AS Author,
  CASE WHEN a.doc_id % 13 = 0 THEN 'N/A' ELSE concat('title ', CAST(a.doc_id AS STRING)) END AS Title,
  CASE WHEN a.doc_id % 13 = 0 THEN 'N/A' WHEN a.doc_id % 29 = 0 THEN '' ELSE a.text END AS Text,
  concat('https://site_', CAST(a.doc_id % 4 AS STRING), '.test/', CASE CAST(a.doc_id % 9 AS INT) WHEN 0 THEN 'videos/' WHEN 1 THEN 'x-podcast/' WHEN 2 THEN 'campaign/' WHEN 3 THEN 'picture-gallery/' ELSE 'news/' END, CAST(a.doc_id AS STRING), '/', CAST(a.copy AS STRING)) AS URL,
  concat(CASE WHEN (a.doc_id % 40) % 3 = 0 THEN 'SB' ELSE 'HB' END, CAST(1000 + a.doc_id % 40 AS STRING)) AS Bill,
  CAST(year(o.o_orderdate) AS INT) AS Year,
  DATE '1995-01-01' + CAST((a.doc_id * 37) % 2300 AS INT) AS published
FROM (SELECT doc_id, text, 0 AS copy FROM documents UNION ALL SELECT doc_id, text, 1 AS copy FROM documents WHERE doc_id % 5 = 0) a
JOIN orders o ON o.o_orderkey = a.doc_id % 40""",
    "bill_topics": """SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'SB' ELSE 'HB' END, CAST(1000 + o_orderkey AS STRING)) AS bill_number, CAST(year(o_orderdate) AS STRING) AS year,
  CAST((o_orderkey * 37) % 5 AS DOUBLE) / 10 AS Topic1, CAST((o_orderkey * 41) % 7 AS DOUBLE) / 10 AS Topic2, CAST((o_orderkey * 43) % 6 AS DOUBLE) / 10 AS Topic3
FROM orders""",
    "lemmas": """SELECT form, CASE WHEN form LIKE '%ing' AND length(form) > 5 THEN left(form, length(form) - 3) WHEN form LIKE '%tion' AND length(form) > 6 THEN concat(left(form, length(form) - 3), 'e')
  WHEN form LIKE '%ies' AND length(form) > 4 THEN concat(left(form, length(form) - 3), 'y') WHEN form LIKE '%s' AND form NOT LIKE '%ss' AND length(form) > 3 THEN left(form, length(form) - 1) ELSE form END AS lemma
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')[1:40]) AS form FROM documents WHERE doc_id % 3 = 0)""",
    "bill_texts": """SELECT b.bill_number, b.year, d.text FROM bills b CROSS JOIN (SELECT count(*) AS n FROM documents) c
JOIN documents d ON d.doc_id = b.bill_id % c.n""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named fixture views as CTEs (and any CTEs of its own)."""
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in names)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
