"""Stand-in page tables in the sites' layouts, made from the driver's ``documents``.

Each page's paragraphs are the lines of a document, in the markup of one site; what extraction must
give back is known from the document.  The rows only have the schema that the extraction jobs expect:
(page_id, url, site, html).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billcov.session import table_path

#: Site of a document, by its identifier.
SITES = ("azcapitoltimes", "azcentral", "azdailystar", "phoenixnewtimes", "cronkitepbs", "foxphoenix")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def paragraphs(text: Column) -> Column:
    """Every line as a paragraph."""
    return F.concat(F.lit("<p>"), F.replace(escaped(text), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article pages of six sites; every tenth lacks its headline."""
    d = F.col("doc_id")
    title, name = F.concat(F.lit("Title "), d.cast("string")), F.concat(F.lit("Writer "), (d % 7).cast("string"))
    whole = d % 10 != 9
    body = paragraphs(F.col("text"))

    def page(head: tuple[str, str], byline: tuple[str, str], box: tuple[str, str]) -> Column:
        line = F.when(whole, F.concat(F.lit(head[0]), title, F.lit(head[1]))).otherwise(F.lit(""))
        return F.concat(F.lit("<html><body>"), line, F.lit(byline[0]), name, F.lit(byline[1]), F.lit(box[0]), body, F.lit(box[1]), F.lit("</body></html>"))

    layouts = {
        "azcapitoltimes": page(("<h1>", "</h1>"), ('<span class="post-meta-author"><a>', ", Reporter</a></span>"), ('<div class="post-inner"><p class="ad">Ad</p>', "</div>")),
        "azcentral": page(('<h1 class="title">', "</h1>"), ('<div class="gnt_ar_pb">', " | Arizona Republic</div>"), ('<div role="main"><p>teaser</p></div><div role="main">', "</div>")),
        "azdailystar": page(('<h1 class="headline"><span> ', " </span></h1>"), ('<span itemprop="author">By ', "\nStaff</span>"), ("", "")),
        "phoenixnewtimes": page(('<div class="the-story"><h1 class="kicker">K</h1><h1>', "</h1></div>"), ('<span class="byline">', "</span>"), ('<div class="story-body"><p style="s">styled</p>', "</div>")),
        "cronkitepbs": page(('<h1 id="main-headline">', "</h1>"), ('<h6 class="story-info"><a>By ', "</a></h6>"), ("", "<p>Connect with us on Facebook and more</p>")),
        "foxphoenix": page(('<h1 class="headline">', "</h1>"), ('<div class="article-body"><a>', ", FOX</a>"), ('<p class="share">share</p>', "</div>")),
    }
    site = F.element_at(F.array(*[F.lit(s) for s in SITES]), (d % len(SITES) + 1).cast("int"))
    html = F.lit(None).cast("string")
    for i, s in enumerate(SITES):
        html = F.when(d % len(SITES) == i, layouts[s]).otherwise(html)
    return _documents(spark, sf_dir).select(d.alias("page_id"), F.concat(F.lit("https://"), site, F.lit(".test/"), d.cast("string")).alias("url"), site.alias("site"), html.alias("html"))


def bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill pages: two new-style sections (the last one counts), an old-style section, or none."""
    d, body = F.col("doc_id"), paragraphs(F.col("text"))
    html = (
        F.when(d % 3 == 0, F.concat(F.lit('<div class="WordSection1"><p>cover</p></div><div class="WordSection2"><p>old</p></div><div class="WordSection2">'), body, F.lit("</div>")))
        .when(d % 3 == 1, F.concat(F.lit('<div class="Section1"><p>cover</p></div><div class="Section2">'), body, F.lit("</div>")))
        .otherwise(F.concat(F.lit("<div>"), body, F.lit("</div>")))
    )
    return _documents(spark, sf_dir).select(d.alias("page_id"), F.concat(F.lit("https://leg.test/"), d.cast("string")).alias("url"), html.alias("html"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search result pages in the three layouts; an anchor without text is no result."""
    d = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<article><a href="/news/'), d, F.lit('">One</a><a href="/other">Two</a></article><article><a href="/empty"></a></article><span class="doc_title"><a href="http://a.test/'), d,
        F.lit('">Three</a></span><h3 class="title"><a href="/story/'), d, F.lit('">Four</a></h3><h3><a href="/none">Five</a></h3>'),
    )
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), html.alias("html"))
