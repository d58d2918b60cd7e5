"""HTML → article extraction as a distributed job (E1–E10, bill text E7).

Pages are parsed inside ``mapInPandas`` (Arrow batches, one pass per partition) into raw fields
``title_raw``, ``author_raw``, ``paragraphs`` and ``status``; all string cleanup afterwards uses
native Spark functions.  Site rules are data: ordered fallback selector steps per field.  Only the
standard-library ``html.parser`` is available, so a small tree builder supplies ``find_all`` with
bs4-like attribute matching.  Deviation, documented: an unclosed ``<p>`` is closed by the next
``<p>`` or block element (HTML5 rule) instead of swallowing its successors.

One bad page never fails a task: parse errors become ``status='failed'`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- tiny DOM --------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
P_CLOSERS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr menu nav ol p pre "
    "section table ul".split()
)
RAW_TEXT = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def text(self) -> str:
        out: list[str] = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in RAW_TEXT:
                stack.extend(reversed(n.children))
        return "".join(out)

    def iter(self) -> Iterator[Node]:
        stack = list(reversed([c for c in self.children if isinstance(c, Node)]))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))

    def find_all(self, tag: str, attrs: dict | None = None) -> list[Node]:
        return [n for n in self.iter() if n.tag == tag and _attrs_match(n, attrs or {})]


def _attrs_match(n: Node, want: dict) -> bool:
    for k, v in want.items():
        have = n.attrs.get(k)
        if v is None:
            if have is not None:
                return False
        elif have is None:
            return False
        elif k == "class":
            if have != v and v not in have.split():
                return False
        elif have != v:
            return False
    return True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        if tag in P_CLOSERS:
            n = self.cur
            while n is not self.root and n.tag != "p":
                n = n.parent
            if n is not self.root:  # an open <p>: close it and everything inside it
                self.cur = n.parent
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# ---- rules -----------------------------------------------------------------------------------
# A field rule is an ordered list of steps; the first step whose selector finds anything fires.
# step = (tag, attrs, inner, pick): ``inner`` = (tag, attrs) searched inside the picked container(s),
# ``pick`` = which matched element(s) are used: "first", "last" (each match overwrote the previous
# one in the reference) or "all".

def _step(tag, attrs=None, inner=None, pick="all", retry_empty=False):
    return (tag, attrs or {}, inner, pick, retry_empty)


# The reference's per-site selectors (tag, attributes, fallback order).
SITE_RULES: dict[str, dict] = {
    "azcapitoltimes": {
        "title": [_step("h1")],
        "author": [_step("span", {"class": "post-meta-author"}, ("a", {}), "last")],
        "text": [_step("div", {"class": "post-inner"}, ("p", {"class": None}), "last")],
        "required": ("title", "text"),
    },
    "azcentral": {
        "title": [
            _step("h1", {"itemprop": "headline"}), _step("h1", {"class": "topper__headline"}),
            _step("h1", {"elementtiming": "ar-headline"}), _step("h1", {"class": "display-2"}),
            _step("h1", {"class": "title"}),
        ],
        "author": [
            _step("a", {"rel": "author"}, pick="first"),
            _step("span", {"class": "asset-metabar-author asset-metabar-item"}, pick="first"),
            _step("span", {"class": "topper__byline"}, pick="first"),
            _step("div", {"class": "gnt_ar_by"}, pick="first"),
            _step("div", {"class": "gnt_ar_pb"}, pick="first"),
            _step("a", {"slot": "bylineInfo"}, pick="first"),
        ],
        "text": [
            _step("div", {"role": "main"}, ("p", {}), "last"),
            _step("section", {"class": "in-depth-content"}, ("p", {}), "last"),
            _step("div", {"class": "longform-body clearfix"}, ("p", {}), "last"),
            _step("p", {"class": "gnt_ar_b_p"}),
            _step("p"),
        ],
        "required": ("title",),
    },
    "azdailystar": {
        "title": [_step("h1", {"class": "headline"}, ("span", {}), "first")],
        "author": [_step("span", {"itemprop": "author"}, pick="first")],
        "text": [_step("p")],
        "required": ("title", "author"),
    },
    "phoenixnewtimes": {
        "title": [_step("div", {"class": "the-story"}, ("h1", {"class": None}), "all")],
        "author": [_step("span", {"class": "byline"}, pick="first")],
        "text": [_step("div", {"class": "story-body"}, ("p", {"style": None}), "last")],
        "required": ("title", "author", "text"),
    },
    "cronkitenewsonline": {
        "title": [_step("h1", {"class": "singlehed"})],
        "author": [_step("span", {"class": "author_name"}, ("a", {}), "first"),
                   _step("h6", {"class": "story-info"}, ("a", {}), "first")],
        "text": [_step("p")],
        "required": (),
    },
    "cronkitepbs": {
        "title": [_step("h1", {"class": "single-story-hdr"}), _step("h1", {"id": "main-headline"})],
        "author": [_step("span", {"class": "author_name"}, ("a", {}), "first"),
                   _step("h6", {"class": "story-info"}, ("a", {}), "first")],
        "text": [_step("p")],
        "required": (),
    },
    "foxphoenix": {
        "title": [_step("h1", {"class": "headline"})],
        "author": [_step("div", {"class": "article-body"}, ("a", {}), "last")],
        "text": [_step("div", {"class": "article-body"}, ("p", {"class": None}), "last", retry_empty=True), _step("p")],
        "required": ("title", "text!"),
    },
    # bill text pages: last WordSection2, else last Section2 (E7)
    "bill_text": {
        "title": [],
        "author": [],
        "text": [_step("div", {"class": "WordSection2"}, ("p", {}), "last"),
                 _step("div", {"class": "Section2"}, ("p", {}), "last")],
        "required": ("text",),
    },
    # generic article pages (driver ``pages`` table): first h1, paragraphs of the last <article>
    "generic": {
        "title": [_step("h1"), _step("title")],
        "author": [_step("a", {"rel": "author"}, pick="first"), _step("span", {"class": "byline"}, pick="first")],
        "text": [_step("article", {}, ("p", {}), "last"), _step("p")],
        "required": (),
    },
}


def _run_field(root: Node, steps) -> tuple[list[str] | None, int]:
    """(texts, index of the step that fired) – (None, -1) when no step's selector matched."""
    for i, (tag, attrs, inner, pick, retry_empty) in enumerate(steps):
        found = root.find_all(tag, attrs)
        if not found:
            continue
        if pick == "first":
            found = found[:1]
        elif pick == "last":
            found = found[-1:]
        if inner is None:
            return [n.text for n in found], i
        out: list[str] = []
        for n in found:
            out.extend(m.text for m in n.find_all(inner[0], inner[1]))
        if out or not retry_empty:
            return out, i
    return None, -1


def extract_one(html: str, rule_key: str) -> tuple[str | None, str | None, int, list[str] | None, str]:
    """(title_raw, author_raw, author_step, paragraphs, status) for one page."""
    rules = SITE_RULES.get(rule_key, SITE_RULES["generic"])
    try:
        root = parse(html)
        title, _ = _run_field(root, rules["title"])
        author, author_step = _run_field(root, rules["author"])
        text, text_step = _run_field(root, rules["text"])
        if text is None and rules["text"] and rules["text"][-1][2] is None:
            text = []  # a final plain find_all that matches nothing is an empty list, not an error
    except Exception:  # noqa: BLE001 - a malformed page becomes a failed row
        return None, None, -1, None, "failed"
    req = rules["required"]
    if (
        ("title" in req and not title)
        or ("author" in req and author is None)
        or ("text" in req and text is None)
        or ("text!" in req and text_step != 0 and not (text_step == 1 and root.find_all(*rules["text"][0][:2])))
    ):
        return None, None, -1, None, "failed"
    return (title[0] if title else None), (author[0] if author else None), author_step, text, "ok"


RAW_FIELDS = [
    T.StructField("title_raw", T.StringType()),
    T.StructField("author_raw", T.StringType()),
    T.StructField("author_step", T.IntegerType()),
    T.StructField("paragraphs", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
]


def _make_extractor(carry: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [extract_one(h, r) for h, r in zip(b["html"], b["rule"])]
            out = {c: b[c].values for c in carry}
            out.update({
                "title_raw": [r[0] for r in rows],
                "author_raw": [r[1] for r in rows],
                "author_step": pd.Series([r[2] for r in rows], dtype="int32"),
                "paragraphs": [r[3] for r in rows],
                "status": [r[4] for r in rows],
            })
            yield pd.DataFrame(out)
    return run


def extract_raw(pages: DataFrame, rule: F.Column | str = "generic", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """carry columns + title_raw, author_raw, author_step, paragraphs, status – the Python step only.

    Only html, the rule key and the (small) carried columns cross into Python, in Arrow batches;
    no join back to the page table is needed afterwards.  Works on streaming DataFrames too.
    """
    rule_col = F.lit(rule) if isinstance(rule, str) else rule
    carry = [c for c in carry if c in pages.columns]
    schema = T.StructType([pages.schema[c] for c in carry] + RAW_FIELDS)
    return pages.select(*carry, "html", rule_col.alias("rule")).mapInPandas(_make_extractor(carry), schema)


# Boilerplate removed by the reference's cleanup steps.
DAILY_STAR_WALL = (
    "To continue viewing content on tucson.com, please sign in with your existing account or subscribe. "
    "We have not been able to find your subscription. Current Subscriber? Log in Current Subscriber? "
    "Activate now Or Don't have a subscription? Subscribe now Subscribe today for unlimited access "
    "Subscribe today for unlimited access"
)
CRONKITE_CUT = "Connect with us on Facebook"
CRONKITE_AUTHOR_PAD = "\r\n                                     "
AP_MARK = "(AP)"
FAILED = "N/A"


def site_rule(url: F.Column, site: F.Column) -> F.Column:
    """Cronkite has two layouts chosen by url; other sites use their own rule."""
    return F.when((site == "cronkitepbs") & url.contains("cronkitenewsonline"), F.lit("cronkitenewsonline")).otherwise(site)


def extract_articles(pages: DataFrame, site_col: str = "site") -> DataFrame:
    """page_id, url, site, Title, Author, Text, status from raw pages ``(page_id, url, site, html[, http_status])``."""
    rule = site_rule(F.col("url"), F.col(site_col))
    raw = extract_raw(pages.withColumnRenamed(site_col, "site"), rule, carry=("page_id", "url", "site", "http_status"))
    return clean_articles(raw)


def clean_articles(raw: DataFrame) -> DataFrame:
    """Native per-site cleanup of the raw fields (split at separators, strip, remove boilerplate,
    paragraph join).  Failed pages keep their row with the ``N/A`` placeholder, as the reference's
    writers did; ``status`` says which rows they are."""
    site = F.col("site")
    paras = F.filter(F.col("paragraphs"), lambda x: x != F.lit(""))
    text = F.array_join(paras, " ")
    text = (
        F.when(site == "azdailystar", F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\t"), F.lit("")), F.lit(DAILY_STAR_WALL), F.lit("")))
        .when(site == "cronkitepbs", F.replace(F.replace(F.split_part(text, F.lit(CRONKITE_CUT), F.lit(1)), F.lit("\n"), F.lit("")), F.lit("\t"), F.lit("")))
        .otherwise(text)
    )
    a = F.col("author_raw")
    author = (
        F.when(site == "azcapitoltimes", F.substring_index(a, ",", 1))
        .when((site == "azcentral") & (F.col("author_step") >= 4), F.substring_index(a, " | ", 1))
        .when(site == "azdailystar", F.substring_index(F.replace(F.trim(a), F.lit("By "), F.lit("")), "\n", 1))
        .when((site == "cronkitepbs") & (F.col("author_step") == 0), F.coalesce(F.trim(a), F.lit(FAILED)))
        .when(site == "cronkitepbs", F.coalesce(F.trim(F.replace(F.replace(F.replace(a, F.lit("By "), F.lit("")), F.lit(CRONKITE_AUTHOR_PAD), F.lit("")), F.lit("/"), F.lit(" "))), F.lit(FAILED)))
        .when((site == "phoenixnewtimes") & (a == ""), F.lit(None).cast("string"))
        .when(site == "foxphoenix", F.coalesce(F.substring_index(a, ",", 1), F.when(text.contains(AP_MARK), F.lit("Associated Press")).otherwise(F.lit("FOX News"))))
        .otherwise(a)
    )
    title = F.col("title_raw")
    title = (
        F.when(site == "azdailystar", F.trim(title))
        .when(site == "cronkitepbs", F.coalesce(title, F.lit(FAILED)))
        .otherwise(title)
    )
    failed = F.col("status") == "failed"
    if "http_status" in raw.columns:
        failed = failed | F.coalesce(F.col("http_status") == 404, F.lit(False))
    ph = F.lit(FAILED)
    keys = [c for c in ("page_id", "url") if c in raw.columns]
    return raw.select(
        *keys, site.alias("site"),
        F.when(failed, ph).otherwise(title).alias("Title"),
        F.when(failed, ph).otherwise(author).alias("Author"),
        F.when(failed, ph).otherwise(text).alias("Text"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
    )


def extract_bill_text(pages: DataFrame) -> DataFrame:
    """page_id, url, Bill_Text, status: last WordSection2 (else Section2) paragraphs joined; pages
    with neither section get null text and ``status='no_section'`` (never the previous bill's text)."""
    j = extract_raw(pages, "bill_text", carry=("page_id", "url"))
    text = F.array_join(F.filter(F.col("paragraphs"), lambda x: x != F.lit("")), " ")
    ok = F.col("status") == "ok"
    return j.select(
        "page_id", "url", F.when(ok, text).alias("Bill_Text"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("no_section")).alias("status"),
    )


def extract_links(pages: DataFrame, prefix: str = "") -> DataFrame:
    """page_id, href: result links of search pages (``article a``, ``span.doc_title a``,
    ``h3.title a``) whose anchor has text; relative links get ``prefix`` (E9, D14)."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("href", T.StringType())])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, hrefs = [], []
            for pid, html in zip(b["page_id"], b["html"]):
                try:
                    root = parse(html)
                except Exception:  # noqa: BLE001
                    continue
                for sel in (("article", {}), ("span", {"class": "doc_title"}), ("h3", {"class": "title"})):
                    for box in root.find_all(*sel):
                        a = next((x for x in box.find_all("a") if "href" in x.attrs), None)
                        if a is not None and a.text:
                            ids.append(int(pid))
                            hrefs.append(a.attrs["href"])
            yield pd.DataFrame({"page_id": pd.Series(ids, dtype="int64"), "href": pd.Series(hrefs, dtype="object")})

    out = pages.select("page_id", "html").mapInPandas(links, schema)
    h = F.col("href")
    return out.select("page_id", F.when(h.startswith("/"), F.concat(F.lit(prefix), h)).otherwise(h).alias("href"))
