"""DuckDB oracle SQL for the registered queries.

Each statement is written independently of the Spark code (windows and joins in plain SQL, the
literal reading of the reference) and runs on the driver's pre-registered parquet views; the
bill-shaped fixture views are prefixed as CTEs.
"""

from __future__ import annotations

from billcov.sources.fixtures import with_views

# Committee chain, literally: count after the Assigned filter, RULES filter, word removal,
# chamber filter, first Senate/House removal, ordered distinct concat, first row's flag.
_COMMITTEE_CTES = r"""
a AS (SELECT *, count(*) OVER (PARTITION BY bill_id) AS cnt,
             CASE WHEN contains(action, 'Senate') THEN 1 ELSE 0 END AS sen
      FROM history WHERE contains(action, 'Assigned')),
b AS (SELECT * FROM a WHERE NOT contains(action, 'RULES') OR cnt = 1),
c AS (SELECT *, regexp_replace(action, '\b(Assigned to | Committee)\b', '', 'g') AS act1 FROM b),
d AS (SELECT * FROM c WHERE (sen = 1 AND contains(act1, 'Senate')) OR (sen = 0 AND contains(act1, 'House'))),
e AS (SELECT bill_id, sen, regexp_replace(regexp_replace(act1, 'Senate', ''), 'House', '') AS act,
             row_number() OVER (PARTITION BY bill_id ORDER BY sequence, date, k1, k2) AS rn
      FROM d),
f AS (SELECT bill_id, act, min(rn) AS first_rn FROM e GROUP BY bill_id, act),
cf AS (SELECT e.bill_id, count(*) AS Committee_Intro_Count, max(CASE WHEN rn = 1 THEN sen END) AS sen_intro,
              (SELECT string_agg(f.act, ',' ORDER BY f.first_rn) FROM f WHERE f.bill_id = e.bill_id) AS Committees_Concat
       FROM e GROUP BY e.bill_id)"""

_SPONSOR_CTES = r"""
pf AS (SELECT people_id, CASE WHEN party = 'R' THEN 1 WHEN party IS NULL THEN NULL ELSE 0 END AS flag FROM people),
sp AS (SELECT s.bill_id, count(*) AS SponsorCount,
              CASE WHEN count(flag) = count(*) THEN round_even(sum(flag) / count(*), 3) END AS RepubSponsorPct
       FROM sponsors s JOIN pf USING (people_id) GROUP BY s.bill_id)"""

_BILL_FEATURES_CTES = _COMMITTEE_CTES + "," + _SPONSOR_CTES + r""",
hs AS (SELECT cf.bill_id, cf.Committee_Intro_Count, cf.Committees_Concat, sp.SponsorCount, sp.RepubSponsorPct
       FROM cf LEFT JOIN sp USING (bill_id)),
bf AS (SELECT b.bill_number, CAST(contains(b.last_action, 'Chapter') AS INT) AS passed, b.bill_id, b.year,
              coalesce(hs.Committee_Intro_Count, 0) AS Committee_Intro_Count,
              coalesce(hs.Committees_Concat, 'RULES') AS Committees_Concat,
              CASE WHEN substr(b.bill_number, 1, 1) = 'S' THEN 1 ELSE 0 END AS sen_intro,
              hs.SponsorCount, hs.RepubSponsorPct
       FROM bills b LEFT JOIN hs USING (bill_id))"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["bill_passed"] = with_views(
        "SELECT bill_id, bill_number, year, CAST(contains(last_action, 'Chapter') AS INT) AS passed FROM bills",
        "bills",
    )
    q["committee_features"] = with_views(
        "WITH" + _COMMITTEE_CTES + "\nSELECT bill_id, Committee_Intro_Count, Committees_Concat, sen_intro FROM cf",
        "history",
    )
    q["sponsor_share"] = with_views(
        "WITH" + _SPONSOR_CTES + "\nSELECT bill_id, SponsorCount, RepubSponsorPct FROM sp",
        "people", "sponsors",
    )
    q["bill_features"] = with_views(
        "WITH" + _BILL_FEATURES_CTES + "\nSELECT * FROM bf",
        "bills", "history", "people", "sponsors",
    )
    return q


_COUNTS_CTES = r"""
na AS (SELECT site, CASE WHEN site = 'site_2' THEN Title ELSE Author END AS Author,
              CASE WHEN site = 'site_2' THEN Author ELSE Title END AS Title, Text, Bill, Year FROM articles),
dd AS (SELECT DISTINCT site, Author, Bill, Text, Title, Year FROM na WHERE site IN ('site_0', 'site_1', 'site_3')
       UNION ALL SELECT site, Author, Bill, Text, Title, Year FROM na WHERE site = 'site_2'),
counts AS (SELECT site, Bill, Year, count(*) AS article_count FROM dd GROUP BY site, Bill, Year),
wide AS (SELECT Bill, Year,
           CAST(coalesce(sum(CASE WHEN site = 'site_0' THEN article_count END), 0) AS BIGINT) AS AZCen_Count,
           CAST(coalesce(sum(CASE WHEN site = 'site_1' THEN article_count END), 0) AS BIGINT) AS AZDS_Count,
           CAST(coalesce(sum(CASE WHEN site = 'site_2' THEN article_count END), 0) AS BIGINT) AS AZCap_Count,
           CAST(coalesce(sum(CASE WHEN site = 'site_3' THEN article_count END), 0) AS BIGINT) AS PNT_Count
         FROM counts GROUP BY Bill, Year)"""

_TOP_TOPIC_CTE = r"""
tt AS (SELECT bill_number, year,
              CASE WHEN Topic1 >= Topic2 AND Topic1 >= Topic3 THEN 'Topic1'
                   WHEN Topic2 >= Topic3 THEN 'Topic2' ELSE 'Topic3' END AS Top_Topic
       FROM bill_topics)"""

# Brute force over all pairs of distinct texts that share a word (no prefix filter) – the exact definition.
_SIM_CTES = r"""
tk AS (SELECT text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS toks FROM (SELECT DISTINCT text FROM bill_texts)),
tk2 AS (SELECT *, len(toks) AS n, sha256(array_to_string(list_sort(toks), ' ')) AS tkey FROM tk),
bt AS (SELECT b.bill_number, b.year, tk2.n, tk2.tkey, tk2.toks FROM bill_texts b LEFT JOIN tk2 ON tk2.text = b.text),
tx AS (SELECT tkey, min(CAST(year AS INT)) AS min_year, any_value(toks) AS toks, any_value(n) AS n FROM bt WHERE n > 0 GROUP BY tkey),
tw AS (SELECT tkey, n, min_year, unnest(toks) AS token FROM tx),
pr AS (SELECT a, min(yb) AS sim_year
       FROM (SELECT x.tkey AS a, y.tkey AS b, x.n AS na, y.n AS nb, y.min_year AS yb, count(*) AS o FROM tw x JOIN tw y ON x.token = y.token AND x.tkey <> y.tkey GROUP BY ALL)
       WHERE o / (na + nb - o) >= 0.8 GROUP BY a),
sim AS (SELECT bt.bill_number, bt.year,
       CASE WHEN coalesce(bt.n, 0) = 0 THEN 0
            WHEN least(tx.min_year, coalesce(pr.sim_year, tx.min_year)) < CAST(bt.year AS INT) THEN 1 ELSE 0 END AS Bill_Sim_Binary
FROM bt LEFT JOIN tx USING (tkey) LEFT JOIN pr ON pr.a = bt.tkey)"""

_MODEL_CTES = _BILL_FEATURES_CTES + "," + _COUNTS_CTES + "," + _TOP_TOPIC_CTE + "," + _SIM_CTES + r""",
mt AS (SELECT bf.bill_number, bf.year, bf.bill_id, bf.passed, bf.Committee_Intro_Count, bf.Committees_Concat,
              bf.sen_intro, bf.SponsorCount, bf.RepubSponsorPct,
              coalesce(w.AZCen_Count, 0) AS AZCen_Count, coalesce(w.AZDS_Count, 0) AS AZDS_Count,
              coalesce(w.AZCap_Count, 0) AS AZCap_Count, coalesce(w.PNT_Count, 0) AS PNT_Count,
              sim.Bill_Sim_Binary, tt.Top_Topic
       FROM bf LEFT JOIN sim ON sim.bill_number = bf.bill_number AND sim.year = bf.year
               LEFT JOIN wide w ON w.Bill = bf.bill_number AND CAST(w.Year AS VARCHAR) = bf.year
               LEFT JOIN tt ON tt.bill_number = bf.bill_number AND tt.year = bf.year),
mf AS (SELECT bill_number, year, bill_id, coalesce(passed, 0) AS passed,
              CAST(length(Committees_Concat) - length(replace(Committees_Concat, ',', '')) + 1 AS BIGINT) AS Committee_Intro_Count,
              Committees_Concat, sen_intro, coalesce(SponsorCount, 0) AS SponsorCount,
              coalesce(RepubSponsorPct, 0) AS RepubSponsorPct, AZCen_Count, AZDS_Count, AZCap_Count, PNT_Count,
              coalesce(Bill_Sim_Binary, 0) AS Bill_Sim_Binary, Top_Topic
       FROM mt)"""

_ALL_VIEWS = ("bills", "history", "people", "sponsors", "articles", "bill_topics", "bill_texts")


def _sql_model() -> dict[str, str]:
    q: dict[str, str] = {}
    q["article_counts"] = with_views("WITH" + _COUNTS_CTES + "\nSELECT * FROM counts", "articles")
    q["article_counts_pivot"] = with_views("WITH" + _COUNTS_CTES + "\nSELECT * FROM wide", "articles")
    q["top_topic"] = with_views("WITH" + _TOP_TOPIC_CTE + "\nSELECT * FROM tt", "bill_topics")
    q["model_table"] = with_views("WITH" + _MODEL_CTES + "\nSELECT * FROM mt", *_ALL_VIEWS)
    q["model_frame"] = with_views("WITH" + _MODEL_CTES + "\nSELECT * FROM mf", *_ALL_VIEWS)
    q["article_bins"] = with_views("WITH" + _MODEL_CTES + r""",
lg AS (SELECT 'PHX New Times' AS news_site, PNT_Count AS c FROM mf UNION ALL
       SELECT 'AZ Republic', AZCen_Count FROM mf UNION ALL
       SELECT 'AZ Capitol Times', AZCap_Count FROM mf UNION ALL
       SELECT 'AZ Daily Star', AZDS_Count FROM mf)
SELECT CASE WHEN c < 25 THEN '0-24' WHEN c < 50 THEN '25-49' WHEN c < 75 THEN '50-74' WHEN c < 100 THEN '75-99' ELSE '100+' END AS article_count_group,
       CASE WHEN c < 25 THEN 1 WHEN c < 50 THEN 2 WHEN c < 75 THEN 3 WHEN c < 100 THEN 4 ELSE 5 END AS bin_order,
       news_site, count(*) AS bills
FROM lg GROUP BY ALL""", *_ALL_VIEWS)
    feats = ["Bill_Sim_Binary", "RepubSponsorPct", "SponsorCount", "sen_intro", "Committee_Intro_Count",
             "PNT_Count", "AZCap_Count", "AZCen_Count", "AZDS_Count"]
    union = "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, min(CAST({f} AS DOUBLE)) AS min_value, max(CAST({f} AS DOUBLE)) AS max_value, "
        f"round_even(avg(CAST({f} AS DOUBLE)), 6) AS mean_value FROM mf" for f in feats)
    q["feature_ranges"] = with_views("WITH" + _MODEL_CTES + "\n" + union, *_ALL_VIEWS)
    q["url_blocklist"] = with_views(r"""
SELECT site, URL, Bill, Year,
  CASE WHEN pre THEN 'N/a' ELSE Author END AS Author, CASE WHEN pre THEN 'N/a' ELSE Title END AS Title,
  CASE WHEN pre THEN 'skipped' ELSE 'ok' END AS status
FROM (SELECT *, (contains(URL, 'podcast') OR contains(URL, 'amp') OR contains(URL, '/picture-gallery/')
                 OR contains(URL, '/videos/') OR contains(URL, '/interactives/') OR contains(URL, '/restricted/')) AS pre
      FROM articles) a
WHERE NOT (contains(URL, '-podcast/') OR contains(URL, '/videos/') OR contains(URL, 'amp')
           OR contains(URL, '/picture_gallery/') OR contains(URL, '/interactives/') OR contains(URL, '/restricted/'))""",
        "articles")
    q["clean_articles"] = with_views(r"""
SELECT site, URL, Bill, Year FROM articles
WHERE (Author IS NULL OR Author <> 'N/A') AND length(Text) > 0
  AND NOT coalesce(contains(Text, 'Enter your user name and password in the fields above to gain access to the subscriber content on this site.'), false)""",
        "articles")
    return q


ORACLE_SQL = _sql()
ORACLE_SQL.update(_sql_model())


# ---- matching ---------------------------------------------------------------------------------

def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_matching() -> dict[str, str]:
    from billcov.operators.matching import STOP_WORDS, SEARCH_PAGES

    stop = _sql_list(STOP_WORDS)
    split = r"'[^\p{L}\p{N}]+'"
    ctes = rf"""
h1 AS (SELECT bill_id, date AS intro_date,
              row_number() OVER (PARTITION BY bill_id ORDER BY sequence, date, k1, k2) AS rn FROM history),
w AS (SELECT b.bill_id, b.bill_number, b.year, b.title, h1.intro_date,
             CAST(h1.intro_date - INTERVAL 6 MONTH AS DATE) AS date_lower
      FROM bills b JOIN h1 ON h1.bill_id = b.bill_id AND h1.rn = 1),
kw AS (SELECT bill_id, array_to_string(list_filter(string_split(title, ';'), lambda x: NOT contains(x, '&')), ' ') AS terms FROM w),
qt AS (SELECT DISTINCT bill_id, t AS token
       FROM (SELECT bill_id, unnest(regexp_split_to_array(lower(terms), {split})) AS t FROM kw)
       WHERE t <> '' AND t NOT IN ({stop})),
nq AS (SELECT bill_id, count(*) AS n_q FROM qt GROUP BY bill_id),
atok AS (SELECT DISTINCT URL, site, published, t AS token
       FROM (SELECT URL, site, published, unnest(regexp_split_to_array(lower(concat_ws(' ', Title, Text)), {split})) AS t
             FROM articles WHERE contains(URL, site) AND published IS NOT NULL)
       WHERE t IN (SELECT token FROM qt)),
pairs AS (SELECT w.bill_id, w.bill_number, w.year, atok.site, atok.URL, atok.published, count(*) AS m
          FROM qt JOIN atok USING (token) JOIN w ON w.bill_id = qt.bill_id
          WHERE atok.published BETWEEN w.date_lower AND w.intro_date
          GROUP BY ALL),
scored AS MATERIALIZED (
  SELECT p.*, p.m = nq.n_q AS is_and, bool_or(p.m = nq.n_q) OVER (PARTITION BY p.bill_id, p.site) AS any_and
  FROM pairs p JOIN nq USING (bill_id)),
and_hits AS (SELECT bill_id, bill_number, year, site, URL, published, m AS matched FROM scored WHERE is_and),
fb AS (SELECT bill_id, bill_number, year, site, URL, published, m AS matched,
              CASE WHEN is_and THEN 'and' ELSE 'or' END AS mode
       FROM scored WHERE is_and OR NOT any_and)"""
    views = ("bills", "history", "articles")
    q: dict[str, str] = {}
    q["intro_window"] = with_views(r"""WITH
h1 AS (SELECT bill_id, date AS intro_date,
              row_number() OVER (PARTITION BY bill_id ORDER BY sequence, date, k1, k2) AS rn FROM history)
SELECT b.bill_id, b.bill_number, b.year, h1.intro_date, CAST(h1.intro_date - INTERVAL 6 MONTH AS DATE) AS date_lower,
       strftime(h1.intro_date, '%m/%d/%Y') AS date_upper_text,
       strftime(CAST(h1.intro_date - INTERVAL 6 MONTH AS DATE), '%m/%d/%Y') AS date_lower_text
FROM bills b JOIN h1 ON h1.bill_id = b.bill_id AND h1.rn = 1""", "bills", "history")
    q["match_and"] = with_views("WITH" + ctes + "\nSELECT * FROM and_hits", *views)
    q["match_or_fallback"] = with_views("WITH" + ctes + "\nSELECT * FROM fb", *views)
    cap = (SEARCH_PAGES + 1) * 10
    q["match_capped"] = with_views("WITH" + ctes + f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id, site ORDER BY matched DESC, published DESC, URL) AS rank FROM fb)
WHERE rank <= {cap}""", *views)
    q["collected_articles"] = with_views("WITH" + ctes + f""",
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_id, site ORDER BY matched DESC, published DESC, URL) AS rank FROM fb)
           WHERE rank <= {cap})
SELECT DISTINCT c.site, a.Author, a.Title, sha256(a.Text) AS text_sha256, c.URL, c.bill_number AS Bill, CAST(c.year AS INT) AS Year
FROM capped c JOIN articles a ON a.URL = c.URL""", *views)
    return q


ORACLE_SQL.update(_sql_matching())


def _sql_manifest() -> dict[str, str]:
    news = [("azcentral", "azcentral"), ("azdailystar", "tucson.com"), ("phoenixnewtimes", "phoenixnewtimes"),
            ("cronkitepbs", "cronkite")]
    parts = []
    for site, src in news:
        head = (f"' %20source%3A{src}%20before%3A' || strftime(intro_date, '%Y-%m-%d') || '%20after%3A' || "
                f"strftime(date_lower, '%Y-%m-%d') || '&hl=en-US&gl=US&ceid=US%3Aen'")
        parts.append(f"SELECT bill_id, '{site}' AS site, 0 AS page, 'and' AS mode, "
                     f"'https://news.google.com/search?q=' || replace(kw, ' ', '%20') || {head} AS request FROM t")
        parts.append(f"SELECT bill_id, '{site}' AS site, 0 AS page, 'or' AS mode, "
                     f"'https://news.google.com/search?q=' || replace(replace(kw, '  ', ' '), ' ', '%20OR%20') || {head} AS request FROM t")
    for p in range(6):
        parts.append(
            f"SELECT bill_id, 'azcapitoltimes' AS site, {p} AS page, 'and' AS mode, "
            f"'https://azcapitoltimes.com/?s=' || replace(raw, ' ', '+') || '&search_category=&date_start=' || "
            f"strftime(date_lower, '%m') || '%2F' || strftime(date_lower, '%d') || '%2F' || strftime(date_lower, '%Y') || "
            f"'&date_end=' || strftime(intro_date, '%m') || '%2F' || strftime(intro_date, '%d') || '%2F' || strftime(intro_date, '%Y') || "
            f"'&sort=rel&page={p}' AS request FROM t")
        parts.append(
            f"SELECT bill_id, 'foxphoenix' AS site, {p} AS page, 'and' AS mode, "
            f"'https://www.fox10phoenix.com/search?q=' || replace(raw, ' ', '%20') || '&sort=relevance&page={p}&from=' || "
            f"strftime(date_lower, '%Y-%m-%d') || '&to=' || strftime(intro_date, '%Y-%m-%d') AS request FROM t")
    body = r"""WITH
h1 AS (SELECT bill_id, date AS intro_date,
              row_number() OVER (PARTITION BY bill_id ORDER BY sequence, date, k1, k2) AS rn FROM history),
t AS (SELECT b.bill_id, h1.intro_date, CAST(h1.intro_date - INTERVAL 6 MONTH AS DATE) AS date_lower,
             array_to_string(string_split(b.title, ';'), ' ') AS raw,
             array_to_string(list_filter(string_split(b.title, ';'), lambda x: NOT contains(x, '&')), ' ') AS kw
      FROM bills b JOIN h1 ON h1.bill_id = b.bill_id AND h1.rn = 1)
""" + "\nUNION ALL\n".join(parts)
    return {"search_manifest": with_views(body, "bills", "history")}


ORACLE_SQL.update(_sql_manifest())

ORACLE_SQL["latest_document"] = with_views(r"""
SELECT bill_id, bill_number, year, document_id, url FROM (
  SELECT b.bill_id, b.bill_number, b.year, d.document_id, d.url,
         row_number() OVER (PARTITION BY b.bill_id ORDER BY b.last_action_date DESC, d.document_id DESC) AS rn
  FROM bills b JOIN bill_documents d USING (bill_id)) WHERE rn = 1""", "bills", "bill_documents")


def _sql_text() -> dict[str, str]:
    from billcov.operators.matching import STOP_WORDS
    from billcov.operators.topics import PUNCTUATION

    stop = "[" + _sql_list(STOP_WORDS) + "]"
    punct = "'" + PUNCTUATION.replace("'", "''") + "'"
    tt = rf"""WITH
s1 AS (SELECT bill_number, year,
              list_filter(string_split(replace(lower(title), '; ', ' '), ' '), lambda x: NOT list_contains({stop}, x)) AS toks
       FROM bills),
s2 AS (SELECT bill_number, year,
              list_filter(regexp_split_to_array(trim(regexp_replace(array_to_string(toks, ' '), '([\p{{P}}\p{{S}}])', ' \1 ', 'g')), '\s+'),
                          lambda x: x <> '') AS toks FROM s1),
s3 AS (SELECT bill_number, year,
              list_filter(toks, lambda x: NOT regexp_matches(x, '^\p{{Nd}}') AND instr({punct}, x) = 0) AS toks FROM s2),
tt AS (SELECT bill_number, year, array_to_string(toks, ' ') AS title_clean, CAST(len(toks) AS INT) AS n_tokens FROM s3)"""
    return {
        "title_tokens": with_views(tt + "\nSELECT * FROM tt", "bills"),
        "token_counts": with_views(tt + r"""
SELECT bill_number, year, term, count(*) AS n
FROM (SELECT bill_number, year, unnest(regexp_extract_all(lower(title_clean), '[\p{L}\p{N}_]{2,}')) AS term FROM tt)
GROUP BY ALL""", "bills"),
        "term_matrix": with_views(tt + r"""
, c AS (
SELECT bill_number, year, term, count(*) AS n
FROM (SELECT bill_number, year, unnest(regexp_extract_all(lower(title_clean), '[\p{L}\p{N}_]{2,}')) AS term FROM tt)
GROUP BY ALL)
SELECT bill_number, year, dense_rank() OVER (ORDER BY term) - 1 AS term_id, n FROM c""", "bills"),
        "lemmatised_titles": with_views(tt + r"""
, x AS (SELECT bill_number, year, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM s3),
p AS (SELECT form, min(lemma) AS lemma FROM lemmas GROUP BY form),
q AS (SELECT form, lemma, list_max(list_filter(range(0, least(length(form), length(lemma)) + 1), lambda k: left(form, k) = left(lemma, k))) AS same FROM p),
e AS (SELECT length(form) - same AS strip, substr(lemma, same + 1) AS ending, right(form, k) AS suffix FROM q, range(1, 6) r(k)
      WHERE k BETWEEN greatest(length(form) - same, 1) AND length(form)),
v AS (SELECT suffix, strip, ending, count(*) AS votes FROM e GROUP BY ALL),
rules AS (SELECT suffix, strip, ending FROM v
          QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, strip, ending) = 1 AND sum(votes) OVER (PARTITION BY suffix) >= 3),
u AS (SELECT DISTINCT x.term, p.lemma FROM x LEFT JOIN p ON p.form = x.term),
h AS (SELECT u.term, strip, ending FROM u JOIN rules ON suffix = right(u.term, length(suffix)) AND length(suffix) <= length(u.term)
      WHERE strip < length(u.term) AND u.lemma IS NULL QUALIFY row_number() OVER (PARTITION BY u.term ORDER BY length(suffix) DESC) = 1),
l AS (SELECT u.term, coalesce(u.lemma, left(u.term, length(u.term) - strip) || ending, u.term) AS lemma FROM u LEFT JOIN h ON h.term = u.term)
SELECT s3.bill_number, s3.year, coalesce(string_agg(l.lemma, ' ' ORDER BY x.pos), '') AS title_lemmas
FROM s3 LEFT JOIN x ON x.bill_number = s3.bill_number AND x.year = s3.year LEFT JOIN l ON l.term = x.term GROUP BY s3.bill_number, s3.year""", "bills", "lemmas"),
    }


ORACLE_SQL.update(_sql_text())


ORACLE_SQL["similar_bills"] = with_views("WITH" + _SIM_CTES + "\nSELECT * FROM sim", "bills", "bill_texts")


# ---- pages in the sites' layouts, session folders ----------------------------------------------

_LINES = "array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), ' ')"

ORACLE_SQL["site_articles"] = f"""
WITH d AS (
  SELECT doc_id, ['azcapitoltimes', 'azcentral', 'azdailystar', 'phoenixnewtimes', 'cronkitepbs', 'foxphoenix'][doc_id % 6 + 1] AS site, {_LINES} AS body FROM documents
), e AS (SELECT *, doc_id % 10 = 9 AND site <> 'cronkitepbs' AS failed FROM d)
SELECT doc_id AS page_id, 'https://' || site || '.test/' || doc_id AS url, site,
  CASE WHEN doc_id % 10 = 9 THEN 'N/A' ELSE 'Title ' || doc_id END AS "Title", CASE WHEN failed THEN 'N/A' ELSE 'Writer ' || doc_id % 7 END AS "Author",
  sha256(CASE WHEN failed THEN 'N/A' WHEN site = 'azdailystar' THEN replace(body, chr(9), '')
    WHEN site = 'cronkitepbs' THEN replace(body || CASE WHEN body = '' THEN '' ELSE ' ' END, chr(9), '') ELSE body END) AS text_sha256,
  CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status
FROM e
"""

ORACLE_SQL["bill_sections"] = f"""
SELECT doc_id AS page_id, CASE WHEN doc_id % 3 < 2 THEN sha256(body) END AS text_sha256, CASE WHEN doc_id % 3 < 2 THEN length(body)::INTEGER END AS n_chars,
  CASE WHEN doc_id % 3 < 2 THEN 'ok' ELSE 'no_section' END AS status
FROM (SELECT doc_id, {_LINES} AS body FROM documents)
"""

ORACLE_SQL["result_links"] = """
SELECT doc_id AS page_id, unnest(['https://site.test/news/' || doc_id, 'http://a.test/' || doc_id, 'https://site.test/story/' || doc_id]) AS href FROM documents
"""

ORACLE_SQL["session_bills"] = with_views(
    "SELECT bill_id, bill_number, title, last_action, last_action_date, year FROM bills WHERE year IN ('1993', '1995', '1997')", "bills"
)

ORACLE_SQL["collection_progress"] = with_views("""
SELECT a.site, CAST(a.Year AS VARCHAR) AS year, count(DISTINCT a.Bill) AS bills_done, any_value(t.total) AS bills_total, count(DISTINCT a.Bill) >= any_value(t.total) AS complete
FROM articles a JOIN (SELECT Year, count(DISTINCT Bill) AS total FROM articles GROUP BY Year) t ON t.Year = a.Year GROUP BY a.site, a.Year""", "articles")


# ---- files written and read back ---------------------------------------------------------------

ORACLE_SQL["session_tables"] = with_views("""
SELECT 'bills' AS table_name, year, count(*) AS n_rows, sum(bill_id)::BIGINT AS id_sum FROM bills GROUP BY year
UNION ALL SELECT 'history', year, count(*), sum(sequence)::BIGINT FROM history JOIN bills USING (bill_id) GROUP BY year
UNION ALL SELECT 'documents', year, count(*), sum(document_id)::BIGINT FROM bill_documents JOIN bills USING (bill_id) GROUP BY year
UNION ALL SELECT 'people', CAST(1993 + people_id % 3 AS VARCHAR) AS y, count(*), sum(people_id)::BIGINT FROM people GROUP BY y
UNION ALL SELECT 'sponsors', year, count(*), sum(people_id)::BIGINT FROM sponsors JOIN bills USING (bill_id) GROUP BY year""",
    "bills", "history", "bill_documents", "people", "sponsors")
ORACLE_SQL["article_files"] = with_views("""
SELECT CASE site WHEN 'site_0' THEN 'azcentral' WHEN 'site_1' THEN 'azdailystar' WHEN 'site_2' THEN 'azcapitoltimes' ELSE 'phoenixnewtimes' END AS site,
  Author, Title, sha256(nullif(Text, '')) AS text_sha256, URL, Bill, Year FROM articles""", "articles")
ORACLE_SQL["model_store"] = with_views("WITH" + _MODEL_CTES + "\nSELECT * REPLACE (CAST(0 AS INT) AS Bill_Sim_Binary) FROM mf", *_ALL_VIEWS)
ORACLE_SQL["bill_text_store"] = ORACLE_SQL["bill_sections"]
ORACLE_SQL["other_url_rules"] = with_views("""
SELECT site, URL, Bill, Year, CASE WHEN hit THEN 'N/a' ELSE Author END AS Author, CASE WHEN hit THEN 'N/a' ELSE Title END AS Title, CASE WHEN hit THEN 'skipped' ELSE 'ok' END AS status
FROM (SELECT *, contains(URL, 'best-of') OR contains(URL, 'slideshow') AS hit
  FROM (SELECT * REPLACE (replace(replace(replace(URL, 'picture-gallery', 'slideshow'), 'videos/', 'video/'), 'x-podcast/', 'x.pdf/') AS URL) FROM articles))
WHERE NOT contains(URL, '.pdf') AND NOT contains(URL, '/video/')""", "articles")
