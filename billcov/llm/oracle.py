"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from billcov.llm import quality_rules as Q
from billcov.llm import secret_scan as S
from billcov.llm import source_mixing as M

WORD = r"[^\x20\x09-\x0D]+"

def _linked(k: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of ``k``-word shingles overlap by ``percent`` of their union."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= {percent} * (na.n + nb.n - o)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id{more} FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


OP1 = _linked(4, 85)
OP12 = _linked(2, 80, ", w.doc_id = c.component_id AS kept")


def _found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind with code point offsets: pieces and matches of a text alternate."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, stop - length(whole) AS start, stop, stop - length(val) AS vstart, val FROM (
    SELECT doc_id, source, whole, val, sum(length(piece) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM (
      SELECT doc_id, source, unnest(range(1, len(whole) + 1)) AS i, unnest(whole) AS whole, unnest(val) AS val, unnest(piece[1:len(whole)]) AS piece FROM (
        SELECT doc_id, source, regexp_extract_all(t, '{p}') AS whole, regexp_extract_all(t, '{p}', {group}) AS val, string_split_regex(t, '{p}') AS piece
        FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)))
  ) WHERE length(val) >= {least}"""


OP2 = f"""
WITH c AS ({" UNION ALL ".join(_found(k, r, p, g, least) for r, (k, p, g, least) in enumerate(S.KINDS))}),
o AS (
  SELECT val, owners, repositories, owners > {S.MAX_OWNERS} OR repositories > {S.MAX_REPOSITORIES} AS example
  FROM (SELECT val, count(DISTINCT coalesce(source, '')) AS owners, count(*) AS repositories FROM (SELECT DISTINCT val, source, doc_id FROM c) GROUP BY val)
), j AS (
  SELECT c.*, owners, repositories, example, NOT example AND (val LIKE '-----BEGIN%' OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
    AND len(list_distinct(string_split(val, ''))) >= {S.MIN_DISTINCT_CHARS} AND NOT regexp_matches(val, '{S.PLACEHOLDER}'))) AS live
  FROM c JOIN o USING (val)
), spans AS (
  SELECT doc_id, start, rank, kind, stop FROM j UNION SELECT doc_id, vstart, {len(S.KINDS)}, 'live', stop FROM j WHERE live
), d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example,
    string_agg(kind || ':' || start || ':' || stop || ':' || owners || ':' || repositories, ',' ORDER BY start, rank, stop) AS spread FROM j GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(spread, '') AS spread, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""

_DOMAINS = "unnest(list_transform(range(1, greatest(len(parts) - 1, 1) + 1), lambda i: array_to_string(parts[i:len(parts)], '.')))"

OP3 = rf"""
WITH h AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
    (DATE '2023-01-01' + ((page_id * 37) % 730)::INTEGER)::DATE AS fetched FROM pages
), k AS (SELECT page_id, fetched, {_DOMAINS} AS domain FROM (SELECT *, string_split(host, '.') AS parts FROM h WHERE host IS NOT NULL)),
f AS (SELECT domain, min(page_id) AS m FROM k GROUP BY domain HAVING m % 3 = 0),
e AS (SELECT CASE WHEN m % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, domain, m, (m * 11) % 400 AS s FROM f),
v AS (
  SELECT list, domain, DATE '2023-01-01' + s::INTEGER AS lo, DATE '2023-01-01' + (s + 60 + m % 90 - 1)::INTEGER AS hi FROM e
  UNION ALL SELECT list, domain, DATE '2023-01-01' + (s + 300)::INTEGER, DATE '9999-01-01' FROM e WHERE m % 4 = 0
), a AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(k.domain, lpad(length(k.domain)::VARCHAR, 6, '0') || k.domain) AS matched
  FROM k JOIN v ON v.domain = k.domain AND fetched BETWEEN lo AND hi GROUP BY page_id
)
SELECT h.page_id, host, fetched, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists, matched, n_active IS NULL AS keep FROM h LEFT JOIN a ON a.page_id = h.page_id
"""


def _bits(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT"


OP4 = f"""
WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
t AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(pow(chars, {M.TEMPERATURE})) AS all_weight FROM s),
r AS (SELECT source, round(pow(chars, {M.TEMPERATURE}) / all_weight * all_chars / chars, 9) AS rate FROM s, t WHERE chars > 0),
p AS (SELECT source, greatest(ceil(rate / {M.PART}), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {M.PART}), 1) AS l FROM r),
c AS (SELECT source, sum(exp(k * ln(l) - l - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p, range(0, {M.LAST + 1}) x(k)),
u AS (
  SELECT doc_id, d.source, ({_bits(f"'{M.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j")} + 0.5) / {1 << 52}::DOUBLE AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range(0, 64) y(j) WHERE j < parts
), n AS (SELECT doc_id, count(*) AS copies FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, n.copies::INTEGER AS mix_copies, i::INTEGER AS mix_copy,
  {_bits(f"'{M.SEED}-order:' || d.doc_id || ':' || i")} AS mix_order
FROM documents d JOIN n ON n.doc_id = d.doc_id, range(1, 10000) z(i) WHERE i <= n.copies
"""

OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS intact FROM f
"""

OP8 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)
"""

#: CRC-32 of the decimal number, as a fold over its bytes and eight shifts (-1) after each.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END), 4294967295::BIGINT)"
)

OP11 = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS l FROM t GROUP BY conv_id
), h AS (SELECT *, {_CRC} % 4 AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d::BIGINT AS depth, l[1:d] AS node, d = len(l) AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM c)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY node, depth
), m AS (
  SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(node[depth].t, '{WORD}')) END AS own, node[1:depth - 1] AS up FROM n
), k AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL),
s AS (
  SELECT a.node, a.depth, sum(b.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM m a JOIN m b ON b.depth >= a.depth AND b.node[1:a.depth] = a.node LEFT JOIN k ON k.node = b.node AND k.depth = b.depth GROUP BY a.node, a.depth
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.node = m.node AND s.depth = m.depth LEFT JOIN k ON k.node = m.node AND k.depth = m.depth LEFT JOIN n u ON m.depth > 0 AND u.node = m.up AND u.depth = m.depth - 1
"""

OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, id, unnest(w) AS x, unnest(range(len(w))) AS i FROM p),
t AS (SELECT lang, x, lead(x, 1) OVER piece AS y, lead(x, 2) OVER piece AS z FROM o WINDOW piece AS (PARTITION BY id ORDER BY i)),
g AS MATERIALIZED (
  SELECT lang, 1 AS k, [x] AS g, count(*) AS f FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, [x, y], count(*) FROM t WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, [x, y, z], count(*) FROM t WHERE z IS NOT NULL GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
held AS (
  SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS part FROM c WHERE k = 3) t ON t.lang = s.lang AND t.part = s.g WHERE s.k = 2 AND 100 * t.f >= 50 * s.f
), cuts AS (SELECT c.lang, c.g, c.f AS a, u.cut FROM c, (VALUES (1), (2)) u(cut) WHERE u.cut < c.k),
scored AS (
  SELECT x.lang, x.g, x.a, x.cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts x JOIN g l ON l.lang = x.lang AND l.g = x.g[1:x.cut] JOIN g r ON r.lang = x.lang AND r.g = x.g[x.cut + 1:]
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT low.lang, array_to_string(low.g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN held ON held.lang = low.lang AND held.g = low.g WHERE held.g IS NULL
)
SELECT ranked.lang, row_number() OVER (PARTITION BY ranked.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang
QUALIFY rank <= 2000
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}') AS w FROM d),
o AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
v AS (SELECT rid, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM o WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, z IS NOT NULL AND count(*) OVER (PARTITION BY rid, x, y, z) > 1 AS again FROM v),
m AS (
  SELECT rid, count(*) FILTER (again OR b1 OR b2) AS n FROM (SELECT rid, again, lag(again, 1) OVER p AS b1, lag(again, 2) OVER p AS b2 FROM r WINDOW p AS (PARTITION BY rid ORDER BY i)) GROUP BY rid
), l AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
e AS (SELECT rid, source, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS lw FROM l WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM e GROUP BY rid),
own AS (SELECT rid, source, t, array_to_string(lw, ' ') AS line, sum(len(lw)) AS n FROM e GROUP BY ALL),
common AS (SELECT source, line FROM own GROUP BY ALL HAVING count(DISTINCT t) > {Q.MAX_DOCS_PER_HOST}),
hits AS (SELECT own.* FROM own JOIN common c ON c.line = own.line AND c.source IS NOT DISTINCT FROM own.source),
held AS (SELECT row_number() OVER () AS doc_id, t FROM (SELECT DISTINCT t FROM hits)),
hw AS (
  SELECT doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM held
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM hw
), sn AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sn na ON na.doc_id = a JOIN sn nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)
), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM held UNION SELECT r.doc_id, k.b FROM reach r JOIN link k ON k.a = r.other),
of AS (SELECT held.t, min(other) AS c FROM reach JOIN held USING (doc_id) GROUP BY held.t),
frequent AS (SELECT source, line FROM hits JOIN of ON of.t = hits.t GROUP BY ALL HAVING count(DISTINCT c) > {Q.MAX_DOCS_PER_HOST}),
gone AS (SELECT rid, sum(n) AS n FROM hits JOIN frequent f ON f.line = hits.line AND f.source IS NOT DISTINCT FROM hits.source GROUP BY rid),
a AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN m USING (rid) LEFT JOIN gone USING (rid)
), b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= {Q.MIN_REMAINING_PERCENT} * n_words AS kept FROM b
"""
