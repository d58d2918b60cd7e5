"""Secret scan, URL filter, source mixing and WARC table against brute force."""

import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from billcov.llm import secret_scan as S
from billcov.llm import source_mixing as M
from billcov.llm import url_filter as U
from billcov.llm import warc_table as A

# ---- secrets ----------------------------------------------------------------------------------

KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(t):
    out = []
    for rank, (kind, p, g, least) in enumerate(KINDS):
        out += [(m.start(), rank, kind, m.end()) for m in p.finditer(t or "") if len(m[g]) >= least]
    return sorted(out)


def secret_texts():
    rng = random.Random(1)
    words = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", "\n", '"', "'", "é", "日", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 3, "0123456789abcdef" * 2, "abc12", "abcdef", "x=", "secret: ", "hunter22Zq!", "token=token :abcdefg"]
    out = ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    return [*out, None, "", "token=token :abcdefg", "é" * 50 + 'password = "Zx9Qw7Lk2m"' + "é", "password=Zx9Qw7Lk2m", "passwd: example123456", "a" * 30_000 + " AKIA" + "B" * 16, "token=Zx9Qw7Lk2m " * 3000]


def secret_docs(spark, texts, owners=7):
    rows = [(i, t, f"o{i % owners}" if i % owners else None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, spans int").repartition(3)


def test_base_spans_match_brute_force(spark):
    texts = secret_texts()
    got = S.digest(S.secret_spans(secret_docs(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, _, k, _ in want) for x in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r.spans.split(",")) | {""}


def test_ownership_separates_examples_from_live_values(spark):
    live, example, weak = "password=Zx9Qw7Lk2m", "token=Ab3Cd5Ef7Gh", "secret=aaaaaaaaaaaa"
    texts = [live if i == 10 else example if i % 2 else weak if i == 12 else "nothing" for i in range(40)]
    got = {r.doc_id: r for r in S.digest(S.secret_spans(secret_docs(spark, texts))).collect()}
    assert got[10].spans == f"assign:0:{len(live)},live:9:{len(live)}" and (got[10].n_live, got[10].n_example) == (1, 0)
    assert got[11].spans == f"assign:0:{len(example)}" and (got[11].n_live, got[11].n_example) == (0, 1)
    assert got[12].spans == f"assign:0:{len(weak)}" and got[12].n_live == 0
    assert got[14].spans == "" and got[14].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_many_repositories_of_one_owner_make_an_example(spark):
    few, many = "password=Zx9Qw7Lk2m", "token=Ab3Cd5Ef7Gh"
    rows = [(i, few if i < S.MAX_REPOSITORIES else many, "a") for i in range(2 * S.MAX_REPOSITORIES + 1)]
    got = {r.doc_id: r for r in S.digest(S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0].spread == f"assign:0:{len(few)}:1:{S.MAX_REPOSITORIES}" and (got[0].n_live, got[0].n_example) == (1, 0)
    assert got[20].spread == f"assign:0:{len(many)}:1:{S.MAX_REPOSITORIES + 1}" and (got[20].n_live, got[20].n_example) == (0, 1)


def test_secrets_in_repeated_rows_and_empty_tables(spark):
    rows = [(1, "password=Zx9Qw7Lk2m", "a"), (1, "password=Zx9Qw7Lk2m", "a"), (None, "password=Zx9Qw7Lk2m", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = S.digest(S.secret_spans(df)).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_live) for r in got) == [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 1)]
    assert S.digest(S.secret_spans(df.limit(0))).count() == 0


# ---- URL filter -------------------------------------------------------------------------------


def filter_brute(captures, entries):
    def active(lst, dom, day):
        last = {}
        for e_list, e_dom, e_day, action in entries:
            if e_list == lst and e_dom and e_dom.lower() == dom and e_day and e_day <= day and action in ("add", "remove"):
                key = (e_day, action == "remove")
                if not last or key > last["k"]:
                    last = {"k": key, "a": action}
        return last.get("a") == "add"

    out = {}
    lists = {e[0] for e in entries}
    for page, url, day in captures:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else None
        hits = []
        if host and day:
            parts = host.split(".")
            doms = [".".join(parts[i:]) for i in range(max(len(parts) - 1, 1))]
            hits = [(lst, d) for d in doms for lst in lists if active(lst, d, day)]
        out[page] = (host, len(hits), ",".join(sorted({x for x, _ in hits})), max((d for _, d in hits), key=len, default=None), not hits)
    return out


def test_temporal_join_matches_brute_force(spark):
    rng = random.Random(3)
    d0 = dt.date(2023, 1, 1)
    day = lambda: d0 + dt.timedelta(rng.randrange(300))
    doms = ["a.com", "b.a.com", "c.org", "x.y.c.org", "host", "HOT.net"]
    entries = [(rng.choice(["spam", "adult"]), rng.choice(doms), day(), rng.choice(["add", "remove"])) for _ in range(60)]
    entries += [("spam", None, d0, "add"), ("spam", "a.com", None, "add"), ("spam", "a.com", d0, "what"), ("spam", "c.org", d0, "add"), ("spam", "c.org", d0, "remove")]
    urls = ["http://a.com/x", "https://u:p@B.A.com:80/", "ftp://z.x.y.c.org?q=http://a.com", "http://host", "nonsense", None, "", "http://www.hot.net#f", "http://ahot.net/"]
    captures = [(i, urls[i % len(urls)] if i < 200 else "http://hot.net/", day() if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched date").repartition(3)
    ent = spark.createDataFrame(entries, "list string, domain string, day date, action string")
    got = {r.page_id: (r.host, r.n_active, r.lists, r.matched, r.keep) for r in U.evaluate(df, ent).collect()}
    assert got == filter_brute(captures, entries)
    assert any(not v[4] for v in got.values())
    assert U.evaluate(df, ent.limit(0)).where("keep").count() == 400
    assert U.evaluate(df.limit(0), ent).count() == 0


def test_repeated_captures_each_get_a_row(spark):
    d = dt.date(2023, 5, 5)
    df = spark.createDataFrame([(1, "http://a.com", d), (1, "http://a.com", d), (None, "http://a.com", d)], "page_id long, url string, fetched date")
    ent = spark.createDataFrame([("spam", "a.com", d, "add")], "list string, domain string, day date, action string")
    assert [r.n_active for r in U.evaluate(df, ent).collect()] == [1, 1, 1]


# ---- source mixing ----------------------------------------------------------------------------


def poisson_brute(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u and k < 100:
        k += 1
        p *= rate / k
        c += p
    return k if c > u else 101


def uniform_brute(seed, name, j):
    return (int(hashlib.md5(f"{seed}:{name}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def mixing_rows():
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 60), "hot" if i % 3 else "s%d" % (i % 9), 5) for i in range(900)]
    return rows + [(2_000, None, "hot", 5), (2_001, "y" * 3, None, 5), (2_002, "", "empty", 5), (2_003, "z" * 20, "tiny", 5), (None, "q" * 9, "hot", 5)]


@pytest.mark.parametrize("temperature", [0.5, 1.0, 0.0])
def test_copies_match_brute_force(spark, temperature):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int").repartition(3)
    chars = defaultdict(int)
    for _, t, s, _ in rows:
        chars[s] += len(t or "")
    weight = {s: c**temperature if c else 0.0 for s, c in chars.items()}
    rate = {s: round(weight[s] / sum(weight.values()) * sum(chars.values()) / c, 9) if c else 0.0 for s, c in chars.items()}
    want = {}
    for i, _, s, _ in rows:
        parts = max(1, math.ceil(rate[s] / M.PART))
        want[i] = sum(poisson_brute(uniform_brute(M.SEED, i, j), rate[s] / parts) for j in range(parts)) if rate[s] else 0
    out = M.mixed(df, temperature=temperature)
    assert out.columns[:4] == ["doc_id", "text", "source", "rate"]
    # A row without an identifier draws by its place: test_rows_without_identifier_draw_on_their_own.
    got = [r for r in out.collect() if r.doc_id is not None]
    want.pop(None, None)
    assert Counter(r.doc_id for r in got) == Counter({i: c for i, c in want.items() if c})
    assert all(r.mix_copies == want[r.doc_id] and 1 <= r.mix_copy <= r.mix_copies for r in got)
    if temperature == 1.0:
        assert abs(len(got) - len(rows)) < 5 * math.sqrt(len(rows))


def test_given_weights_and_high_rates(spark):
    df = spark.createDataFrame([(i, "x" * 10, "a" if i < 20 else "b") for i in range(2_000)], "doc_id long, text string, source string")
    want = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("unknown", 9.0)], "src string, weight double")
    rates = {r.src: r.rate for r in M.rates(df, weights=want).collect()}
    assert rates["a"] == pytest.approx(0.75 * 2000 / 20) and rates["b"] == pytest.approx(0.25 * 2000 / 1980)
    got = Counter(r.source for r in M.mixed(df, weights=want).select("source").collect())
    assert abs(got["a"] - 1500) < 6 * math.sqrt(1500) and abs(got["b"] - 500) < 6 * math.sqrt(500)
    again = Counter(r.doc_id for r in M.mixed(df.repartition(5), weights=want).collect())
    assert again == Counter(r.doc_id for r in M.mixed(df, weights=want).collect())
    assert M.mixed(df.limit(0)).count() == 0


# ---- WARC -------------------------------------------------------------------------------------


def warc_rows():
    big = "é" * 90_000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 70_001
    same = "<html>" + "s" * 200
    rows = [(1, "http://a", same), (2, "http://b", same), (0, "http://c", same), (3, None, None), (4, "http://e\r\nX: y", ""), (5, "http://f", "s" * 99), (6, "http://g", "s" * 99), (7, "http://h", "s" * 100), (8, "http://i", "s" * 100), (9, "http://j", big), (10, "http://k", big)]
    return rows + [(100 + i, f"http://p/{i}", f"page {i % 40} " + "é" * (i % 60)) for i in range(200)]


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 2_000, "segment_bytes": 700}])
def test_round_trip(spark, tmp_path, options):
    rows = warc_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    got = {r.page_id: r for r in A.digest(A.archived(df, str(tmp_path / "warc"), **options)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None, True)


def test_chunks_give_the_payload_back(spark, tmp_path):
    rows = warc_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/warc"
    manifest = A.write_archives(A.record_chunks(A.records(df), chunk_bytes=1000), folder, segment_bytes=5_000)
    parts = defaultdict(dict)
    for r in A.read_archives(manifest, folder, chunk_bytes=777).where("record_type = 'response'").collect():
        parts[r.page_id][r.chunk_no] = bytes(r.chunk)
        assert len(r.chunk) <= 777
    for i, _, h in rows:
        if i in parts:
            assert b"".join(parts[i][k] for k in sorted(parts[i])) == (h or "").encode()
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").iterdir()))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n") and b"\r\nX: y" not in text


def test_repeated_and_unnamed_pages(spark, tmp_path):
    same = "z" * 150
    df = spark.createDataFrame([(1, "u", same), (1, "u", same), (None, "u", same), (None, None, "a" * 120), (None, "v", "a" * 120)], "page_id long, url string, html string")
    got = A.digest(A.archived(df, str(tmp_path / "w"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
    assert A.digest(A.archived(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_rows_without_identifier_draw_on_their_own(spark):
    rows = [(None if i % 2 else i, f"text {i}", "s", "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_name string").repartition(5)
    out = M.mixed(df, weights=spark.createDataFrame([("s", 1.0)], "src string, weight double"))
    got = out.collect()
    assert out.columns == [*df.columns, "mix_copies", "mix_copy", "mix_order"]
    null = [r for r in got if r.doc_id is None]
    assert 350 < len(null) < 650 and len({r.mix_copies for r in null}) > 2
    assert max(Counter(r.mix_order for r in null).values()) == 1
    assert {r.mix_name for r in got} == {"x"}
