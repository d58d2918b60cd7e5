"""Exact dedup and n-gram join against brute force, with nulls, empty, long, tied and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from billcov.llm import exact_dedup as D
from billcov.llm import ngram_join as J
from billcov.llm.components import components

SCHEMA = "doc_id long, text string, kept string, key long"  # with clashing extra columns


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, prose(rng, rng.randint(1, 80), words)) for i in range(n)]
    base = prose(rng, 60, words).split()
    for i in range(n, n + 60):  # a family of near copies with drifting edits
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy[: rng.randint(50, 60)])))
    passage = prose(rng, 12, words)
    rows += [(500 + k, passage + " " + prose(rng, 3 + k, words)) for k in range(40)]  # a shared passage
    rows += [(700, None), (701, ""), (702, "  \n "), (703, "one"), (704, "ONE"), (705, "one two three"), (706, "one two\tthree"), (707, "one two three four")]
    rows += [(708, " ".join(["tie"] * 30)), (709, " ".join(["tie"] * 9)), (710, prose(rng, 30_000, words))]
    return rows


# ---- exact dedup ------------------------------------------------------------------------------


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = {}
    for t, ids in groups.items():
        for i in ids:
            out[i] = (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_exact_duplicates_match_brute_force(spark):
    rows = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, " a b"), (5, "a b "), (6, None), (7, ""), (8, " "), (9, "\n\n"), (10, "a b"), (11, "a  b"), (12, "x" * 100_000), (13, "x" * 100_000)]
    rows += [(100 + i, f"text {i % 7}") for i in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in D.exact_duplicates(frame(spark, rows)).collect()}
    assert got == exact_brute(rows)


@pytest.mark.parametrize("budget", [1, 200, 5_000])
def test_exact_duplicates_with_spilling_tries(spark, budget):
    rows = corpus(3) + [(2_000 + i, t) for i, t in corpus(3)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_duplicates(frame(spark, rows), trie_bytes=budget).collect()}
    assert got == {i: v[:3] for i, v in exact_brute(rows).items()}


def test_trie_compares_bytes_not_hashes():
    trie, made = D.RadixTrie(), []

    def new():
        made.append(len(made))
        return made[-1]

    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcabc"]
    assert [trie.find_or_add(w, new) for w in words] == list(range(7))
    assert [trie.find_or_add(w, new) for w in words] == list(range(7))


def test_spilled_answers_equal_plain_ones():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    for budget in (1, 7, 60, 10_000):
        n = iter(range(10**6))
        found = defaultdict(set)
        for t, (text,) in D.answer(iter((t, (t,)) for t in texts), lambda n=n: next(n), budget):
            found[t].add(text)
        assert all(len(v) == 1 for v in found.values())
        assert len(found) == len(set(texts))


def test_exact_duplicates_of_repeated_and_unnamed_rows(spark):
    rows = [(1, "same"), (1, "same"), (None, "same"), (None, "other"), (None, "other"), (2, "same")]
    got = D.exact_duplicates(frame(spark, rows)).collect()
    same = [r for r in got if r.group_size == 4]
    assert len(got) == 6 and len(same) == 4
    assert {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    other = [r for r in got if r.group_size == 2]
    assert [r.keep_id for r in other] == [None, None] and sum(r.kept for r in other) == 1


def test_deduplicated_keeps_columns(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (3, "c"), (4, None)]
    out = D.deduplicated(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "kept", "key"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_empty_tables(spark):
    none = frame(spark, [], 1)
    assert D.exact_duplicates(none).count() == 0
    assert D.deduplicated(none).count() == 0
    assert J.ngram_components(none).count() == 0


# ---- n-gram join ------------------------------------------------------------------------------


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def components_brute(rows, k=4, t=85):
    sets = sets_of(rows, k)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("options", [{}, {"run_limit": 2, "tile": 8}, {"frequent_from": 2, "run_limit": 5, "tile": 30}, {"shingle": 5, "threshold": 80}])
def test_components_match_brute_force(spark, options):
    rows = corpus()
    want = components_brute(rows, options.get("shingle", 4), options.get("threshold", 85))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(frame(spark, rows), **options).collect()}
    assert got == want
    assert Counter(c for _, c in want.values()).most_common(1)[0][1] > 5


def test_threshold_is_exact(spark):
    # 20 shingles each, 17 or 18 of them shared: 17/23 < 85 %, 18/22 < 85 %, 19/21 > 85 %.
    base = [f"b{i}" for i in range(23)]
    rows = [(1, " ".join(base))]
    for i, cut in enumerate((1, 2, 3), 2):
        rows.append((i, " ".join([f"x{i}{j}" for j in range(cut)] + base[cut:])))
    got = {r.doc_id: r.component_id for r in J.ngram_components(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in components_brute(rows).items()}


def test_bound_never_undercuts_the_overlap():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        wx, wy = J.signature(x), J.signature(y)
        true = len(np.intersect1d(x, y))
        assert J.overlap(x, y) == true
        assert J.bound((len(x), *wx), (len(y), *wy)) >= true


def test_unnamed_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (None, text), (3, text + " w20"), (None, "alone here"), (None, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_components(frame(spark, rows)).collect())
    assert got == Counter({(5, 17, 3): 2, (None, 17, 3): 1, (3, 18, 3): 1, (None, 1, None): 1, (None, 0, None): 1})


def test_one_of_each_keeps_the_smallest(spark):
    rows = corpus(2)
    want = {i for i, (_, c) in components_brute(rows).items() if c == i}
    out = J.one_of_each(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "kept", "key"]
    assert {r.doc_id for r in out.collect()} == want


def test_stars_find_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


def test_exact_decisions_hold_for_rows_with_repeated_or_null_ids(spark):
    rows = [(5, "x"), (5, "y"), (3, "y"), (7, "a b"), (7, "a  b"), (None, "y"), (None, "z"), (None, "z "), (None, "z "), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in D.deduplicated(df).collect()]
    assert len(got) == 6
    assert {(i, " ".join((t or "").split(" "))) for i, t in got if i in (3, 5)} == {(3, "y"), (5, "x")}
    assert sorted(str(i) for i, _ in got) == ["3", "5", "7", "8", "None", "None"]


def test_columns_named_like_helpers_stay(spark):
    names = ["kept_id", "kept_text", "kept_place", "_kept_id", "_kept_raw", "_again", "component_id", "raw"]
    rows = [(i if i % 2 else None, t, *["x"] * len(names)) for i, t in enumerate(["a b c d e", "a b c d e", "z", "y", "y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = D.deduplicated(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["a b c d e", "y", "z"]
    one = J.one_of_each(df)
    assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {None, 1, 3}
