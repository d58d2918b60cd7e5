"""Operator 13 against counting by dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from billcov.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, word string, count int, a int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(parts)


def brute(rows, least=10, limit=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            key = "und" if lang is None else lang
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[key][tuple(w[i : i + k])] += 1
    out = []
    for lang, g in f.items():
        n[lang] = sum(c for p, c in g.items() if len(p) == 1)
        cand = {p: c for p, c in g.items() if len(p) > 1 and c >= least}
        rows_of = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in cand.items()):
                continue
            s, _, left, right = min((10**6 * a * a // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Big", "a-b", "ß x"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" "] * 20 + ["  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", " . , "), ("en", "of the moon " * 3000), ("de", "x x x x x x x x x x x x x x")] + [("en", "copied words here again")] * 200


@pytest.mark.parametrize("options", [{}, {"shard_words": 100, "range_bytes": 64}, {"limit": 3}])
def test_phrases_match_brute_force(spark, options):
    rows = corpus(5)
    want = brute(rows, limit=options.get("limit", 2000))
    assert got(C.collocations(frame(spark, rows), **options)) == want
    assert len(want) > 10


def test_ties_follow_bytes(spark):
    rows = [("en", ". ".join(f"{x} same" for x in ("Ω", "b", "a", "é", "zz") for _ in range(12)))]
    assert got(C.collocations(frame(spark, rows), limit=2)) == brute(rows, limit=2)


def test_empty_table(spark):
    assert got(C.collocations(frame(spark, [], 1))) == []
    assert got(C.collocations(frame(spark, [(None, None)], 1))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 10**12 + 9, 10**12 + 11), (999_999_999_989, 10**13, 999_999_999_989), (10, 10, 10), (3 * 10**9, 7 * 10**9, 9 * 10**9 + 1)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    rows = df.select("a", "l", "r", C.score(df["a"], df["l"], df["r"]).alias("s")).collect()
    assert [r["s"] for r in rows] == [10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in rows]


def test_equal_arcs_are_one_state():
    u = lambda *x: np.array(x, dtype=np.uint64)
    state = lambda fields: np.frombuffer(fields[4], dtype="<u2").tolist()
    t = C.Transducer(u(1, 2, 3, 1), u(5, 6, 7, 5), u(9, 9, 8, 9), np.array([True, True, True, True]))
    ((_, fields),) = t.packed(1)
    assert len(t.key) == 3 and len(set(state(fields))) == 3  # (1 5) goes to 9 twice, (2 6) once
    t = C.Transducer(u(1, 2, 3), u(5, 6, 7), u(9, 9, 8), np.array([True, True, True]))
    ((_, fields),) = t.packed(1)
    assert len(set(state(fields))) == 2 and len(fields[6]) == 4  # two arcs are stored for three pairs
