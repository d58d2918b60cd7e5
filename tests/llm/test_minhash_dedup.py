"""Operator 12 against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from billcov.llm import minhash_dedup as M
from tests.llm.test_dedup_ops import components_brute, corpus, frame


@pytest.mark.parametrize("options", [{}, {"run_limit": 2, "tile": 8}, {"hot_from": 6}])
def test_components_match_brute_force(spark, options):
    rows = corpus(7)
    want = {i: (*v, v[1] == i) for i, v in components_brute(rows, 2, 80).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.minhash_components(frame(spark, rows), **options).collect()}
    assert got == want
    assert Counter(v[1] for v in want.values()).most_common(1)[0][1] > 5


def test_pairs_at_the_threshold_are_found(spark):
    """300 pairs of 80 % exactly and as many just below: 16 of 20 shingles of the union, or 15."""
    rng = random.Random(11)
    rows = []
    for k in range(600):
        words = [f"x{rng.randrange(10**9)}" for _ in range(19)]
        a, b = words, words[:17] + [f"y{rng.randrange(10**9)}", f"y{rng.randrange(10**9)}"]
        if k % 2:
            a = words + [f"z{k}"]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    want = {i: v[1] for i, v in components_brute(rows, 2, 80).items()}
    assert {r.doc_id: r.component_id for r in M.minhash_components(frame(spark, rows)).collect()} == want
    assert sum(v != i for i, v in want.items()) == 300


def test_unnamed_repeated_and_empty_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (None, text), (3, text + " w20"), (None, "alone here"), (None, None), (6, "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.minhash_components(frame(spark, rows)).collect())
    assert got == Counter({(5, 19, 3, False): 2, (None, 19, 3, False): 1, (3, 20, 3, True): 1, (None, 1, None, True): 1, (None, 0, None, True): 1, (6, 0, 6, True): 1})
    assert M.minhash_components(frame(spark, [], 1)).count() == 0


def test_tables_come_from_few_minhashes():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:440], rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    sets, bounds = np.concatenate([x, y]), np.array([0, len(x), len(x), len(x) + len(y)])
    m = M.minhashes(sets, bounds, 2000)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((m[0] == m[2]).mean() - true) < 0.05 and not m[1].any()
    a, b = M.band_keys(sets, bounds, 12, 2)
    assert a.shape == b.shape == (3, 12)
    assert len(set(a.ravel().tolist())) > 24  # a band's key doesn't meet those of other bands
