"""Packing's assignment and the classifier's dual solution against plain versions."""

import random

import numpy as np
import pytest

from billcov.llm import packing as P
from billcov.llm import quality_classifier as C


def pack_brute(lengths, seq_len):
    """Whole sequences first; what is left goes, longest first, to the cheapest sequence with room, or is cut into the cheapest that has any."""
    pieces, seqs, rest = [], 0, []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= seq_len:
            pieces.append((d, start, seq_len, seqs, 0))
            seqs, start = seqs + 1, start + seq_len
        if n > start:
            rest.append((d, start, n - start))
    total = sum(r[2] for r in rest)
    sizes = [seq_len] * (total // seq_len) + [b for b in (1 << k for k in range(20, -1, -1)) if b < seq_len and total % seq_len & b]
    bins = [{"size": s, "used": 0, "cost": 0.0} for s in sizes]
    for d, start, n in sorted(rest, key=lambda r: (-r[2], r[0])):
        while n:
            able = [k for k, b in enumerate(bins) if b["size"] - b["used"] >= n] or [k for k, b in enumerate(bins) if b["size"] > b["used"]]
            k = min(able, key=lambda k: (bins[k]["cost"], k))
            b = bins[k]
            take = min(n, b["size"] - b["used"])
            pieces.append((d, start, take, seqs + k, b["used"]))
            b["used"] += take
            b["cost"] += P.LINEAR * take + P.QUADRATIC * take * take
            start, n = start + take, n - take
    assert all(b["used"] == b["size"] for b in bins)
    return pieces, seqs + len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pieces_go_to_the_cheapest_sequence_with_room(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 7, 64, 100, rng.randint(1, 400)]) for _ in range(rng.randint(0, 120))]
    assert P.pack_block(lengths, seq_len=64) == pack_brute(lengths, 64)


def dual_brute(x, y, cost, steps=20_000):
    """Projected gradient on the whole dual; (weights with the bias last, dual objective)."""
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(steps):
        a = np.clip(a - rate * (q @ a - 1), 0, cost)
    return (a * y) @ x, a.sum() - 0.5 * a @ q @ a


@pytest.mark.parametrize("seed", range(3))
def test_hinge_fit_is_the_optimum(seed):
    rng = np.random.default_rng(seed)
    ratio = rng.normal(size=30)
    labels = (rng.random(60) < 0.3).astype(int)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 8), rng.integers(0, 10, 4) + 20 * labels[i]])) for i in range(60)]
    w, bias = C.fit_hinge(rows, labels, ratio, epochs=5_000)
    x = np.zeros((60, 31))
    for i, f in enumerate(rows):
        x[i, f] = C.unit(f, ratio)
    x[:, 30] = 1.0
    y = np.where(labels > 0, 1.0, -1.0)
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) * C.COST
    want, dual = dual_brute(x, y, cost)
    mine = np.append(w, bias)
    primal = lambda v: 0.5 * v @ v + float(cost @ np.maximum(0, 1 - y * (x @ v)))
    assert primal(mine) == pytest.approx(dual, rel=2e-2)  # no duality gap but for the stopping rule
    assert mine == pytest.approx(want, abs=2e-2)
