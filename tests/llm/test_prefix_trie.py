"""Operator 11 against a trie of nested dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from billcov.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, words string, n int"


def rebuilt_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def trie_brute(convs):
    """Rows (depth, conv_id, parent, n_convs, n_children, n_leaves, saved, sha) of every node."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids[p]
        leaves[p] = sum(leaves[x] for x in below) or (1 if not below else 0)
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own + sum(saved[x] for x in below)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((len(p), min(m), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def got(df):
    return sorted((r["depth"], r["conv_id"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("span,chunk", [(4096, 16384), (4096, 3), (3, 3)])
def test_random_conversations(spark, span, chunk):
    rnd = random.Random(span * 31 + chunk)
    rows = []
    for c in range(60):
        if rnd.random() < 0.1:
            continue
        start = rnd.choice([["a"], ["a", "b"], ["x y"], []])
        ts = start + [rnd.choice(["p q", "r", "", "s  t"]) for _ in range(rnd.randrange(0, 7))]
        rows += [(c, k if rnd.random() < 0.9 else None, rnd.choice(["user", None]) if k > 3 else "user", t or None) for k, t in enumerate(ts)]
    rnd.shuffle(rows)
    assert got(P.conversation_trie(table(spark, rows), span=span, chunk_rows=chunk)) == trie_brute(rebuilt_brute(rows))


def test_copies_prefixes_and_one_long_conversation(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(20, 60) for k in range(4)]  # copies
    rows += [(60, k, "user", f"t{k % 3} w") for k in range(50)]
    rows += [(80, k, "user", f"t{k % 3} w") for k in range(31)]  # a prefix of it, once the heads are the same
    rows += [(100, 1, "user", "z"), (100, 1, "user", "z"), (100, None, None, None), (None, 1, "user", "q")]
    rows += [(1, 0, "user", "only")]  # its head conversation is missing
    expected = trie_brute(rebuilt_brute(rows))
    for span, chunk in ((4096, 5), (16, 5)):
        assert got(P.conversation_trie(table(spark, rows), span=span, chunk_rows=chunk)) == expected


def test_empty_and_turnless(spark):
    assert got(P.conversation_trie(table(spark, []))) == []
    lone = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    rows = [(lone, 0, "user", "gone")]  # its only turn is replaced by the head of a conversation that isn't there
    assert got(P.conversation_trie(table(spark, rows))) == trie_brute({lone: []})


def test_long_text_is_one_turn(spark):
    rows = [(20, 0, "user", "w " * 200_000), (40, 0, "user", "w " * 200_000), (40, 1, "user", "v")]
    assert got(P.conversation_trie(table(spark, rows))) == trie_brute(rebuilt_brute(rows))
