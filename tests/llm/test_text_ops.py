"""Quality rules, packing, license scan and classifier against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from billcov.llm import license_scan as L
from billcov.llm import packing as P
from billcov.llm import quality_classifier as C
from billcov.llm import quality_rules as Q
from billcov.llm.queries import word_tokenizer_path
from tests.llm.test_dedup_ops import components_brute

SPACE = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t ", "a", "A b", "é é é\né é é", "x\x1cy", "日本 語\n\n日本 語", "it's <|endoftext|> 9,9 İΣς", " ", "a " * 70_000]


def table(spark, texts, parts=3):
    rows = [(i, t, f"h{i % 3}" if i % 5 else None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(parts)


def sample(seed=1, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["a|b", "x#", "é", "THE!!"]
    out = list(ODD)
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        lines += [rng.choice(lines)] * rng.randint(0, 2)
        out.append("\n".join(lines))
    return out


# ---- quality rules ----------------------------------------------------------------------------


def base_counts(t):
    t = t or ""
    w = re.findall(SPACE, t)
    c = Counter(zip(w, w[1:], w[2:]))
    marked = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def test_base_counts_match_brute_force(spark):
    texts = sample()
    got = Q.quality_rules(table(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])


def lines_brute(rows, most, least, percent):
    """rows: (id, host, text). Words removed and verdict: documents per host and line, near copies being one."""
    docs, texts, held = [], defaultdict(set), defaultdict(set)
    for i, host, t in rows:
        size = Counter()
        for line in (t or "").split("\n"):
            w = tuple(re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            size[w] += len(w)
        docs.append((i, host, size))
        for line in size:
            if len(line) >= max(least, 1):
                texts[host, line].add(t)
    for key, own in texts.items():
        if len(own) > most:
            held[key] = own
    every = sorted(set().union(*held.values())) if held else []
    of = {every[k]: c for k, (_, c) in components_brute(list(enumerate(every)), 4, 85).items()}
    frequent = {key for key, own in held.items() if len({of[t] for t in own}) > most}
    out = {}
    for i, host, size in docs:
        gone = sum(n for x, n in size.items() if (host, x) in frequent)
        total = sum(size.values())
        out[i] = (gone, 100 * (total - gone) >= percent * total)
    return out


def test_cross_document_lines_match_brute_force(spark):
    rng = random.Random(7)
    own = lambda n: "\n".join(" ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) for _ in range(n))
    banner = "Subscribe to our newsletter today " * 9
    texts = [own(8) + "\n" + banner for _ in range(40)]  # banner on pages with enough text of their own
    texts += [banner + "\n" + own(1)] * 1 + [banner + "\nBuy now\n" + own(1) for _ in range(20)]  # nothing but banner
    texts += [own(10)] * 30 + [None, ""]  # whole copies
    page = own(12).split("\n")
    for _ in range(200):  # near copies: one word of one line differs
        k = rng.randrange(12)
        texts.append("\n".join(x + f" e{rng.randrange(10**6)}" if j == k else x for j, x in enumerate(page)))
    df = table(spark, texts)
    want = lines_brute([(i, f"h{i % 3}" if i % 5 else None, t) for i, t in enumerate(texts)], 5, 3, Q.MIN_REMAINING_PERCENT)
    got = Q.quality_rules(df, max_docs_per_host=5).collect()
    for r in got:
        gone, rest = want[r.doc_id]
        assert (r.n_removed_words, r.kept) == (gone, rest and not r.base_failed), r
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(40)) and all(kept[i] for i in [*range(61, 91), *range(93, 293)]) and not any(kept[i] for i in range(41, 61) if (i % 5))
    clean = {r.doc_id: r.text for r in Q.without_lines(df, Q.quality_rules(df, max_docs_per_host=5)).collect()}
    assert banner not in clean[0] and texts[0].startswith(clean[0]) and clean[91] is None and clean[70] == texts[70]


def one_host(spark, texts):
    return spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)


def fresh_words(rng, n):
    return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))


@pytest.mark.parametrize("lines, words, own", [(10, 12, 25), (4, 12, 10), (2, 30, 12), (1, 60, 10)])
def test_templates_of_several_lines_are_removed_from_thin_pages(spark, lines, words, own):
    rng = random.Random(lines)
    template = [fresh_words(rng, words) for _ in range(lines)]
    texts = ["\n".join([*template, fresh_words(rng, own)]) for _ in range(100)]
    for r in Q.quality_rules(one_host(spark, texts)).collect():
        assert (r.n_removed_words, r.kept, r.base_failed) == (lines * words, False, False)


@pytest.mark.parametrize("of", [15, 40])
def test_pages_of_shared_lines_alone_are_rejected(spark, of):
    """Pages of 10 of so many lines and nothing else: many documents hold each line, so all go."""
    rng = random.Random(of)
    lines = [fresh_words(rng, 12) for _ in range(of)]
    texts = list({"\n".join(x for x in lines if x in take) for take in (set(rng.sample(lines, 10)) for _ in range(400))})
    got = Q.quality_rules(one_host(spark, texts)).collect()
    assert {(r.n_removed_words, r.kept, r.base_failed) for r in got} == {(120, False, False)}


def test_pages_that_differ_in_a_word_are_one_document(spark):
    rng = random.Random(9)
    lines = [fresh_words(rng, 12) for _ in range(10)]
    texts = ["\n".join([*lines, f"posted by user n{i} on the day before"]) for i in range(200)]
    assert {(r.n_removed_words, r.kept) for r in Q.quality_rules(one_host(spark, texts)).collect()} == {(0, True)}


def test_columns_named_like_helpers_stay(spark):
    names = ["verdict_id", "verdict_host", "VERDICT_TEXT", "lost_lines", "_id", "_host", "_text", "rid", "host", "text_hash", "_gone"]
    good = [" ".join(f"w{i}{k}" for i in range(60)) for k in range(4)]
    rows = [(i if i % 2 else None, t, "h", *["x"] * len(names)) for i, t in enumerate(good)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = Q.kept_documents(df)
    assert out.columns == df.columns and Counter(map(tuple, out.collect())) == Counter(rows)
    cut = Q.without_lines(df.where("doc_id is not null"), Q.quality_rules(df).where("doc_id is not null"))
    assert cut.columns == df.columns and cut.count() == 2


def test_edited_copies_of_a_page_do_not_shield_a_line(spark):
    rng = random.Random(3)
    line, page = fresh_words(rng, 50), [fresh_words(rng, 20) for _ in range(5)]
    pages = ["\n".join([line, fresh_words(rng, 10)]) for _ in range(60)]
    copies = []
    for _ in range(400):
        words = [x.split() for x in page]
        words[rng.randrange(5)][rng.randrange(20)] = fresh_words(rng, 1)
        copies.append("\n".join([line, *map(" ".join, words)]))
    for texts in (pages, [*pages, *copies]):  # copies change no verdict on the pages
        got = Q.quality_rules(one_host(spark, texts)).collect()
        assert {(r.n_removed_words, r.kept) for r in got if r.doc_id < 60} == {(50, False)}
    assert {(r.n_removed_words, r.kept) for r in got if r.doc_id >= 60} == {(50, True)}


def test_pages_of_short_shared_lines_are_rejected(spark, tmp_path):
    import corpus_pipeline
    from billcov.llm.queries import QUERIES

    rng = random.Random(5)
    menu = [fresh_words(rng, 1 + i % 2) for i in range(40)]
    one_host(spark, ["\n".join([*menu, fresh_words(rng, 8)]) for _ in range(30)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect()
    assert {(r.n_removed_words, r.kept, r.base_failed) for r in got} == {(60, False, False)}
    assert corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").count() == 0


def test_verdicts_hold_for_rows_with_repeated_or_null_ids(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "h"), (1, "short", "h"), (None, good, None), (None, "short", None), (None, None, None)]
    got = Q.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2]])


def test_rules_on_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "h"), (1, text, "h"), (None, text, None), (None, None, None)], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.n_words, r.kept) for r in Q.quality_rules(df).collect())
    assert got == Counter({(1, 60, True): 2, (None, 60, True): 1, (None, 0, False): 1})
    assert Q.kept_documents(df.limit(0)).count() == 0
    assert Q.kept_documents(table(spark, sample())).columns == ["doc_id", "text", "source", "kept"]


# ---- packing ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer_path())


def check_pieces(rows, texts, tok, seq_len):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert bytes(p.ids) == np.array(ids[at : at + p.length], dtype="<u4").tobytes()
            at += p.length
        assert at == len(ids)
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == seq_len or at < seq_len and at & (at - 1) == 0  # nothing to pad


def test_pieces_hold_every_id_once(spark, tok):
    texts = sample()
    check_pieces(P.pack_documents(table(spark, texts), word_tokenizer_path()).collect(), texts, tok, 4096)
    check_pieces(P.pack_documents(table(spark, texts), word_tokenizer_path(), seq_len=64, block_tokens=500).collect(), texts, tok, 64)


def test_sequences_concatenate_pieces(spark, tok):
    texts = sample(2, 20)
    pieces = P.pack_documents(table(spark, texts), word_tokenizer_path(), seq_len=256)
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    seqs = P.sequences(pieces).collect()
    assert sum(s.length for s in seqs) == total and all(len(s.ids) == 4 * s.length for s in seqs)


def test_tokens_equal_the_library_on_odd_text(tok):
    rng = random.Random(3)
    units = list("abcXYZÀÉéß×÷'’ \n\t.,!<|>|-0 9ÇΣσς İ́ 日本") + ["<|endoftext|>", "'s", "<|startoftext|>", " \r\n", "...", " ", "\x1c", " "]
    texts = ["".join(rng.choice(units) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    import pyarrow as pa

    from billcov.llm import words as W

    mine = P.UnitTokenizer(word_tokenizer_path())
    for at, raw, offsets in W.slices(pa.array([t.encode() for t in texts], pa.binary()), 2_000):
        ids, bounds = mine.encode(raw, offsets)
        for k in range(len(offsets) - 1):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tok.encode(texts[at + k], add_special_tokens=False).ids


def test_block_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randint(1, 3000) for _ in range(600)]
    pieces, n = P.pack_block(lengths)
    cost, size = defaultdict(float), Counter()
    for _, _, length, s, _ in pieces:
        cost[s] += length + length * length / 4096
        size[s] += length
    full = [cost[s] for s in size if size[s] == 4096]
    assert n == len(size) and max(full) <= 1.35 * sum(full) / len(full)


def test_packing_of_nothing(spark):
    assert P.pack_documents(table(spark, ["x"]).limit(0), word_tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(table(spark, ["x"]), word_tokenizer_path(), seq_len=100)


# ---- license scan -----------------------------------------------------------------------------


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def places_brute(t):
    w = words_of(t)
    return sorted((k, label) for p, label in L.PHRASES for k in range(len(w) - len(p.split()) + 1) if w[k : k + len(p.split())] == p.split())


def test_places_and_labels(spark):
    texts = [*ODD, "Licensed under CC BY-NC 4.0.", "cc by cc-by CC.BY ccby", "GNU General\nPublic  License, general public license", "All rights reserved. all rights, reserved",
             "Released under the MIT License.", "released under the MIT licence", "Licensed under the Apache License, Version 2.0.",
             "x " * 50 + L.TEMPLATES[2][1].upper() + " y" * 50, L.TEMPLATES[2][1].replace("software and", "software z and"), "general public general public license", "rights reserved all"]
    rng = random.Random(2)
    some = "cc by general public license all rights reserved the of software".split()
    texts += [" ".join(rng.choice(some) for _ in range(60)) for _ in range(60)]
    got = {r.doc_id: r for r in L.license_spans(table(spark, texts)).collect()}
    final = {r.doc_id: r for r in L.digest(L.license_spans(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = places_brute(t)
        assert got[i].n_words == len(words_of(t))
        assert sorted((p.start, p.label) for p in got[i].places) == want
        r = final[i]
        assert (r.n_base, r.first_word, r.last_word) == (len(want), want[0][0] if want else None, want[-1][0] if want else None)
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    at = len(ODD)
    labels = [final[at + k].labels for k in range(11)]
    assert labels[0] == "cc-by,cc-by-nc-4.0" and labels[4] == "mit" and labels[5] == "mit" and labels[6] == "apache-2.0" and labels[7] == "mit" and labels[8] == "mit"
    assert L.license_spans(table(spark, texts).limit(0)).count() == 0


def test_matching_statistics_match_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        a = L.SuffixAutomaton(seqs)
        text = [rng.randrange(3) for _ in range(40)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, (v, n) in enumerate(a.statistics(text), 1):
            want = next((k for k in range(min(i, 9), 0, -1) if tuple(text[i - k : i]) in subs), 0)
            assert n == want
            if n:
                ends = {(s, e) for s, q in enumerate(seqs) for e in range(n - 1, len(q)) if q[e - n + 1 : e + 1] == text[i - n : i]}
                assert a.positions(v) == sorted(ends)


# ---- classifier -------------------------------------------------------------------------------


def labelled(n=900, seed=4):
    rng = random.Random(seed)
    good = [f"wor{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 3 == 0
        w = [rng.choice(good) for _ in range(rng.randint(20, 60))]
        kind = i % 2
        text = " ".join(x + "%%%" for x in w) if junk and kind else " ".join([w[0]] * 30 + [w[1]] * 30) if junk else " ".join(w)
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    rows += [(5_000, None), (5_001, ""), (None, "wor1 wor2"), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = C.classified(docs, spark.createDataFrame([*labels, (None, 1, 0), (6, None, 0), (9_999, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    seen = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(seen) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in seen) >= 0.97 * len(seen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    assert len({r.score for r in got if r.doc_id in (5_000, 5_001)}) == 1


def test_labels_of_held_out_rows_are_never_used(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    a, b = (C.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert np.array_equal(a.w, b.w) and (a.slope, a.offset) == (b.slope, b.offset)


def test_bounded_fit_and_degenerate_labels(spark):
    rows, labels = labelled(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = C.train(docs, lab, fit_rows=100, curve_rows=50)
    s = {r.doc_id: r.predicted for r in C.score(docs, m).collect()}
    assert sum(s[i] == q for i, q, _ in labels) >= 0.95 * len(labels)
    assert {r.score for r in C.classified(docs, lab.where("false")).collect()} == {0.5}
    assert all(r.score > 0.99 for r in C.classified(docs, lab.where("quality = 1")).collect())
    assert C.classified(docs.limit(0), lab).count() == 0
