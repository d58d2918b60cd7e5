"""The pipeline against a brute-force version of its stages, and the guard in the driver's entry."""

import importlib
import random
import sys
from collections import Counter, defaultdict

import corpus_pipeline
from billcov.llm import quality_rules as Q
from billcov.llm import source_mixing as M
from billcov.llm.queries import word_tokenizer_path
from tests.llm.test_dedup_ops import components_brute, exact_brute
from tests.llm.test_native_ops import poisson_brute, uniform_brute
from tests.llm.test_text_ops import base_counts, check_pieces, lines_brute


def documents(n=160):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(rng.randint(1, 8)))
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "hot", len(text)))
    for i in range(n, n + 30):  # exact copies (but for white space), near copies, junk
        d = rows[rng.randrange(n)]
        text = d[1].replace(" ", "  ", 3) if i % 3 == 0 else d[1] + " tail" if i % 3 == 1 else "no no " * 60
        rows.append((i, text, "en", "hot", len(text)))
    banner = " ".join(f"menu{k}" for k in range(70))
    for i in range(n + 30, n + 60):  # pages of a banner and little else, on one host: too many for the line rule
        text = banner + "\n" + " ".join(rng.choice(words) for _ in range(10))
        rows.append((i, text, "en", "hot", len(text)))
    rows.append((n + 60, banner + "\nother words " + rows[0][1], "en", "s1", 500))  # the banner on another host
    return [*rows, (900, None, None, None, None), (901, "", "en", "hot", 0), (902, "short text", "en", "s1", 10)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    lines = lines_brute([(r[0], r[3], r[1]) for r in rows], Q.MAX_DOCS_PER_HOST, 1, Q.MIN_REMAINING_PERCENT)
    assert sum(gone > 0 for gone, _ in lines.values()) == 30
    rows = [r for r in rows if not base_counts(r[1])[-1] and lines[r[0]][1]]
    keep = exact_brute([r[:2] for r in rows])
    rows = [r for r in rows if keep[r[0]][2]]
    comp = components_brute([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    chars = defaultdict(int)
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    weight = {s: c**M.TEMPERATURE for s, c in chars.items() if c}
    copies = {}
    for i, _, _, s, _ in rows:
        rate = round(weight[s] / sum(weight.values()) * sum(chars.values()) / chars[s], 9)
        copies[i] = poisson_brute(uniform_brute(M.SEED, i, 0), rate)
    return rows, copies


def test_stages_match_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept, copies = brute(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "ngram_join":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept)
    assert 0 < len(kept) < 165
    assert Counter(r.doc_id for r in docs.collect()) == Counter({i: c for i, c in copies.items() if c})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer_path())
    # Copies of a document are packed one by one; here each is checked as a text of its own.
    starts = defaultdict(Counter)
    for p in pieces:
        starts[p.doc_id][p.start] += 1
    assert {i: c[0] for i, c in starts.items()} == {i: c for i, c in copies.items() if c}
    text = {r[0]: r[1] for r in kept}
    total = sum(c * (len(tok.encode(text[i], add_special_tokens=False).ids) + 1) for i, c in copies.items())
    assert sum(p.length for p in pieces) == total


def test_run_equals_its_stages(spark, tmp_path):
    rows = documents(60)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    kept, copies = brute(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {i for i, c in copies.items() if c}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()} and "pipeline" in entry.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        without = importlib.reload(entry)
        assert "pipeline" not in without.queries() and "bill_features" in without.queries()
        assert set(without.oracle_sql()) <= set(without.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_packing_pieces_helper_covers_long_documents(spark):
    from tokenizers import Tokenizer

    from billcov.llm import packing

    texts = ["w1 " * 9000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack_documents(df, word_tokenizer_path()).collect(), texts, Tokenizer.from_file(word_tokenizer_path()), 4096)
