"""Every fixture view gives the same rows in both engines."""

import pytest

from billcov.sources import fixtures as fx
from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of


@pytest.mark.parametrize("name", sorted(fx.VIEW_SQL))
def test_view_is_the_same_in_both_engines(spark, duck, name):
    df = getattr(fx, name)(spark, SF_SMALL)
    needs = [name] if name != "bill_texts" else ["bills", "bill_texts"]
    got = duck.execute(fx.with_views(f"SELECT * FROM {name}", *needs))
    columns = [d[0] for d in got.description]
    shared = [c for c in columns if c in df.columns]
    assert shared and set(df.columns) <= set(columns)
    at = [columns.index(c) for c in shared]
    theirs = [tuple(r[i] for i in at) for r in got.fetchall()]
    mine = [tuple(r) for r in df.select(*shared).collect()]
    assert rows_of(shared, mine) == rows_of(shared, theirs)


def test_article_texts_do_not_travel(spark):
    """The few orders that articles can meet go to the articles, so that no whole text is shuffled."""
    from billcov.sources import fixtures as fx

    plan = fx.articles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_bill_titles_from_odd_texts(spark, tmp_path):
    """Title words are what splitting the whole text gives: empty parts, few words, line ends, nulls."""
    texts = ["", "a", "a  b", ".a,b\nc d", None, " x", "\u00fc\U0001d4b3.b\r\n\tc d", "one two three four." * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1, 9).selectExpr("id AS o_orderkey", "timestamp'1997-01-01' AS o_orderdate", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    parts = lambda t: (t.translate(str.maketrans(".,\n", "   ")).split(" ") + ["", ""])[:3]
    want = {i: None if t is None else "{}; {};{}".format(*parts(t)) for i, t in enumerate(texts)}
    got = {r.bill_id % 8: r.title and r.title.removesuffix("; R&D 2020") for r in fx.bills(spark, str(tmp_path)).collect()}
    assert got == want
