"""Completion ledger: bills pass once, complete years are skipped, restarts write nothing twice."""

from collections import Counter

import pytest

from billcov.streaming import ledger as L


def put(spark, rows, path):
    spark.createDataFrame(rows, "site string, year string, bill string").coalesce(1).write.mode("append").parquet(str(path))


def test_bills_pass_once_and_complete_years_are_skipped(spark, tmp_path):
    totals = spark.createDataFrame([("2015", 3), ("2016", 5)], "year string, total int")
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    run = lambda: L.run_ledger(spark, src, totals, out, ckpt)
    got = lambda: Counter((r.site, r.year, r.bill) for r in spark.read.parquet(out).collect())
    put(spark, [("a", "2015", "HB1"), ("a", "2015", "HB1"), ("a", "2016", "HB9"), ("b", "2015", "HB1"), ("a", None, "HB1"), (None, "2015", "x"), ("a", "2099", "HB1")], src)
    run()
    first = Counter([("a", "2015", "HB1"), ("a", "2016", "HB9"), ("b", "2015", "HB1"), ("a", "2099", "HB1")])
    assert got() == first
    run()  # nothing new
    assert got() == first
    put(spark, [("a", "2015", "HB2"), ("a", "2015", "HB3"), ("a", "2015", "HB1")], src)
    put(spark, [("a", "2015", "HB4"), ("a", "2015", "HB2"), ("b", "2015", "HB2")], src)  # the year of site a is complete by now
    run()
    assert got() == first + Counter([("a", "2015", "HB2"), ("a", "2015", "HB3"), ("b", "2015", "HB2")])
    done = {(r.site, r.year): (r.bills_done, r.bills_total, r.complete) for r in L.progress(spark.read.parquet(out)).collect()}
    assert done == {("a", "2015"): (3, 3, True), ("a", "2016"): (1, 5, False), ("b", "2015"): (2, 3, False), ("a", "2099"): (1, None, False)}


def test_a_killed_batch_is_repeated_once(spark, tmp_path, monkeypatch):
    totals = spark.createDataFrame([("2015", 9)], "year string, total int")
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    put(spark, [("a", "2015", "HB1")], src)
    L.run_ledger(spark, src, totals, out, ckpt)
    put(spark, [("a", "2015", "HB1"), ("a", "2015", "HB2")], src)

    def broken(key, batches, state):
        list(batches)
        state.update((["lost"], 9))
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(L, "_advance", broken)
        with pytest.raises(Exception, match="killed"):
            L.run_ledger(spark, src, totals, out, ckpt)
    L.run_ledger(spark, src, totals, out, ckpt)
    assert sorted(r.bill for r in spark.read.parquet(out).collect()) == ["HB1", "HB2"]
