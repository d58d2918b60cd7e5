"""CSV readers (fixed schemas, year from path, index column dropped), sinks with resume, streaming."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from billcov.sources import readers, sinks
from billcov.operators import similarity
from tests.conftest import SF_SMALL


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_yearly_reader_types_year_and_index(spark):
    root = tempfile.mkdtemp(prefix="run-")
    _write(f"{root}/2015/csv/bills.csv", ',bill_id,bill_number,title,last_action,last_action_date\n'
                                         '0,1,HB1,"Taxes; schools",Chapter 3,2015-05-01\n1,2,SB2,"Multi\nline",,2015-06-01\n')
    _write(f"{root}/2016/csv/bills.csv", ',bill_id,bill_number,title,last_action,last_action_date\n0,3,HB3,T,Held,2016-01-02\n')
    df = readers.read_session_table(spark, root, "bills")
    assert df.columns == ["bill_id", "bill_number", "title", "last_action", "last_action_date", "year"]
    rows = {r.bill_id: r for r in df.collect()}
    assert rows[2].title == "Multi\nline" and rows[2].last_action is None and rows[2].year == "2015"
    only = readers.read_session_table(spark, root, "bills", years=[2016], blank_text="empty")
    assert [r.bill_id for r in only.collect()] == [3]
    blank = readers.read_session_table(spark, root, "bills", years=[2015], blank_text="empty")
    assert {r.bill_id: r.last_action for r in blank.collect()}[2] == ""


def test_article_reader_sites(spark):
    root = tempfile.mkdtemp(prefix="run-")
    hdr = ",Author,Title,Text,URL,Bill,Year\n"
    _write(f"{root}/azcen_articletext_2015.csv", hdr + '0,A,T,x,u1,HB1,2015\n')
    _write(f"{root}/azcen_articletext_all.csv", hdr + '0,A,T,x,u1,HB1,2015\n')
    _write(f"{root}/az_capitol_times.csv", hdr + '0,T2,A2,y,u2,HB2,2016\n')
    df = readers.read_articles(spark, root, sites=("azcentral", "azcapitoltimes"))
    got = sorted((r.site, r.URL, r.Year) for r in df.collect())
    assert got == [("azcapitoltimes", "u2", 2016), ("azcentral", "u1", 2015)]


def test_append_new_is_idempotent(spark):
    out = tempfile.mkdtemp(prefix="run-") + "/t"
    df = spark.createDataFrame([("HB1", 2015, "a"), ("HB2", 2015, "b")], "Bill string, Year int, x string")
    sinks.append_new(df, out, keys=["Bill", "Year"], partition_by=["Year"])
    sinks.append_new(df, out, keys=["Bill", "Year"], partition_by=["Year"])  # resume: nothing new
    more = spark.createDataFrame([("HB3", 2016, "c"), ("HB1", 2015, "a")], "Bill string, Year int, x string")
    sinks.append_new(more, out, keys=["Bill", "Year"], partition_by=["Year"])
    assert sorted((r.Bill, r.Year) for r in spark.read.parquet(out).collect()) == [("HB1", 2015), ("HB2", 2015), ("HB3", 2016)]


def test_dynamic_partition_overwrite(spark):
    out = tempfile.mkdtemp(prefix="run-") + "/t"
    a = spark.createDataFrame([("s", 2015, 1), ("s", 2016, 2)], "site string, Year int, n int")
    sinks.write_table(a, out, partition_by=["site", "Year"])
    sinks.write_table(spark.createDataFrame([("s", 2016, 9)], "site string, Year int, n int"), out, partition_by=["site", "Year"])
    assert sorted((r.Year, r.n) for r in spark.read.parquet(out).collect()) == [(2015, 1), (2016, 9)]


def test_streaming_extraction_resumes_exactly_once(spark):
    from billcov.streaming.incremental import start_extraction

    d = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{d}/landing")
    shutil.copy(f"{SF_SMALL}/pages.parquet", f"{d}/landing/part-0.parquet")
    n = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    start_extraction(spark, f"{d}/landing", f"{d}/out", f"{d}/ckpt").awaitTermination(180)
    assert spark.read.parquet(f"{d}/out").count() == n
    start_extraction(spark, f"{d}/landing", f"{d}/out", f"{d}/ckpt").awaitTermination(180)
    assert spark.read.parquet(f"{d}/out").count() == n  # restart: already-processed files skipped


def test_similarity_prefix_filter_equals_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [
        ("HB1", "2015", base),
        ("HB2", "2016", base),                                   # exact copy, later year
        ("HB3", "2017", base + " lambda"),                       # 10/11 ≈ 0.91 with HB1
        ("HB4", "2014", base.replace("kappa", "mu nu omicron")), # 9/13 ≈ 0.69
        ("HB5", "2018", "completely different words here"),
        ("HB6", "2019", ""),
    ]
    df = spark.createDataFrame(texts, "bill_number string, year string, text string")
    got = {r.bill_number: r.Bill_Sim_Binary for r in similarity.similarity_flags(df, 0.8).collect()}

    def toks(t):
        return set(w for w in t.lower().split() if w)

    want = {}
    for b, y, t in texts:
        a = toks(t)
        want[b] = int(bool(a) and any(
            int(y2) < int(y) and toks(t2) and len(a & toks(t2)) / len(a | toks(t2)) >= 0.8
            for b2, y2, t2 in texts if b2 != b))
    assert got == want == {"HB1": 0, "HB2": 1, "HB3": 1, "HB4": 0, "HB5": 0, "HB6": 0}
