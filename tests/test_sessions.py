"""Session folders: written by year, and a filter on the year reads only that year's files."""

from billcov.sources import fixtures as fx
from billcov.sources import readers, sinks
from tests.conftest import SF_SMALL


def files_read(df):
    """Files that the executed scans opened."""
    found = []

    def walk(node):
        m = node.metrics()
        if m.contains("numFiles"):
            found.append(m.apply("numFiles").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_a_year_filter_reads_only_its_files(spark, tmp_path):
    bills = fx.bills(spark, SF_SMALL)
    root = sinks.write_sessions(bills, "bills", root=str(tmp_path))
    everything = readers.read_session_table(spark, root, "bills")
    total = files_read(everything)
    one = everything.where("year = '1995'")
    assert 0 < files_read(one) == files_read(readers.read_session_table(spark, root, "bills", years=[1995])) < total
    cols = ["bill_id", "bill_number", "title", "last_action", "last_action_date", "year"]
    assert sorted(map(str, everything.select(*cols).collect())) == sorted(map(str, bills.select(*cols).collect()))
    assert {r.year for r in one.collect()} == {"1995"} and one.count() == bills.where("year = '1995'").count()


def test_odd_text_survives_the_folders(spark, tmp_path):
    rows = [(1, "HB1", '  "quoted", and\nbroken\r\nlines; ', None, None, "2016"), (2, "SB2", "", "é\t", None, "2016")]
    df = spark.createDataFrame(rows, "bill_id long, bill_number string, title string, last_action string, last_action_date date, year string")
    root = sinks.write_sessions(df, "bills", root=str(tmp_path))
    got = sorted(map(tuple, readers.read_session_table(spark, root, "bills").collect()))
    assert got[1][2] is None and got[1][3] == "é\t"  # a blank cell is null, as in the reference
    assert got[0][2].replace("\r\n", "\n") == rows[0][2].replace("\r\n", "\n")
