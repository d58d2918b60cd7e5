"""Suffix rules learned from pairs, and their use on words that the table lacks."""

from billcov.operators import lemmas as L

PAIRS = [("taxes", "tax"), ("boxes", "box"), ("foxes", "fox"), ("cities", "city"), ("duties", "duty"), ("bodies", "body"), ("roads", "road"), ("cars", "car"), ("funds", "fund"),
         ("children", "child"), ("water", "water"), ("paper", "paper"), ("order", "order")]


def test_rules_take_the_majority_of_the_longest_suffix(spark):
    rules = {r.suffix: (r.strip, r.ending) for r in L.learned(spark.createDataFrame([*PAIRS, (None, "x"), ("y", None)], "form string, lemma string")).collect()}
    assert rules["xes"] == (2, "") and rules["ies"] == (3, "y") and rules["er"] == (0, "")
    assert "ren" not in rules and "hildren" not in rules  # one pair only, or too long
    assert rules["es"] == (2, "")  # three of "xes" and three of "ies": the shorter strip


def test_titles_keep_order_and_unknown_words(spark):
    pairs = spark.createDataFrame(PAIRS, "form string, lemma string")
    rows = [("HB1", "2015", ["indexes", "children", "counties", "zzz", "barrier", "children"]), ("HB2", "2015", []), ("HB3", "2016", ["s"])]
    df = spark.createDataFrame(rows, "bill_number string, year string, tokens array<string>")
    got = {r.bill_number: r.title_lemmas for r in L.lemmatised(df, pairs).collect()}
    assert got == {"HB1": "index child county zzz barrier child", "HB2": "", "HB3": "s"}
    none = spark.createDataFrame([], "form string, lemma string")
    assert {r.bill_number: r.title_lemmas for r in L.lemmatised(df, none).collect()}["HB1"] == "indexes children counties zzz barrier children"
