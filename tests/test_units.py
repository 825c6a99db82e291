import pytest
from pyspark.sql import functions as F

from gleaner.operators import units as U

CASES = [
    ("$ 2208.37 (000s)", "USD", None, "money", 2208370.0),
    ("USD 259,000 K", None, None, "money", 259e6),
    ("USD (14,493,000)", None, None, "money", -14493000.0),
    ("-$5.2MM", None, None, "money", -5.2e6),
    ("US$5.4979B", None, None, "money", 5.4979e9),
    ("13 770 000", "¢", None, "money", 137700.0),
    ("1 h 19 min 32.8 s", None, None, "time", 4772.8),
    ("01:19:32.8", None, None, "time", 4772.8),
    ("5 ft 3 in", None, None, "length", 1.6002),
    ("5' 3\"", None, None, "length", 1.6002),
    ("a ratio of −0.5", "ratio", None, "ratio", -0.5),
    ('["(8)"]', "percent", None, "ratio", -0.08),
    ("3 per thousand", None, None, "ratio", 0.003),
    ("49.1 thousand", None, "How many in 2008 in thousands of persons?", "persons", 49100.0),
    ("5.2", "persons (000s)", None, "persons", 5200.0),
    ("5.2", "USD '000", None, "money", 5200.0),
    ("$ 5.2", "thousands", None, "money", 5200.0),
    ("186.5", None, "How large at the end of 2006 in square kilometres?", "area", 186.5e6),
    ("23.7", None, "What in 1998 (in percent)?", "ratio", 0.237),
    ("42m", None, None, "length", 42.0),
    ("USD 102m", None, None, "money", 102e6),
    ("2 metric tons", "t", None, "mass", 2000.0),
    ('{"value": 7}', "acres", None, "area", 28327.9949568),
]


@pytest.mark.parametrize("text,unit,question,kind,amount", CASES)
def test_amounts(text, unit, question, kind, amount):
    value, _, got, factor = U.read_amount(text, unit, question)
    assert got == kind and value * factor == pytest.approx(amount, rel=1e-9)


@pytest.mark.parametrize("text", [None, "", " ", "yes", "null", "true", "[]", "[1, 2]", "{}", "4 May 1966", "7-9", "nan", "x" * 10000, "[" * 2000])
def test_what_is_no_amount(text):
    assert U.read_amount(text, "kg", None) is None


def test_bare_numbers_have_no_unit():
    assert U.read_amount("84", None, "Which river?")[2] is None


def test_propagation_finds_unknown_notations(spark):
    """A notation nobody knows gets its factor from links, and noise does no harm."""
    links = [("# zorks||", 2.0 + i, "kg||", (2.0 + i) * 1000) for i in range(9)] + [("# zorks||", 5.0, "kg||", 3.0 + i) for i in range(4)]
    links += [("# bliks||", 3.0 + i, "# zorks||", (3.0 + i) / 1e6) for i in range(5)]
    df = spark.createDataFrame(links, "a string, x double, b string, y double")
    anchors = spark.createDataFrame([("kg||", "mass", 1.0)], "notation string, kind string, factor double")
    got = {r["notation"]: (r["kind"], r["factor"], r["hops"]) for r in U.propagate(anchors, U.snapped_votes(df)).collect()}
    assert got["# zorks||"] == ("mass", 1000.0, 1) and got["# bliks||"] == ("mass", 0.001, 2)


def test_offsets_travel_along_lines(spark):
    links = [("# celsius||", float(i), "# fahrenheit||", i * 1.8 + 32) for i in range(1, 60)] + [("# celsius||", float(i), "# kelvin||", i + 273.15) for i in range(1, 60)]
    df = spark.createDataFrame(links, "a string, x double, b string, y double")
    anchors = spark.createDataFrame([("# kelvin||", "temperature", 1.0)], "notation string, kind string, factor double")
    got = {r["notation"]: (r["factor"], r["offset"], r["hops"]) for r in U.propagate(anchors, U.snapped_votes(df), U.lines(df)).collect()}
    assert got["# celsius||"] == (1.0, 273.15, 1)
    factor, offset, hops = got["# fahrenheit||"]
    assert factor * 212 + offset == pytest.approx(373.15) and hops == 2


def test_hidden_notations_come_back(spark):
    rows = [("km", "m", 1000.0), ("mi", "km", 1.609344), ("m", "km", 0.001), ("kg", "lb", 1 / 0.45359237), ("g", "kg", 0.001)]
    links = [(f"{a}||", 3.0 + i, f"{b}||", (3.0 + i) * s) for a, b, s in rows for i in range(6)] + [("km||", 7.0, "kg||", 7.0)]
    df = spark.createDataFrame(links, "a string, x double, b string, y double")
    recorded = spark.createDataFrame([(f"{n}||", *U.read_amount("1 " + n, None, None)[2:]) for n in ("km", "mi", "m", "kg", "lb", "g")] + [("? ||", None, None)], "notation string, kind string, factor double")
    got = U.recovered(recorded, df).collect()
    assert len(got) == 6 and all(r["supported"] and (r["kind"], r["factor"]) == (r["kind_told"], r["factor_told"]) for r in got)


def test_known_offsets(spark):
    df = spark.createDataFrame([("celsius||", float(i), "fahrenheit||", i * 1.8 + 32) for i in range(1, 60)], "a string, x double, b string, y double")
    (r,) = U.pairwise(df).collect()
    assert r["line_scale"] == pytest.approx(1.8) and r["known_offset"] == 32.0


def test_amounts_over_tables(spark):
    df = spark.createDataFrame([(1, "5 kg", None, "clash"), (2, None, "kg", None), (3, "x", None, None)], "id int, text string, unit string, value string")
    out = U.amounts(df, ["id"], F.col("text"), F.col("unit"), F.lit(None))
    assert [tuple(r) for r in out.collect()] == [(1, 5.0, "kg||", "mass", 1.0)]
    assert U.amounts(df.where("false"), ["id"], F.col("text"), F.col("unit"), F.lit(None)).count() == 0


def test_propagation_reaches_notations_many_hops_away(spark):
    anchors = spark.createDataFrame([("n0", "money", 1.0)], "notation string, kind string, factor double")
    votes = spark.createDataFrame([(f"n{i + 1}", f"n{i}", 0.0, 1000) for i in range(10)], "a string, b string, s double, n long")
    assert {(r["notation"], r["kind"], r["hops"]) for r in U.propagate(anchors, votes).collect()} == {(f"n{i}", "money", i) for i in range(11)}
