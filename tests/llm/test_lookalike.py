import itertools
import random

import pytest

from gleaner.llm import lookalike as L

SAME = [("Vopus", "Vo﻿pus"), ("forward", "fοrԝаrԁ"), ("daflfaltstad", "daﬂfаӏtѕtad"), ("Röro", "Rö‍ro"), ("ïb", "їb"), ("3 Oct", "３ Ｏｃｔ"), ("6-7", "6‑7"), ("a b", "a b"), ("x", "x️"), ("office", "oﬃce"), ("ëx", "ёx"), ("ӧ", "ö"), ("\u304c", "\u304b\u3099"), ("\uac00", "\u1100\u1161"), ("\uac01", "\u1100\u1161\u11a8"), ("\u212b", "\u00c5"), ("\u2126", "\u03a9"), ("\u1e69", "s\u0323\u0307")]
DIFFERENT = [("m²", "m2"), ("a", "á"), ("A", "a"), ("a_b", "a b"), ("Ж", "X"), ("é", "è"), ("1", "l"), ("a", ""), ("-", "–")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_looking(a, b):
    rw = L.default_rewriter()
    assert rw(a) == rw(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_differences_stay(a, b):
    rw = L.default_rewriter()
    assert rw(a) != rw(b)


def test_null_empty_and_long():
    rw = L.default_rewriter()
    assert rw(None) is None and rw("") == "" and rw("​﻿") == "" and rw("а" * 100_000) == "a" * 100_000


def test_rewriting_is_stable():
    rng = random.Random(1)
    letters = [x for x in L.classes() if x] + list("abc xyz")
    rw = L.default_rewriter()
    for _ in range(500):
        text = "".join(rng.choices(letters, k=6))
        assert rw(rw(text)) == rw(text)


def test_frequent_members_represent(spark):
    df = spark.createDataFrame([("рррр p",), ("ррр",), (None,), ("",)], "t string")
    table = L.learn(df, ["t"])
    assert table["p"] == "р" and L.Rewriter(table)("p-р") == "р-р"


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    forms = ["ab", "аb", "a​b", "cd", "сd", "c d", "c d", None, "", "​"]
    rows = [(i, rng.choice(["q1", "q2", None]), *(rng.choice(forms) for _ in range(3)), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, q string, h string, r string, t string, _k1 string")
    table = L.default_table()
    rw = L.Rewriter(table)
    expected = set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] is not None and a[1] == b[1] and a[2:5] != b[2:5] and [rw(x) for x in a[2:5]] == [rw(x) for x in b[2:5]]:
            expected.add((a[0], b[0]))
    got = L.same_looking_pairs(df, "id", "q", ["h", "r", "t"], table).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert L.same_looking_pairs(df.where("false"), "id", "q", ["h", "r", "t"]).count() == 0


def test_canonical_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "аb", "аb"), (1, None, None)], "id int, x string, y string")
    assert [tuple(r) for r in L.canonical(df, ["x"]).collect()] == [(1, "ab", "аb"), (1, None, None)] or L.learn(df, ["x"])["a"] == "а"


def test_one_variant_among_many_copies(spark):
    df = spark.range(4000).selectExpr("id", "'q' as q", "if(id = 7, 'a\u0430b', 'aab') as h").withColumn("r", L.F.lit("x")).withColumn("t", L.F.lit(None).cast("string"))
    assert L.same_looking_pairs(df, "id", "q", ["h", "r", "t"], L.default_table()).count() == 3999
