import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import sampling, splits

WRITTEN = ["Nirámi_Open_1", "nirámi open 1", "tables/Nirámi_Open_0.json", "Nir%C3%A1mi%20Open%201", "\tNirámi_Open_2\n", "NIRÁMI_OPEN_1.JSON", "tables%2FNirámi_Open_3", " Nirámi Open 2 ", "%20Nir%C3%A1mi_Open_12%20"]


def test_pages(spark):
    rows = [(x,) for x in [*WRITTEN, None, " ", "", "Squad_7_(men)_0", "Squad_7_0", "100%_x_1", "a+b_1"]]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(splits.page_of(F.col("x"))).collect()]
    assert set(got[: len(WRITTEN)]) == {"nirami_open"}
    assert got[len(WRITTEN) :] == [None, None, None, "squad_7_(men)", "squad_7", "100%_x", "a+b"]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, e in edges:
        if r is not None and e is not None:
            parent[find(("r", r))] = find(("e", e))
    groups = defaultdict(set)
    for r, e in edges:
        if r is not None and e is not None:
            groups[find(("r", r))].add(r)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"r{rng.randint(0, 60)}", f"e{rng.randint(0, 70):02}") for _ in range(70)] + [(f"c{i}", f"x{j:02}") for i in range(30) for j in (i, i + 1)] + [(None, "e1"), ("r1", None)]
    got = defaultdict(set)
    rows = splits.components(spark.createDataFrame(edges, "r string, e string"), "r", "e").collect()
    for r in rows:
        got[r["component"]].add(r["r"])
    assert len(rows) == len({r["r"] for r in rows}) and {frozenset(g) for g in got.values()} == brute_components(edges)


def test_divided_and_assigned(spark):
    rng = random.Random(4)
    rows = [(i, f"g{int(40 * rng.random() ** 3)}" if i % 10 else None, "abc"[i % 3], rng.choice(["x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, label string, split string")
    by = defaultdict(set)
    for _, g, _, s in rows:
        by[g].add(s)
    assert {r[0] for r in splits.divided(df, "id", "g", "split").collect()} == {r[0] for r in rows if r[1] and len(by[r[1]]) > 1}
    out = splits.assign(df.unionByName(df), "id", "g", "label", [("train", 0.7), ("test", 0.2), ("dev", 0.1)]).collect()
    assert len(out) == 3000
    where = defaultdict(set)
    for r in out:
        if r["component"] is not None:
            where[r["component"]].add(r["split"])
    assert all(len(s) == 1 for s in where.values())
    share = Counter(r["split"] for r in out)
    assert abs(share["train"] / 3000 - 0.7) < 0.05 and share["dev"] > 0 and share["test"] > 0
    assert splits.assign(df.where("false"), "id", "g", "label", [("train", 1.0)]).count() == 0


NODE = "array<struct<entity:string,row_index:int,col_index:int,link_id:string,node_source:string>>"


def questions(spark, rows):
    return spark.createDataFrame([(i, q, a, n, t) for i, (q, a, n, t) in enumerate(rows)], f"n int, question string, answer_text string, answer_node {NODE}, ingested_at int").withColumn("question_id", F.concat(F.lit("q"), F.col("n")))


@pytest.mark.parametrize("text,kind", [("1,234.5", "numeric"), ("-7", "numeric"), ("7-9", "numeric"), ("1.2.3", "text"), ("4 May", "text"), ("", "text"), (None, "text"), ("٣", "numeric"), (" 5 ", "numeric"), ("5%", "text")])
def test_answer_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "x string").select(sampling.answer_kind(F.col("x"))).first()[0] == kind


def test_attributes(spark):
    ann = lambda s: [("Ann Lee", 0, 0, None, s)]
    df = questions(spark, [("Who is the SECOND most-liked ann  lee?", "x", ann("passage"), 1), ("difference between", "x", ann("passage") + ann("table"), 1), ("x", "x", ann("table"), 1), (None, "x", None, 1), ("x", "x", [(None, 0, 0, None, None)], 1), ("annlee", "x", [None], 1)])
    got = [tuple(r) for r in df.orderBy("n").select(*list(sampling.attributes().values())[1:]).collect()]
    assert got == [("passage", "bridge_mentioned", "ordinal+superlative"), ("mixed", "table_to_text_likely", "comparison_or_count"), ("table", "table_answer", "other"), ("unknown", "table_answer", "other"), ("unknown", "table_answer", "other"), ("unknown", "table_answer", "other")]


TARGET = "plan_id int, strat_name string, category string, target_share double, min_rows long, sample_rows long"


def test_report_and_sample(spark):
    rows = [("x", str(i) if i % 4 else "word", None, 1) for i in range(2000)] + [("x", None, None, 1), ("x", " ", None, 1)]
    q = questions(spark, rows)
    q = q.unionByName(q.withColumn("ingested_at", F.lit(2)))  # delivered again
    targets = spark.createDataFrame([(1, "answer_kind", "numeric", 0.6, 0, 500), (1, "answer_kind", "text", 0.4, 0, 500), (2, "answer_kind", "text", 0.9, 600, 400), (2, "answer_kind", "numeric", 0.1, 0, 400), (3, "answer_kind", "none such", 1.0, None, 3), (3, "no_such_name", "a", 1.0, 0, 3), (4, "answer_kind|answer_source", "text|unknown", 1.0, 0, 7)], TARGET)
    unmet = {(r["plan_id"], r["category"]) for r in sampling.unmet(q, targets).collect()}
    assert unmet == {(2, "text"), (3, "none such"), (3, "a")}
    drawn = sampling.sample(q, targets).collect()
    assert Counter((r["plan_id"], r["category"]) for r in drawn) == {(1, "numeric"): 300, (1, "text"): 200, (2, "text"): 500, (2, "numeric"): 40, (4, "text|unknown"): 7}
    assert len({(r["plan_id"], r["question_id"]) for r in drawn}) == len(drawn)
    assert sampling.report(q.where("false"), targets).where("available > 0").count() == 0
    assert sampling.sample(q, targets.where("false")).count() == 0
