import random

import pytest

from gleaner.llm import subjects

WORDS = {"sport": "goal striker match league medal referee", "law": "court judge statute verdict plaintiff jury", "arts": "opera novel painting poem canvas melody"}
GENERIC = ["The page was changed by {}.", "{} was born in a town.", "The table below names {}."]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    for i in range(n):
        kinds = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        parts, count = [], {k: 0 for k in kinds}
        for j in range(rng.randint(4, 8)):
            k = kinds[j % len(kinds)]
            a, b = rng.sample(WORDS[k].split(), 2)
            parts.append(f"{name()} saw the {a} and the {b} near {name()} in {rng.randint(1900, 2000)}.")
            count[k] += 1
        parts.insert(2, rng.choice(GENERIC).format(name()))
        docs.append((i, " ".join(parts)))
        truth[i] = {k for k, c in count.items() if c >= 0.25 * len(parts)}
        if rng.random() < 0.15:
            labels.append((i, rng.choice([kinds[0], kinds[0].upper() + " ", kinds[0]]) if rng.random() < 0.95 else rng.choice([None, "nonsense", "law"])))
    return docs, truth, labels


def test_subjects_of_held_out_documents(spark):
    docs, truth, labels = corpus(600, 8)
    docs += [(9000, None), (9001, ""), (9002, "  \n "), (9003, "Read more"), (0, docs[0][1]), (9004, "goal. " * 3000)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(k, "") for k in WORDS], "subject string, description string")
    rows = subjects.subjects(d, "doc_id", "text", areas, spark.createDataFrame(labels, "doc_id long, subject string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held_out = set(truth) - {i for i, _ in labels}
    assert sum(got.get(i, set()) == truth[i] for i in held_out) > 0.95 * len(held_out)
    assert not got.keys() & {9000, 9001, 9002, 9003} and got[9004] == {"sport"}
    assert len(rows) == len({tuple(r) for r in rows})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    areas = spark.createDataFrame([("a", None)], "subject string, description string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.subjects(docs, "doc_id", "text", areas, labels).count() == 0
    some = spark.createDataFrame([(1, "one two three.")], "doc_id long, text string")
    assert subjects.subjects(some, "doc_id", "text", areas.where("false"), labels).count() == 0


def test_sentences_that_recur_in_many_documents_count(spark):
    docs, _, labels = corpus(300, 3)
    hot = "The goal and the striker. The match of the league."  # short sentences, a third of the rows
    docs = [(i, t + " Read more.") for i, t in docs] + [(1000 + i, hot) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([(k, "") for k in WORDS], "subject string, description string")
    model = subjects.fit(d, "doc_id", "text", areas, spark.createDataFrame(labels, "doc_id long, subject string"))
    rows = model.shares().collect()
    assert {r["subject"] for r in rows if r["doc"] >= 1000} == {"sport"} and len({r["doc"] for r in rows if r["doc"] >= 1000}) == 150
    texts = dict(docs)
    assert all(r["n_all"] == len(subjects.sentences_of(texts[r["doc"]])) for r in rows)


def test_the_tree_decides(spark):
    """With one leaf nothing tells subjects apart; repeated areas and clashing columns do no harm."""
    docs, truth, labels = corpus(400, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([(k, "") for k in WORDS] + [("law", None)], "subject string, description string")
    named = spark.createDataFrame(labels, "doc_id long, subject string")

    def right(leaves):
        got = {}
        for r in subjects.subjects(d, "doc_id", "text", areas, named, leaves=leaves).collect():
            got.setdefault(r["doc_id"], set()).add(r["subject"])
        return sum(got.get(i, set()) == t for i, t in truth.items()) / len(truth)

    assert right(1) < 0.5 < 0.95 < right(24)


def test_too_many_areas_are_an_error(spark):
    docs = spark.createDataFrame([(1, "one two three.")], "doc_id long, text string")
    areas = spark.createDataFrame([("a", ""), ("b", ""), ("c", "")], "subject string, description string")
    with pytest.raises(ValueError):
        subjects.fit(docs, "doc_id", "text", areas, None, most_areas=2)
