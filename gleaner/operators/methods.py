"""From a data set to answers: the pipeline, and the contexts of the methods it is compared with.

Every stage works on all questions at once.  A context is a text of at most ``limit`` characters a
question; what a provider makes of it is not this module's business.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import generation, graph, retrieval, score, search, tables, templates
from gleaner.session import materialize
from gleaner.sources import sinks
from gleaner.sources.adapters import Dataset, documents, oracle_evidence

KEY = ["question_id"]


def facts(data: Dataset, top_k: int = 5, budget: int = 3, provider: generation.Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of every question's graph, all table cells and what is found in its best passages of both stages; and
    the constraints of its tables.  A ``provider`` adds the facts it reads in these passages; a batch it fails on
    adds none.

    Self loops are left out.  ``edge_seq`` orders cells before texts, by place."""
    cells = tables.cell_facts(data.cells, ["question_id", "table_name"])
    cell_seq = F.row_number().over(Window.partitionBy(*KEY).orderBy("table_name", "row_index", "column_name"))
    from_cells = cells.select(*KEY, cell_seq.cast("long").alias("edge_seq"), "head", "relation", "tail", F.lit("table").alias("source_type"), F.col("table_name").alias("source_id"), "row_index")
    best, constraints = retrieval.retrieve(data.questions, data.cells, data.passages, top_k, budget)
    context = tables.passage_context(data.passages, KEY, "position", "text")
    texts = context.join(best.select(*KEY, "source_id"), [*KEY, "source_id"], "left_semi")
    found = tables.text_facts(texts, [*KEY, "source_type", "source_id", "position"], "text", "context_before")
    from_texts = found.select(*KEY, (F.lit(1 << 40) + F.col("position") * 8).cast("long").alias("edge_seq"), "head", "relation", "tail", "source_type", "source_id", F.lit(None).cast("int").alias("row_index"))
    both = from_cells.unionByName(from_texts)
    if provider is not None:
        named = texts.withColumn("_key", F.to_json(F.struct(*KEY, "source_type", "source_id", "position"))).withColumn("_prompt", F.concat(F.lit("Read the facts in this text as a JSON list of head, relation and tail.\n"), F.col("context_before"), F.lit("\n"), F.col("text")))
        told = generation.facts_of(generation.complete(named, "_key", "_prompt", provider), "_key")
        key = F.from_json("_key", "question_id string, source_type string, source_id string, position long")
        told = told.select(key["question_id"].alias("question_id"), (F.lit(1 << 41) + key["position"] * 8).cast("long").alias("edge_seq"), "head", "relation", "tail", key["source_type"].alias("source_type"), key["source_id"].alias("source_id"), F.lit(None).cast("int").alias("row_index"))
        both = both.unionByName(told)
    return graph.insert(both)[0], constraints


def candidates(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """Executed candidate answers of all templates and of anchored search, with their evidence."""
    q = questions.select(*KEY, "question", F.col("question_id").alias("q"))
    ref = F.struct("source_type", "source_id", "head", "relation", "tail")
    found = search.symbolic_search(q, "q", "question", edges, KEY).select(F.col("q").alias("question_id"), F.col("answer").alias("value"), "relation", "hops", "place")
    own = edges.select(*KEY, "relation", F.col("tail").alias("value"), ref.alias("ref"))
    paths = found.join(own, [*KEY, "relation", "value"]).groupBy(*KEY, "value", "relation", "hops", "place").agg(F.collect_set("ref").alias("evidence"))
    paths = paths.select(*KEY, (F.col("place") + 100).alias("candidate_pos"), "value", "evidence", F.size("evidence").alias("accessed"), F.col("hops").alias("n_steps"))
    made = templates.answers(q, "q", "question", edges, KEY).select(F.col("q").alias("question_id"), "place", "value")
    # what a template read: the facts of the entities that the question names, else of its tables
    named = q.join(edges.select(*KEY, "head", ref.alias("ref")), KEY).where(F.contains(T.normalize_key(F.col("question")), T.normalize_key(F.col("head"))))
    tabled = edges.where("source_type = 'table'").select(*KEY, ref.alias("ref"))
    of_named, of_tables = named.groupBy(*KEY).agg(F.collect_set("ref").alias("_n")), tabled.groupBy(*KEY).agg(F.collect_set("ref").alias("_t"))
    made = made.join(of_named, KEY, "left").join(of_tables, KEY, "left").withColumn("evidence", F.coalesce("_n", "_t", F.array().cast(paths.schema["evidence"].dataType)))
    made = made.select(*KEY, F.col("place").alias("candidate_pos"), "value", "evidence", F.size("evidence").alias("accessed"), F.lit(2).alias("n_steps"))
    return made.unionByName(paths).withColumn("success", F.lit(True))


def answer(data: Dataset, top_k: int = 5, budget: int = 3, programs: DataFrame | None = None, provider: generation.Provider | None = None) -> DataFrame:
    """``question_id, question, answer, prediction, score, confidence, mode``: the best grounded candidate of every
    question, null where none is admissible.

    ``programs`` (``question_id, success, value, evidence, accessed, n_steps, candidate_pos``) are executed programs
    that compete with the templates and the search."""
    edges, constraints = facts(data, top_k, budget, provider)
    edges, _ = graph.resolve(materialize(edges, "facts"), KEY)
    found = candidates(data.questions, edges)
    if programs is not None:
        found = found.unionByName(programs.select(found.columns))
    groups = data.questions.select(*KEY, T.relation_groups(F.col("question")).alias("groups"))
    policy = retrieval.constraint_policy(constraints, "question_id")
    found = found.join(groups, KEY).join(policy, KEY, "left").withColumn("need_table", F.coalesce("need_table", F.lit(False)))
    scored = score.score_candidates(found, "question_id").where("place = 1 and reason is null")
    best = scored.select(*KEY, score.render(F.col("value"), F.lit(None).cast("double"), F.when(F.col("value").isin("true", "false"), F.col("value") == "true")).alias("prediction"), "score", score.confidence(F.col("score")).alias("confidence"), "mode")
    return data.questions.select(*KEY, "question", "answer").join(best, KEY, "left")


def run(data: Dataset, path: str, method: Callable[[DataFrame], DataFrame], limit: int | None = None) -> None:
    """Run a method (questions to ``question_id, answer``) over what the output does not hold yet, and append
    ``question_id, question, gold, answer, metadata``; ``limit`` counts new questions."""

    def process(questions: DataFrame) -> DataFrame:
        got = method(questions).select(*KEY, F.col("answer").alias("_answer"))
        rows = questions.join(got, KEY, "left")
        return rows.select(*KEY, "question", F.col("answer").alias("gold"), F.col("_answer").alias("answer"), "metadata")

    sinks.run_resumable(data.questions, path, "question_id", process, limit)


def baseline_summary(records: DataFrame, method: str) -> DataFrame:
    """``method, n, exact_match_percent, f1_percent`` of records ``gold, answer``; unanswered ones count as wrong."""
    answer, gold = F.coalesce("answer", F.lit("")), F.coalesce("gold", F.lit(""))
    rows = records.select(score.exact_match(answer, gold).alias("e"), score.token_f1(answer, gold).alias("f"))
    return rows.agg(F.lit(method).alias("method"), F.count("*").alias("n"), F.round(100 * F.avg("e"), 2).alias("exact_match_percent"), F.round(100 * F.avg("f"), 2).alias("f1_percent"))


def audit(data: Dataset, top_k: int = 5) -> DataFrame:
    """One row about a data set with gold evidence: examples, kinds of evidence, answers of yes or no, examples with
    gold texts, those whose gold texts are no passages, and the share whose gold texts are all among the ``top_k``."""
    gold = F.from_json(F.get_json_object("metadata", "$.gold_inds"), "map<string,string>")
    q = materialize(data.questions.select(*KEY, "question", "answer", gold.alias("gold")), "gold")
    keys = F.coalesce(F.map_keys("gold"), F.array().cast("array<string>"))
    table_, text_ = F.exists(keys, lambda k: F.startswith(k, F.lit("table"))), F.exists(keys, lambda k: ~F.startswith(k, F.lit("table")))
    plain = lambda x: F.lower(T.clean(x))
    asked = q.select(*KEY, F.explode("gold").alias("k", "v")).where(~F.startswith("k", F.lit("table"))).select(*KEY, plain(F.col("v")).alias("t")).distinct()
    first = data.passages.groupBy(*KEY, plain(F.col("text")).alias("t")).agg(F.min(F.struct("position", "source_id")).alias("_p")).select(*KEY, "t", "_p.source_id")
    own = data.passages.select(F.col("question_id").alias("_g"), F.col("source_id").alias("_i"), "position", "text")
    best = retrieval.ranked_within(q.select(F.col("question_id").alias("_g"), F.col("question").alias("_text")), own, top_k).select(F.col("_g").alias("question_id"), F.col("_i").alias("source_id"), F.lit(1).alias("_in"))
    found = asked.join(first, [*KEY, "t"], "left").join(best, [*KEY, "source_id"], "left").groupBy(*KEY).agg(F.max(F.col("source_id").isNull()).alias("unmatched"), F.min(F.coalesce("_in", F.lit(0))).alias("all_in"))
    rows = q.join(found, KEY, "left").withColumn("kind", F.when(table_ & text_, "both").when(table_, "table_only").when(text_, "text_only").otherwise("none"))
    n = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("n_examples"), *[n(F.col("kind") == k).alias(f"n_{k}") for k in ("both", "table_only", "text_only", "none")], n(F.lower(F.trim("answer")).isin("yes", "no")).alias("n_yes_no"),
        n(F.col("unmatched").isNotNull()).alias("n_text"), n(F.col("unmatched")).alias("n_unmatched"), F.coalesce(F.round(n(F.col("all_in") == 1) / F.nullif(n(F.col("unmatched").isNotNull()), F.lit(0)), 6), F.lit(1.0)).alias("recall"),
    )


def table_audit(records: DataFrame, matrix: str) -> DataFrame:
    """``n_lossy, n_repeated``: matrices that lose columns as rows of cells, and those that repeat a header."""
    cells = tables.matrix_cells(records.select(F.monotonically_increasing_id().alias("_k"), matrix), "_k", matrix)
    width = cells.groupBy("_k").agg((F.max("col_index") + 1).alias("out"))
    m = F.col(matrix)
    rows = records.select(F.monotonically_increasing_id().alias("_k"), F.array_max(F.transform(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1))), lambda r: F.size(r))).alias("given"), F.transform(F.get(m, F.lit(0)), lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("h"))
    return rows.join(width, "_k", "left").agg(F.count_if(F.col("out") < F.col("given")).alias("n_lossy"), F.count_if(F.size("h") != F.size(F.array_distinct("h"))).alias("n_repeated"))


# -- contexts of other methods ---------------------------------------------------------------------


def _fit(rows: DataFrame, place: Column, block: Column, limit: int, skip: bool) -> DataFrame:
    """One text a question of the blocks that fit, in order; ``skip`` passes over those that don't."""
    listed = rows.select(*KEY, F.struct(place.alias("p"), block.alias("b")).alias("x")).groupBy(*KEY).agg(F.sort_array(F.collect_list("x")).alias("x"))
    sizes = F.transform("x", lambda r: F.length(r["b"]))
    kept = retrieval.greedy_budget(sizes, limit)
    if not skip:  # up to the first that doesn't fit
        kept = F.filter(kept, lambda i: F.get(kept, i) == i)
    return listed.select(*KEY, F.array_join(F.transform(kept, lambda i: F.get(F.col("x"), i)["b"]), "\n\n").alias("context"))


def flat_context(data: Dataset, top_k: int = 5, limit: int = 24000) -> DataFrame:
    """The best rows and passages by BM25, skipping what no longer fits."""
    docs = documents(data)
    best = retrieval.top_k(retrieval.bm25_within(data.questions, "question", docs, "question_id", "doc", "text"), "question_id", "doc", top_k)
    rows = best.join(docs, [*KEY, "doc"])
    return _fit(rows, F.col("rank"), F.concat(F.lit("["), "doc", F.lit("] "), "text"), limit, True)


def oracle_context(data: Dataset, limit: int = 24000) -> DataFrame:
    """The evidence that the data set marks as gold."""
    return _fit(oracle_evidence(data), F.col("doc"), F.concat(F.lit("["), "doc", F.lit("] "), "text"), limit, True)


def direct_context(data: Dataset, limit: int = 24000) -> DataFrame:
    """Rows, then passages, up to the first that doesn't fit."""
    docs = documents(data).withColumn("_k", F.when(F.startswith("doc", F.lit("table:")), 0).otherwise(1))
    return _fit(docs, F.struct("_k", "doc"), F.col("text"), limit, False)


def edge_context(edges: DataFrame, k: int = 200) -> DataFrame:
    """The first ``k`` edges of each graph as one JSON list."""
    first = retrieval.first_edges(edges, KEY, k)
    return first.groupBy(*KEY).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("edge_seq", "head", "relation", "tail"))), lambda e: F.struct(e["head"].alias("head"), e["relation"].alias("relation"), e["tail"].alias("tail")))).alias("context"))


def path_context(questions: DataFrame, edges: DataFrame, named: DataFrame | None = None, paths: DataFrame | None = None, limit: int = 24000) -> DataFrame:
    """Edges as lines, skipping what no longer fits: four a term shared with the question, two a term shared with the
    ``goals`` of its ``paths``, and six for ends among ``named`` (``question_id, entity``); ties go to the earlier."""
    e = edges.join(questions.select(*KEY, "question"), KEY)
    own = T.terms(F.concat_ws(" ", "head", "relation", "tail"))
    e = e.withColumn("_s", 4 * F.size(F.array_intersect(own, T.terms(F.col("question")))))
    if paths is not None:
        goals = paths.groupBy(*KEY).agg(F.array_join(F.flatten(F.collect_list("goals")), " ").alias("_goals"))
        e = e.join(goals, KEY, "left").withColumn("_s", F.col("_s") + 2 * F.size(F.array_intersect(own, T.terms(F.coalesce("_goals", F.lit(""))))))
    if named is not None:
        at = lambda c: named.select(*KEY, F.lower("entity").alias(f"_l{c}"), F.lit(True).alias(f"_at_{c}")).distinct()
        e = e.withColumn("_lhead", F.lower("head")).withColumn("_ltail", F.lower("tail")).join(at("head"), [*KEY, "_lhead"], "left").join(at("tail"), [*KEY, "_ltail"], "left")
        e = e.withColumn("_s", F.col("_s") + F.when(F.coalesce("_at_head", "_at_tail", F.lit(False)), 6).otherwise(0))
    block = F.concat(F.concat_ws(" | ", "head", "relation", "tail"), F.lit(" ["), F.concat_ws(" ", "source_type", "source_id"), F.lit("]"))
    return _fit(e, F.struct(-F.col("_s"), "edge_seq"), block, limit, True)


def preferred_alias(aliases: DataFrame) -> DataFrame:
    """``question_id, canonical, shown``: the shortest name of each resolved entity."""
    names = aliases.select(*KEY, "canonical", F.explode(F.array("canonical", "node")).alias("name"))
    return names.groupBy(*KEY, "canonical").agg(F.min_by("name", F.struct(F.length("name"), F.lower("name"), "name")).alias("shown"))


def match_candidate(answers: DataFrame, named: DataFrame) -> DataFrame:
    """Answers replaced by the candidate they equal, or by the only one they contain."""
    own = F.lower(F.trim("prediction"))
    hit = answers.join(named, KEY).where(F.contains(own, F.lower("entity"))).withColumn("_same", F.lower("entity") == own)
    best = hit.groupBy(*KEY).agg(F.max(F.struct(F.col("_same").alias("same"), "entity")).alias("x"), F.countDistinct("entity").alias("n"))
    best = best.where("x.same or n = 1").select(*KEY, F.col("x.entity").alias("_e"))
    return answers.join(best, KEY, "left").withColumn("prediction", F.coalesce("_e", "prediction")).drop("_e")
