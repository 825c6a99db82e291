"""Ranking of passages: BM25 over groups, entity-first and two-stage retrieval, context budgets.

A group (one question, or one corpus) ranks its own items.  Scores follow the Okapi formula with k1
1.5, b 0.75; terms held by more than half of a group's items weigh a quarter of the group's mean
weight.  Items without any query term score 0 and still fill up the ranks, in order of position.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import materialize, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def _term_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(T.tokens(F.col(text))).alias("term"))


def bm25(queries: DataFrame, query: str, query_text: str, items: DataFrame, item: str, text: str) -> DataFrame:
    """``query, item, score`` of every item that shares a term with a query, over one corpus.

    Term and document frequencies are aggregated before the join; only the terms of the queries
    reach it, so that the join sees query terms times the documents that hold them."""
    asked = _term_rows(queries, [query], query_text).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    tf = _term_rows(items, [item], text).groupBy(item, "term").agg(F.count("*").alias("tf"))
    sizes = items.select(item, F.size(T.tokens(F.col(text))).alias("dl"))
    corpus = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    weights = idf.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    weights = weights.select("term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    hits = tf.join(weights, "term").join(sizes, item)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.withColumn("part", part).join(asked, "term").groupBy(query, item).agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def top_k(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The ``k`` best items of each query with their ``rank``; scores equal to nine places tie, and ties
    go to the smaller item, so that the order of summation decides nothing."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_stage(first: DataFrame, second: DataFrame, query: str, item: str, budget: int) -> DataFrame:
    """Stage one whole, then up to ``budget`` new items of stage two by ``priority`` and ``rank``.

    A budget of 0 adds nothing; an item proposed several times counts at its best place."""
    rest = second.join(first.select(query, item), [query, item], "left_anti")
    best = rest.groupBy(query, item).agg(F.min(F.struct("priority", "rank")).alias("_p"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("_p", item))
    added = best.withColumn("rank", place).where(F.col("rank") <= budget).select(query, item, F.lit(2).alias("stage"), "rank")
    return first.select(query, item, F.lit(1).alias("stage"), "rank").unionByName(added)


# -- budgets ---------------------------------------------------------------------------------------


def greedy_budget(sizes: Column, limit: int) -> Column:
    """Positions (from 0) of the blocks that fit when each that doesn't is skipped."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(acc: Column, size: Column) -> Column:
        fits = acc["used"] + size <= limit
        return F.struct(F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], acc["at"])).otherwise(acc["kept"]).alias("kept"), (acc["at"] + 1).alias("at"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step)["kept"]


def prefix_budget(df: DataFrame, keys: list[str], position: str, size: Column, limit: int) -> DataFrame:
    """The rows before the first that no longer fits."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= limit)


# -- ranked edges as context -----------------------------------------------------------------------


def rank_edges(edges: DataFrame, keys: list[str], question: str, k: int, stopwords: list[str] | None = None) -> DataFrame:
    """The ``k`` edges of each graph that share most terms with its question; equal edges (of one
    source type) count once; ties go to the earlier edge."""
    once = edges.groupBy(*keys, question, "head", "relation", "tail", "source_type").agg(F.min("edge_seq").alias("edge_seq"))
    words = T.terms(F.concat_ws(" ", "head", "relation", "tail"), stopwords)
    asked = T.terms(F.col(question), stopwords)
    phrase = F.aggregate(F.filter(asked, lambda t: (F.length(t) >= 4) & F.contains(F.lower(F.concat_ws(" ", "head", "relation", "tail")), t)), F.lit(0), lambda a, t: a + F.length(t))
    scored = once.withColumn("overlap", F.size(F.array_intersect(words, asked))).withColumn("phrase", phrase)
    w = Window.partitionBy(*keys).orderBy(F.desc("overlap"), F.desc("phrase"), "edge_seq")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "edge_seq", "head", "relation", "tail", "overlap", "phrase", "rank")


def rank_code_edges(edges: DataFrame, keys: list[str], question: str, k: int = 72, named: DataFrame | None = None, favoured: str = "annual_interest_amount") -> DataFrame:
    """The ``k`` edges of each graph for generated code: edges at ``named`` entities (``keys, entity``) first, then by
    shared terms with the question, three more for the ``favoured`` relation; equal edges count once."""
    once = edges.groupBy(*keys, question, "head", "relation", "tail").agg(F.min("edge_seq").alias("edge_seq"))
    shared = F.size(F.array_intersect(T.terms(F.col(question)), T.terms(F.concat_ws(" ", "head", "relation", "tail"))))
    once = once.withColumn("overlap", shared + F.when(F.col("relation") == favoured, 3).otherwise(0)).withColumn("_named", F.lit(False))
    if named is not None:
        at = lambda c: named.select(*keys, F.col("entity").alias(c), F.lit(True).alias(f"_at_{c}")).distinct()
        once = once.join(at("head"), [*keys, "head"], "left").join(at("tail"), [*keys, "tail"], "left").withColumn("_named", F.coalesce("_at_head", "_at_tail", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_named"), F.desc("overlap"), "edge_seq")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "edge_seq", "head", "relation", "tail", "overlap", "rank")


def first_edges(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` edges of each graph."""
    w = Window.partitionBy(*keys).orderBy("edge_seq")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, table_name, row_index, cells``: every row as an array of ``struct(col_index, column_name, value)``."""
    return cells.groupBy(*keys, "table_name", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", "column_name", "value"))).alias("cells"))


def table_constraints(questions: DataFrame, query: str, question: str, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``query, keys, literal, column_name, entity_column, candidate, enforce_output, place``: for the literals of
    a question that are whole cells, the entities of their rows.

    Of the columns that hold a literal those count whose headers share most terms with the question.  Candidates
    come once for a literal and column, ``place`` is their order.  Output is enforced where the question asks for
    the entities' column."""
    asked = questions.select(query, *keys, question, F.explode(T.question_literals(F.col(question))).alias("literal"))
    own = cells.select(*keys, "table_name", "row_index", "col_index", "column_name", T.literal_key(F.col("value")).alias("_k"))
    hits = asked.withColumn("_k", T.literal_key(F.col("literal"))).join(own, [*keys, "_k"]).drop("_k")
    hits = hits.join(table_rows(cells, keys), [*keys, "table_name", "row_index"])
    hits = hits.withColumn("entity_column", T.answer_column(F.col("cells"), F.col(question)))
    value = F.filter("cells", lambda c: T.clean(c["column_name"]) == F.col("entity_column"))
    hits = hits.withColumn("candidate", T.clean(F.get(value, F.lit(0))["value"])).where("candidate <> ''")
    hits = hits.withColumn("column_name", T.clean(F.col("column_name"))).withColumn("overlap", F.size(F.array_intersect(T.terms(F.col("column_name")), T.terms(F.col(question)))))
    best = F.rank().over(Window.partitionBy(query, "literal").orderBy(F.desc("overlap")))
    kept = hits.withColumn("_r", best).where("_r = 1")
    once = kept.groupBy(query, *keys, question, "literal", "column_name", "entity_column", "candidate").agg(F.min(F.struct("table_name", "row_index", "col_index")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("_at", "literal", "column_name"))
    return once.withColumn("place", place).select(query, *keys, "literal", "column_name", "entity_column", "candidate", T.requests_column(F.col(question), F.col("entity_column")).alias("enforce_output"), "place")


def constraint_policy(constraints: DataFrame, query: str) -> DataFrame:
    """``query, allowed, need_table``: the values that an answer may have, null for any, and that it needs evidence
    from tables."""
    allowed = F.array_sort(F.collect_set(F.when(F.col("enforce_output"), T.normalize_key(F.col("candidate")))))
    return constraints.groupBy(query).agg(F.when(F.size(allowed) > 0, allowed).alias("allowed"), F.lit(True).alias("need_table"))


def bridge_entities(questions: DataFrame, query: str, question: str, cells: DataFrame, keys: list[str], constraints: DataFrame) -> DataFrame:
    """``query, keys, entity, place``: what stands in the rows of the rank that a question names, then the
    candidates of its constraints, each once."""
    rank = T.rank_constraint(F.col(question))
    asked = questions.select(query, *keys, rank.alias("_rank")).where("_rank is not null")
    held = cells.where(F.contains(F.lower("column_name"), F.lit("rank"))).select(*keys, "table_name", "row_index", F.lower(T.clean(F.col("value"))).alias("_rank")).distinct()
    rows = asked.join(held, [*keys, "_rank"]).join(table_rows(cells, keys), [*keys, "table_name", "row_index"])
    ranked = rows.select(query, *keys, T.row_entity(F.col("cells")).alias("entity"), F.struct(F.lit(0).alias("kind"), "table_name", F.col("row_index").cast("long").alias("at")).alias("_at"))
    others = constraints.select(query, *keys, F.col("candidate").alias("entity"), F.struct(F.lit(1).alias("kind"), F.lit("").alias("table_name"), F.col("place").cast("long").alias("at")).alias("_at"))
    once = ranked.unionByName(others).where("entity is not null").groupBy(query, *keys, "entity").agg(F.min("_at").alias("_at"))
    return once.select(query, *keys, "entity", F.row_number().over(Window.partitionBy(query).orderBy("_at", "entity")).alias("place"))


def header_list(cells: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """``keys, headers``: the first ``most`` different headers, in the order of tables, rows and columns."""
    head = cells.where("trim(column_name) <> ''").groupBy(*keys, F.lower(F.trim("column_name")).alias("_l")).agg(F.min(F.struct("table_name", "row_index", "col_index", F.trim("column_name").alias("h"))).alias("_x"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_x"))
    return head.withColumn("_p", place).where(F.col("_p") <= most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["h"]).alias("headers"))


def anchored(questions: DataFrame, query: str, question: str, nodes: DataFrame, keys: list[str], generic: list[str]) -> DataFrame:
    """``query, node``: nodes a question names: by two or more of at most eight distinctive terms, or
    by their whole key.  Nodes meet questions of their own graph by terms."""
    terms = lambda c: T.terms(T.normalize_key(F.col(c)), generic)
    n = nodes.select(*keys, "node", T.normalize_key(F.col("node")).alias("_key"), terms("node").alias("_terms"))
    q = questions.select(query, *keys, T.normalize_key(F.col(question)).alias("_qkey"), terms(question).alias("_qterms"))
    hit = n.withColumn("_t", F.explode("_terms")).join(q.withColumn("_t", F.explode("_qterms")), [*keys, "_t"])
    hit = hit.groupBy(query, *keys, "node", "_key", "_qkey", F.size("_terms").alias("_size")).agg(F.count("*").alias("_shared"))
    named = (F.length("_key") >= 3) & F.contains(F.col("_qkey"), F.col("_key"))
    return hit.where(named | ((F.col("_shared") >= 2) & (F.col("_size") <= 8))).select(query, *keys, "node")


def target_relations(questions: DataFrame, query: str, question: str, edges: DataFrame, keys: list[str], stopwords: list[str]) -> DataFrame:
    """``query, relation, score``: the relations a question describes best: shared terms over all terms,
    plus one if the question holds the relation as a phrase."""
    r = edges.select(*keys, "relation").distinct().withColumn("_terms", T.terms(T.normalize_key(F.col("relation")), stopwords))
    q = questions.select(query, *keys, T.normalize_key(F.col(question)).alias("_qkey"), T.terms(T.normalize_key(F.col(question)), stopwords).alias("_qterms"))
    both = r.join(q, keys).withColumn("_n", F.size(F.array_intersect("_terms", "_qterms"))).where("_n > 0")
    phrase = F.array_join(F.regexp_extract_all(F.lower("relation"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    score = F.col("_n") / F.greatest(F.size("_terms"), F.lit(1)) + F.when((phrase != "") & F.contains("_qkey", phrase), 1.0).otherwise(0.0)
    both = both.withColumn("score", score).where("score >= 1.0 or _n >= 2")
    best = F.rank().over(Window.partitionBy(query).orderBy(F.desc("score")))
    return both.withColumn("_r", best).where("_r = 1").select(query, *keys, "relation", "score")


# -- ranking inside groups -------------------------------------------------------------------------


def bm25_within(queries: DataFrame, query_text: str, items: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """``group, item, score`` of all items of each group against the group's own query; frequencies and
    lengths are those of the group.  Items without a query term score 0."""
    asked = _term_rows(queries, [group], query_text).groupBy(group, "term").agg(F.count("*").alias("qtf"))
    tf = _term_rows(items, [group, item], text).groupBy(group, item, "term").agg(F.count("*").alias("tf"))
    sizes = items.select(group, item, F.size(T.tokens(F.col(text))).alias("dl"))
    corpus = sizes.groupBy(group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = tf.groupBy(group, "term").agg(F.count("*").alias("df")).join(corpus, group)
    idf = idf.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(group).agg(F.avg("idf").alias("mean_idf"))
    weights = idf.join(asked, [group, "term"]).join(mean, group)
    weights = weights.select(group, "term", "qtf", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    hits = tf.join(weights, [group, "term"]).join(sizes, [group, item])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(group, item).agg(F.sum(part).alias("score"))
    return items.select(group, item).join(scored, [group, item], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked_within(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``_g, _i, rank``: the ``k`` best items ``_g, _i, position, text`` of each group against its query
    ``_g, _text``; ties go by position."""
    scored = bm25_within(queries, "_text", items, "_g", "_i", "text").join(items.select("_g", "_i", "position"), ["_g", "_i"])
    w = Window.partitionBy("_g").orderBy(F.desc(F.round("score", 9)), "position")
    own = scored.join(queries.select("_g"), "_g", "left_semi")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_g", "_i", "rank")


def entity_within(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``_g, _i, rank``: of each group the items that hold all words of its query, by position, then the others by
    BM25 among themselves."""
    words = lambda c: F.filter(F.array_distinct(F.split(T.normalize_key(F.col(c)), " ")), lambda w: w != "")
    both = items.join(queries.select("_g", words("_text").alias("_w")), "_g")
    both = materialize(both.withColumn("_all", (F.size("_w") > 0) & (F.size(F.array_except("_w", words("text"))) == 0)).drop("_w"), "named")
    direct = both.where("_all").select("_g", "_i", F.struct(F.lit(0).alias("t"), F.col("position").cast("long").alias("p")).alias("_at"))
    others = ranked_within(queries, both.where("not _all"), k).select("_g", "_i", F.struct(F.lit(1).alias("t"), F.col("rank").cast("long").alias("p")).alias("_at"))
    w = Window.partitionBy("_g").orderBy("_at")
    return direct.unionByName(others).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_g", "_i", "rank")


def retrieve(questions: DataFrame, cells: DataFrame, passages: DataFrame, top_k: int = 10, budget: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two stages over each question's own passages: ``question_id, source_id, stage, rank``, and the constraints
    of its tables.

    Stage one takes the ``top_k`` best by the question.  Stage two adds up to ``budget`` of the rest, in this
    order: the best passage of every constraint candidate, ranked by the question; those of the bridge entities;
    those of the query expansions."""
    q, key = questions.select("question_id", "question"), ["question_id"]
    constraints = materialize(table_constraints(q.withColumn("q", F.col("question_id")), "q", "question", cells, key).drop("q"), "constraints")
    own = passages.select(F.col("question_id").alias("_g"), F.col("source_id").alias("_i"), "position", "text")
    first = materialize(ranked_within(q.select(F.col("question_id").alias("_g"), F.col("question").alias("_text")), own, top_k), "first")
    rest = materialize(own.join(first.select("_g", "_i"), ["_g", "_i"], "left_anti").select(F.col("_g").alias("question_id"), "_i", "position", "text"), "rest")

    def for_each(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries ``question_id, _g, _text`` and the items of their groups."""
        return asked.select("_g", "_text"), asked.select("question_id", "_g").join(rest, "question_id").select("_g", "_i", "position", "text")

    def named(found: DataFrame, asked: DataFrame) -> DataFrame:
        return found.join(asked.select("_g", "question_id", "priority"), "_g").select("question_id", F.col("_i").alias("source_id"), "priority", "rank")

    one = lambda kind, place: F.concat_ws("|", "question_id", F.lit(kind), F.col(place).cast("string"))
    # one passage a candidate, then the best of these by the whole question
    wanted = constraints.groupBy("question_id", F.col("candidate").alias("_text")).agg(F.min("place").alias("place")).withColumn("_g", one("c", "place"))
    best = entity_within(*for_each(wanted), 1).join(wanted.select("_g", "question_id"), "_g").select(F.col("question_id").alias("_g"), "_i").distinct()
    best = best.join(rest.withColumnRenamed("question_id", "_g"), ["_g", "_i"])
    by_question = ranked_within(q.select(F.col("question_id").alias("_g"), F.col("question").alias("_text")), best, budget)
    found = by_question.select(F.col("_g").alias("question_id"), F.col("_i").alias("source_id"), F.lit(0).alias("priority"), "rank")
    bridges = bridge_entities(q.withColumn("q", F.col("question_id")), "q", "question", cells, key, constraints.withColumn("q", F.col("question_id")))
    bridges = bridges.select("question_id", F.col("entity").alias("_text"), one("e", "place").alias("_g"), F.col("place").alias("priority"))
    found = found.unionByName(named(entity_within(*for_each(bridges), budget), bridges))
    headers = q.join(header_list(cells, key), key, "left")
    more = T.query_expansions(F.col("question"), F.coalesce("headers", F.array().cast("array<string>")))
    more = headers.select("question_id", F.posexplode(more).alias("at", "_text")).withColumn("priority", F.lit(1 << 20) + F.col("at")).withColumn("_g", one("x", "at"))
    found = found.unionByName(named(ranked_within(*for_each(more), budget), more))
    stage_one = first.select(F.col("_g").alias("question_id"), F.col("_i").alias("source_id"), "rank")
    return two_stage(stage_one, found, "question_id", "source_id", budget), constraints


# -- few queries against many items ------------------------------------------------------------------

#: Queries up to so many characters in all, so many of them, and so many terms times queries are sent to the
#: executors.
SENT_CHARS, SENT_QUERIES, SENT_CELLS = 8_000_000, 5_000, 4_000_000


def bm25_top_k(queries: DataFrame, query: str, query_text: str, items: DataFrame, item: str, text: str, k: int) -> DataFrame:
    """``query, item, score, rank``: the ``k`` best items of every query over one corpus, among those
    that share a term with it.

    Where the queries are few (their size is measured), each Arrow batch of items is scored against all
    of them by one matrix product and only its own best ``k`` of each query leave the task; otherwise
    terms meet in joins."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(query_text)), F.lit(0)).alias("c")).first()
    if size["n"] > SENT_QUERIES or size["c"] > SENT_CHARS:
        return top_k(bm25(queries, query, query_text, items, item, text), query, item, k)
    asked = _term_rows(queries, [query], query_text).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    rows = asked.orderBy(query, "term").collect()
    ids, terms = sorted({r[query] for r in rows}), sorted({r["term"] for r in rows})
    if len(ids) * len(terms) > SENT_CELLS:
        return top_k(bm25(queries, query, query_text, items, item, text), query, item, k)
    row_of, column_of = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
    items = spread(items.select(item, text))
    tokens = items.select(item, T.tokens(F.col(text)).alias("_t"))
    corpus = tokens.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl")).first()
    df = tokens.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(corpus["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = materialize(df.withColumn("idf", idf), "idf")
    mean = df.agg(F.avg("idf")).first()[0] or 0.0
    own = df.join(F.broadcast(asked.select("term").distinct()), "term").collect()
    weight = np.zeros((len(terms), len(ids)))
    for r in rows:
        weight[row_of[r["term"]], column_of[r[query]]] = r["qtf"]
    scale = np.zeros(len(terms))
    for r in own:
        scale[row_of[r["term"]]] = r["idf"] if r["idf"] >= 0 else EPSILON * mean
    weight *= scale[:, None]
    avgdl = corpus["avgdl"] or 1.0
    kinds = [queries.schema[query].dataType.simpleString(), items.schema[item].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                part = np.zeros((len(batch), len(terms)))
                for i, words in enumerate(batch.column(1).to_pylist()):
                    norm = K1 * (1 - B + B * len(words) / avgdl)
                    for t, n in Counter(w for w in words if w in row_of).items():
                        part[i, row_of[t]] = n * (K1 + 1) / (n + norm)
                held = (part > 0).astype(np.float32) @ (weight != 0).astype(np.float32) > 0
                scores = np.where(held, part @ weight, -np.inf)
                # all that tie with the last place leave too: the smaller item wins in the end
                last = np.partition(scores, -min(k, len(batch)), axis=0)[-min(k, len(batch))]
                i, j = np.nonzero((scores >= last - 1e-8) & held)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in j]), batch.column(0).take(pa.array(i)), pa.array(scores[i, j])], ["_q", "_i", "score"])

    found = tokens.mapInArrow(run, f"_q {kinds[0]}, _i {kinds[1]}, score double") if ids else queries.where("false").select(F.col(query).alias("_q")).crossJoin(items.where("false").select(F.col(item).alias("_i"))).withColumn("score", F.lit(0.0))
    return top_k(found.select(F.col("_q").alias(query), F.col("_i").alias(item), "score"), query, item, k)
