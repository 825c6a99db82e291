"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import leakage, lookalike, oracles, sampling, splits, subjects, tokenize
from gleaner.session import materialize, table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LOOKS = ["head", "relation", "tail"]


def _query(f: Callable) -> Callable:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of triples of a question that look the same but differ in their characters."""
    return lookalike.same_looking_pairs(table(spark, sf_dir, "triple"), "triple_id", "question_id", LOOKS)


@_query
def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triple with head, relation and tail in one form of characters."""
    return lookalike.canonical(table(spark, sf_dir, "triple").select("triple_id", *LOOKS), LOOKS)


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the sampling plans whose target the data cannot meet."""
    return sampling.unmet(table(spark, sf_dir, "sample_hybridqa"), table(spark, sf_dir, "sample_target"))


@_query
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, available rows and deficits of all plans."""
    return sampling.report(table(spark, sf_dir, "sample_hybridqa"), table(spark, sf_dir, "sample_target"))


@_query
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions drawn for every plan."""
    return sampling.sample(table(spark, sf_dir, "sample_hybridqa"), table(spark, sf_dir, "sample_target"))


@_query
def p3_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was drawn for every row of the plans: questions, different ones, and those of the category."""
    questions, targets = table(spark, sf_dir, "sample_hybridqa"), table(spark, sf_dir, "sample_target")
    kinds = sampling.strata(sampling.eligible(questions), sampling._names(targets))
    named = sampling.sample(questions, targets).join(targets.select("plan_id", "strat_name", "category").distinct(), ["plan_id", "category"])
    fits = named.join(kinds.withColumn("_fits", F.lit(1)), ["question_id", "strat_name", "category"], "left")
    return fits.groupBy("plan_id", "category").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("n_different"), F.count("_fits").alias("n_of_category"))


def _components(questions: DataFrame) -> DataFrame:
    """``question_id, component``: questions name tables in whatever way they are written, and every way of
    writing, read once, is a record that names its page."""
    rows = questions.select("question_id", "table_id").distinct()
    ways = rows.select("table_id").distinct().withColumn("page", splits.page_of(F.col("table_id"))).where("page is not null")
    ways = materialize(ways, "ways")
    named = rows.join(ways.select("table_id"), "table_id")
    both = F.array(F.struct(F.concat(F.lit("t:"), "table_id").alias("entity")), F.struct(F.concat(F.lit("p:"), "page").alias("entity")))
    edges = named.select(F.concat(F.lit("q:"), "question_id").alias("record"), F.concat(F.lit("t:"), "table_id").alias("entity")).unionByName(ways.select(F.concat(F.lit("t:"), "table_id").alias("record"), F.inline(both)))
    found = splits.components(edges, "record", "entity").where(F.startswith("record", F.lit("q:")))
    return found.select(F.substring("record", 3, 1 << 30).alias("question_id"), "component")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_hybridqa").where("question_id is not null")


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions related to one that the present column puts into another split."""
    rows = _questions(spark, sf_dir)
    records = rows.select("question_id", "split").distinct().join(_components(rows), "question_id")
    return splits.divided(records, "question_id", "component", "split")


@_query
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new split of every question, whole pages together, shares of split_target."""
    rows = _questions(spark, sf_dir)
    records = rows.groupBy("question_id").agg(F.max(sampling.answer_source(F.col("answer_node"))).alias("label")).join(_components(rows), "question_id", "left")
    most = 1000  # splits; more are an error
    targets = [(r["split"], r["target_share"]) for r in table(spark, sf_dir, "split_target").orderBy("split").limit(most + 1).collect()]
    if len(targets) > most:
        raise ValueError(f"more than {most} splits")
    return splits.assign(records, "question_id", "component", "label", targets)


@_query
def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each new split: whether its share and its shares of labels are within 0.02 of the target's and
    the whole's, and how many of its questions have a related one elsewhere."""
    rows = _questions(spark, sf_dir).select("question_id", splits.page_of(F.col("table_id")).alias("page"), sampling.answer_source(F.col("answer_node")).alias("label"))
    made = p5_splits(spark, sf_dir).select("question_id", F.col("split").alias("made"))
    labels = made.join(rows.groupBy("question_id").agg(F.max("label").alias("label")), "question_id")
    n = labels.groupBy("made", "label").agg(F.count("*").alias("n")).withColumn("of_split", F.sum("n").over(Window.partitionBy("made"))).withColumn("of_label", F.sum("n").over(Window.partitionBy("label")))
    total = labels.agg(F.count("*").alias("total"))
    even = n.crossJoin(F.broadcast(total)).groupBy("made").agg(F.max(F.abs(F.col("n") / F.col("of_split") - F.col("of_label") / F.col("total"))).alias("off"), F.first(F.col("of_split") / F.col("total")).alias("share"))
    apart = made.join(rows.where("page is not null").select("question_id", "page"), "question_id")
    lost = splits.divided(apart, "question_id", "page", "made").join(made, "question_id").groupBy("made").agg(F.count("*").alias("n_divided"))
    targets = table(spark, sf_dir, "split_target").select("split", "target_share")
    out = targets.join(even.withColumnRenamed("made", "split"), "split", "left").join(lost.withColumnRenamed("made", "split"), "split", "left")
    return out.select("split", (F.abs(F.col("share") - F.col("target_share")) <= 0.02).alias("share_met"), (F.col("off") <= 0.02).alias("labels_even"), F.coalesce("n_divided", F.lit(0)).cast("long").alias("n_divided"))


@_query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenize.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 14 consecutive words of an evaluation item: the overlaps found by spaced
    seeds, of which an exact check keeps those with a whole window."""
    return p7_overlaps(spark, sf_dir).where("exact").select("doc_id", "item_id")


@_query
def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best overlap of each document and item, two replaced words in any 14 allowed."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    return leakage.overlaps(docs, "doc_id", "text", items, "item_id", "text")


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that at least a quarter of a document's sentences deal with."""
    docs, areas, labels = (table(spark, sf_dir, t) for t in ("documents", "subject_area", "subject_label"))
    return subjects.subjects(docs, "doc_id", "text", areas, labels)


@_query
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents deal with each subject, over the whole corpus."""
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"))


@_query
def p8_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the corpus with their first subject, its share and their discriminative terms."""
    docs, areas, labels = (table(spark, sf_dir, t) for t in ("documents", "subject_area", "subject_label"))
    rows = subjects.fit(docs, "doc_id", "text", areas, labels).leaf_table()
    return spark.createDataFrame(rows, "leaf int, subject string, share double, terms string")
