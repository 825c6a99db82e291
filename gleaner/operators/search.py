"""Short evidenced paths from the nodes a question names to the relations it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import graph, retrieval
from gleaner.session import materialize

STOP = "a an and are as at be by did do does for from has have had how in is it its of on or that the their this to was were what when where which who whose with".split()
#: Words of relations that end in an entity, never in a date or number.
ENTITY_WORDS = ["city", "country", "person", "player", "club"]


def symbolic_search(questions: DataFrame, query: str, question: str, edges: DataFrame, keys: list[str], max_hops: int = 4, k: int = 5) -> DataFrame:
    """``query, answer, relation, score, hops, n_kinds, place``: the best ``k`` answers of each question.

    Anchors spread out over undirected edges in at most ``max_hops - 1`` rounds; an answer is the tail
    of a described relation whose head was reached.  Ranked by relation score, shortness and the number
    of kinds of sources; ties go by answer and relation."""
    found = graph.nodes(edges, keys).select(*keys, "node")
    anchors = materialize(retrieval.anchored(questions, query, question, found, keys, STOP), "anchors")
    targets = materialize(retrieval.target_relations(questions, query, question, edges, keys, STOP), "targets")
    reach = graph.hops(edges, keys, anchors.join(targets.select(query).distinct(), query, "left_semi").select(*keys, F.col("node").alias("start")).distinct(), max_hops - 1)
    reach = reach.join(anchors.withColumnRenamed("node", "start"), [*keys, "start"]).groupBy(query, *keys, "node").agg(F.min("hops").alias("_h"))
    literal_ends = F.size(F.array_intersect(T.terms(T.normalize_key(F.col("relation"))), F.array(*[F.lit(w) for w in ENTITY_WORDS]))) > 0
    ends = edges.where(~(literal_ends & T.looks_literal(F.col("tail"))))
    hits = targets.join(ends, [*keys, "relation"]).join(reach.withColumnRenamed("node", "head"), [query, *keys, "head"])
    out = hits.groupBy(query, F.col("tail").alias("answer"), "relation").agg(F.max("score").alias("score"), (F.min("_h") + 1).alias("hops"), F.countDistinct("source_type").alias("n_kinds"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "hops", F.desc("n_kinds"), "answer", "relation"))
    return out.withColumn("place", place).where(F.col("place") <= k)
