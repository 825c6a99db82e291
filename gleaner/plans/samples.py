"""Queries over samples, templates, sources and streams, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import generation, graph, retrieval, samples, search, templates
from gleaner.plans import sqltext as S
from gleaner.plans.graphs import Q, edges
from gleaner.plans.registry import query
from gleaner.session import table
from gleaner.streaming import incremental


@query("stratified_shards", "SELECT lang, shard_index, count(*) AS n FROM (SELECT lang, CAST((row_number() OVER (ORDER BY k, lang NULLS FIRST, doc_id) - 1) % 4 AS INTEGER) AS shard_index FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS k FROM documents)) GROUP BY ALL")
def stratified_shards(spark: SparkSession, d: str) -> DataFrame:
    """Documents in four shards, every language dealt out evenly; the sizes."""
    return samples.stratified_shards(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", ["lang"], 4).groupBy("lang", "shard_index").agg(F.count("*").alias("n"))


@query("chunk_shards", "SELECT shard_index, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 300) AS INTEGER) AS shard_index FROM documents) GROUP BY 1")
def chunk_shards(spark: SparkSession, d: str) -> DataFrame:
    return samples.chunks(table(spark, d, "documents").select("doc_id"), "doc_id", 300).groupBy("shard_index").agg(F.count("*").alias("n"))


@query("balanced_sample")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two disjoint samples of a hundred programs, balanced by result step and repairs."""
    rows = table(spark, d, "numericalprogram").select("program_id", "result_step", "repair_count")
    return samples.balanced_shards(rows, "program_id", ["result_step", "repair_count"], 100, shards=2, seed=7, cover=0)


@query("balanced_distinct_sample")
def balanced_distinct_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred questions of as many tables, balanced by present split."""
    rows = table(spark, d, "sample_hybridqa").where("table_id is not null and question_id is not null")
    rows = rows.groupBy("question_id").agg(F.max_by(F.struct("table_id", "split"), F.struct("ingested_at", "table_id", "split")).alias("x")).select("question_id", "x.*")
    return samples.balanced_shards(rows, "question_id", ["split"], 100, seed=7, distinct="table_id")


@query("balanced_shape", "SELECT 'programs ' || i AS sample, CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_different, true AS near FROM range(0, 2) r(i) UNION ALL SELECT 'questions 0', 100, 100, true")
def balanced_shape(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of balanced samples: programs by different ids, questions by different tables, and whether the shares of
    repairs and splits lie within 0.05 of all rows'."""

    def near(sample: DataFrame, all_: DataFrame, column: str) -> DataFrame:
        n, total = sample.count(), all_.count()
        own, whole = sample.groupBy("shard_index", column).count(), all_.groupBy(column).agg(F.count("*").alias("_w"))
        shards = max(1, sample.select("shard_index").distinct().count())
        off = own.join(whole, column).groupBy("shard_index").agg(F.max(F.abs(F.col("count") / (n / shards) - F.col("_w") / total)).alias("off"))
        return off.select("shard_index", (F.col("off") <= 0.05).alias("near"))

    p, q = balanced_sample(spark, d), balanced_distinct_sample(spark, d)
    shape = lambda s, name, of: s.groupBy("shard_index").agg(F.count("*").alias("n"), F.countDistinct(of).alias("n_different")).withColumn("_name", F.lit(name))
    one = shape(p, "programs", "program_id").join(near(p, table(spark, d, "numericalprogram"), "repair_count"), "shard_index")
    two = shape(q, "questions", "table_id").join(near(q, table(spark, d, "sample_hybridqa").where("table_id is not null"), "split"), "shard_index")
    return one.unionByName(two).select(F.concat_ws(" ", "_name", "shard_index").alias("sample"), "n", "n_different", "near")


@query("distribution", "SELECT 'dataset' AS dimension, dataset AS value, count(*) AS n FROM datasetexample GROUP BY ALL UNION ALL SELECT 'has_answer', CAST(answer IS NOT NULL AS VARCHAR), count(*) FROM datasetexample GROUP BY ALL")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "datasetexample").select("dataset", F.col("answer").isNotNull().alias("has_answer"))
    return samples.marginals(rows, ["dataset", "has_answer"])


@query("filter_records", "SELECT program_id FROM (SELECT program_id, count(*) AS n, bool_and(op IN ('const', 'lookup', 'add', 'multiply')) AS ok FROM (SELECT DISTINCT program_id, step_id, op FROM irstep) GROUP BY 1) WHERE n BETWEEN 2 AND 4 AND ok")
def filter_records(spark: SparkSession, d: str) -> DataFrame:
    """Programs of two to four steps with allowed operators only."""
    steps = table(spark, d, "irstep").select("program_id", "step_id", "op").distinct()
    rows = steps.groupBy("program_id").agg(F.collect_list("op").alias("ops"))
    return samples.filter_steps(rows, F.col("ops"), least=2, most=4, allowed=["const", "lookup", "add", "multiply"]).select("program_id")


@query("semi_join", "SELECT DISTINCT e.example_id FROM datasetexample e WHERE EXISTS (SELECT 1 FROM hitab h WHERE h.table_id = e.table_id)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Examples whose table is there."""
    return table(spark, d, "datasetexample").join(table(spark, d, "hitab").select("table_id"), "table_id", "left_semi").select("example_id").distinct()


@query("equi_left_join", "SELECT e.example_id, e.ingested_at, coalesce(h.n, 0) AS deliveries FROM datasetexample e LEFT JOIN (SELECT table_id, count(*) AS n FROM hitab GROUP BY 1) h USING (table_id)")
def equi_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "hitab").groupBy("table_id").agg(F.count("*").alias("n"))
    return table(spark, d, "datasetexample").join(n, "table_id", "left").select("example_id", "ingested_at", F.coalesce("n", F.lit(0)).cast("long").alias("deliveries"))


@query("set_operations", "SELECT head AS name, 'both' AS side FROM (SELECT head FROM triple INTERSECT SELECT tail FROM triple) UNION ALL SELECT head, 'heads' FROM (SELECT head FROM triple EXCEPT SELECT tail FROM triple)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Names that are heads and tails, and heads that are never tails."""
    t = table(spark, d, "triple")
    heads, tails = t.select(F.col("head").alias("name")), t.select(F.col("tail").alias("name"))
    return heads.intersect(tails).withColumn("side", F.lit("both")).unionByName(heads.exceptAll(tails).distinct().join(tails, "name", "left_anti").withColumn("side", F.lit("heads")))


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


# -- templates over orders as facts ------------------------------------------------------------------


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's order totals by year as table facts of one graph."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return o.select(F.lit(1).alias("g"), F.concat(F.lit("customer "), "o_custkey").alias("head"), F.concat(F.lit("year_"), "y").alias("relation"), F.col("v").cast("string").alias("tail"), F.lit("table").alias("source_type"), F.col("o_custkey").cast("int").alias("row_index"), F.xxhash64("o_custkey", "y").alias("edge_seq"))


@query("template_values", "SELECT 'customer ' || o_custkey AS head, 'year_' || y AS relation, CAST(v AS DOUBLE) AS value FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL)")
def template_values(spark: SparkSession, d: str) -> DataFrame:
    return templates.table_values(_yearly(spark, d), ["g"]).select("head", "relation", "value")


@query(
    "template_average",
    "SELECT 'customer ' || o_custkey AS node, round(avg(v), 4) AS value, count(*) AS n FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS v FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING count(*) >= 2",
)
def template_average(spark: SparkSession, d: str) -> DataFrame:
    """One question for the average of every customer."""
    e = _yearly(spark, d).withColumn("g", F.col("row_index"))
    asked = e.select("g", F.concat(F.lit("What is the average "), F.col("head"), F.lit("?")).alias("question")).distinct().withColumn("q", F.col("g"))
    return templates.row_aggregate(asked, "q", "question", e, ["g"]).select("node", F.round("value", 4).alias("value"), "n")


# four kinds of questions, by customer: an average, a comparison, a total up to a month, an earlier value
_TEMPLATES = """SELECT c.o_custkey AS q, template, place, round(value + 0.0001, 2) AS value FROM (
SELECT o_custkey, 'row_aggregate' AS template, CAST(1 AS INTEGER) AS place, avg(v) AS value FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS v FROM orders WHERE o_custkey % 4 = 0 GROUP BY ALL) GROUP BY o_custkey HAVING count(*) >= 2
UNION ALL SELECT o_custkey, 'outperforms', 3, 1.0 FROM orders WHERE o_custkey % 4 = 1 GROUP BY 1
UNION ALL SELECT o_custkey, 'month_total', 2, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE FROM orders WHERE o_custkey % 4 = 2 AND month(o_orderdate) <= 6 GROUP BY 1 HAVING count(*) >= 2
UNION ALL SELECT o_custkey, 'prior_value', 4, 1600.0 - o_custkey % 7 FROM orders WHERE o_custkey % 4 = 3 GROUP BY 1) c"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions ``q, g, question`` of the four kinds and the facts of their graphs."""
    o = table(spark, d, "orders").where("o_totalprice is not null")
    k = F.col("g") % 4
    yearly = _yearly(spark, d).withColumn("g", F.col("row_index").cast("long"))
    half = yearly.where(k == 1).withColumn("head", F.lit("half")).withColumn("tail", (F.col("tail").cast("double") / 2).cast("string"))
    base = o.where("o_custkey % 4 = 2").select(F.col("o_custkey").alias("g"), F.concat(F.lit("order "), "o_orderkey").alias("head"), F.col("o_orderkey").alias("edge_seq"), F.lit("table").alias("source_type"), F.lit(0).alias("row_index"), "o_orderdate", "o_totalprice")
    each = F.array(F.struct(F.lit("date_completed").alias("relation"), F.date_format("o_orderdate", "MMMM yyyy").alias("tail")), F.struct(F.lit("sales_proceeds").alias("relation"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("tail")))
    months = base.select("g", "head", "edge_seq", "source_type", "row_index", F.inline(each))
    said = F.array(F.struct(F.lit("value_2004").alias("relation"), F.lit("$1.6 billion").alias("tail")), F.struct(F.lit("increase_from_2003_to_2004").alias("relation"), F.concat(F.lit("$"), F.col("g") % 7, F.lit(" million")).alias("tail")))
    prior = o.select(F.col("o_custkey").alias("g")).distinct().where(k == 3).select("g", F.lit("net revenue").alias("head"), F.col("g").alias("edge_seq"), F.lit("text").alias("source_type"), F.lit(None).cast("int").alias("row_index"), F.inline(said))
    edges = yearly.where(k < 2).unionByName(half).unionByName(months).unionByName(prior)
    asked = F.when(k == 0, F.concat(F.lit("What is the average customer "), F.col("g"), F.lit(" in the years?"))).when(k == 1, F.concat(F.lit("Did customer "), F.col("g"), F.lit(" outperform half?"))).when(k == 2, F.lit("What were total proceeds up to June?")).otherwise(F.lit("What was net revenue in 2003?"))
    questions = o.select(F.col("o_custkey").alias("g")).distinct().select(F.col("g").alias("q"), "g", asked.alias("question"))
    return questions, edges


@query("template_answers", _TEMPLATES)
def template_answers(spark: SparkSession, d: str) -> DataFrame:
    """What all templates answer to questions of four kinds."""
    questions, facts = _asked(spark, d)
    out = templates.answers(questions, "q", "question", facts, ["g"])
    return out.select("q", "template", "place", F.round(F.when(F.col("value") == "true", 1.0).when(F.col("value") == "false", 0.0).otherwise(F.col("value").try_cast("double")) + 0.0001, 2).alias("value"))


@query("label_match", "SELECT s_suppkey AS q, s_name AS node FROM supplier")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    """The supplier that each phrase names: an article more, a plural."""
    s = table(spark, d, "supplier")
    asked = s.select(F.col("s_suppkey").alias("q"), F.lit(1).alias("g"), F.concat(F.lit("the "), F.regexp_replace("s_name", "Supplier", "Suppliers"), F.lit(" of")).alias("phrase"))
    return templates.label_match(asked, "q", "phrase", s.select(F.lit(1).alias("g"), F.col("s_name").alias("node")), ["g"]).drop("g")


_STOPPED = "(" + ", ".join(f"'{w}'" for w in search.STOP) + ")"


def _kept(x: str) -> str:
    return f"list_filter({S.terms(x)}, lambda t: length(t) > 1 AND t NOT IN {_STOPPED})"


_SEARCH = f"""asked AS (SELECT question_id, 'What is the ' || arg_min(relation, triple_id) || ' of ' || arg_min(head, triple_id) || '?' AS question FROM triple WHERE question_id IS NOT NULL GROUP BY 1),
node AS (SELECT DISTINCT question_id, node FROM (SELECT question_id, head AS node FROM triple UNION ALL SELECT question_id, tail FROM triple)),
an AS (SELECT question_id, node FROM (SELECT n.question_id, node, {S.key('node')} AS k, {S.key('question')} AS qk, {_kept(S.key('node'))} AS nt, {_kept(S.key('question'))} AS qt FROM node n JOIN asked USING (question_id)) WHERE len(list_intersect(nt, qt)) > 0 AND ((length(k) >= 3 AND contains(qk, k)) OR (len(list_intersect(nt, qt)) >= 2 AND len(nt) <= 8))),
rl AS (SELECT question_id, relation, n / greatest(size, 1) + CASE WHEN phrase <> '' AND contains(qk, phrase) THEN 1 ELSE 0 END AS score, n FROM (SELECT t.question_id, relation, {S.key('question')} AS qk, len(list_intersect({_kept(S.key('relation'))}, {_kept(S.key('question'))})) AS n, len({_kept(S.key('relation'))}) AS size, array_to_string(regexp_extract_all(lower(relation), '[a-z0-9]+'), ' ') AS phrase FROM (SELECT DISTINCT question_id, relation FROM triple) t JOIN asked USING (question_id)) WHERE n > 0),
tr AS (SELECT question_id, relation, score FROM rl WHERE score >= 1 OR n >= 2 QUALIFY rank() OVER (PARTITION BY question_id ORDER BY score DESC) = 1)"""


@query("anchored_nodes", f"WITH {_SEARCH} SELECT question_id, node FROM an")
def anchored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that every question names."""
    asked, e = _search_questions(spark, d)
    found = graph.nodes(e, Q).select(*Q, "node")
    return retrieval.anchored(asked, "q", "question", found, Q, search.STOP).select(*Q, "node")


@query("target_relations", f"WITH {_SEARCH} SELECT question_id, relation, round(score, 6) AS score FROM tr")
def target_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relations that every question describes best."""
    asked, e = _search_questions(spark, d)
    return retrieval.target_relations(asked, "q", "question", e, Q, search.STOP).select(*Q, "relation", F.round("score", 6).alias("score"))


_LITERAL = r"regexp_full_match(trim(tail, ' '), '[\d\s:./,%$-]+') OR regexp_matches(lower(tail), '\b(?:" + "|".join(T.MONTHS) + r")\b')"
_SYMBOLIC = f"""WITH RECURSIVE {_SEARCH}, way AS (SELECT DISTINCT question_id, a, b FROM (SELECT question_id, head AS a, tail AS b FROM triple UNION ALL SELECT question_id, tail, head FROM triple) WHERE a <> b),
walk AS (SELECT question_id, node, 0 AS h FROM an WHERE question_id IN (SELECT question_id FROM tr) UNION SELECT w.question_id, b, h + 1 FROM walk w JOIN way ON way.question_id = w.question_id AND a = node WHERE h < 3),
reach AS (SELECT question_id, node, min(h) AS h FROM walk GROUP BY ALL),
ends AS (SELECT t.question_id, tail AS answer, t.relation, max(score) AS score, min(h) + 1 AS hops, count(DISTINCT source_type) AS n_kinds FROM triple t JOIN tr ON tr.question_id = t.question_id AND tr.relation = t.relation JOIN reach r ON r.question_id = t.question_id AND r.node = head WHERE NOT (len(list_intersect({S.terms(S.key('t.relation'))}, ['city', 'country', 'person', 'player', 'club'])) > 0 AND ({_LITERAL})) GROUP BY ALL)
SELECT question_id, answer, relation, round(score, 6) AS score, CAST(hops AS INTEGER) AS hops, n_kinds, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hops, n_kinds DESC, answer, relation) AS place FROM ends) WHERE place <= 5"""


def _search_questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A question for each graph's first relation by name."""
    e = edges(spark, d).where("question_id is not null")
    first = e.groupBy(*Q).agg(F.min_by(F.struct("head", "relation"), "edge_seq").alias("x"))
    return first.select(*Q, F.col("question_id").alias("q"), F.concat(F.lit("What is the "), F.col("x.relation"), F.lit(" of "), F.col("x.head"), F.lit("?")).alias("question")), e


@query("symbolic_search", _SYMBOLIC)
def symbolic_search(spark: SparkSession, d: str) -> DataFrame:
    """Anchored search over all graphs."""
    asked, e = _search_questions(spark, d)
    out = search.symbolic_search(asked, "q", "question", e, Q)
    return out.select(F.col("q").alias("question_id"), "answer", "relation", F.round("score", 6).alias("score"), "hops", "n_kinds", "place")


@query("generation_boundary", "SELECT DISTINCT example_id, 'echo ' || length(question) AS completion FROM datasetexample")
def generation_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Prompts through a stub provider; without one there are no completions."""
    rows = table(spark, d, "datasetexample").select("example_id", "question").distinct()
    return generation.complete(rows, "example_id", "question", lambda prompts: [f"echo {len(p or '')}" for p in prompts])
