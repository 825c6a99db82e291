"""Queries over the pipeline and the contexts of other methods, with driver tables as a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import methods, retrieval
from gleaner.plans import hybrid, readers
from gleaner.plans import sqltext as S
from gleaner.plans.graphs import Q, edges
from gleaner.plans.registry import query
from gleaner.session import table
from gleaner.sources.adapters import Dataset


def dataset(spark: SparkSession, d: str) -> Dataset:
    """Each customer's yearly order totals and order count as a table, with one question for the
    total; all documents are dealt out to customers as passages."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("v"))
    qid = F.concat(F.lit("c"), F.col("o_custkey"))
    cells = o.select(qid.alias("question_id"), F.lit("orders").alias("table_name"), F.lit(0).alias("row_index"), (F.col("y") - 1900).alias("col_index"), F.concat(F.lit("year "), "y").alias("column_name"), F.col("v").alias("value"))
    head = o.select("o_custkey").distinct().select(qid.alias("question_id"), F.lit("orders").alias("table_name"), F.lit(0).alias("row_index"), F.lit(0).alias("col_index"), F.lit("name").alias("column_name"), F.lit("total order volume").alias("value"))
    questions = head.select("question_id", F.lit("What is the total of all orders?").alias("question"), F.lit("").alias("answer"), F.lit("{}").alias("metadata"))
    docs = table(spark, d, "documents").where("text is not null and source_id is not null")
    passages = docs.select(F.concat(F.lit("c"), F.col("doc_id") % 500).alias("question_id"), F.lit("text").alias("source_type"), F.concat("source_id", F.lit("#"), "doc_id").alias("source_id"), F.col("doc_id").cast("int").alias("position"), "text")
    return Dataset(questions, head.unionByName(cells), passages)


@query(
    "pipeline_answers",
    "SELECT 'c' || o_custkey AS question_id, round(sum(v), 2) AS prediction FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS v FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING count(*) >= 2",
)
def pipeline_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's question through facts, resolution, templates, search and scores."""
    out = methods.answer(dataset(spark, d)).where("mode = 'derived_numeric'")
    return out.select("question_id", F.round(F.col("prediction").cast("double"), 2).alias("prediction"))


def _four_kinds(spark: SparkSession, d: str) -> Dataset:
    """A question for every customer with orders, of four kinds: the average over a row, a comparison of two rows, a
    total up to a month, and an earlier value that only a passage tells."""
    o = table(spark, d, "orders").where("o_totalprice is not null").withColumn("k", F.col("o_custkey") % 4).withColumn("question_id", F.concat(F.lit("c"), "o_custkey"))
    own = F.concat(F.lit("customer "), F.col("o_custkey"))
    cell = lambda row, at, name, value: F.struct(F.lit("orders").alias("table_name"), row.cast("int").alias("row_index"), at.cast("int").alias("col_index"), name.alias("column_name"), value.cast("string").alias("value"))
    yearly = o.where("k < 2").groupBy(*Q, "k", "o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    two = F.col("k") == 1
    year, zero, one = F.concat(F.lit("year_"), "y"), F.lit(0), F.lit(1)
    rows = yearly.select(*Q, F.inline(F.array_compact(F.array(cell(zero, zero, F.lit("name"), own), cell(zero, F.col("y") - 1900, year, F.col("v")), F.when(two, cell(one, zero, F.lit("name"), F.lit("half"))), F.when(two, cell(one, F.col("y") - 1900, year, F.col("v") / 2))))))
    months = o.where("k = 2").select(*Q, F.inline(F.array(cell(F.col("o_orderkey"), zero, F.lit("name"), F.concat(F.lit("order "), "o_orderkey")), cell(F.col("o_orderkey"), one, F.lit("date_completed"), F.date_format("o_orderdate", "MMMM yyyy")), cell(F.col("o_orderkey"), F.lit(2), F.lit("sales_proceeds"), F.col("o_totalprice").cast("decimal(18,2)")))))
    each = o.groupBy(*Q, "k", "o_custkey").agg(F.count("*").alias("n"))
    asked = F.when(F.col("k") == 0, F.concat(F.lit("What is the average "), own, F.lit(" in the years?"))).when(two, F.concat(F.lit("Did "), own, F.lit(" outperform half?"))).when(F.col("k") == 2, "What were total proceeds up to June?").otherwise("What was net revenue in 2003?")
    questions = each.select(*Q, asked.alias("question"), F.lit("").alias("answer"), F.lit("{}").alias("metadata"))
    said = F.concat(F.lit("Net revenue increased $"), F.col("o_custkey") % 7, F.lit(" million, mainly abroad, from 2003 to $1.6 billion in 2004."))
    passages = each.select(*Q, F.lit("text").alias("source_type"), F.concat("question_id", F.lit("#0")).alias("source_id"), F.lit(0).alias("position"), F.when(F.col("k") == 3, said).otherwise("Nothing of note.").alias("text"))
    return Dataset(questions, rows.distinct().unionByName(months), passages)


_KINDS = """SELECT 'c' || o_custkey AS question_id, kind, round(value + 0.0001, 2) AS value FROM (
SELECT o_custkey, 'derived_numeric' AS kind, avg(v) AS value FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS v FROM orders WHERE o_custkey % 4 = 0 GROUP BY ALL) GROUP BY o_custkey HAVING count(*) >= 2
UNION ALL SELECT o_custkey, 'derived_boolean', 1.0 FROM orders WHERE o_custkey % 4 = 1 GROUP BY 1
UNION ALL SELECT o_custkey, 'derived_numeric', sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE FROM orders WHERE o_custkey % 4 = 2 AND month(o_orderdate) <= 6 GROUP BY 1 HAVING count(*) >= 2
UNION ALL SELECT o_custkey, 'derived_numeric', 1600.0 - o_custkey % 7 FROM orders WHERE o_custkey % 4 = 3 GROUP BY 1)"""


@query("pipeline_questions", _KINDS)
def pipeline_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of four kinds through retrieval, facts, resolution, all templates, search and scores."""
    out = methods.answer(_four_kinds(spark, d)).where("prediction is not null")
    value = F.when(F.col("prediction") == "yes", 1.0).when(F.col("prediction") == "no", 0.0).otherwise(F.col("prediction").try_cast("double"))
    return out.select("question_id", F.col("mode").alias("kind"), F.round(value + 0.0001, 2).alias("value"))


_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
_WITHIN = f"""WITH tf AS (SELECT page_title, doc_id, term, count(*) AS tf FROM (SELECT page_title, doc_id, unnest(regexp_split_to_array(lower(text), '{_WS}')) AS term FROM documents WHERE text IS NOT NULL AND page_title IS NOT NULL) WHERE term <> '' GROUP BY ALL),
dl AS (SELECT d.page_title, d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) WHERE d.text IS NOT NULL AND d.page_title IS NOT NULL GROUP BY ALL),
st AS (SELECT page_title, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1),
i0 AS (SELECT page_title, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN st USING (page_title) GROUP BY page_title, term, n),
i1 AS (SELECT page_title, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY page_title) ELSE idf END AS idf FROM i0),
qt AS (SELECT page_title, term, count(*) AS qtf FROM (SELECT page_title, unnest(regexp_split_to_array(lower(replace(page_title, '_', ' ')), '{_WS}')) AS term FROM (SELECT DISTINCT page_title FROM documents WHERE text IS NOT NULL AND page_title IS NOT NULL)) WHERE term <> '' GROUP BY ALL),
sc AS (SELECT page_title, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (page_title, term) JOIN i1 USING (page_title, term) JOIN dl USING (page_title, doc_id) JOIN st USING (page_title) GROUP BY ALL)
SELECT page_title, doc_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT page_title, doc_id, coalesce(score, 0.0) AS s, row_number() OVER (PARTITION BY page_title ORDER BY round(coalesce(score, 0.0), 9) DESC, doc_id) AS r FROM dl LEFT JOIN sc USING (page_title, doc_id)) WHERE r <= 3"""


@query("bm25_within", _WITHIN)
def bm25_within(spark: SparkSession, d: str) -> DataFrame:
    """Documents ranked inside each source page against the page's title."""
    docs = table(spark, d, "documents").where("text is not null and page_title is not null")
    titles = docs.select("page_title").distinct().withColumn("asked", F.replace(F.col("page_title"), F.lit("_"), F.lit(" ")))
    best = retrieval.top_k(retrieval.bm25_within(titles, "asked", docs, "page_title", "doc_id", "text"), "page_title", "doc_id", 3)
    return best.select("page_title", "doc_id", F.round("score", 6).alias("score"), "rank")


def _greedy(blocks: str, limit: int) -> str:
    """Blocks ``(g, p, b)`` in order, skipping those that no longer fit, as one text a group."""
    return f"""o AS (SELECT g, b, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM {blocks}),
r AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS b FROM (SELECT DISTINCT g FROM o) UNION ALL SELECT o.g, o.i, CASE WHEN used + length(o.b) <= {limit} THEN used + length(o.b) ELSE used END, CASE WHEN used + length(o.b) <= {limit} THEN o.b END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g AS question_id, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY i), '') AS context FROM r GROUP BY g"""


_DOCS = "docs AS (SELECT question_id, 'table:' || table_name || ':row:' || row_index AS doc, 'Table ' || table_name || '. ' || string_agg(column_name || ' is ' || value || '.', ' ' ORDER BY col_index) AS text FROM cells WHERE trim(value, ' ') <> '' GROUP BY question_id, table_name, row_index UNION ALL SELECT question_id, 'text:' || i, text FROM passages)"
_FLAT = f"WITH RECURSIVE {hybrid.DATA}, {_DOCS}, iq AS (SELECT question_id AS g, question AS t FROM qs), it AS (SELECT question_id AS g, doc AS i, doc AS pos, text FROM docs), {hybrid.bm25_sql('b1', 'iq', 'it')}, s1 AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, i) AS p FROM b1 QUALIFY p <= 5), bl AS (SELECT s1.g, p, '[' || i || '] ' || text AS b FROM s1 JOIN it USING (g, i)), {_greedy('bl', 400)}"


@query("context_flat", _FLAT)
def context_flat(spark: SparkSession, d: str) -> DataFrame:
    """The best rows and passages of every question within 400 characters."""
    return methods.flat_context(hybrid.dataset(spark, d), 5, 400)


@query("context_direct", f"WITH {hybrid.DATA}, {_DOCS}, c AS (SELECT *, CASE WHEN doc LIKE 'table:%' THEN 0 ELSE 1 END AS k, sum(length(text)) OVER (PARTITION BY question_id ORDER BY CASE WHEN doc LIKE 'table:%' THEN 0 ELSE 1 END, doc ROWS UNBOUNDED PRECEDING) AS used FROM docs) SELECT question_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY k, doc) FILTER (used <= 300), '') AS context FROM c GROUP BY question_id")
def context_direct(spark: SparkSession, d: str) -> DataFrame:
    """Rows, then passages of every question up to the first that does not fit 300 characters."""
    return methods.direct_context(hybrid.dataset(spark, d), 300)


@query("context_oracle", "SELECT 'q' || c_nationkey AS question_id, CAST(2 AS INTEGER) AS n_blocks FROM customer GROUP BY 1 HAVING count(*) > 1")
def context_oracle(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of gold evidence of every question."""
    out = methods.oracle_context(readers._linked(spark, d))
    return out.select(*Q, F.size(F.split("context", "\n\n")).alias("n_blocks"))


@query("context_edges", "SELECT question_id, CAST(least(count(*), 20) AS INTEGER) AS n, arg_min(head, triple_id) AS first FROM triple WHERE question_id IS NOT NULL GROUP BY question_id")
def context_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty edges of every graph as JSON, read again."""
    out = methods.edge_context(edges(spark, d).where("question_id is not null"), 20)
    listed = F.from_json("context", "array<struct<head: string>>")
    return out.select(*Q, F.size(listed).alias("n"), listed[0]["head"].alias("first"))


_PATHS = f"""WITH RECURSIVE qs AS (SELECT question_id, arg_max(question, ingested_at) AS question FROM sample_hybridqa GROUP BY 1),
nm AS (SELECT question_id AS g, lower(x) AS n FROM (SELECT question_id, unnest([head, tail]) AS x FROM triple) WHERE x LIKE '% Bay' GROUP BY ALL),
bl AS (SELECT question_id AS g, (-(4 * len(list_intersect({S.terms("concat_ws(' ', head, relation, tail)")}, {S.terms("question")})) + 2 * len(list_intersect({S.terms("concat_ws(' ', head, relation, tail)")}, ['birth', 'date'])) + CASE WHEN (question_id, lower(head)) IN (SELECT (g, n) FROM nm) OR (question_id, lower(tail)) IN (SELECT (g, n) FROM nm) THEN 6 ELSE 0 END), triple_id) AS p, concat_ws(' | ', head, relation, tail) || ' [' || concat_ws(' ', source_type, source_id) || ']' AS b FROM triple JOIN qs USING (question_id)), {_greedy('bl', 300)}"""


@query("context_paths", _PATHS)
def context_paths(spark: SparkSession, d: str) -> DataFrame:
    """Edges by the terms of questions and paths and by candidates, within 300 characters."""
    questions = table(spark, d, "sample_hybridqa").groupBy(*Q).agg(F.max_by("question", "ingested_at").alias("question"))
    named = edges(spark, d).select(*Q, F.explode(F.array("head", "tail")).alias("entity")).where("entity like '% Bay'").distinct()
    paths = questions.select(*Q, F.array(F.lit("find the birth"), F.lit("date")).alias("goals"))
    return methods.path_context(questions, edges(spark, d), named, paths, 300)


@query("preferred_aliases", "SELECT s_suppkey AS question_id, 'Club ' || s_name || ' FC' AS canonical, s_name AS shown FROM supplier")
def preferred_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The shortest of the names of each entity."""
    s = table(spark, d, "supplier")
    aliases = s.select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("Club "), "s_name", F.lit(" FC")).alias("canonical"), F.explode(F.array(F.col("s_name"), F.concat("s_name", F.lit(" FC")))).alias("node"))
    return methods.preferred_alias(aliases)


@query("matched_candidates", "SELECT s_suppkey AS question_id, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name ELSE 'none of ' || s_name || ' and Other' END AS prediction FROM supplier")
def matched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Answers replaced by the candidate they equal or the only one they hold."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey") % 3
    answers = s.select(F.col("s_suppkey").alias("question_id"), F.when(k == 0, F.concat(F.lit(" "), F.upper("s_name"))).when(k == 1, F.concat(F.lit("It is "), "s_name", F.lit("."))).otherwise(F.concat(F.lit("none of "), "s_name", F.lit(" and Other"))).alias("prediction"))
    named = s.select(F.col("s_suppkey").alias("question_id"), F.explode(F.array(F.col("s_name"), F.lit("Other"))).alias("entity"))
    return methods.match_candidate(answers, named).select(*Q, "prediction")


@query("audit", "SELECT count(*) AS n_examples, count(*) AS n_both, CAST(0 AS BIGINT) AS n_table_only, CAST(0 AS BIGINT) AS n_text_only, CAST(0 AS BIGINT) AS n_none, CAST(0 AS BIGINT) AS n_yes_no, count(*) AS n_text, count(*) FILTER (c_mktsegment <> 'MACHINERY') AS n_unmatched, round(count(*) FILTER (c_mktsegment = 'MACHINERY') * 1.0 / count(*), 6) AS recall FROM customer")
def audit(spark: SparkSession, d: str) -> DataFrame:
    """An audit of reports whose gold text is a passage of some of them only."""
    data = readers._reports(spark, d)
    data.questions = data.questions.withColumn("metadata", F.lit('{"gold_inds": {"text_2": " Machinery ", "table_1": "row"}}'))
    return methods.audit(data, 3)


@query("audit_tables", "SELECT CAST(0 AS BIGINT) AS n_lossy, count(*) FILTER (len(h) <> len(list_distinct(h))) AS n_repeated FROM (SELECT [trim(coalesce(c, ''), ' ') FOR c IN texts[1]] AS h FROM hitab)")
def audit_tables(spark: SparkSession, d: str) -> DataFrame:
    """Matrices that lose columns or repeat headers."""
    return methods.table_audit(table(spark, d, "hitab"), "texts")


@query("program_attributes", "SELECT last_op, bucket, count(*) AS n FROM (SELECT program_id, arg_max(op, (step_pos, step_id)) AS last_op, CASE WHEN count(*) <= 1 THEN '1' WHEN count(*) = 2 THEN '2' ELSE '3+' END AS bucket FROM (SELECT DISTINCT program_id, step_id, step_pos, op FROM irstep) GROUP BY 1) GROUP BY ALL")
def program_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Final operators and step buckets of all programs."""
    steps = table(spark, d, "irstep").select("program_id", "step_id", "step_pos", "op").distinct()
    rows = steps.groupBy("program_id").agg(F.max_by("op", F.struct("step_pos", "step_id")).alias("last_op"), F.count("*").alias("k"))
    bucket = F.when(F.col("k") <= 1, "1").when(F.col("k") == 2, "2").otherwise("3+")
    return rows.groupBy("last_op", bucket.alias("bucket")).agg(F.count("*").alias("n"))
