"""Queries over the readers of data sets, fed with records made of the driver's tables, and over sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import generation, methods, nested, score
from gleaner.plans import problems
from gleaner.plans.registry import query
from gleaner.session import materialize, shared_dir, table
from gleaner.sources import adapters, sinks


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("read_records", "SELECT c_custkey, c_name FROM customer")
def read_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as one wrapped JSON file a nation, and read again as records."""
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct("c_custkey", "c_name")).alias("examples"))).alias("value"))
    path = _folder(spark, "wrapped")
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    got = adapters.read_records(spark, f"{path}/*/*.txt")
    back = F.from_json("record", "c_custkey long, c_name string")
    return got.dropDuplicates(["position"]).select(back["c_custkey"].alias("c_custkey"), back["c_name"].alias("c_name"))


@query("read_lines", "SELECT c_custkey, c_name FROM customer")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as JSON lines, and read again as records."""
    path = _folder(spark, "lines")
    table(spark, d, "customer").select("c_custkey", "c_name").write.json(path)
    back = F.from_json("record", "c_custkey long, c_name string")
    return adapters.read_records(spark, path, lines=True).select(back["c_custkey"].alias("c_custkey"), back["c_name"].alias("c_name"))


# -- questions on tables with linked passages -----------------------------------------------------------

_ORDER = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1"


def _linked(spark: SparkSession, d: str) -> adapters.Dataset:
    """A question for every nation on a table of its customers; names link to a passage of their segment, and every
    nation has an external passage and one that the table knows already."""
    c = table(spark, d, "customer")
    link = F.struct(F.concat(F.lit("/wiki/"), F.col("c_mktsegment")).alias("url"), F.concat(F.lit("About "), F.col("c_mktsegment")).alias("summary"))
    cell = F.to_json(F.struct(F.col("c_name").alias("value"), F.array(link).alias("urls")))
    row = F.concat(F.lit("["), cell, F.lit(', "'), F.col("c_custkey"), F.lit('"]'))
    rows = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]), ", ").alias("rows"))
    key = F.concat(F.lit("t"), F.col("c_nationkey"))
    tables = rows.select(key.alias("name"), F.concat(F.lit('{"title": "T '), F.col("c_nationkey"), F.lit('", "header": ["Name", "Key", ""], "data": ['), F.col("rows"), F.lit("]}")).alias("content"))
    records = rows.select(F.col("c_nationkey").cast("long").alias("position"), F.concat(F.lit('{"question_id": "q'), F.col("c_nationkey"), F.lit('", "question": "Who?", "table_id": "'), key, F.lit('", "answer-text": "x", "answer-node": [["x", [1, 0], "/wiki/BUILDING", "passage"]]}')).alias("record"))
    extra = rows.select(key.alias("name"), F.lit('{"/wiki/BUILDING": "other", "/ext": {"text": ["more", {"summary": "words"}]}}').alias("content"))
    return adapters.load_linked(spark, records, tables, extra)


@query("adapter_linked_cells", f"SELECT 'q' || c_nationkey AS question_id, 'T ' || c_nationkey AS table_name, CAST(i AS INTEGER) AS row_index, CAST(j AS INTEGER) AS col_index, ['Name', 'Key', 'column_2'][j + 1] AS column_name, CASE j WHEN 0 THEN c_name WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS value FROM (SELECT *, {_ORDER} AS i FROM customer), range(0, 3) r(j)")
def adapter_linked_cells(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).cells


@query("adapter_linked_passages", f"SELECT 'q' || c_nationkey AS question_id, source_id, text FROM (SELECT DISTINCT c_nationkey, '/wiki/' || c_mktsegment AS source_id, 'About ' || c_mktsegment AS text FROM customer UNION ALL SELECT DISTINCT c_nationkey, '/ext', 'more words' FROM customer UNION ALL SELECT c_nationkey, '/wiki/BUILDING', 'other' FROM customer GROUP BY 1 HAVING NOT bool_or(c_mktsegment = 'BUILDING'))")
def adapter_linked_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of links, each once, and external ones whose names are new."""
    return _linked(spark, d).passages.select("question_id", "source_id", "text")


@query("adapter_linked_questions", "SELECT DISTINCT 'q' || c_nationkey AS question_id, 't' || c_nationkey AS table_id, 'x' AS answer FROM customer")
def adapter_linked_questions(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).questions.select("question_id", "table_id", "answer")


@query("oracle_evidence", f"SELECT 'q' || c_nationkey AS question_id, 'table:T ' || c_nationkey || ':row:1' AS doc, 'Table T ' || c_nationkey || '. Name is ' || c_name || '. Key is ' || c_custkey || '.' AS text FROM (SELECT *, {_ORDER} AS i FROM customer) WHERE i = 1 UNION ALL SELECT 'q' || c_nationkey, 'text:/wiki/BUILDING', CASE WHEN bool_or(c_mktsegment = 'BUILDING') THEN 'About BUILDING' ELSE 'other' END FROM customer GROUP BY c_nationkey")
def oracle_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The row and the passage that answers are marked with."""
    return adapters.oracle_evidence(_linked(spark, d))


# -- questions on reports ------------------------------------------------------------------------------------


def _reports(spark: SparkSession, d: str, form: str = "official") -> adapters.Dataset:
    """A report for every customer: its balance in two years, and three paragraphs."""
    c = table(spark, d, "customer")
    q = lambda x: F.to_json(F.array(x))
    record = F.concat(F.lit('{"id": "'), "c_name", F.lit('", "pre_text": ["one", "two"], "post_text": '), q(F.col("c_mktsegment")), F.lit(', "table": [["", "2001", "2002"], ["balance", "'), F.col("c_acctbal"), F.lit('"]], "table_ori": [["a"], ["'), F.col("c_custkey"), F.lit('", "wide"]], "qa": {"question": "What?", "answer": "5%", "exe_ans": 0.05, "program": "divide(1, 20)", "gold_inds": {"text_2": "gold", "table_1": "row"}}}'))
    return adapters.load_reports(spark, c.select(F.col("c_custkey").alias("position"), record.alias("record")), form)


@query("adapter_report_cells", "SELECT c_name AS question_id, CAST(j AS INTEGER) AS col_index, ['column_0', '2001_period', '2002_period'][j + 1] AS column_name, CASE j WHEN 0 THEN 'balance' ELSE CAST(c_acctbal AS VARCHAR) END AS value FROM customer, range(0, 2) r(j)")
def adapter_report_cells(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).cells.select("question_id", "col_index", "column_name", "value")


@query("adapter_report_raw", "SELECT c_name AS question_id, CAST(j AS INTEGER) AS col_index, ['a', 'column_1'][j + 1] AS column_name, CASE j WHEN 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'wide' END AS value FROM customer, range(0, 2) r(j)")
def adapter_report_raw(spark: SparkSession, d: str) -> DataFrame:
    """The raw tables of reports, with a row wider than the header."""
    return _reports(spark, d, "raw").cells.select("question_id", "col_index", "column_name", "value")


@query("adapter_report_passages", "SELECT c_name AS question_id, c_name || ':text:' || i AS source_id, CASE i WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE c_mktsegment END AS text, '0.05' AS answer FROM customer, range(0, 3) r(i)")
def adapter_report_passages(spark: SparkSession, d: str) -> DataFrame:
    data = _reports(spark, d)
    return data.passages.join(data.questions, "question_id").select("question_id", "source_id", "text", "answer")


@query("oracle_gold", "SELECT c_name AS question_id, 'gold:' || k AS doc, CASE k WHEN 'text_2' THEN 'gold' ELSE 'row' END AS text FROM customer, (VALUES ('text_2'), ('table_1')) v(k)")
def oracle_gold(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that reports list as gold."""
    return adapters.oracle_evidence(_reports(spark, d))


# -- questions on hierarchical tables ------------------------------------------------------------------------

_HT = f"SELECT table_id, count(*) + count(DISTINCT row_index) AS n_cells FROM ({problems._CELLS}) GROUP BY table_id"


@query("adapter_hierarchical", f"SELECT e.example_id AS question_id, e.table_id, CAST(coalesce(n_cells, 0) AS BIGINT) AS n_cells FROM (SELECT DISTINCT example_id, table_id FROM datasetexample WHERE dataset = 'hitab') e LEFT JOIN ({_HT}) USING (table_id)")
def adapter_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Questions on hierarchical tables with the number of their cells and row paths."""
    e = table(spark, d, "datasetexample").where("dataset = 'hitab'").select("example_id", "table_id").distinct()
    records = e.select(F.xxhash64("example_id").alias("position"), F.to_json(F.struct(F.col("example_id").alias("id"), "table_id", F.lit("?").alias("question"), F.array(F.lit("1")).alias("answer"))).alias("record"))
    t = nested.latest(table(spark, d, "hitab"), "table_id", "ingested_at", nested.TABLE)
    rest = F.to_json(F.struct("texts", "top_header_rows_num", "left_header_columns_num", "merged_regions"))
    named = t.withColumn("x", rest).select(F.col("table_id").alias("name"), F.concat(F.expr("substring(x, 1, length(x) - 1)"), F.lit(', "left_root": '), F.coalesce("left_root", F.lit("null")), F.lit("}")).alias("content"))
    data = adapters.load_hierarchical(spark, records, named)
    n = data.cells.groupBy("question_id").agg(F.count("*").alias("n_cells"))
    return data.questions.join(n, "question_id", "left").select("question_id", "table_id", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


# -- sinks ---------------------------------------------------------------------------------------------------


@query("resume_anti_join", "SELECT DISTINCT program_id FROM numericalprogram WHERE repair_count > 0")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Programs that a stopped run has left: those without repairs are in the output."""
    rows = table(spark, d, "numericalprogram").select("program_id", "repair_count").distinct()
    path = _folder(spark, "run")
    sinks.run_resumable(rows.where("repair_count = 0"), path, "program_id", lambda df: df)
    return sinks.pending(rows, path, "program_id").select("program_id")


@query("resumed_run", "SELECT program_id, count(*) AS n FROM (SELECT DISTINCT program_id FROM numericalprogram) GROUP BY 1")
def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run stopped half way and resumed twice writes every program once."""
    rows = table(spark, d, "numericalprogram").select("program_id", "repair_count").distinct()
    path = _folder(spark, "run")
    for part in (rows.where("repair_count = 0"), rows, rows):
        sinks.run_resumable(part, path, "program_id", lambda df: df.select("program_id"))
    return spark.read.schema("program_id string").json(path).groupBy("program_id").agg(F.count("*").alias("n"))


@query("written_summary", "SELECT dataset, count(*) AS n, count(*) FILTER (answer IS NULL) AS n_failed, round(avg(length(question)), 4) AS mean_size FROM datasetexample GROUP BY dataset")
def written_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary as it lies beside its output."""
    rows = table(spark, d, "datasetexample").select("dataset", F.length("question").alias("size"), F.when(F.col("answer").isNull(), "no answer").alias("error"))
    path = _folder(spark, "out")
    sinks.write_summary(rows, path, ["size"], "dataset")
    back = spark.read.schema("dataset string, n long, n_failed long, mean_size double").json(f"{path}.summary")
    return back.withColumn("mean_size", F.round("mean_size", 4))


@query("written_shards", "SELECT CAST(program_shard AS INTEGER) AS shard_index, count(*) AS n FROM (SELECT CAST(substr(program_id, 2) AS BIGINT) % 3 AS program_shard FROM (SELECT DISTINCT program_id FROM numericalprogram)) GROUP BY 1")
def written_shards(spark: SparkSession, d: str) -> DataFrame:
    """Samples by shard as files, read again."""
    rows = table(spark, d, "numericalprogram").select("program_id").distinct().withColumn("shard_index", (F.substring("program_id", 2, 20).cast("long") % 3).cast("int"))
    path = _folder(spark, "shards")
    sinks.write_shards(rows, path, rows.groupBy("shard_index").count())
    return spark.read.json(path).groupBy(F.col("shard_index").cast("int").alias("shard_index")).agg(F.count("*").alias("n"))


@query("dataset_run", "SELECT c_name AS question_id, 'What?' AS question, '0.05' AS gold, '5.0%' AS answer, CAST(0 AS DOUBLE) AS exact_match, CAST(1 AS DOUBLE) AS ratio_match FROM customer")
def dataset_run(spark: SparkSession, d: str) -> DataFrame:
    """A run of a method over a data set, written and read again with its metrics."""
    path = _folder(spark, "run")
    methods.run(_reports(spark, d), path, lambda questions: questions.select("question_id", F.lit("5.0%").alias("answer")))
    back = spark.read.schema("question_id string, question string, gold string, answer string").json(path)
    return back.select("*", score.exact_match(F.col("answer"), F.col("gold")).alias("exact_match"), score.ratio_match(F.col("answer"), F.col("gold")).alias("ratio_match"))


@query("baseline_run", "SELECT 'baseline' AS method, count(*) AS n, round(100.0 * avg(e), 2) AS exact_match_percent, round(100.0 * avg(f), 2) AS f1_percent FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS e, CASE WHEN c_custkey % 4 = 0 THEN 1.0 WHEN c_custkey % 4 = 1 THEN 2.0 / 3 ELSE 0.0 END AS f FROM customer)")
def baseline_run(spark: SparkSession, d: str) -> DataFrame:
    """The summary of one method: exact matches and F1 in percent."""
    k = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select(F.col("c_name").alias("question_id"), F.lit("Ann Lee").alias("gold"), F.when(k == 0, "the Ann Lee!").when(k == 1, "Lee").otherwise("x").alias("answer"))
    return methods.baseline_summary(materialize(rows, "rows"), "baseline")


@query("call_log", "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS chars FROM customer")
def call_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of a provider's replies: their keys and lengths."""
    path = _folder(spark, "log")
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    generation.logged(generation.complete(rows, "c_custkey", "c_name", lambda prompts: prompts), path)
    return spark.read.schema("c_custkey long, chars int").json(path)
