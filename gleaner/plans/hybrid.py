"""Queries over questions on tables and passages made of the stored facts: anchors, constraints, two-stage retrieval.

Facts from tables are cells of rows (the row's first head under ``name``, its place under ``rank`` and a season),
facts from texts are passages, one a source.  Every question also asks for the second row of a season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import graph, retrieval, tables
from gleaner.plans import sqltext as S
from gleaner.plans.registry import query
from gleaner.session import materialize, table
from gleaner.sources.adapters import Dataset

Q = ["question_id"]
_END = " Which name was second in 1902?"

DATA = f"""qs AS (SELECT question_id, question || '{_END}' AS question, answer_text AS answer FROM (SELECT DISTINCT ON (question_id) * FROM sample_hybridqa WHERE question_id IS NOT NULL AND question IS NOT NULL ORDER BY question_id, ingested_at DESC)),
tt AS (SELECT question_id, source_id AS table_name, row_index, column_name, tail, head, min(triple_id) AS s FROM triple WHERE source_type = 'table' AND row_index IS NOT NULL AND source_id IS NOT NULL AND column_name IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL),
cells AS (SELECT question_id, table_name, row_index, 0 AS col_index, 'name' AS column_name, arg_min(head, s) AS value FROM tt GROUP BY question_id, table_name, row_index
UNION ALL SELECT question_id, table_name, row_index, row_number() OVER (PARTITION BY question_id, table_name, row_index ORDER BY s), column_name, tail FROM tt
UNION ALL SELECT DISTINCT question_id, table_name, row_index, 1000, 'rank', CAST(row_index + 1 AS VARCHAR) FROM tt UNION ALL SELECT DISTINCT question_id, table_name, row_index, 1001, 'season', CAST(1900 + row_index % 5 AS VARCHAR) FROM tt),
pp AS (SELECT question_id, source_id AS i, string_agg(head || ' ' || relation || ' ' || tail || '.', ' ' ORDER BY triple_id) AS text, min(triple_id) AS s FROM triple WHERE source_type = 'text' AND source_id IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL),
passages AS (SELECT question_id, i, text, row_number() OVER (PARTITION BY question_id ORDER BY s) AS pos FROM pp)"""


def dataset(spark: SparkSession, d: str) -> Dataset:
    t = table(spark, d, "triple").where("question_id is not null and source_id is not null")
    facts = t.where("source_type = 'table' and row_index is not null and column_name is not null").groupBy(*Q, F.col("source_id").alias("table_name"), "row_index", "column_name", "tail", "head").agg(F.min("triple_id").alias("s"))
    facts = materialize(facts, "cells")
    row = [*Q, "table_name", "row_index"]
    rows = facts.groupBy(*row).agg(F.min_by("head", "s").alias("name"))
    cell = lambda at, name, value: F.struct(F.lit(at).alias("col_index"), F.lit(name).alias("column_name"), value.alias("value"))
    extra = F.array(cell(0, "name", F.col("name")), cell(1000, "rank", (F.col("row_index") + 1).cast("string")), cell(1001, "season", (1900 + F.col("row_index") % 5).cast("string")))
    own = facts.select(*row, F.row_number().over(Window.partitionBy(*row).orderBy("s")).alias("col_index"), "column_name", F.col("tail").alias("value"))
    cells = rows.select(*row, F.inline(extra)).unionByName(own)
    text = F.concat(F.col("head"), F.lit(" "), F.col("relation"), F.lit(" "), F.col("tail"), F.lit("."))
    said = t.where("source_type = 'text'").select(*Q, "source_id", "triple_id", text.alias("x"))
    joined = said.groupBy(*Q, "source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("triple_id", "x"))), lambda r: r["x"]), " ").alias("text"), F.min("triple_id").alias("s"))
    passages = joined.select(*Q, F.lit("text").alias("source_type"), "source_id", F.row_number().over(Window.partitionBy(*Q).orderBy("s")).alias("position"), "text")
    asked = table(spark, d, "sample_hybridqa").where("question_id is not null and question is not null").groupBy(*Q).agg(F.max_by(F.struct("question", "answer_text"), "ingested_at").alias("x"))
    questions = asked.select(*Q, F.concat("x.question", F.lit(_END)).alias("question"), F.col("x.answer_text").alias("answer"), F.lit("{}").alias("metadata"))
    return Dataset(questions, cells, passages)


# -- tables in long form -------------------------------------------------------------------------------


@query("melt_cells", f"WITH {DATA} SELECT question_id, table_name, CAST(row_index AS INTEGER) AS row_index, CAST(col_index AS INTEGER) AS col_index, column_name, value FROM cells")
def melt_cells(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).cells.select(*Q, "table_name", "row_index", "col_index", "column_name", "value")


_KEYED = "c JOIN (SELECT question_id, table_name, row_index, value AS head FROM cells WHERE col_index = 0) k USING (question_id, table_name, row_index)"


@query("cells_to_triples", rf"WITH {DATA} SELECT question_id, table_name, CAST(row_index AS INTEGER) AS row_index, head, column_name AS relation, trim(value, ' ') AS tail, array_to_string(list_filter(regexp_split_to_array(column_name, '_+'), lambda x: x <> ''), '|') AS path FROM cells {_KEYED} WHERE col_index > 0 AND trim(value, ' ') <> '' AND trim(head, ' ') <> ''")
def cells_to_triples(spark: SparkSession, d: str) -> DataFrame:
    facts = tables.cell_facts(dataset(spark, d).cells, [*Q, "table_name"])
    return facts.select(*Q, "table_name", "row_index", "head", "relation", "tail", F.array_join("header_path", "|").alias("path"))


@query("flatten_documents", f"WITH {DATA} SELECT question_id, 'table:' || table_name || ':row:' || row_index AS doc, 'Table ' || table_name || '. ' || string_agg(column_name || ' is ' || value || '.', ' ' ORDER BY col_index) AS text FROM cells WHERE trim(value, ' ') <> '' GROUP BY question_id, table_name, row_index")
def flatten_documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_documents(dataset(spark, d).cells, Q)


@query("kg_structure", f"WITH {DATA} SELECT kind, count(*) AS n, count(DISTINCT head) AS n_heads, count(DISTINCT tail) AS n_tails FROM (SELECT DISTINCT 'table:' || table_name AS head, 'table:' || table_name || ':row:' || row_index AS tail, 'row_contains' AS kind FROM cells UNION SELECT 'table:' || table_name || ':row:' || row_index, 'table:' || table_name || ':row:' || row_index || ':cell:' || column_name, 'row_contains' FROM cells UNION SELECT 'table:' || table_name || ':row:' || row_index || ':cell:' || column_name, 'table:' || table_name || ':column:' || column_name, 'column_of' FROM cells) GROUP BY kind")
def kg_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the structure of all tables, counted by kind."""
    return graph.structure(dataset(spark, d).cells).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("head").alias("n_heads"), F.countDistinct("tail").alias("n_tails"))


@query("prompt_batches", f"WITH {DATA} SELECT question_id, table_name, CAST(row_index // 5 AS INTEGER) AS batch, CAST(count(DISTINCT row_index) AS INTEGER) AS n FROM cells GROUP BY ALL")
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables in batches of five."""
    from gleaner.operators import generation

    return generation.batches_of(dataset(spark, d).cells, [*Q, "table_name"]).select(*Q, "table_name", "batch", F.size("rows").alias("n"))


@query("context_before", f"WITH {DATA} SELECT question_id, i AS source_id, concat_ws(' ', lag(text, 2) OVER w, lag(text, 1) OVER w) AS context_before FROM passages WINDOW w AS (PARTITION BY question_id ORDER BY pos)")
def context_before(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the two passages before each one of the same question."""
    return tables.passage_context(dataset(spark, d).passages, Q, "position", "text").select(*Q, "source_id", "context_before")


# -- anchors and constraints -----------------------------------------------------------------------------

_ENTITY = "(lower(column_name) LIKE '%" + "%' OR lower(column_name) LIKE '%".join(T.ENTITY_COLUMNS) + "%')"
_ANSWER = "(lower(column_name) LIKE '%" + "%' OR lower(column_name) LIKE '%".join(T.ANSWER_COLUMNS) + "%')"
_V = f"trim(regexp_replace(value, '{S.WHITE}', ' ', 'g'), ' ')"
ANCHORS = f"""ent AS (SELECT question_id, table_name, row_index, arg_min({_V}, (CASE WHEN {_ENTITY} THEN 0 ELSE 1 END, col_index)) AS entity FROM cells WHERE {_V} <> '' AND ({_ENTITY} OR lower(column_name) NOT LIKE '%rank%') GROUP BY ALL),
ac AS (SELECT question_id, table_name, row_index, arg_min(column_name, (CASE WHEN {_ANSWER} AND contains(lower(question), lower(column_name)) THEN 0 WHEN {_ANSWER} THEN 1 ELSE 2 END, col_index)) AS entity_column FROM cells JOIN qs USING (question_id) GROUP BY ALL),
lit AS (SELECT DISTINCT question_id, question, unnest(regexp_extract_all(question, '\\b(?:19|20)\\d{{2}}\\b')) AS literal FROM qs),
hit AS (SELECT l.question_id, question, literal, c.table_name, c.row_index, c.col_index, c.column_name, entity_column, len(list_intersect({S.terms('c.column_name')}, {S.terms('question')})) AS overlap FROM lit l JOIN cells c ON c.question_id = l.question_id AND lower({_V.replace('value', 'c.value')}) = l.literal JOIN ac ON ac.question_id = c.question_id AND ac.table_name = c.table_name AND ac.row_index = c.row_index),
top AS (SELECT h.*, (SELECT arg_min({_V}, col_index) FROM cells c WHERE c.question_id = h.question_id AND c.table_name = h.table_name AND c.row_index = h.row_index AND c.column_name = h.entity_column) AS candidate FROM hit h),
kept AS (SELECT * FROM top WHERE candidate <> '' QUALIFY rank() OVER (PARTITION BY question_id, literal ORDER BY overlap DESC) = 1),
con AS (SELECT question_id, literal, column_name, entity_column, candidate, regexp_matches(lower(any_value(question)), '\\b(?:which|what|who)\\b') AND regexp_matches(lower(any_value(question)), '\\b' || lower(entity_column) || '\\b') AS enforce_output, min((table_name, row_index, col_index)) AS pl FROM kept GROUP BY question_id, literal, column_name, entity_column, candidate),
cons AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pl, literal, column_name) AS place FROM con),
br AS (SELECT question_id, entity, min(pl) AS pl FROM (SELECT e.question_id, entity, (0, e.table_name, CAST(e.row_index AS BIGINT)) AS pl FROM ent e JOIN cells c ON c.question_id = e.question_id AND c.table_name = e.table_name AND c.row_index = e.row_index WHERE lower(c.column_name) LIKE '%rank%' AND c.value = (SELECT CASE WHEN regexp_matches(lower(question), '\\bfirst\\b') THEN '1' ELSE '2' END FROM qs WHERE qs.question_id = e.question_id) UNION ALL SELECT question_id, candidate, (1, '', place) FROM cons) GROUP BY ALL),
bridge AS (SELECT question_id, entity, row_number() OVER (PARTITION BY question_id ORDER BY pl, entity) AS place FROM br)"""


@query("row_entities", f"WITH {DATA}, {ANCHORS} SELECT question_id, table_name, CAST(row_index AS INTEGER) AS row_index, entity, entity_column FROM ent JOIN ac USING (question_id, table_name, row_index)")
def row_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity and the answer column of every row."""
    data = dataset(spark, d)
    rows = retrieval.table_rows(data.cells, Q).join(data.questions, Q)
    return rows.select(*Q, "table_name", "row_index", T.row_entity(F.col("cells")).alias("entity"), T.answer_column(F.col("cells"), F.col("question")).alias("entity_column"))


def _constraints(data: Dataset) -> DataFrame:
    return retrieval.table_constraints(data.questions.withColumn("q", F.col("question_id")), "q", "question", data.cells, Q)


@query("table_constraints", f"WITH {DATA}, {ANCHORS} SELECT question_id, literal, column_name, entity_column, candidate, enforce_output, CAST(place AS INTEGER) AS place FROM cons")
def table_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Cells that equal a literal of the question, with the entities of their rows."""
    return _constraints(dataset(spark, d)).drop("q")


@query("constraint_policy", f"WITH {DATA}, {ANCHORS} SELECT question_id, array_to_string(list_sort(list_distinct(list({S.key('candidate')}) FILTER (enforce_output))), '|') AS allowed, true AS need_table FROM cons GROUP BY question_id")
def constraint_policy(spark: SparkSession, d: str) -> DataFrame:
    """What the constraints of a question allow as its answer."""
    policy = retrieval.constraint_policy(_constraints(dataset(spark, d)).drop("q"), "question_id")
    return policy.select(*Q, F.array_join("allowed", "|").alias("allowed"), "need_table")


@query("bridge_entities", f"WITH {DATA}, {ANCHORS} SELECT question_id, entity, CAST(place AS INTEGER) AS place FROM bridge")
def bridge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the rows of the named rank, then candidates of constraints."""
    data = dataset(spark, d)
    return retrieval.bridge_entities(data.questions.withColumn("q", F.col("question_id")), "q", "question", data.cells, Q, _constraints(data)).drop("q")


@query("header_lists", f"WITH {DATA} SELECT question_id, string_agg(h, '|' ORDER BY pl) AS headers FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pl) AS r FROM (SELECT question_id, min((table_name, row_index, col_index)) AS pl, arg_min(trim(column_name, ' '), (table_name, row_index, col_index)) AS h FROM cells WHERE trim(column_name, ' ') <> '' GROUP BY question_id, lower(trim(column_name, ' ')))) WHERE r <= 20 GROUP BY question_id")
def header_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty headers of each question's tables."""
    return retrieval.header_list(dataset(spark, d).cells, Q).select(*Q, F.array_join("headers", "|").alias("headers"))


# -- retrieval -----------------------------------------------------------------------------------------------


def bm25_sql(name: str, queries: str, items: str) -> str:
    """Common tables that end in ``name (g, i, pos, score)``: items ``(g, i, pos, text)`` of each group against the
    group's query ``(g, t)``."""
    cut = lambda x: f"unnest(regexp_split_to_array(lower({x}), '{S.WHITE}'))"
    return f"""{name}_tf AS (SELECT g, i, term, count(*) AS tf FROM (SELECT g, i, {cut('text')} AS term FROM {items}) WHERE term <> '' GROUP BY ALL),
{name}_dl AS (SELECT t.g, t.i, t.pos, coalesce(sum(tf), 0) AS dl FROM {items} t LEFT JOIN {name}_tf USING (g, i) GROUP BY ALL),
{name}_st AS (SELECT g, count(*) AS n, avg(dl) AS avgdl FROM {name}_dl GROUP BY g),
{name}_i0 AS (SELECT g, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM {name}_tf JOIN {name}_st USING (g) GROUP BY g, term, n),
{name}_i1 AS (SELECT g, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY g) ELSE idf END AS idf FROM {name}_i0),
{name}_q AS (SELECT g, term, count(*) AS qtf FROM (SELECT g, {cut('t')} AS term FROM {queries}) WHERE term <> '' GROUP BY ALL),
{name}_s AS (SELECT g, i, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_q JOIN {name}_tf USING (g, term) JOIN {name}_i1 USING (g, term) JOIN {name}_dl USING (g, i) JOIN {name}_st USING (g) GROUP BY ALL),
{name} AS (SELECT g, i, pos, coalesce(score, 0) AS score FROM {name}_dl LEFT JOIN {name}_s USING (g, i) WHERE g IN (SELECT g FROM {queries}))"""


def _top(name: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, pos) AS r FROM {name} QUALIFY r <= {k})"


def _named(queries: str, items: str, k: int, out: str) -> str:
    words = lambda x: f"list_filter(list_distinct(string_split({S.key(x)}, ' ')), lambda w: w <> '')"
    return f"""{out}_b AS (SELECT m.g, m.i, m.pos, m.text, len({words('t')}) > 0 AND list_has_all({words('m.text')}, {words('t')}) AS whole FROM {items} m JOIN {queries} q USING (g)),
{out}_n AS (SELECT g, i, pos, text FROM {out}_b WHERE NOT whole), {bm25_sql(out + '_f', queries, out + '_n')}, {_top(out + '_f', k, out + '_k')},
{out} AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY tier, p) AS r FROM (SELECT g, i, 0 AS tier, pos AS p FROM {out}_b WHERE whole UNION ALL SELECT g, i, 1, r FROM {out}_k) QUALIFY r <= {k})"""


_K, _B = 2, 2
_FIRST = f"""iq AS (SELECT question_id AS g, question AS t FROM qs), it AS (SELECT question_id AS g, i, pos, text FROM passages), {bm25_sql('b1', 'iq', 'it')}, {_top('b1', _K, 's1')}"""
_RETRIEVE = f"""WITH {DATA}, {ANCHORS}, {_FIRST},
rest AS (SELECT * FROM it WHERE (g, i) NOT IN (SELECT (g, i) FROM s1)),
cq AS (SELECT question_id || '|c|' || min(place) AS g, candidate AS t, question_id FROM cons GROUP BY question_id, candidate), ci AS (SELECT cq.g, i, pos, text FROM cq JOIN rest ON rest.g = cq.question_id),
{_named('cq', 'ci', 1, 'cb')}, c2 AS (SELECT DISTINCT rest.g, rest.i, rest.pos, rest.text FROM cb JOIN cq USING (g) JOIN rest ON rest.g = cq.question_id AND rest.i = cb.i), {bm25_sql('c3', 'iq', 'c2')}, {_top('c3', _B, 'c4')},
eq AS (SELECT question_id || '|e|' || place AS g, entity AS t, question_id, place FROM bridge), ei AS (SELECT eq.g, i, pos, text FROM eq JOIN rest ON rest.g = eq.question_id), {_named('eq', 'ei', _B, 'eb')},
hd AS (SELECT question_id, string_agg(h, ' ' ORDER BY pl) AS h FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pl) AS r FROM (SELECT question_id, min((table_name, row_index, col_index)) AS pl, arg_min(trim(column_name, ' '), (table_name, row_index, col_index)) AS h FROM cells WHERE trim(column_name, ' ') <> '' GROUP BY question_id, lower(trim(column_name, ' ')))) WHERE r <= 20 GROUP BY question_id),
xl AS (SELECT question_id, list_filter([CASE WHEN contains(lower(question), 'interest') THEN 'interest amount expense payable annually per year' END, CASE WHEN regexp_matches(lower(question), 'percent|ratio') THEN 'percentage ratio total amount' END, 'annual annually year period from to', h], lambda x: x IS NOT NULL) AS l FROM qs LEFT JOIN hd USING (question_id)),
xq AS (SELECT question_id || '|x|' || pl AS g, l[pl + 1] AS t, question_id, pl FROM (SELECT *, unnest(range(0, len(l))) AS pl FROM xl)), xi AS (SELECT xq.g, i, pos, text FROM xq JOIN rest ON rest.g = xq.question_id), {bm25_sql('x1', 'xq', 'xi')}, {_top('x1', _B, 'xb')},
al AS (SELECT g, i, (0, r) AS pl FROM c4 UNION ALL SELECT question_id, i, (place, r) FROM eb JOIN eq USING (g) UNION ALL SELECT question_id, i, (1048576 + pl, r) FROM xb JOIN xq USING (g)),
s2 AS (SELECT g, i, row_number() OVER (PARTITION BY g ORDER BY pl, i) AS r FROM (SELECT g, i, min(pl) AS pl FROM al GROUP BY ALL) QUALIFY r <= {_B})
SELECT g AS question_id, i AS source_id, CAST(stage AS INTEGER) AS stage, CAST(r AS INTEGER) AS rank FROM (SELECT g, i, 1 AS stage, r FROM s1 UNION ALL SELECT g, i, 2, r FROM s2)"""


@query("coarse_retrieve", f"WITH {DATA}, {_FIRST} SELECT g AS question_id, i AS source_id, CAST(r AS INTEGER) AS rank FROM s1")
def coarse_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The two best passages of each question among its own."""
    data = dataset(spark, d)
    own = data.passages.select(F.col("question_id").alias("_g"), F.col("source_id").alias("_i"), "position", "text")
    best = retrieval.ranked_within(data.questions.select(F.col("question_id").alias("_g"), F.col("question").alias("_text")), own, _K)
    return best.select(F.col("_g").alias("question_id"), F.col("_i").alias("source_id"), "rank")


@query("two_stage_retrieve", _RETRIEVE)
def two_stage_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Two passages by the question, two more by constraints, bridge entities and expansions."""
    data = dataset(spark, d)
    return retrieval.retrieve(data.questions, data.cells, data.passages, _K, _B)[0]


@query("entity_retrieve", f"WITH {DATA}, {ANCHORS}, it AS (SELECT question_id AS g, i, pos, text FROM passages), eq AS (SELECT question_id || '|' || place AS g, entity AS t, question_id FROM bridge), ei AS (SELECT eq.g, i, pos, text FROM eq JOIN it ON it.g = eq.question_id), {_named('eq', 'ei', 2, 'eb')} SELECT question_id, t AS entity, i AS source_id, CAST(r AS INTEGER) AS rank FROM eb JOIN eq USING (g)")
def entity_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The two best passages of each question for each of its bridge entities."""
    data = dataset(spark, d)
    asked = retrieval.bridge_entities(data.questions.withColumn("q", F.col("question_id")), "q", "question", data.cells, Q, _constraints(data)).select(*Q, F.col("entity").alias("_text"), F.concat_ws("|", "question_id", F.col("place").cast("string")).alias("_g"))
    asked = materialize(asked, "asked")
    items = asked.select("_g", *Q).join(data.passages, Q).select("_g", F.col("source_id").alias("_i"), "position", "text")
    best = retrieval.entity_within(asked.select("_g", "_text"), items, 2).join(asked, "_g")
    return best.select(*Q, F.col("_text").alias("entity"), F.col("_i").alias("source_id"), "rank")
