"""Queries over nested records and over quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import nested, units
from gleaner.plans.registry import query
from gleaner.session import materialize, table


#: The latest delivery of each table; its cells trimmed; regions filled one after the other.
_FILLED = """RECURSIVE t AS (SELECT table_id, [[trim(coalesce(c, ''), E' \t\n\r') FOR c IN r] FOR r IN texts] AS x, greatest(coalesce(top_header_rows_num, 1), 0) AS top, greatest(coalesce(left_header_columns_num, 1), 0) AS lft, coalesce(merged_regions, []) AS g, left_root
  FROM (SELECT DISTINCT ON (table_id) * FROM hitab WHERE table_id IS NOT NULL AND texts IS NOT NULL ORDER BY table_id, ingested_at DESC)),
f AS (SELECT table_id, x, g, 0 AS i FROM t UNION ALL SELECT table_id, CASE WHEN g[i + 1].first_row BETWEEN 0 AND len(x) - 1 AND g[i + 1].first_column BETWEEN 0 AND len(x[g[i + 1].first_row + 1]) - 1
    THEN list_transform(x, lambda r, p: CASE WHEN p - 1 BETWEEN g[i + 1].first_row AND g[i + 1].last_row THEN list_transform(r, lambda c, q: CASE WHEN q - 1 BETWEEN g[i + 1].first_column AND g[i + 1].last_column THEN x[g[i + 1].first_row + 1][g[i + 1].first_column + 1] ELSE c END) ELSE r END) ELSE x END, g, i + 1 FROM f WHERE i < len(g)),
m AS (SELECT table_id, f.x, top, lft, left_root FROM f JOIN t USING (table_id) WHERE i = len(f.g)),
cell AS (SELECT table_id, r, q - 1 AS c, trim(row[q]) AS v FROM (SELECT table_id, p - 1 AS r, x[p] AS row FROM (SELECT table_id, x, unnest(range(1, len(x) + 1)) AS p FROM m)), LATERAL (SELECT unnest(range(1, len(row) + 1)) AS q)),
n AS (SELECT table_id, [] :: INTEGER[] AS node, CAST(left_root AS JSON) AS j FROM m WHERE left_root IS NOT NULL UNION ALL SELECT table_id, list_append(node, CAST(k AS INTEGER)), json_extract(j, '$.children[' || k || ']') FROM n, LATERAL (SELECT unnest(range(0, CAST(coalesce(json_array_length(j, '$.children'), 0) AS BIGINT))) AS k)),
node AS (SELECT table_id, node, CASE WHEN len(node) > 0 THEN node[:-2] END AS parent, coalesce(try_cast(try_cast(json_extract_string(j, '$.row_index') AS DOUBLE) AS INTEGER), -1) AS row_index, coalesce(try_cast(try_cast(json_extract_string(j, '$.column_index') AS DOUBLE) AS INTEGER), -1) AS column_index FROM n),
label AS (SELECT node.*, coalesce(v, '') AS label FROM node LEFT JOIN cell ON cell.table_id = node.table_id AND r = row_index AND c = column_index),
deep AS (SELECT * FROM label WHERE row_index >= 0 QUALIFY row_number() OVER (PARTITION BY table_id, row_index ORDER BY len(node) DESC, node DESC) = 1),
above AS (SELECT d.table_id, d.row_index, any_value(p.row_index) FILTER (len(d.node) > 1 AND p.node = d.parent) AS parent_row, list(p.label ORDER BY len(p.node)) FILTER (p.label <> '') AS labels FROM deep d JOIN label p ON p.table_id = d.table_id AND p.node = d.node[:len(p.node)] GROUP BY d.table_id, d.row_index),
lefts AS (SELECT cell.table_id, r, list(v ORDER BY c) FILTER (v <> '') AS labels FROM cell JOIN m USING (table_id) WHERE c < lft GROUP BY ALL),
tops AS (SELECT cell.table_id, c, list(v ORDER BY r) FILTER (v <> '') AS labels FROM cell JOIN m USING (table_id) WHERE r < top GROUP BY ALL)"""


def _once(labels: str, by: str) -> str:
    return f"array_to_string(list_filter({labels}, lambda x, i: i = 1 OR {labels}[i - 1] <> x), '{by}')"


_CELLS = f"""WITH {_FILLED} SELECT cell.table_id, CAST(cell.r AS INTEGER) AS row_index, CAST(cell.c AS INTEGER) AS column_index, CAST(coalesce(parent_row, -1) AS INTEGER) AS parent_row_index,
coalesce(nullif({_once("above.labels", " / ")}, ''), nullif({_once("lefts.labels", " / ")}, ''), 'row_' || cell.r) AS row_path, coalesce(nullif({_once("tops.labels", "__")}, ''), 'column_' || cell.c) AS column_path
FROM cell JOIN m USING (table_id) LEFT JOIN above ON above.table_id = cell.table_id AND above.row_index = cell.r LEFT JOIN lefts ON lefts.table_id = cell.table_id AND lefts.r = cell.r LEFT JOIN tops ON tops.table_id = cell.table_id AND tops.c = cell.c
WHERE cell.r >= top AND cell.c >= lft AND v <> ''"""


@query("p1_found", _CELLS)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data cells of all hierarchical tables with their row and column headers."""
    return nested.hierarchical_cells(table(spark, sf_dir, "hitab")).drop("value")


@query("p1_nodes", f"WITH {_FILLED} SELECT table_id, CAST(to_json(node) AS VARCHAR) AS node, CAST(to_json(parent) AS VARCHAR) AS parent, row_index, column_index, label FROM label")
def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row nodes of all tables, linked to their parents."""
    return nested.row_nodes(table(spark, sf_dir, "hitab")).withColumn("node", F.to_json("node")).withColumn("parent", F.to_json("parent"))


@query("p1_headers", f"WITH {_FILLED} SELECT cell.table_id, CAST(c AS INTEGER) AS column_index, CAST(r AS INTEGER) AS level, v AS label FROM cell JOIN m USING (table_id) WHERE r < top AND c >= lft AND v <> ''")
def p1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top header labels of all tables."""
    return nested.header_labels(table(spark, sf_dir, "hitab"))


KEYS = ["table_id", "ingested_at"]
_RELATED = """WITH RECURSIVE n AS (SELECT table_id, ingested_at, [] :: INTEGER[] AS node, CAST(left_root AS JSON) AS j FROM hitab WHERE left_root IS NOT NULL UNION ALL SELECT table_id, ingested_at, list_append(node, CAST(k AS INTEGER)), json_extract(j, '$.children[' || k || ']') FROM n, LATERAL (SELECT unnest(range(0, CAST(coalesce(json_array_length(j, '$.children'), 0) AS BIGINT))) AS k)),
r AS (SELECT table_id, ingested_at, CAST(i - 1 AS INTEGER) AS i, texts[i] AS x FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM hitab)),
c AS (SELECT table_id, ingested_at, i, CAST(k - 1 AS INTEGER) AS k, x[k] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM r))
SELECT table_id, ingested_at, '' AS group_path, '[]' AS row_id, CAST(NULL AS VARCHAR) AS parent_group, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS label FROM hitab
UNION ALL SELECT table_id, ingested_at, 'left_root.children[]', CAST(to_json(node) AS VARCHAR), CASE WHEN len(node) = 1 THEN '' ELSE 'left_root.children[]' END, CAST(to_json(node[:-2]) AS VARCHAR), json_extract_string(j, '$.row_index') FROM n WHERE len(node) > 0
UNION ALL SELECT table_id, ingested_at, 'merged_regions[]', '[' || (i - 1) || ']', '', '[]', CAST(merged_regions[i].first_row AS VARCHAR) FROM (SELECT *, unnest(range(1, len(merged_regions) + 1)) AS i FROM hitab)
UNION ALL SELECT table_id, ingested_at, 'texts[]', '[' || i || ']', '', '[]', NULL FROM r
UNION ALL SELECT table_id, ingested_at, 'texts[]', '[' || i || ',' || k || ']', 'texts[]', '[' || i || ']', v FROM c"""


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.related(table(spark, sf_dir, "hitab"), KEYS, ["texts", "merged_regions", "left_root"], ("left_root",))


@query("p1_related", _RELATED)
def p1_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat rows of all delivered records, with their groups, ordinals, parents and main field."""
    field = F.when(F.col("group") == "left_root.children[]", F.element_at("fields", F.lit("row_index"))).when(F.col("group") == "merged_regions[]", F.element_at("fields", F.lit("first_row"))).when(F.col("group") == "texts[]", F.element_at("fields", F.lit("")))
    return _related(spark, sf_dir).select(*KEYS, F.col("group").alias("group_path"), F.to_json("row").alias("row_id"), F.col("parent_group"), F.to_json("parent").alias("parent_id"), field.alias("label"))


@query("p1_dangling", "SELECT table_id, '' AS group_path, '' AS row_id FROM hitab WHERE false")
def p1_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent does not exist, and rows that share their key: there must be none."""
    rows = _related(spark, sf_dir).select(*KEYS, "group", "row", "parent_group", "parent")
    twice = rows.groupBy(*KEYS, "group", "row").count().where("count > 1").select("table_id", "group", "row")
    there = rows.select(*KEYS, F.col("group").alias("parent_group"), F.col("row").alias("parent"))
    lost = rows.where("parent is not null").join(there, [*KEYS, "parent_group", "parent"], "left_anti").select("table_id", "group", "row")
    return lost.unionByName(twice).select("table_id", F.col("group").alias("group_path"), F.to_json("row").alias("row_id"))


_TRIPLES = """SELECT path, kind, count(*) AS n FROM (
SELECT 'texts[]' AS path, 'element' AS kind FROM (SELECT unnest(texts) AS x FROM hitab) WHERE x IS NOT NULL
UNION ALL SELECT 'texts[][]', 'value' FROM (SELECT unnest(x) AS c FROM (SELECT unnest(texts) AS x FROM hitab))
UNION ALL SELECT 'merged_regions[]', 'element' FROM (SELECT unnest(merged_regions) AS g FROM hitab) WHERE g IS NOT NULL
UNION ALL SELECT 'merged_regions[].' || f, 'value' FROM (SELECT unnest(merged_regions) AS g FROM hitab), (VALUES ('first_row'), ('last_row'), ('first_column'), ('last_column')) s(f) WHERE g IS NOT NULL) GROUP BY ALL"""


@query("p1_triples", _TRIPLES)
def p1_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples of each kind the matrices and regions of all records give, by path."""
    rows = nested.triples(table(spark, sf_dir, "hitab"), KEYS, ["texts", "merged_regions"])
    return rows.groupBy("path", "kind").agg(F.count("*").alias("n"))


_REGIONS = """
SELECT table_id, ingested_at, i - 1 AS region, r.first_row AS first_row, r.last_row AS last_row, r.first_column AS first_column, r.last_column AS last_column
FROM (SELECT table_id, ingested_at, unnest(merged_regions) AS r, generate_subscripts(merged_regions, 1) AS i FROM hitab)
"""


@query("p1_regions", _REGIONS)
def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged regions of every delivered record as a flat table."""
    rows = nested.related(table(spark, sf_dir, "hitab"), KEYS, ["merged_regions"])
    flat = nested.pivot(rows, KEYS, "merged_regions[]", dict.fromkeys(["first_row", "last_row", "first_column", "last_column"], "int"))
    return flat.select(*KEYS, F.element_at("row", 1).cast("long").alias("region"), "first_row", "last_row", "first_column", "last_column")


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The amounts of constant steps and of examples' answers, each row once."""
    examples = table(spark, sf_dir, "datasetexample").where("example_id is not null")
    # redelivered examples differ in ingested_at only: any delivery with an answer serves
    examples = examples.groupBy("example_id").agg(F.max_by(F.struct("answer", "question"), F.struct(F.col("answer").isNotNull(), "ingested_at")).alias("_x")).select("example_id", "_x.*")
    programs = table(spark, sf_dir, "numericalprogram").select("program_id", "example_id").distinct()
    steps = table(spark, sf_dir, "irstep").where("op = 'const'").select("program_id", "step_id", "arguments", "unit").distinct()
    asked = steps.join(programs, "program_id").join(examples.select("example_id", "question"), "example_id", "left")
    consts = units.amounts(asked, ["example_id", "program_id", "step_id"], F.col("arguments"), F.col("unit"), F.col("question"))
    answers = units.amounts(examples, ["example_id"], F.col("answer"), F.lit(None), F.col("question"))
    return materialize(consts, "consts"), materialize(answers, "answers")


def _linked(consts: DataFrame, answers: DataFrame) -> DataFrame:
    """Each constant beside the answer of its example."""
    right = answers.select("example_id", F.col("notation").alias("b"), F.col("value").alias("y"))
    return consts.select("example_id", "program_id", "step_id", F.col("notation").alias("a"), F.col("value").alias("x")).join(right, "example_id")


def _amounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All recorded amounts, and the links between constants and answers."""
    consts, answers = _recorded(spark, sf_dir)
    return consts.unionByName(answers, allowMissingColumns=True), materialize(_linked(consts, answers), "links")


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant steps whose amount equals, in common units, the answer of the program's example."""
    recorded, links = _amounts(spark, sf_dir)
    known = materialize(units.common_units(recorded, links), "notations")
    sides = [known.select(F.col("notation").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("kind", "factor", "offset")]) for n in ("a", "b")]
    both = links.join(sides[0], "a").join(sides[1], "b").where("kind_a = kind_b").withColumn("u", F.col("x") * F.col("factor_a") + F.col("offset_a")).withColumn("v", F.col("y") * F.col("factor_b") + F.col("offset_b"))
    equal = F.abs(F.col("u") - F.col("v")) <= 0.001 * F.greatest(F.abs("u"), F.abs("v")) * (1 + 1e-9)
    return both.where(equal).select("program_id", "step_id").distinct()


@query("p2_notations")
def p2_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notation with its kind, conversion to the common unit, and distance from an anchor."""
    return units.common_units(*_amounts(spark, sf_dir))


@query("p2_scales")
def p2_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated and snapped scale between every two linked notations."""
    return units.pairwise(_amounts(spark, sf_dir)[1])


@query("p2_recovered")
def p2_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links tell about every known notation while its words are hidden."""
    return units.recovered(*_amounts(spark, sf_dir))
