"""Queries over facts in prose and over matrices as tables, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import tables
from gleaner.plans.registry import query
from gleaner.session import table

_PROSE = """SELECT c_custkey, head, relation, tail FROM (
SELECT c_custkey, 'Ann ' || n AS head, 'full_name' AS relation, 'Ann Of-' || n || ' ' || n AS tail FROM c WHERE k = 0
UNION ALL SELECT c_custkey, CASE WHEN k = 1 THEN 'new loans' ELSE '2025 notes' END, r, CASE WHEN r = 'payment_frequency' THEN 'annual' ELSE '$ ' || c_custkey || ' million per year' END FROM c, (VALUES ('annual_interest_amount'), ('payment_frequency')) v(r) WHERE k IN (1, 2)
UNION ALL SELECT c_custkey, 'interest', r, CASE WHEN r = 'payment_frequency' THEN 'annual' ELSE '$' || c_custkey || ' million per year' END FROM c, (VALUES ('annual_interest_amount'), ('payment_frequency')) v(r) WHERE k = 3
UNION ALL SELECT c_custkey, 'net sales', 'value_2014', '$1.6 billion' FROM c WHERE k = 4 UNION ALL SELECT c_custkey, 'net sales', 'increase_from_2013_to_2014', '$' || c_custkey || ' million' FROM c WHERE k = 4)"""


@query("text_facts", "WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, 'Name' || chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS n FROM customer) " + _PROSE)
def text_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts in sentences about every customer: names, interest on something, on notes named before, on nothing
    named, changes, and sentences without facts."""
    k, n = F.col("c_custkey") % 6, F.concat(F.lit("Name"), F.char((F.lit(97) + F.col("c_custkey") % 26).cast("int")))
    key = F.col("c_custkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Ann Of-"), n, F.lit(" "), n, F.lit(" (born 1950) is a person.")))
        .when(k == 1, F.concat(F.lit("Fees were $3 million. Interest on the new loans of approximately $ "), key, F.lit(" million per year is due.")))
        .when(k == 2, F.concat(F.lit("We pay interest of $ "), key, F.lit(" million per year.")))
        .when(k == 3, F.concat(F.lit("Annual interest approximately $"), key, F.lit(" million per year")))
        .when(k == 4, F.concat(F.lit("In 2014, net sales increased $"), key, F.lit(" million, or 7%, mainly abroad, from 2013 to $1.6 billion in 2014.")))
        .otherwise("They paid $5 million per year in rent and costs increased 3 million in 2014. A B (x)")
    )
    before = F.when(k == 2, "The 2020 notes and the 2025 notes are due.").otherwise("")
    rows = table(spark, d, "customer").select("c_custkey", text.alias("text"), before.alias("before"))
    return tables.text_facts(rows, ["c_custkey"], "text", "before")


@query("text_facts_documents", "SELECT doc_id, '' AS relation FROM documents WHERE false")
def text_facts_documents(spark: SparkSession, d: str) -> DataFrame:
    """Facts that all documents hold; the corpus has none of the forms."""
    return tables.text_facts(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "relation")


_MATRIX = """WITH h AS (SELECT table_id, ingested_at, [[coalesce(c, '') FOR c IN coalesce(r, [])] FOR r IN texts] AS m FROM hitab WHERE len(texts) > 0 AND len(texts[1]) > 0),
g AS (SELECT *, [trim(c, E' \\t\\n\\r') FOR c IN m[1]] AS a, CASE WHEN len(m) > 2 THEN [trim(c, E' \\t\\n\\r') FOR c IN m[2]] ELSE [] END AS b FROM h),
k AS (SELECT *, len(b) > len(a) AND len(a) > 1 AS longer, len(b) > len(a) AND len(a) > 1 AND (len(b) - 1) % greatest(len(a) - 1, 1) = 0 AS two, list_max([len(r) FOR r IN m[CASE WHEN len(b) > len(a) AND len(a) > 1 AND (len(b) - 1) % greatest(len(a) - 1, 1) = 0 THEN 3 ELSE 2 END:]]) AS w FROM g),
i AS (SELECT *, unnest(range(1, CASE WHEN two THEN len(b) ELSE len(a) END + 1)) AS i FROM k),
n AS (SELECT *, CASE WHEN two THEN CASE WHEN i = 1 THEN coalesce(nullif(b[1], ''), 'row') ELSE CASE WHEN a[2 + (i - 2) // ((len(b) - 1) // (len(a) - 1))] <> '' THEN a[2 + (i - 2) // ((len(b) - 1) // (len(a) - 1))] || '_' ELSE '' END || coalesce(nullif(b[i], ''), 'value_' || (i - 1)) END
  WHEN longer THEN a[i] WHEN regexp_full_match(a[i], '[0-9]{4}') THEN CASE WHEN i = 1 THEN a[i] ELSE a[i] || '_period' END
  ELSE coalesce(CASE WHEN a[i] <> '' THEN list_filter(a[:i], lambda x: regexp_full_match(x, '[0-9]{4}'))[-1] || '_' END, '') || a[i] END AS x FROM i),
u AS (SELECT *, CASE WHEN x = '' THEN 'column_' || (i - 1) ELSE x END AS base FROM n),
v AS (SELECT table_id, ingested_at, m, two, w, i, CASE WHEN two THEN x WHEN row_number() OVER (PARTITION BY table_id, ingested_at, base ORDER BY i) = 1 THEN base ELSE base || '__' || row_number() OVER (PARTITION BY table_id, ingested_at, base ORDER BY i) END AS name FROM u),
z AS (SELECT table_id, ingested_at, any_value(m) AS m, any_value(two) AS two, list(name ORDER BY i) || ['column_' || (e - 1) FOR e IN range(count(*) + 1, coalesce(any_value(w), 0) + 1)] AS names FROM v GROUP BY ALL),
y AS (SELECT *, unnest(range(CASE WHEN two THEN 3 ELSE 2 END, len(m) + 1)) AS r FROM z)
SELECT table_id, ingested_at, CAST(r - CASE WHEN two THEN 3 ELSE 2 END AS BIGINT) AS row_index, CAST(j - 1 AS INTEGER) AS col_index, names[j] AS column_name, coalesce(m[r][j], '') AS value FROM (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM y)"""


@query("matrix_to_rows", _MATRIX)
def matrix_to_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cells of all delivered matrices under their header names."""
    rows = table(spark, d, "hitab").select(F.concat_ws("|", "table_id", F.col("ingested_at").cast("string")).alias("k"), "texts")
    cells = tables.matrix_cells(rows, "k", "texts")
    at = F.substring_index("k", "|", -1).cast(table(spark, d, "hitab").schema["ingested_at"].dataType)
    return cells.select(F.substring_index("k", "|", 1).alias("table_id"), at.alias("ingested_at"), "row_index", "col_index", "column_name", "value")


@query(
    "matrix_headers",
    "SELECT p_brand, CAST(i - 1 AS INTEGER) AS col_index, name FROM (SELECT p_brand, unnest(n) AS name, generate_subscripts(n, 1) AS i FROM (SELECT p_brand, CASE k WHEN 0 THEN ['Quarter', '2002_High', '2002_Low', '2002_Dividend', '2001_High', '2001_Low', '2001_value_6'] WHEN 1 THEN ['2002', '2002_High', '2001_period', '2001_High', '2001_High__2'] WHEN 2 THEN ['Period', 'High', 'High__2', 'column_3'] ELSE ['a', 'b', 'column_2'] END AS n FROM (SELECT p_brand, min(p_partkey) % 4 AS k FROM part GROUP BY 1)))",
)
def matrix_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header names of matrices of all shapes: groups over fields, years between names, repeats, wide rows."""
    row = lambda *xs: F.array(*map(F.lit, xs))
    k = F.min("p_partkey") % 4
    matrix = F.when(k == 0, F.array(row("", "2002", "2001"), row("Quarter", "High", "Low", "Dividend", "High", "Low", ""), row("x"))).when(k == 1, F.array(row("2002", "High", "2001", "High", "High"), row("1"))).when(k == 2, F.array(row("Period", "High", "High"), row("1", "2", "3", "4"))).otherwise(F.array(row("a", "b"), row("1", "2", "3")))
    made = table(spark, d, "part").groupBy("p_brand").agg(matrix.alias("m"))
    cells = tables.matrix_cells(made, "p_brand", "m").where("row_index = 0")
    return cells.select("p_brand", "col_index", F.col("column_name").alias("name"))
