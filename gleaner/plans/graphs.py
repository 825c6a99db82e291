"""Queries over tables as facts and over fact graphs, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import graph, tables
from gleaner.plans import sqltext as S
from gleaner.plans.registry import query
from gleaner.session import materialize, table


@query(
    "unique_headers",
    """SELECT table_id, CAST(col_index AS INTEGER) AS col_index, CASE WHEN n > 1 THEN base || '__' || n ELSE base END AS column_name FROM (
SELECT *, row_number() OVER (PARTITION BY table_id, base ORDER BY col_index) AS n FROM (
SELECT table_id, i - 1 AS col_index, CASE WHEN trim(coalesce(h, ''), ' ') = '' THEN 'column_' || (i - 1) ELSE trim(h, ' ') END AS base
FROM (SELECT table_id, unnest(header) AS h, generate_subscripts(header, 1) AS i FROM (SELECT DISTINCT ON (table_id) table_id, texts[1] AS header FROM hitab ORDER BY table_id, ingested_at DESC))))""",
)
def unique_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hitab").groupBy("table_id").agg(F.max_by(F.col("texts")[0], "ingested_at").alias("h"))
    cells = rows.select("table_id", F.posexplode("h").alias("col_index", "column_name"))
    return tables.unique_names(cells, ["table_id"])


# -- graphs ----------------------------------------------------------------------------------------

Q = ["question_id"]


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All stored triples as edges of one graph a question."""
    return table(spark, d, "triple").select(*Q, F.col("triple_id").alias("edge_seq"), "head", "relation", "tail", "source_type", "source_id", "source_group", "row_index")


@query("kg_neighbors", "SELECT question_id, head AS node, relation, tail AS other, min(triple_id) AS edge_seq FROM triple GROUP BY ALL")
def kg_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d), Q)


@query("kg_sources", "SELECT question_id, tail AS node, relation, head AS other, min(triple_id) AS edge_seq FROM triple GROUP BY ALL")
def kg_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(edges(spark, d), Q, outgoing=False)


@query("kg_relations", "SELECT question_id, head AS node, string_agg(relation, '|' ORDER BY relation) AS relations FROM (SELECT DISTINCT question_id, head, relation FROM triple) GROUP BY ALL")
def kg_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.relations(edges(spark, d), Q).withColumn("relations", F.array_join("relations", "|"))


@query("kg_evidence", "SELECT question_id, head, tail, count(*) AS n_edges, count(DISTINCT (coalesce(source_type, '~'), coalesce(source_id, '~'), relation)) AS n_evidence FROM triple GROUP BY ALL")
def kg_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence(edges(spark, d), Q).select(*Q, "head", "tail", "n_edges", F.size("evidence").cast("long").alias("n_evidence"))


@query("kg_nodes", "SELECT question_id, node, bool_or(o) AS has_out, bool_or(NOT o) AS has_in, min(s) AS first_seq FROM (SELECT question_id, head AS node, true AS o, triple_id AS s FROM triple UNION ALL SELECT question_id, tail, false, triple_id FROM triple) GROUP BY ALL")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(edges(spark, d), Q)


@query("kg_summary", "SELECT t.question_id, n_edges, n_nodes, relations FROM (SELECT question_id, count(*) AS n_edges FROM triple GROUP BY 1) t JOIN (SELECT question_id, count(DISTINCT node) AS n_nodes FROM (SELECT question_id, head AS node FROM triple UNION ALL SELECT question_id, tail FROM triple) GROUP BY 1) n USING (question_id) JOIN (SELECT question_id, string_agg(relation, '|' ORDER BY relation) AS relations FROM (SELECT DISTINCT question_id, relation FROM triple) GROUP BY 1) r USING (question_id)")
def kg_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(edges(spark, d), Q)


_LOOPED = f"(SELECT question_id, triple_id, head, relation, CASE WHEN triple_id % 5 = 0 THEN '  ' || upper(head) || '!' ELSE tail END AS tail FROM triple WHERE regexp_full_match(head, '[ -~]+'))"


@query("kg_self_loops", f"WITH {S.canonical_relations('triple')} SELECT question_id, triple_id AS edge_seq, head, canonical AS relation, tail, 'self_loop' AS reason FROM {_LOOPED} JOIN rel USING (relation) WHERE {S.key('head')} = {S.key('tail')}")
def kg_self_loops(spark: SparkSession, d: str) -> DataFrame:
    """Rejected triples: every fifth is given a tail that is its head by key."""
    rows = edges(spark, d).where(F.col("head").rlike(r"^[ -~]+$"))
    rows = rows.withColumn("tail", F.when(F.col("edge_seq") % 5 == 0, F.concat(F.lit("  "), F.upper("head"), F.lit("!"))).otherwise(F.col("tail")))
    return graph.insert(rows)[1].select(*Q, "edge_seq", "head", "relation", "tail", "reason")


@query("kg_insert", f"WITH {S.canonical_relations('triple')} SELECT question_id, canonical AS relation, count(*) AS n FROM {_LOOPED} JOIN rel USING (relation) WHERE {S.key('head')} <> {S.key('tail')} GROUP BY ALL")
def kg_insert(spark: SparkSession, d: str) -> DataFrame:
    """The edges that go in, by canonical relation."""
    rows = edges(spark, d).where(F.col("head").rlike(r"^[ -~]+$"))
    rows = rows.withColumn("tail", F.when(F.col("edge_seq") % 5 == 0, F.concat(F.lit("  "), F.upper("head"), F.lit("!"))).otherwise(F.col("tail")))
    return graph.insert(rows)[0].groupBy(*Q, "relation").agg(F.count("*").alias("n"))


@query("kg_is_empty", "SELECT DISTINCT q.question_id FROM sample_hybridqa q WHERE q.question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM triple t WHERE t.question_id = q.question_id AND t.source_type = 'web')")
def kg_is_empty(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose graph of facts from the web is empty."""
    web = graph.nodes(edges(spark, d).where("source_type = 'web'"), Q)
    return table(spark, d, "sample_hybridqa").where("question_id is not null").select(*Q).distinct().join(web, Q, "left_anti")


@query("kg_middle_names", "SELECT c_custkey AS g, c_name AS player, 'Mid' || c_custkey AS middle_name FROM customer WHERE c_custkey % 3 > 0")
def kg_middle_names(spark: SparkSession, d: str) -> DataFrame:
    """From the second rank over its player to the middle of the full name; two-part names have none."""
    full = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Ann Mid"), "c_custkey", F.lit(" Lee"))).otherwise("Ann Lee")
    each = F.array(F.struct(F.lit("2").alias("head"), F.lit("player").alias("relation"), F.col("c_name").alias("tail")), F.struct(F.col("c_name").alias("head"), F.lit("full_name").alias("relation"), full.alias("tail")), F.struct(F.lit("1").alias("head"), F.lit("player").alias("relation"), F.lit("Bob A B").alias("tail")))
    return graph.middle_names(table(spark, d, "customer").select(F.col("c_custkey").alias("g"), F.inline(each)), ["g"], "2")


def _geo(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in nations in regions, as one graph."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    parts = [
        table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("head"), F.lit("in_nation").alias("relation"), F.col("n_name").alias("tail")),
        table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("head"), F.lit("in_nation").alias("relation"), F.col("n_name").alias("tail")),
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("in_region").alias("relation"), F.col("r_name").alias("tail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("g", F.lit(1)).withColumn("edge_seq", F.xxhash64("head", "tail"))


@query("kg_two_hop", "SELECT DISTINCT c_name AS head, n_name AS middle, r_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def kg_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain(_geo(spark, d), ["g"], "in_nation", "in_region").drop("g")


@query(
    "kg_shortest_path",
    """WITH RECURSIVE geo AS (SELECT c_name AS head, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
ways AS (SELECT DISTINCT a, b FROM (SELECT head AS a, tail AS b FROM geo UNION ALL SELECT tail, head FROM geo)),
walk AS (SELECT r_name AS start, r_name AS node, 0 AS hops FROM region UNION SELECT w.start, ways.b, w.hops + 1 FROM walk w JOIN ways ON w.node = ways.a WHERE w.hops < 4)
SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY ALL""",
)
def kg_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Distances from every region over undirected edges, up to four."""
    starts = table(spark, d, "region").select(F.lit(1).alias("g"), F.col("r_name").alias("start"))
    return graph.hops(_geo(spark, d), ["g"], starts, 4).drop("g")


_NODES = "nodes AS (SELECT question_id, node, min(s) AS first_seq FROM (SELECT question_id, head AS node, triple_id AS s FROM triple UNION ALL SELECT question_id, tail, triple_id FROM triple) GROUP BY ALL)"
_LEXICAL = f"lex AS (SELECT n.question_id, node, canonical FROM (SELECT *, {S.key('node')} AS k FROM nodes) n JOIN (SELECT question_id, k, arg_max(node, ({S.shown('node')}, -first_seq, node)) AS canonical FROM (SELECT *, {S.key('node')} AS k FROM nodes) GROUP BY ALL HAVING count(*) > 1) b ON b.k = n.k AND b.question_id IS NOT DISTINCT FROM n.question_id WHERE node <> canonical AND n.question_id IS NOT NULL)"


@query("resolve_lexical", f"WITH {_NODES}, {_LEXICAL} SELECT * FROM lex")
def resolve_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one key under their most presentable name."""
    return graph.lexical_aliases(graph.nodes(edges(spark, d), Q), Q)


@query("resolve_merge", f"WITH {_NODES}, {_LEXICAL} SELECT triple_id AS edge_seq, coalesce(a.canonical, head) AS head, coalesce(b.canonical, tail) AS tail FROM triple t LEFT JOIN lex a ON a.question_id = t.question_id AND a.node = head LEFT JOIN lex b ON b.question_id = t.question_id AND b.node = tail")
def resolve_merge(spark: SparkSession, d: str) -> DataFrame:
    """All edges after the first tier."""
    e = edges(spark, d)
    return graph.merge(e, graph.lexical_aliases(graph.nodes(e, Q), Q), Q).select("edge_seq", "head", "tail")


def _variants(spark: SparkSession, d: str, names: list) -> DataFrame:
    """A graph of names for every supplier, each name with a fact."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("edge_seq"), n.alias("head"), F.lit("is").alias("relation"), F.lit(f"thing {i}").alias("tail")) for i, n in enumerate(names)])
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("g"), F.inline(each))


@query("resolve_alias", "SELECT s_suppkey AS g, node, canonical FROM supplier, (VALUES ('U.S.A.', 'United States'), ('Moroccan', 'Morocco'), ('bác Hồ', 'Hồ Chí Minh')) v(node, canonical)")
def resolve_alias(spark: SparkSession, d: str) -> DataFrame:
    """Names that a table of aliases knows, whatever their case and accents."""
    e = _variants(spark, d, [F.lit("U.S.A."), F.lit("Moroccan"), F.lit("bác Hồ"), F.col("s_name"), F.lit("United States")])
    return graph.known_aliases(graph.nodes(e, ["g"]), ["g"])


@query("resolve_structural", "SELECT s_suppkey AS g, n AS node, 'Club ' || s_name || ' FC' AS canonical FROM supplier, LATERAL (SELECT unnest([s_name, s_name || ' F.C.', 'Club ' || s_name]) AS n)")
def resolve_structural(spark: SparkSession, d: str) -> DataFrame:
    """Clubs with and without designators; dates never merge."""
    n = F.col("s_name")
    e = _variants(spark, d, [n, F.concat(n, F.lit(" F.C.")), F.concat(F.lit("Club "), n), F.concat(F.lit("Club "), n, F.lit(" FC")), F.lit("4 May 2001"), F.lit("Club 4 May 2001")])
    return graph.core_aliases(graph.nodes(e, ["g"]), ["g"])


@query("resolve_semantic", "SELECT s_suppkey AS g, 'internationel federation of red crosses and cressents ' || s_name AS node, 'international federation of red crosses and crescents ' || s_name AS canonical FROM supplier")
def resolve_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Names nearly alike merge; other numbers, a negation and other roles keep names apart."""
    n = F.col("s_name")
    name = lambda x: F.concat(F.lit(x), n)
    e = _variants(spark, d, [name("international federation of red crosses and crescents "), name("internationel federation of red crosses and cressents "), F.concat(n, F.lit(" net income gaap 2001 as reported")), F.concat(n, F.lit(" net income gaap 2002 as reported")), F.concat(n, F.lit(" net income non gaap 2001 as reported"))])
    return graph.near_aliases(graph.nodes(e, ["g"]), ["g"]).drop("score")


_CORE = "regexp_replace(regexp_replace({0}, '^club( |$)', ''), '(^| )(fc|cf|f c|c f|football club|futbol club)$', '')"
_INDEX = f"own AS (SELECT question_id, {S.key('node')} AS key, node FROM nodes WHERE question_id IS NOT NULL), idx AS (SELECT question_id, key, arg_min(node, (p, node)) AS node FROM (SELECT *, 0 AS p FROM own UNION ALL SELECT question_id, {_CORE.format('key')} AS k, max(node), 1 FROM own WHERE {_CORE.format('key')} <> '' GROUP BY question_id, k HAVING count(*) = 1 UNION ALL SELECT question_id, {S.key('node')}, canonical, 2 FROM lex) GROUP BY question_id, key)"


@query("resolve_index", f"WITH {_NODES}, {_LEXICAL}, {_INDEX} SELECT * FROM idx")
def resolve_index(spark: SparkSession, d: str) -> DataFrame:
    """What queries may call every node of every graph."""
    found = graph.nodes(edges(spark, d), Q).where("question_id is not null")
    return graph.query_index(found, graph.lexical_aliases(found, Q), Q)


@query("resolve_entity", f"WITH {_NODES}, {_LEXICAL}, {_INDEX}, ask AS (SELECT DISTINCT question_id, CASE WHEN length(node) % 2 = 0 THEN node ELSE upper(node) || '?' END AS name FROM nodes WHERE question_id IS NOT NULL AND regexp_full_match(node, '[ -~]+')) SELECT question_id, name, CASE WHEN n.node IS NOT NULL THEN name ELSE coalesce(idx.node, name) END AS node FROM ask LEFT JOIN nodes n USING (question_id) LEFT JOIN idx USING (question_id) WHERE false".replace("LEFT JOIN nodes n USING (question_id) LEFT JOIN idx USING (question_id) WHERE false", "LEFT JOIN nodes n ON n.question_id = ask.question_id AND n.node = name LEFT JOIN idx ON idx.question_id = ask.question_id AND idx.key = " + S.key("name")).replace("SELECT question_id, name, CASE WHEN n.node", "SELECT ask.question_id, name, CASE WHEN n.node"))
def resolve_entity(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that names in other writing stand for."""
    found = graph.nodes(edges(spark, d), Q).where("question_id is not null")
    names = graph.query_index(found, graph.lexical_aliases(found, Q), Q)
    asked = found.where(F.col("node").rlike(r"^[ -~]+$")).select(*Q, F.when(F.length("node") % 2 == 0, F.col("node")).otherwise(F.concat(F.upper("node"), F.lit("?"))).alias("name")).distinct()
    return graph.nodes_by_key(found, names, Q, asked)


@query("resolve_all")
def resolve_all(spark: SparkSession, d: str) -> DataFrame:
    """The log of all four tiers over all graphs."""
    return graph.resolve(edges(spark, d), Q)[1]


@query("resolve_dangling", "SELECT question_id, node FROM (SELECT question_id, head AS node FROM triple) WHERE false")
def resolve_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that still stand in resolved graphs, and those whose final name is no node: there must be none."""
    merged, log = graph.resolve(edges(spark, d).where("question_id is not null"), Q)
    left = graph.nodes(merged, Q).select(*Q, "node")
    flat = materialize(graph.flat_aliases(log, Q), "flat")
    lost = flat.select(*Q, F.col("canonical").alias("node")).distinct().join(left, [*Q, "node"], "left_anti")
    return flat.select(*Q, "node").join(left, [*Q, "node"], "left_semi").unionByName(lost)


@query("kg_summary_resolved", f"WITH {_NODES}, {_LEXICAL} SELECT question_id, count(DISTINCT node) AS n_aliases, count(*) AS n_lexical FROM lex GROUP BY question_id")
def kg_summary_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and merges of the first tier in the summaries of graphs that have any."""
    e = edges(spark, d).where("question_id is not null")
    log = graph.lexical_aliases(graph.nodes(e, Q), Q).withColumn("tier", F.lit("lexical"))
    return graph.summary(e, Q, log).where("n_aliases > 0").select(*Q, "n_aliases", "n_lexical")


@query("kg_trace", f"WITH {_NODES}, {_LEXICAL}, a AS (SELECT question_id, count(*) AS n FROM lex GROUP BY 1), n AS (SELECT question_id, count(*) AS n FROM nodes GROUP BY 1) SELECT t.question_id, count(*) AS n_edges, any_value(n.n) AS n_nodes, coalesce(any_value(a.n), 0) AS n_aliases, count(row_index) AS n_rows FROM triple t JOIN n USING (question_id) LEFT JOIN a USING (question_id) GROUP BY t.question_id")
def kg_trace(spark: SparkSession, d: str) -> DataFrame:
    """Graphs exported as JSON with provenance and aliases, read again and counted."""
    e = edges(spark, d).where("question_id is not null")
    traces = graph.to_trace(e, Q, graph.lexical_aliases(graph.nodes(e, Q), Q))
    back = F.from_json("trace", "nodes array<struct<id: string, types: array<string>>>, edges array<struct<head: string, row_index: int>>, aliases array<struct<alias: string>>")
    return traces.select(*Q, F.size(back["edges"]).cast("long").alias("n_edges"), F.size(back["nodes"]).cast("long").alias("n_nodes"), F.size(back["aliases"]).cast("long").alias("n_aliases"), F.size(F.filter(back["edges"]["row_index"], lambda r: r.isNotNull())).cast("long").alias("n_rows"))


@query("kg_dot", f"WITH {_NODES}, {_LEXICAL}, a AS (SELECT question_id, count(*) AS n FROM lex GROUP BY 1), v AS (SELECT question_id, count(*) AS n FROM nodes WHERE NOT EXISTS (SELECT 1 FROM triple t WHERE t.question_id = nodes.question_id AND t.head = nodes.node) GROUP BY 1) SELECT t.question_id, count(*) + coalesce(any_value(a.n), 0) AS n_arrows, coalesce(any_value(v.n), 0) AS n_values, count(*) FILTER (source_type = 'table') AS n_blue FROM triple t LEFT JOIN a USING (question_id) LEFT JOIN v USING (question_id) GROUP BY t.question_id")
def kg_dot(spark: SparkSession, d: str) -> DataFrame:
    """Arrows, values and table facts in the drawings of all graphs."""
    e = edges(spark, d).where("question_id is not null")
    dots = graph.to_dot(e, Q, graph.lexical_aliases(graph.nodes(e, Q), Q))
    n = lambda p: F.size(F.regexp_extract_all("dot", F.lit(p), F.lit(0))).cast("long")
    return dots.select(*Q, n(r'" -> "').alias("n_arrows"), n(r"\[shape=ellipse\]").alias("n_values"), n(r", color=blue\]").alias("n_blue"))
