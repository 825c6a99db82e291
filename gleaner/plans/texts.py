"""Queries over text functions, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import generation
from gleaner.plans import sqltext as S
from gleaner.plans.registry import query
from gleaner.session import table

_MONTH = r"\b(?:" + "|".join(T.MONTHS) + r")\b"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("normalize_key", f"SELECT p_partkey, {S.key('p_name')} AS name_key, {S.key('p_type')} AS type_key FROM part")
def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.normalize_key(F.col("p_name")).alias("name_key"), T.normalize_key(F.col("p_type")).alias("type_key"))


@query("name_keys", f"SELECT triple_id, {S.key('head')} AS head_key, {S.key('tail')} AS tail_key FROM triple")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names with all kinds of characters."""
    return table(spark, d, "triple").select("triple_id", T.normalize_key(F.col("head")).alias("head_key"), T.normalize_key(F.col("tail")).alias("tail_key"))


@query("relation_names", f"SELECT relation, {S.relation('relation')} AS relation_key, count(*) AS n FROM triple GROUP BY ALL")
def relation_names(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all relations, aliases replaced."""
    rows = table(spark, d, "triple").groupBy("relation").agg(F.count("*").alias("n"))
    return rows.select("relation", T.relation_key(F.col("relation")).alias("relation_key"), "n")


@query("relation_canonical", f"WITH {S.canonical_relations('triple')} SELECT relation, n, canonical FROM (SELECT relation, count(*) AS n FROM triple GROUP BY 1) LEFT JOIN rel USING (relation)")
def relation_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical relations with aliases and the fuzzy step, counted."""
    names = table(spark, d, "triple").groupBy("relation").agg(F.count("*").alias("n"))
    return T.normalize_relations(names, "relation", "canonical")


_CLUB = "CASE s_suppkey % 5 WHEN 0 THEN 'Club ' || s_name WHEN 1 THEN s_name || ' F.C.' WHEN 2 THEN 'club ' || s_name || ' football club' WHEN 3 THEN s_name || ' CF fc' ELSE s_name END"


@query("entity_core", f"SELECT s_suppkey, CASE s_suppkey % 5 WHEN 3 THEN {S.key('s_name')} || ' cf' ELSE {S.key('s_name')} END AS core FROM supplier")
def entity_core(spark: SparkSession, d: str) -> DataFrame:
    """Names of clubs without one designator in front and one behind."""
    return table(spark, d, "supplier").select("s_suppkey", T.entity_core(T.normalize_key(F.expr(_CLUB))).alias("core"))


@query("display_scores", f"SELECT triple_id, x[1] AS others, x[2] AS size, x[3] AS capitals FROM (SELECT triple_id, {S.shown('tail')} AS x FROM triple WHERE tail IS NOT NULL)")
def display_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "triple").where("tail is not null").select("triple_id", T.display_score(F.col("tail")).alias("x"))
    return rows.select("triple_id", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("others", "size", "capitals")])


@query("literal_cells", rf"SELECT triple_id, regexp_full_match(trim(tail, ' '), '[\d\s:./-]+') OR regexp_matches({S.key('tail')}, '{_MONTH}') AS literal, regexp_full_match(trim(tail, ' '), '[\d\s:./,%$-]+') OR regexp_matches(lower(tail), '{_MONTH}') AS looks FROM triple")
def literal_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triple").select("triple_id", T.is_literal(F.col("tail")).alias("literal"), T.looks_literal(F.col("tail")).alias("looks"))


@query("tokens", rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{S.WHITE}'), lambda t: t <> '')) AS n_tokens FROM documents WHERE text IS NOT NULL""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("term_sets", f"SELECT doc_id, len({S.terms('text')}) AS n_terms, len(list_filter({S.terms('text')}, lambda t: length(t) > 1 AND t NOT IN ('the', 'of', 'in'))) AS n_kept FROM documents WHERE text IS NOT NULL")
def term_sets(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.terms(x)).cast("long").alias("n_terms"), F.size(T.terms(x, ["the", "of", "in"])).cast("long").alias("n_kept"))


@query("first_number", f"SELECT triple_id, {S.number('tail')} AS num FROM triple")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triple").select("triple_id", T.number(F.col("tail")).alias("num"))


@query("last_number", f"SELECT triple_id, {S.last_number('tail')} AS num FROM triple")
def last_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triple").select("triple_id", T.last_number(F.col("tail")).alias("num"))


@query("answer_numbers", f"SELECT example_id, ingested_at, {S.number('answer')} AS first, {S.last_number('answer')} AS last FROM datasetexample")
def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    """First and last numbers of answers in all notations."""
    return table(spark, d, "datasetexample").select("example_id", "ingested_at", T.number(F.col("answer")).alias("first"), T.last_number(F.col("answer")).alias("last"))


@query("normalize_answer", f"SELECT question_id, ingested_at, {S.answer('answer_text')} AS answer FROM sample_hybridqa")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", T.normalize_answer(F.col("answer_text")).alias("answer"))


@query("entity_answers", f"SELECT c_custkey, {S.entity_answer('x')} AS answer FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'The U.S.A.' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'Moroccan' ELSE c_name END AS x FROM customer)")
def entity_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers under the names that known aliases stand for."""
    x = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'The U.S.A.' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'Moroccan' ELSE c_name END")
    return table(spark, d, "customer").select("c_custkey", T.normalize_entity_answer(x).alias("answer"))


@query("literal_keys", rf"SELECT triple_id, regexp_replace(lower(trim(regexp_replace(tail || ' %', '{S.WHITE}', ' ', 'g'), ' ')), '\s+%', '%', 'g') AS k FROM triple")
def literal_keys(spark: SparkSession, d: str) -> DataFrame:
    """What a cell and a literal of a question must share."""
    return table(spark, d, "triple").select("triple_id", T.literal_key(F.concat("tail", F.lit(" %"))).alias("k"))


_ASKED = "concat_ws(' ', question, answer)"
_FOUND = "list_transform(list_concat(regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?\\s*%'), regexp_extract_all(t, '\\$\\s*\\d+(?:[,.]\\d+)*(?:\\s*(?i:million|billion|thousand))?'), regexp_extract_all(t, '\\b(?:19|20)\\d{2}\\b')), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' '))"


@query("question_literals", f"SELECT example_id, ingested_at, array_to_string({_FIRST.format('f')}, '|') AS literals FROM (SELECT *, {_FOUND} AS f FROM (SELECT *, {_ASKED} AS t FROM datasetexample WHERE answer IS NULL OR NOT regexp_matches(answer, '[\\w.]\\$')))")
def question_literals(spark: SparkSession, d: str) -> DataFrame:
    """Percentages, amounts and years in questions with their answers."""
    rows = table(spark, d, "datasetexample").where(F.col("answer").isNull() | ~F.col("answer").rlike(r"[\w.]\$"))
    return rows.select("example_id", "ingested_at", F.array_join(T.question_literals(F.expr(_ASKED)), "|").alias("literals"))


@query(
    "rank_constraint",
    "SELECT question_id, ingested_at, coalesce("
    + ", ".join(f"CASE WHEN regexp_matches(lower(question), '\\b{w}\\b') THEN '{i + 1}' END" for i, w in enumerate(T.ORDINALS))
    + r", nullif(regexp_extract(lower(question), '\b(\d+)(?:st|nd|rd|th)\b', 1), '')) AS rank_named FROM sample_hybridqa",
)
def rank_constraint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", T.rank_constraint(F.col("question")).alias("rank_named"))


@query(
    "question_anchor",
    r"""SELECT question_id, ingested_at,
CASE WHEN q LIKE '%middle name%' THEN 'middle_name' WHEN q LIKE '%full name%' THEN 'full_name' WHEN q LIKE '%nationality%' THEN 'nationality' WHEN q LIKE '%born%' THEN 'birth_date' WHEN q LIKE '%place of birth%' THEN 'place_of_birth' WHEN q LIKE '%where%' THEN 'location' WHEN regexp_matches(q, '\bwho\b') THEN 'person' END AS attribute,
CASE WHEN q LIKE '%player%' OR q LIKE '%manager%' OR q LIKE '%person%' THEN 'person' WHEN q LIKE '%team%' THEN 'team' WHEN q LIKE '%club%' THEN 'club' WHEN q LIKE '%city%' OR q LIKE '%country%' THEN 'location' END AS kind,
CASE WHEN q LIKE '%what year%' OR q LIKE '%which year%' THEN 'year' WHEN regexp_matches(q, '\bwhen\b') THEN 'date' WHEN q LIKE '%how many%' OR q LIKE '%how much%' THEN 'count' ELSE 'short' END AS shape
FROM (SELECT *, lower(question) AS q FROM sample_hybridqa)""",
)
def question_anchor(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", T.target_attribute(q).alias("attribute"), T.entity_type(q).alias("kind"), T.answer_shape(q).alias("shape"))


@query("direct_mentions", r"""SELECT question_id, ingested_at, array_to_string(regexp_extract_all(question, '\b[A-Z][\p{L}\p{N}_\x27-]+(?:\s+[A-Z][\p{L}\p{N}_\x27-]+)*\s+[A-Z][\p{L}\p{N}_\x27-]*[\p{L}\p{N}_]'), '|') AS mentions FROM sample_hybridqa""")
def direct_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", F.array_join(T.direct_mentions(F.col("question")), "|").alias("mentions"))


@query("requested_columns", r"SELECT question_id, ingested_at, c AS column_name, regexp_matches(lower(question), '\b(?:which|what|who)\b') AND regexp_matches(lower(question), '\b' || lower(c) || '\b') AS requested FROM sample_hybridqa, (VALUES ('Name'), ('stadium'), ('was'), ('score')) v(c)")
def requested_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which of some columns every question asks for."""
    rows = table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", "question", F.explode(F.array(*map(F.lit, ["Name", "stadium", "was", "score"]))).alias("column_name"))
    return rows.select("question_id", "ingested_at", "column_name", T.requests_column(F.col("question"), F.col("column_name")).alias("requested"))


_RELATIONS = "CASE WHEN dataset = 'finqa' THEN ['percentage of total', 'annual_interest_amount'] ELSE [] END"
_INTENT_TEXT = "question || CASE WHEN dataset = 'finqa' THEN ' interest combined percent from 2001 to 2005 range' ELSE ' on average of the top 3 and second largest total' END"
_INTENT = r"""(SELECT example_id, ingested_at, list_filter([
CASE WHEN combined AND share AND finqa THEN 'add' END,
CASE WHEN t LIKE '%average%' THEN 'table_average' END,
CASE WHEN regexp_matches(t, 'highest|largest|most ') THEN 'argmax' END,
CASE WHEN regexp_matches(t, 'lowest|smallest|least ') THEN 'argmin' END,
CASE WHEN regexp_matches(t, '\btop\s+\d+\b') THEN 'topk_argmax' END,
CASE WHEN regexp_matches(t, '\b(second|third|fourth)\s+(largest|highest)\b') THEN 'kth_argmax' END,
CASE WHEN regexp_matches(t, '\b(second|third|fourth)\s+(smallest|lowest)\b') THEN 'kth_argmin' END,
CASE WHEN t LIKE '%range%' THEN 'range' END,
CASE WHEN regexp_matches(t, '\bhow many\b') AND regexp_matches(t, 'reported|countries|provinces|territories|groups') THEN 'count' END,
CASE WHEN regexp_matches(t, 'difference|increase|decline|decrease') THEN 'subtract' END,
CASE WHEN regexp_matches(t, 'outperform|greater than|higher than') THEN 'greater' END,
CASE WHEN share AND NOT combined THEN 'divide' END,
CASE WHEN years AND t LIKE '%interest%' AND finqa THEN 'multiply' END,
CASE WHEN t LIKE '%sum%' AND NOT (combined AND share AND finqa) THEN 'add' WHEN combined AND NOT share THEN 'add' END
], lambda x: x IS NOT NULL) AS operators,
list_filter([CASE WHEN combined AND share AND finqa THEN 'add_displayed_shares' END, CASE WHEN t LIKE '%average%' THEN 'average_of_displayed_values' END, CASE WHEN t LIKE '%range%' THEN 'range_is_greatest_then_least' END,
CASE WHEN regexp_matches(t, 'outperform|greater than|higher than') THEN 'compare_both_values' END, CASE WHEN share AND NOT combined THEN 'share_needs_both_parts' END, CASE WHEN years AND t LIKE '%interest%' AND finqa THEN 'interest_years=5' END,
CASE WHEN regexp_matches(t, '\bfrom\b.+\bto\b') THEN 'change_is_last_less_first' END, CASE WHEN t LIKE '%total%' THEN 'total_may_name_a_row' END], lambda x: x IS NOT NULL) AS heed
FROM (SELECT *, ' ' || t LIKE '% combined%' OR t LIKE '%together%' AS combined, regexp_matches(t, 'proportion|percent') AS share, regexp_matches(t, '\bfrom\s+20\d{2}\s+to\s+20\d{2}\b') AS years, dataset = 'finqa' AS finqa FROM (SELECT *, array_to_string(regexp_extract_all(lower(@TEXT), '[a-z0-9]+'), ' ') AS t FROM datasetexample)))""".replace("@TEXT", _INTENT_TEXT)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    finqa = F.col("dataset") == "finqa"
    text = F.concat("question", F.when(finqa, " interest combined percent from 2001 to 2005 range").otherwise(" on average of the top 3 and second largest total"))
    relations = F.when(finqa, F.array(F.lit("percentage of total"), F.lit("annual_interest_amount"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "datasetexample").select("example_id", "ingested_at", text.alias("asked"), relations.alias("relations"))


@query("operation_intent", f"SELECT example_id, ingested_at, array_to_string(operators, ',') AS operators FROM {_INTENT}")
def operation_intent(spark: SparkSession, d: str) -> DataFrame:
    ops = T.operation_intent(F.col("asked"), F.col("relations"))
    return _asked(spark, d).select("example_id", "ingested_at", F.array_join(ops, ",").alias("operators"))


@query("intent_lines", f"SELECT example_id, ingested_at, CASE WHEN len(operators) = 0 AND len(heed) = 0 THEN 'no constraint' ELSE 'operators: ' || CASE WHEN len(operators) > 0 THEN array_to_string(operators, ', ') ELSE 'any' END || '; heed: ' || array_to_string(heed, ', ') END AS line FROM {_INTENT}")
def intent_lines(spark: SparkSession, d: str) -> DataFrame:
    """Operators and constraints of every question as a line of a prompt."""
    q, r = F.col("asked"), F.col("relations")
    return _asked(spark, d).select("example_id", "ingested_at", T.format_intent(T.operation_intent(q, r), T.operation_constraints(q, r)).alias("line"))


@query(
    "query_expansions",
    r"""SELECT example_id, ingested_at, array_to_string(list_filter([
CASE WHEN contains(lower(question), 'interest') THEN 'interest amount expense payable annually per year' END,
CASE WHEN regexp_matches(lower(question), 'percent|ratio') THEN 'percentage ratio total amount' END,
CASE WHEN regexp_matches(question, '\b(19|20)\d{2}\b') THEN 'annual annually year period from to' END,
nullif(array_to_string(list_slice(h, 1, 20), ' '), '')], lambda x: x IS NOT NULL), '|') AS expansions FROM (SELECT e.*, coalesce(texts[1], []) AS h FROM datasetexample e LEFT JOIN (SELECT DISTINCT ON (table_id) table_id, texts FROM hitab ORDER BY table_id, ingested_at DESC) t USING (table_id))""",
)
def query_expansions(spark: SparkSession, d: str) -> DataFrame:
    """Extra queries of every question, with the headers of its table."""
    headers = table(spark, d, "hitab").groupBy("table_id").agg(F.max_by(F.col("texts")[0], "ingested_at").alias("h"))
    rows = table(spark, d, "datasetexample").join(headers, "table_id", "left")
    return rows.select("example_id", "ingested_at", F.array_join(T.query_expansions(F.col("question"), F.coalesce("h", F.array().cast("array<string>"))), "|").alias("expansions"))


@query("relation_groups", "SELECT question_id, ingested_at, CASE WHEN q LIKE '%middle name%' THEN 'middle name|full name' WHEN q LIKE '%most populous city%' THEN 'most populous city' WHEN q LIKE '%nationality%' THEN 'nationality' WHEN q LIKE '%place of birth%' THEN 'place birth|born in' ELSE '' END AS groups FROM (SELECT *, " + S.key("question") + " AS q FROM sample_hybridqa)")
def relation_groups(spark: SparkSession, d: str) -> DataFrame:
    """The relations that must support an answer to each question."""
    groups = F.array_join(F.transform(T.relation_groups(F.col("question")), lambda g: F.array_join(g, " ")), "|")
    return table(spark, d, "sample_hybridqa").select("question_id", "ingested_at", groups.alias("groups"))


@query("value_keys", "SELECT p_brand, CAST(to_json(list_sort(list(p_name))) AS VARCHAR) AS k FROM part GROUP BY p_brand")
def value_keys(spark: SparkSession, d: str) -> DataFrame:
    """One key for the names of each brand, whatever their order."""
    return table(spark, d, "part").groupBy("p_brand").agg(T.value_key(F.collect_list("p_name")).alias("k"))


@query("value_terms", f"SELECT program_id, step_id, string_agg(k, '|' ORDER BY k) AS terms FROM (SELECT DISTINCT program_id, step_id, {S.key('a')} AS k FROM (SELECT program_id, step_id, j.atom ->> '$' AS a FROM irstep, json_tree(arguments) j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'DOUBLE'))) WHERE k <> '' GROUP BY ALL")
def value_terms(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all texts and whole numbers in the arguments of steps."""
    plain = F.regexp_replace("arguments", r'(?<=[\[:,] ?)-?\d+\.\d+(?:[eE][-+]?\d+)?(?=[\],}])|^-?\d+\.\d+$', '""')
    rows = table(spark, d, "irstep").select("program_id", "step_id", T.value_terms(plain).alias("t")).where("size(t) > 0")
    terms = F.array_distinct(F.flatten(F.collect_list("t")))
    return rows.groupBy("program_id", "step_id").agg(F.array_join(F.array_sort(terms), "|").alias("terms"))


@query("numeric_values", r"SELECT triple_id, try_cast(rtrim(trim(replace(tail, ',', ''), ' '), '%') AS DOUBLE) IS NOT NULL AS is_number FROM triple WHERE tail IS NOT NULL")
def numeric_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triple").where("tail is not null").select("triple_id", T.is_numeric(F.col("tail")).alias("is_number"))


@query("fenced_texts", "SELECT example_id, ingested_at, trim(answer, E' \\t\\n') AS answer FROM datasetexample WHERE answer IS NOT NULL AND NOT contains(answer, '`')")
def fenced_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers taken out of the code fences around them."""
    rows = table(spark, d, "datasetexample").where("answer is not null and not contains(answer, '`')")
    return rows.select("example_id", "ingested_at", F.regexp_replace(T.strip_fence(F.concat(F.lit("```json\n"), "answer", F.lit("\n```"))), r"^[ \t\n]+|[ \t\n]+$", "").alias("answer"))


@query("json_lists", "SELECT program_id, step_id, CAST(json_array_length(arguments) AS INTEGER) AS n FROM (SELECT DISTINCT program_id, step_id, arguments FROM irstep) WHERE json_type(arguments) = 'ARRAY'")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """The lists found in replies that talk around them."""
    rows = table(spark, d, "irstep").select("program_id", "step_id", "arguments").distinct().where("arguments like '[%'")
    found = T.json_list(F.concat(F.lit("The list is "), "arguments", F.lit(" as asked.")))
    return rows.select("program_id", "step_id", F.size(F.from_json(found, "array<string>")).alias("n"))


@query("facts_of_replies", "SELECT c_custkey, c_name AS head, 'lives_in' AS relation, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0")
def facts_of_replies(spark: SparkSession, d: str) -> DataFrame:
    """Facts read from the replies of a provider; what lacks a part or is no list gives none."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    whole = F.to_json(F.array(F.struct(F.col("c_name").alias("head"), F.lit("lives_in").alias("relation"), F.col("n_name").alias("tail")), F.struct(F.lit("x").alias("head"), F.lit(None).cast("string").alias("relation"), F.lit("y").alias("tail"))))
    prompt = F.when(F.col("c_custkey") % 3 == 0, F.lit("no list")).otherwise(F.concat(F.lit("Facts: "), whole))
    rows = table(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", prompt.alias("prompt"))
    return generation.facts_of(generation.complete(rows, "c_custkey", "prompt", lambda prompts: prompts), "c_custkey")


@query("paths_of_replies", "SELECT c_custkey, 'p' || i AS path_id, CAST(2 AS INTEGER) AS n_steps FROM customer, (VALUES (1), (2)) v(i)")
def paths_of_replies(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning paths read from the replies of a provider."""
    reply = F.concat(F.lit('```json\n[{"steps": [{"goal": "find '), "c_name", F.lit('"}, "count"]}, {"path_id": "p2", "steps": ["a", "b"]}, {"steps": []}]\n```'))
    rows = table(spark, d, "customer").select("c_custkey", reply.alias("prompt"))
    paths = generation.paths_of(generation.complete(rows, "c_custkey", "prompt", lambda prompts: prompts), "c_custkey")
    return paths.select("c_custkey", "path_id", F.size("goals").alias("n_steps"))


@query(
    "code_problems",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'import' WHEN 2 THEN 'unknown relation nowhere' WHEN 3 THEN 'constant result' ELSE 'unknown call kg.delete' END AS problem FROM customer",
)
def code_problems(spark: SparkSession, d: str) -> DataFrame:
    """Why generated programs must not run."""
    name = F.concat(F.lit('"'), "c_name", F.lit('"'))
    texts = [F.concat(F.lit("result = len(kg.get_neighbors("), name, F.lit(', "lives_in"))')), F.lit("import os\nresult = 1"), F.concat(F.lit("result = kg.get_sources("), name, F.lit(', "nowhere")')), F.lit('x = "yes"\nresult = x'), F.lit("kg.delete(1)\nresult = 2")]
    k = F.col("c_custkey") % 5
    code = F.when(k == 0, texts[0]).when(k == 1, texts[1]).when(k == 2, texts[2]).when(k == 3, texts[3]).otherwise(texts[4])
    rows = table(spark, d, "customer").select("c_custkey", code.alias("code"))
    return rows.select("c_custkey", generation.problems_of(F.col("code"), ["lives_in"]).alias("problem"))
