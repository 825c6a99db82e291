"""Queries over the numerical operators and programs, each on whole tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import graph, ir
from gleaner.plans import sqltext as S
from gleaner.plans.graphs import Q, edges
from gleaner.plans.registry import query
from gleaner.session import materialize, table

OPS = ir.COLUMN_OPS

# -- one program over many rows ----------------------------------------------------------------------


def _binary(name: str, op: str, sql: str) -> None:
    @query(f"ir_{name}", f"SELECT l_orderkey, l_linenumber, {sql} AS value FROM lineitem")
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = F.col("l_extendedprice"), F.col("l_quantity")
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", OPS[op](a, b).alias("value"))


_binary("subtract", "subtract", "l_extendedprice - l_quantity")
_binary("divide", "divide", "l_extendedprice / nullif(l_quantity, 0)")
_binary("greater", "greater", "l_extendedprice > l_quantity")
_binary("compare", "compare", "l_extendedprice > l_quantity")
_binary("less", "less", "l_extendedprice < l_quantity")


def _variadic(name: str, sql: str) -> None:
    @query(f"ir_{name}", f"SELECT l_orderkey, l_linenumber, {sql} AS value FROM lineitem")
    def run(spark: SparkSession, d: str) -> DataFrame:
        nums = F.array("l_quantity", "l_discount", "l_tax")
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", OPS[name](nums).alias("value"))


_variadic("add", "l_quantity + l_discount + l_tax")
_variadic("multiply", "l_quantity * l_discount * l_tax")
_variadic("negate", "-l_quantity")


@query("ir_exp", "SELECT l_orderkey, l_linenumber, pow(1 + l_discount, l_quantity) AS value FROM lineitem")
def ir_exp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", OPS["exp"](1 + F.col("l_discount"), F.col("l_quantity")).alias("value"))


@query("ir_const", "SELECT l_orderkey, l_linenumber, l_quantity * 100 AS value FROM lineitem")
def ir_const(spark: SparkSession, d: str) -> DataFrame:
    """A compiled program: lookup, constant, product."""
    program = {"steps": [{"id": "v1", "op": "lookup", "arguments": {"entity": "row", "relation": "l_quantity"}}, {"id": "v2", "op": "const", "arguments": {"value": "$100"}}, {"id": "v3", "op": "multiply", "arguments": ["v1", "v2"]}], "result": "v3"}
    value = ir.compile_program(program, lambda a: F.col(a["relation"]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


@query("ir_program", "SELECT l_orderkey, l_linenumber, (l_extendedprice - l_quantity) / nullif(l_quantity, 0) AS value FROM lineitem")
def ir_program(spark: SparkSession, d: str) -> DataFrame:
    """A percentage change whose closing times one hundred a ratio question drops."""
    look = lambda i, r: {"id": i, "op": "lookup", "arguments": {"entity": "row", "relation": r}}
    program = {"steps": [look("v1", "l_extendedprice"), look("v2", "l_quantity"), {"id": "v3", "op": "subtract", "arguments": ["v1", "v2"]}, {"id": "v4", "op": "divide", "arguments": ["v3", "v2"]}, {"id": "v5", "op": "multiply", "arguments": ["v4", 100]}], "result": "v5"}
    value = ir.compile_program(ir.ratio_result(program, "What was the percentage change?"), lambda a: F.col(a["relation"]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


@query("ir_inclusive_year_count", "SELECT o_custkey, CAST(year(max(o_orderdate)) - year(min(o_orderdate)) + 1 AS INTEGER) AS value FROM orders GROUP BY o_custkey")
def ir_inclusive_year_count(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return years.select("o_custkey", OPS["inclusive_year_count"](F.col("a"), F.col("b")).alias("value"))


# -- programs of one step over the parts of every brand, run by the interpreter -----------------------


def _one_step(spark: SparkSession, d: str, op: str, arguments: Column) -> DataFrame:
    """A program for each brand whose only step has ``arguments``, an aggregate over the brand's parts."""
    made = table(spark, d, "part").groupBy(F.col("p_brand").alias("program_id")).agg(arguments.alias("arguments"))
    steps = made.select("program_id", F.lit("v1").alias("step_id"), F.lit(1).alias("step_pos"), F.lit(op).alias("op"), "arguments")
    programs = made.select("program_id", F.lit("v1").alias("result_step"), F.lit(None).cast("string").alias("question_id"))
    out = ir.run_programs(programs, steps, edges(spark, d).where("false"), Q)
    return out.where("success").select(F.col("program_id").alias("p_brand"), "value", "value_num")


def _parts() -> Column:
    """The parts of a brand in order: price as text, name, price."""
    return F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("t"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("value"))))


def _numbers() -> Column:
    return F.to_json(F.transform(_parts(), lambda x: x["t"]))


def _labelled() -> Column:
    return F.transform(_parts(), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))


def _of_numbers(op: str, sql: str) -> None:
    @query(f"ir_{op}", f"SELECT p_brand, {sql} AS value FROM part GROUP BY p_brand")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _one_step(spark, d, op, _numbers()).select("p_brand", F.round("value_num", 2).alias("value"))


_of_numbers("table_sum", "round(sum(p_retailprice), 2)")
_of_numbers("table_average", "round(avg(p_retailprice), 2)")
_of_numbers("table_max", "max(p_retailprice)")
_of_numbers("table_min", "min(p_retailprice)")
_of_numbers("count", "CAST(count(*) AS DOUBLE)")


@query("ir_range", "SELECT p_brand, max(p_retailprice) AS greatest, min(p_retailprice) AS least FROM part GROUP BY p_brand")
def ir_range(spark: SparkSession, d: str) -> DataFrame:
    ends = F.from_json("value", "array<double>")
    return _one_step(spark, d, "range", _numbers()).select("p_brand", ends[0].alias("greatest"), ends[1].alias("least"))


def _extreme(op: str, sql: str) -> None:
    @query(f"ir_{op}", f"SELECT p_brand, {sql}(p_name, (p_retailprice, p_name)) AS value FROM part GROUP BY p_brand")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _one_step(spark, d, op, F.to_json(_labelled())).select("p_brand", F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x").alias("value"))


_extreme("argmax", "arg_max")
_extreme("argmin", "arg_min")


def _ranked(op: str, way: str) -> None:
    place = f"row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice {way}, p_name {way})"

    @query(f"ir_topk_{op}", f"SELECT p_brand, string_agg(p_name, '|' ORDER BY place) AS value FROM (SELECT p_brand, p_name, {place} AS place FROM part) WHERE place <= 3 GROUP BY p_brand")
    def top(spark: SparkSession, d: str) -> DataFrame:
        made = _one_step(spark, d, f"topk_{op}", F.to_json(F.struct(_labelled().alias("items"), F.lit("3").alias("k"))))
        return made.select("p_brand", F.array_join(F.from_json("value", "array<string>"), "|").alias("value"))

    @query(f"ir_kth_{op}", f"SELECT p_brand, p_name AS value FROM (SELECT p_brand, p_name, {place} AS place FROM part) WHERE place = 3")
    def kth(spark: SparkSession, d: str) -> DataFrame:
        made = _one_step(spark, d, f"kth_{op}", F.to_json(F.struct(_labelled().alias("items"), F.lit(3).alias("k"))))
        return made.select("p_brand", F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x").alias("value"))


_ranked("argmax", "DESC")
_ranked("argmin", "ASC")


def _filtered(op: str, sign: str, at: float) -> None:
    @query(f"ir_{op}", f"SELECT p_brand, coalesce(string_agg(p_name, '|' ORDER BY p_partkey) FILTER (p_retailprice {sign} {at}), '') AS value FROM part GROUP BY p_brand")
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = _one_step(spark, d, op, F.to_json(F.struct(_labelled().alias("items"), F.lit(at).alias("threshold"))))
        return made.select("p_brand", F.array_join(F.from_json("value", "array<string>"), "|").alias("value"))


_filtered("filter_greater", ">", 950.0)
_filtered("filter_less", "<", 920.0)


@query("ir_topk_columns", "SELECT p_brand, p_name, CAST(place AS INTEGER) AS place FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name DESC) AS place FROM part) WHERE place <= 3")
def ir_topk_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking as a grouped form over rows."""
    return ir.ranked_labels(table(spark, d, "part"), ["p_brand"], "p_name", "p_retailprice", True, 3)


# -- programs over fact graphs -------------------------------------------------------------------------

_GRAPH = f"""{S.canonical_relations("triple")}, g AS (SELECT question_id, triple_id, head, canonical AS relation, tail, source_type, source_id FROM triple JOIN rel USING (relation) WHERE question_id IS NOT NULL AND head IS NOT NULL AND tail IS NOT NULL AND NOT {S.key('head')} = {S.key('tail')})"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    whole = edges(spark, d).where("question_id is not null and head is not null and tail is not null and relation is not null")
    return materialize(graph.insert(whole)[0], "graph")


def _lookups(spark: SparkSession, d: str, entity: str, extra: dict) -> DataFrame:
    """A program of one lookup for every entity and relation of every graph."""
    e = _graph(spark, d)
    asked = e.select(*Q, F.col(entity).alias("entity"), "relation").distinct().withColumn("program_id", F.concat_ws("|", *Q, "entity", "relation"))
    arguments = F.to_json(F.struct("entity", "relation", *[F.lit(v).alias(k) for k, v in extra.items()]))
    steps = asked.select("program_id", F.lit("v1").alias("step_id"), F.lit(1).alias("step_pos"), F.lit("lookup").alias("op"), arguments.alias("arguments"))
    out = ir.run_programs(asked.select("program_id", F.lit("v1").alias("result_step"), *Q), steps, e, Q)
    return out.join(asked, "program_id")


@query(
    "ir_lookup",
    f"""WITH {_GRAPH}, n AS (SELECT question_id, head, relation, tail, min(triple_id) AS s FROM g GROUP BY ALL), e AS (SELECT question_id, head, relation, count(DISTINCT (coalesce(source_type, '~'), coalesce(source_id, '~'), tail)) AS n_edges FROM g GROUP BY ALL)
SELECT question_id, head AS entity, relation, string_agg(tail, '|' ORDER BY s) AS found, any_value(n_edges) AS n_edges FROM n JOIN e USING (question_id, head, relation) GROUP BY ALL""",
)
def ir_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every entity along every relation in its own graph, by first edges, with the size
    of the evidence."""
    out = _lookups(spark, d, "head", {})
    return out.select(*Q, "entity", "relation", F.array_join(F.from_json("value", "array<string>"), "|").alias("found"), "n_edges")


@query("ir_lookup_index", f"WITH {_GRAPH} SELECT question_id, tail AS entity, relation, arg_min(head, triple_id) AS value FROM g GROUP BY ALL")
def ir_lookup_index(spark: SparkSession, d: str) -> DataFrame:
    """The first source of every entity along every relation."""
    out = _lookups(spark, d, "tail", {"direction": "sources", "index": 0})
    return out.select(*Q, "entity", "relation", F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x").alias("value"))


# the value of a step: a number, a truth or neither; a step that fails ends its program
_VALUE = "STRUCT(n DOUBLE, b BOOLEAN, list BOOLEAN, ok BOOLEAN)"
_RUN = f"""WITH RECURSIVE s AS (SELECT DISTINCT program_id, step_id, step_pos, op, arguments FROM irstep),
o AS (SELECT program_id, op, arguments AS a, row_number() OVER w AS i, count(*) OVER (PARTITION BY program_id) AS k, step_id, step_id = 'v' || row_number() OVER w AS named FROM s WINDOW w AS (PARTITION BY program_id ORDER BY step_pos, step_id)),
x AS (SELECT *, CASE WHEN op = 'const' THEN CASE WHEN json_type(a) = 'OBJECT' THEN json_extract(a, '$.value') ELSE CAST(a AS JSON) END END AS c,
  CASE WHEN json_type(a) = 'ARRAY' THEN [json_extract(a, '$[' || p || ']') FOR p IN range(0, CAST(json_array_length(a) AS BIGINT))] END AS args FROM o),
y AS (SELECT *, CASE WHEN json_type(c) = 'ARRAY' AND json_array_length(c) = 1 THEN json_extract(c, '$[0]') ELSE c END AS c1 FROM x),
z AS (SELECT program_id, i, k, op, args, CASE WHEN json_type(c1) = 'VARCHAR' THEN {S.number("json_extract_string(c1, '$')")} ELSE try_cast(CAST(c1 AS VARCHAR) AS DOUBLE) END AS cn, op = 'const' AND json_type(c) = 'VARCHAR' AND json_extract_string(c, '$') = '' AS blank FROM y),
r AS (SELECT program_id, 0 AS i, [] :: {_VALUE}[] AS v, true AS ok FROM (SELECT DISTINCT program_id FROM o)
UNION ALL SELECT program_id, i, list_append(v, CAST(CASE WHEN op = 'const' THEN {{'n': cn, 'b': NULL, 'list': false, 'ok': true}} WHEN op = 'lookup' THEN {{'n': NULL, 'b': NULL, 'list': true, 'ok': true}}
  WHEN len(list_filter(nums, lambda n: n IS NULL)) > 0 OR (op = 'divide' AND nums[2] = 0) THEN {{'n': NULL, 'b': NULL, 'list': false, 'ok': false}}
  WHEN op IN ('greater', 'compare') THEN {{'n': NULL, 'b': nums[1] > nums[2], 'list': false, 'ok': true}}
  ELSE {{'n': CASE op WHEN 'add' THEN list_sum(nums) WHEN 'table_sum' THEN list_sum(nums) WHEN 'multiply' THEN list_product(nums) WHEN 'table_average' THEN list_sum(nums) / len(nums) WHEN 'table_max' THEN list_max(nums) WHEN 'table_min' THEN list_min(nums) WHEN 'subtract' THEN nums[1] - nums[2] WHEN 'divide' THEN nums[1] / nums[2] END, 'b': NULL, 'list': false, 'ok': true}} END AS {_VALUE})), ok AND (op IN ('const', 'lookup') OR (len(list_filter(nums, lambda n: n IS NULL)) = 0 AND NOT (op = 'divide' AND nums[2] = 0)))
FROM (SELECT r.program_id, z.i, r.v, r.ok, z.op, z.cn, [CASE WHEN json_type(g) = 'VARCHAR' AND regexp_full_match(json_extract_string(g, '$'), 'v[0-9]+') THEN r.v[CAST(substr(json_extract_string(g, '$'), 2) AS BIGINT)].n WHEN json_type(g) = 'VARCHAR' THEN {S.number("json_extract_string(g, '$')")} ELSE try_cast(CAST(g AS VARCHAR) AS DOUBLE) END FOR g IN z.args] AS nums FROM r JOIN z ON z.program_id = r.program_id AND z.i = r.i + 1)),
e AS (SELECT r.program_id, v, ok, k FROM r JOIN (SELECT program_id, max(k) AS k FROM o GROUP BY 1) USING (program_id) WHERE r.i = k)
SELECT p.program_id, coalesce(ok, false) AS success, CASE WHEN ok THEN round(v[CAST(substr(result_step, 2) AS BIGINT)].n, 4) END AS value_num, CASE WHEN ok THEN v[CAST(substr(result_step, 2) AS BIGINT)].b END AS value_bool, CAST(coalesce(k, 0) AS INTEGER) AS n_steps
FROM numericalprogram p LEFT JOIN e USING (program_id)"""


def _programs(spark: SparkSession, d: str) -> DataFrame:
    """Every stored program over the graph of its own example."""
    programs = table(spark, d, "numericalprogram").withColumnRenamed("example_id", "question_id")
    return ir.run_programs(programs, table(spark, d, "irstep"), _graph(spark, d), Q)


@query("ir_run_programs", _RUN)
def ir_run_programs(spark: SparkSession, d: str) -> DataFrame:
    """Every stored program, executed over the graph of its example: its result read as a number."""
    return _programs(spark, d).select("program_id", "success", F.round(_result(), 4).alias("value_num"), "value_bool", "n_steps")


def _result() -> Column:
    """A result as a number, where a constant says it as text or in a list of one."""
    plain = F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x")
    inner = F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x[0]"), plain)
    return F.when(F.col("value_bool").isNull(), F.coalesce("value_num", T.number(inner)))


@query(
    "ir_step_values",
    "SELECT program_id, CAST(count(*) AS INTEGER) AS n_values, string_agg(op, ',' ORDER BY step_pos, step_id) AS operators FROM (SELECT DISTINCT program_id, step_id, step_pos, op FROM irstep) JOIN (SELECT program_id FROM (" + _RUN + ") WHERE success) USING (program_id) GROUP BY program_id",
)
def ir_step_values(spark: SparkSession, d: str) -> DataFrame:
    """How many step values every successful program reports, and the trace of its operators."""
    done = _programs(spark, d).where("success")
    return done.select("program_id", F.size("step_values").alias("n_values"), F.array_join("operators", ",").alias("operators"))


@query("ir_failures", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN success THEN 'none' ELSE 'ValueError' END AS class FROM (" + _RUN + ")) GROUP BY 1")
def ir_failures(spark: SparkSession, d: str) -> DataFrame:
    """Programs by the class of error that ended them."""
    return _programs(spark, d).groupBy(F.coalesce(F.regexp_extract("error", r"^(\w+)", 1), F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "ir_operator_counts",
    "SELECT op, count(*) AS n_steps, count(DISTINCT program_id) AS n_programs FROM (SELECT DISTINCT program_id, step_id, op FROM irstep) GROUP BY op",
)
def ir_operator_counts(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "irstep").select("program_id", "step_id", "op").distinct()
    return steps.groupBy("op").agg(F.count("*").alias("n_steps"), F.countDistinct("program_id").alias("n_programs"))


# -- repairs of programs -----------------------------------------------------------------------------------


@query(
    "ir_unwrap",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 < 2 THEN '[1, ' || l_linenumber || ']' ELSE '{\"left\": 1, \"other\": ' || l_linenumber || '}' END AS arguments, CAST(CASE WHEN l_linenumber % 3 < 2 THEN 1 ELSE 0 END AS INTEGER) AS repairs FROM lineitem",
)
def ir_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Named operands of two operators as lists, where the names are known."""
    @F.pandas_udf("struct<arguments: string, repairs: int>")
    def repaired(n: pd.Series) -> pd.DataFrame:
        out = []
        for k in n:
            step = [{"op": "subtract", "arguments": {"minuend": 1, "subtrahend": int(k)}}, {"op": "add", "arguments": {"values": [1, int(k)]}}, {"op": "divide", "arguments": {"left": 1, "other": int(k)}}][k % 3]
            program, repairs = ir.unwrap_operands({"steps": [step]})
            out.append((json.dumps(program["steps"][0]["arguments"]), repairs))
        return pd.DataFrame(out, columns=["arguments", "repairs"])

    made = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", repaired("l_linenumber").alias("x"))
    return made.select("l_orderkey", "l_linenumber", "x.arguments", "x.repairs")


@query(
    "ir_gold",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN l_extendedprice ** 2 ELSE (l_extendedprice - 100) / nullif(l_quantity, 0) END AS value, CAST(CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 1 ELSE 2 END AS INTEGER) AS n_steps FROM lineitem",
)
def ir_gold(spark: SparkSession, d: str) -> DataFrame:
    """Flat gold programs over the prices of all line items; one with an unknown operator has no value."""
    price, n = F.format_number("l_extendedprice", 2), F.col("l_linenumber")
    program = F.when(n == 1, F.concat(F.lit("table_max("), price, F.lit(", none)"))).when(n == 2, F.concat(F.lit("exp("), F.col("l_extendedprice"), F.lit(", const_2)"))).otherwise(F.concat(F.lit("subtract("), F.col("l_extendedprice"), F.lit(", const_100), divide(#0, "), F.col("l_quantity"), F.lit(")")))
    got = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ir.gold_steps(program).alias("s"))
    return got.select("l_orderkey", "l_linenumber", F.try_element_at("s", F.lit(-1))["value"].alias("value"), F.when(F.col("s").isNotNull(), F.size("s")).alias("n_steps"))
