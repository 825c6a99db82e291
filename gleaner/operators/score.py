"""Candidates: admissibility, grounded scores, votes, answers, and the metrics of their answers."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleaner.functions import text as T

REASONS = ["execution error", "empty result", "violates_table_candidate_constraint", "missing_required_table_evidence", "missing_target_relation_evidence", "ungrounded output"]


#: Beyond so many pieces of evidence and terms, evidence is looked up in sorted terms, not compared with each.
FEW = 16


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from(values: Column, steps: Column, x: Column) -> Column:
    """The first of the sorted ``values`` that is not less than ``x``, by halving; ``steps`` are the powers of two up to
    their number, the largest first."""
    less = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) < x, n + step).otherwise(n))
    return F.get(values, less)


def _grounded(keyed: Column, terms: Column) -> Column:
    """Those of ``keyed`` with a key that holds a term as a word or lies within one.

    A key lies within a term exactly if it begins the first of the terms' sorted ends that is not less; ends are cut
    at the longest key."""
    longest = F.array_max(F.transform(F.flatten(F.transform(keyed, lambda x: x["keys"])), F.length))
    tails = lambda n: F.flatten(F.transform(terms, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i, n))))
    ends = _once(longest, lambda n: F.array_sort(F.array_distinct(tails(n))))
    steps = lambda xs: F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda step: step <= F.size(xs))
    sorted_ = F.struct(F.array_sort(F.array_distinct(terms)).alias("terms"), ends.alias("ends"))

    def found(b: Column) -> Column:
        within = lambda k: F.startswith(_from(b["ends"], b["end_steps"], k), k)
        word = lambda k: F.exists(F.split(k, " "), lambda w: _from(b["terms"], b["term_steps"], w) == w)
        return F.filter(keyed, lambda x: F.exists(x["keys"], lambda k: within(k) | word(k)))

    return _once(sorted_, lambda x: _once(F.struct(x["terms"].alias("terms"), x["ends"].alias("ends"), steps(x["terms"]).alias("term_steps"), steps(x["ends"]).alias("end_steps")), found))


def direct_evidence(evidence: Column, terms: Column) -> Column:
    """The evidence with an end that equals one of the value's terms (keys), holds it as a word, or lies within
    it (ends without letters or digits never do)."""
    ends = lambda e: F.filter(F.array(T.normalize_key(e["head"]), T.normalize_key(e["tail"])), lambda k: k != "")
    grounds = lambda k: F.exists(terms, lambda t: F.array_contains(F.split(k, " "), t) | F.contains(t, k))
    few = lambda keyed: F.filter(keyed, lambda x: F.exists(x["keys"], grounds))
    many = lambda keyed: _once(F.filter(terms, lambda t: t != ""), lambda ts: _grounded(keyed, ts))
    pick = lambda keyed: F.when(F.least(F.size(evidence), F.size(terms)) <= FEW, few(keyed)).otherwise(many(keyed))
    return F.transform(_once(F.transform(evidence, lambda e: F.struct(e.alias("e"), ends(e).alias("keys"))), pick), lambda x: x["e"])


def score_candidates(candidates: DataFrame, query: str) -> DataFrame:
    """Scores of ``candidate_pos, success, error, value, evidence, accessed, n_steps`` per query, with
    optional columns ``allowed`` (value keys), ``need_table``, ``groups`` (relation terms) and ``terms`` (the
    keys of a value that is a list, see ``text.value_terms``).

    ``evidence`` is an array of ``source_type, source_id, head, relation, tail``.  Evidence is pooled
    over the candidates of one value; rejected candidates score minus infinity with a reason."""
    c = candidates
    for name, default in (("allowed", F.lit(None).cast("array<string>")), ("need_table", F.lit(False)), ("groups", F.array().cast("array<array<string>>")), ("terms", F.filter(F.array(T.normalize_key(F.col("value"))), lambda t: t != ""))):
        if name not in c.columns:
            c = c.withColumn(name, default)
    c = c.withColumn("evidence", F.array_distinct(F.coalesce("evidence", F.array().cast(c.schema["evidence"].dataType))))
    c = c.withColumn("_empty", F.col("value").isNull() | (F.col("value") == "")).withColumn("_valid", F.col("success") & ~F.col("_empty"))
    c = c.withColumn("_direct", F.size(direct_evidence(F.col("evidence"), F.coalesce("terms", F.array().cast("array<string>")))))
    boolean = F.lower("value").isin("true", "false")
    mode = F.when(F.col("_direct") > 0, "direct").when(F.size("evidence") == 0, "none").when(boolean, "derived_boolean").when(T.is_numeric(F.col("value")), "derived_numeric").otherwise("none")
    c = c.withColumn("mode", mode)
    same, all_ = Window.partitionBy(query, "value"), Window.partitionBy(query)
    votes = F.sum(F.col("_valid").cast("int")).over(same) / F.greatest(F.sum(F.col("_valid").cast("int")).over(all_), F.lit(1))
    own = F.when(F.col("_valid") & (F.col("mode") != "none"), F.col("evidence"))
    c = c.withColumn("agreement", votes).withColumn("_pool", F.array_distinct(F.flatten(F.collect_list(own).over(same))))
    has_table = F.exists("evidence", lambda e: e["source_type"] == "table")
    words = lambda e: T.terms(T.normalize_key(e["relation"]))
    on_target = (F.size("groups") == 0) | F.exists("evidence", lambda e: F.exists(F.col("groups"), lambda g: F.size(F.array_except(g, words(e))) == 0))
    reason = (
        F.when(~F.col("success"), REASONS[0])
        .when(F.col("_empty"), REASONS[1])
        .when(F.col("allowed").isNotNull() & (F.size("allowed") > 0) & ~F.array_contains("allowed", T.normalize_key(F.col("value"))), REASONS[2])
        .when(F.col("need_table") & ~has_table, REASONS[3])
        .when(~on_target, REASONS[4])
        .when((F.size("evidence") == 0) | (F.col("mode") == "none"), REASONS[5])
    )
    kinds = F.array_distinct(F.transform("_pool", lambda e: e["source_type"]))
    sources = F.size(F.array_distinct(F.transform("_pool", lambda e: F.struct(e["source_type"], e["source_id"]))))
    triples = F.size(F.array_distinct(F.transform("_pool", lambda e: F.struct(e["head"], e["relation"], e["tail"]))))
    has = lambda k: F.array_contains(kinds, k).cast("int")
    bonus = 2.0 * has("table") + has("text") + 0.25 * has("web") + 1.5 * has("table") * has("text")
    precision = F.when(F.col("mode") == "direct", F.col("_direct") / F.greatest("accessed", F.size("evidence"), F.lit(1))).otherwise(F.lit(0.5))
    total = 4.0 * F.least(sources / 3.0, F.lit(1.0)) + bonus + 1.5 * F.least(triples / 4.0, F.lit(1.0)) + F.col("agreement") + precision - 0.5 * F.col("n_steps")
    c = c.withColumn("reason", reason).withColumn("score", F.when(reason.isNotNull(), F.lit(-math.inf)).otherwise(total))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "candidate_pos"))
    return c.withColumn("place", place).select(query, "candidate_pos", "value", "mode", "agreement", "reason", "score", "place")


def vote(candidates: DataFrame, query: str) -> DataFrame:
    """Plain majority: every valid value with its votes and place."""
    votes = candidates.where("success and value is not null and value <> ''").groupBy(query, "value").agg(F.count("*").alias("votes"), F.min("candidate_pos").alias("first_pos"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("votes"), "first_pos")))


def confidence(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 10)), 4)


def python_number(x: Column) -> Column:
    """A number as text: at least one decimal; with an exponent from 17 digits on and below 0.0001."""
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    powers = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2"), r"E(-?)", "e$1")
    small = (F.abs(x) < 1e-4) & (x != 0)
    return F.when(small, powers).when(F.abs(x) >= 1e16, F.regexp_replace(powers, "e", "e+")).otherwise(plain)


def render(value: Column, number: Column, truth: Column, verbal: Column | None = None) -> Column:
    """An answer as text: truths as yes or no, numbers as they are; a verbal form only where it says the same
    as the value."""
    told = value if verbal is None else F.when(T.normalize_key(verbal) == T.normalize_key(value), verbal).otherwise(value)
    return F.when(truth.isNotNull(), F.when(truth, "yes").otherwise("no")).when(number.isNotNull(), python_number(number)).otherwise(told)


def path_metrics(scored: DataFrame, query: str, evidence: Column, accessed: Column) -> DataFrame:
    """Of the best candidate of every query: completed, steps, evidence, kinds of sources, whether it joins table
    and text, and how much of what it touched is direct."""
    kinds = F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["source_type"])))
    direct = F.size(direct_evidence(evidence, F.filter(F.array(T.normalize_key(F.col("value"))), lambda t: t != "")))
    done = F.col("reason").isNull()
    return scored.where("place = 1").select(query, done.alias("completed"), F.when(done, F.col("n_steps")).otherwise(0).alias("length"), F.when(done, F.size(evidence)).otherwise(0).alias("n_evidence"), F.when(done, F.array_join(kinds, "+")).otherwise("").alias("kinds"), (done & F.array_contains(kinds, "table") & F.array_contains(kinds, "text")).alias("cross_modal"), F.when(done, direct / F.greatest(accessed, F.lit(1))).otherwise(0.0).alias("precision"))


# -- metrics ---------------------------------------------------------------------------------------


def exact_match(prediction: Column, gold: Column) -> Column:
    return (T.normalize_answer(prediction) == T.normalize_answer(gold)).cast("double")


def semantic_match(prediction: Column, gold: Column) -> Column:
    return (T.normalize_entity_answer(prediction) == T.normalize_entity_answer(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 over the multisets of tokens; two empty answers agree."""
    p, g = (F.filter(F.split(T.normalize_answer(x), " "), lambda t: t != "") for x in (prediction, gold))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.array_distinct(g), F.lit(0), lambda a, t: a + F.least(count(g, t), count(p, t)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


@F.pandas_udf(DoubleType())
def rounded_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 where two numbers agree when both are rounded half to even at five places."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else float(round(x, 5) == round(y, 5)) for x, y in zip(a, b)], dtype="float64")


def _near(a: Column, b: Column) -> Column:
    """Equal to five places, up to the last half."""
    return F.abs(a - b) < 5e-6


def execution_match(prediction: Column, gold: Column) -> Column:
    """Agreement of the last numbers to five places, or of yes and no."""
    word = F.lower(F.trim(gold))
    said = F.regexp_replace(F.lower(F.trim(prediction)), "[.! ]+$", "")
    return F.coalesce(F.when(word.isin("yes", "no"), said == word).otherwise(_near(T.last_number(prediction), T.last_number(gold))), F.lit(False)).cast("double")


def ratio_equal(prediction: Column, gold: Column) -> Column:
    """Two numbers agree as they are or a hundred times apart."""
    return F.coalesce(_near(prediction, gold) | _near(prediction / 100, gold) | _near(prediction, gold / 100), F.lit(False))


def ratio_match(prediction: Column, gold: Column) -> Column:
    """``execution_match``, or last numbers a hundred times apart."""
    return F.greatest(execution_match(prediction, gold), ratio_equal(T.last_number(prediction), T.last_number(gold)).cast("double"))


def close(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def denotation_match(prediction: Column, gold: Column, scaled: bool = False) -> Column:
    """Two arrays of texts: single numbers agree within tolerance (``scaled`` also a hundred times apart), all
    else as sorted normalised answers."""
    sorted_ = lambda xs: F.array_sort(F.transform(xs, T.normalize_answer))
    p, g = T.last_number(F.get(prediction, F.lit(0))), T.last_number(F.get(gold, F.lit(0)))
    numbers = (F.size(prediction) == 1) & (F.size(gold) == 1) & p.isNotNull() & g.isNotNull()
    near = close(p, g) | (close(p / 100, g) | close(p, g / 100) if scaled else F.lit(False))
    return F.coalesce(F.when(numbers, near).otherwise(sorted_(prediction) == sorted_(gold)), F.lit(False)).cast("double")


def evidence_id(source_type: Column, row_index: Column, source_id: Column) -> Column:
    """Evidence named as data sets name it: ``table_`` and the row from one, ``text_`` and the number of a
    ``:text:`` or ``:pre:`` source; null for all else."""
    number = F.regexp_extract(source_id, r":(?:pre|text):(\d+)$", 1)
    return F.when((source_type == "table") & row_index.isNotNull(), F.concat(F.lit("table_"), row_index + 1)).when(number != "", F.concat(F.lit("text_"), number))


def grounding(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """Precision and recall of evidence ids; null without gold, precision 0 without predictions."""
    p, g = F.array_distinct(F.array_compact(F.coalesce(predicted, F.array().cast("array<string>")))), F.array_distinct(gold)
    hits, some = F.size(F.array_intersect(p, g)), F.size(g) > 0
    return F.when(some, F.when(F.size(p) > 0, hits / F.size(p)).otherwise(0.0)), F.when(some, hits / F.size(g))


#: Operators that count as arithmetic when programs are compared.
ARITHMETIC = ["add", "subtract", "multiply", "divide", "exp", "greater", "table_sum", "table_average", "table_max", "table_min"]


def program_metrics(steps: Column, result: Column, gold: Column, question: Column) -> Column:
    """``struct(operator_accuracy, step_accuracy, strict_operator_accuracy, strict_step_accuracy, aligned_steps,
    level)`` of predicted ``struct(id, op, value)`` steps against gold ``struct(operator, value, truth)`` steps.

    Lookups and constants don't count; steps are compared in order, the longer list is the base.  A final
    average may stand for a gold program that ends in a division when the question asks for an average; then
    only its value counts.  Truths have no number and never agree as steps.  All null without either side."""
    own = F.filter(steps, lambda s: s["op"].isin(ARITHMETIC))
    last = F.try_element_at(gold, F.lit(-1))
    final = F.get(F.filter(steps, lambda s: s["id"] == result), F.lit(0))
    number = lambda g: F.when(g["truth"].isNull(), g["value"])
    macro = F.coalesce(F.contains(F.lower(question), F.lit("average")) & (final["op"] == "table_average") & (last["operator"] == "divide"), F.lit(False))
    right = ratio_equal(final["value"], number(last)).cast("double")
    pairs = F.slice(F.arrays_zip(own.alias("p"), gold.alias("g")), 1, F.least(F.size(own), F.size(gold)))
    same = F.filter(pairs, lambda z: z["p"]["op"] == z["g"]["operator"])
    valued = F.filter(same, lambda z: ratio_equal(z["p"]["value"], number(z["g"])))
    base = F.greatest(F.size(own), F.size(gold))
    some = F.least(F.size(own), F.size(gold)) > 0
    share = lambda xs: F.when(some, F.size(xs) / base).otherwise(0.0)
    strict = lambda x: F.when(macro, 0.0).when(some, x)
    return F.when(
        steps.isNotNull() & gold.isNotNull(),
        F.struct(
            F.when(macro, right).otherwise(share(same)).alias("operator_accuracy"),
            F.when(macro, right).otherwise(share(valued)).alias("step_accuracy"),
            strict(share(same)).alias("strict_operator_accuracy"),
            strict(share(valued)).alias("strict_step_accuracy"),
            F.when(macro, 1).otherwise(F.least(F.size(own), F.size(gold))).alias("aligned_steps"),
            F.when(macro, "semantic_macro").when(some, "exact_steps").alias("level"),
        ),
    )


def error_category(failed: Column, error: Column, execution: Column, schema_rate: Column, success_rate: Column, precision: Column, recall: Column, operators: Column, path: Column) -> Column:
    """Why an answer is wrong: the first of an ordered list of kinds that fits; null for a right one."""
    text = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(failed & text.rlike("json|decode"), "serialization_schema")
        .when(failed, "pipeline_failure")
        .when(execution == 1, F.lit(None).cast("string"))
        .when(schema_rate == 0, "serialization_schema")
        .when(success_rate == 0, "arithmetic_execution")
        .when(precision < 1, "grounding")
        .when((recall < 1) & (operators < 1), "operand_or_operator_selection")
        .when(recall < 1, "operand_selection")
        .when(operators < 1, "operator_selection")
        .when((path == 1) & (execution == 0), "answer_rendering")
        .when(execution == 0, "unit_scale_or_unclassified")
    )


def record_metrics(records: DataFrame) -> DataFrame:
    """``records`` (``dataset, gold, answer, executed``) with the metrics of their data set, null for others;
    those of ``executed`` values also where nothing was executed."""
    one = lambda c: F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.array(c))
    gold, answer, executed = F.col("gold"), F.col("answer"), F.col("executed")
    of = lambda name, x: F.when(F.col("dataset") == name, x)
    ran = lambda x: F.when(executed.isNotNull(), x)
    return records.select(
        *records.columns,
        of("hybridqa", exact_match(answer, gold)).alias("exact_match"),
        of("hybridqa", semantic_match(answer, gold)).alias("semantic_exact_match"),
        of("hybridqa", token_f1(answer, gold)).alias("f1"),
        of("hybridqa", ran(exact_match(executed, gold))).alias("execution_exact_match"),
        of("finqa", execution_match(answer, gold)).alias("official_execution_accuracy"),
        of("finqa", ratio_match(answer, gold)).alias("execution_accuracy"),
        of("finqa", ran(ratio_match(executed, gold))).alias("path_execution_accuracy"),
        of("hitab", denotation_match(one(answer), one(gold))).alias("official_denotation_accuracy"),
        of("hitab", denotation_match(one(answer), one(gold), scaled=True)).alias("denotation_accuracy"),
        of("hitab", ran(denotation_match(one(executed), one(gold), scaled=True))).alias("path_denotation_accuracy"),
    )
