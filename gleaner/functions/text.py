"""Text functions as columns: keys, relations, tokens, literals, numbers, question intent.

All but the ones that end in ``_exact`` and the similarity are native expressions.  Null in, null out,
unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Aliases and canonical names of relations and entities.
RELATION_ALIASES = {
    "has_nationality": "nationality",
    "country_of_citizenship": "nationality",
    "date_of_birth": "birth_date",
    "birthdate": "birth_date",
    "born_on": "birth_date",
    "current_profession": "current_occupation",
    "former_profession": "former_occupation",
    "head_coach_in": "coached_in",
    "manages_from": "tenure_start",
    "managed_from": "tenure_start",
    "started": "tenure_start",
    "from": "tenure_start",
    "manages_to": "tenure_end",
    "managed_to": "tenure_end",
    "managed_until": "tenure_end",
    "ended": "tenure_end",
    "to": "tenure_end",
}
CANONICAL_RELATIONS = ["birth_date", "coached_in", "current_occupation", "former_occupation", "name", "nationality", "occupation", "tenure_end", "tenure_start"]
ENTITY_ALIASES = {
    "bac ho": "Hồ Chí Minh",
    "ho chi minh": "Hồ Chí Minh",
    "moroccan": "Morocco",
    "u s": "United States",
    "u s a": "United States",
    "usa": "United States",
    "united states of america": "United States",
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
ENTITY_COLUMNS = ["player", "person", "name", "manager", "team", "club", "entity"]
ANSWER_COLUMNS = ["jurisdiction", "country", "city", "state", "province", "region", "company", "organization", "team", "club", "player", "person", "name"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: How the first and the last number of a text are read.
FIRST_NUMBER = r"[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"
LAST_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"


@lru_cache(1)
def _fold_letters() -> tuple[str, str]:
    """For ``translate``: letters whose decomposition is one letter and marks, and that letter."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).casefold()
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def normalize_key(text: Column) -> Column:
    """Accents and case folded, runs of other than letters, digits and ``_`` as one space.

    Native; letters that fold to several (but for ``ß``) keep their form, see the exact version."""
    x = F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_fold_letters())
    x = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "))


def _key(value: str | None) -> str | None:
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.strip()) if not unicodedata.combining(c))
    return re.sub(r"[^\w]+", " ", plain.casefold()).strip()


@F.pandas_udf(StringType())
def normalize_key_exact(text: pd.Series) -> pd.Series:
    """The key of any Unicode text; use it on distinct values."""
    return text.map(_key, na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks similarity in [0, 1]; use it on distinct pairs."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def relation_key(text: Column) -> Column:
    """Camel case and other separators as ``_``, lower case, known aliases replaced."""
    x = F.regexp_replace(F.trim(text), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    x = F.lower(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(_lookup(x, RELATION_ALIASES), x)


@F.pandas_udf(StringType())
def _nearest_relation(key: pd.Series) -> pd.Series:
    def best(k: str) -> str:
        if k in CANONICAL_RELATIONS:
            return k
        score, name = max((SequenceMatcher(None, k, c).ratio(), c) for c in CANONICAL_RELATIONS)
        return name if score >= 0.9 else k

    return key.map(best, na_action="ignore")


def normalize_relations(df, column: str, out: str):
    """``df`` with the canonical relation of ``column``: the fuzzy step runs on distinct keys only,
    which come back by a join."""
    rows = df.withColumn("_rk", relation_key(F.col(column)))
    names = rows.select("_rk").where("_rk is not null").distinct().withColumn(out, _nearest_relation("_rk"))
    return rows.join(names, "_rk", "left").drop("_rk")


def entity_core(key: Column) -> Column:
    """A key without one leading and one trailing club designator."""
    return F.regexp_replace(F.regexp_replace(key, r"^club(?: |$)", ""), r"(?:^| )(?:fc|cf|f c|c f|football club|futbol club)$", "")


def display_score(text: Column) -> Column:
    """How good a name is to show: other than ASCII characters, length, capitals; compare as a whole."""
    others = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return F.struct(others.alias("others"), F.length(text).alias("size"), F.length(F.regexp_replace(text, r"\P{Lu}", "")).alias("capitals"))


def is_literal(text: Column) -> Column:
    """A date or plain number, not a name."""
    return F.trim(text).rlike(r"^[\d\s:./-]+$") | normalize_key(text).rlike(r"\b(?:" + "|".join(MONTHS) + r")\b")


def looks_literal(text: Column) -> Column:
    """Like ``is_literal``, also amounts and percentages."""
    return F.trim(text).rlike(r"^[\d\s:./,%$-]+$") | F.lower(text).rlike(r"\b(?:" + "|".join(MONTHS) + r")\b")


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """The distinct terms of letters and digits; with stop words also without one-letter terms."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))
    if stopwords is None:
        return found
    return F.array_except(F.filter(found, lambda t: F.length(t) > 1), F.array(*[F.lit(w) for w in stopwords]).cast("array<string>"))


def number(text: Column) -> Column:
    """The first number of a text: thousands commas, exponents; positive ones in parentheses are
    negative; null without a number."""
    x = F.replace(F.trim(text), F.lit("$"), F.lit(""))
    n = F.regexp_replace(F.regexp_extract(x, FIRST_NUMBER, 0), ",", "").try_cast("double")
    return F.when(F.contains(x, F.lit("(")) & F.contains(x, F.lit(")")) & (n > 0), -n).otherwise(n)


def last_number(text: Column) -> Column:
    """The last number of a text, without a sign rule for parentheses."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(text, F.lit(LAST_NUMBER), F.lit(0)), F.lit(-1)), ",", "").try_cast("double")


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and repeated spaces."""
    x = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(?:a|an|the)\b", " "), r"(?U)\s+", " "))


def normalize_entity_answer(text: Column) -> Column:
    """``normalize_answer`` of the name an alias stands for."""
    return normalize_answer(F.coalesce(_lookup(normalize_key(text), ENTITY_ALIASES), text))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def literal_key(text: Column) -> Column:
    """What two literals must share to be the same cell."""
    return F.regexp_replace(F.lower(clean(text)), r"\s+%", "%")


def question_literals(question: Column) -> Column:
    """Percentages, dollar amounts and years of a question, in this order, each once."""
    rules = [r"\b\d+(?:\.\d+)?\s*%", r"(?<![\w.])\$\s*\d+(?:[,.]\d+)*(?:\s*(?:(?i)million|billion|thousand))?", r"\b(?:19|20)\d{2}\b"]
    found = F.concat(*[F.regexp_extract_all(question, F.lit(r), F.lit(0)) for r in rules])
    return F.array_distinct(F.transform(found, clean))


def rank_constraint(question: Column) -> Column:
    """The rank a question names: the least ordinal word, else the first number with an ending."""
    x = F.lower(question)
    words = [F.when(x.rlike(rf"\b{w}\b"), str(i + 1)) for i, w in enumerate(ORDINALS)]
    return F.coalesce(*words, F.nullif(F.regexp_extract(x, r"\b(\d+)(?:st|nd|rd|th)\b", 1), F.lit("")))


def _first_rule(x: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(x.rlike(rule), out) for rule, out in rules])


def target_attribute(question: Column) -> Column:
    """The attribute a question asks for, by the first rule that fits; null if none does."""
    rules = [("middle name", "middle_name"), ("full name", "full_name"), ("nationality", "nationality"), ("born", "birth_date"), ("place of birth", "place_of_birth"), ("where", "location"), (r"\bwho\b", "person")]
    return _first_rule(F.lower(question), rules)


def entity_type(question: Column) -> Column:
    rules = [("player", "person"), ("manager", "person"), ("person", "person"), ("team", "team"), ("club", "club"), ("city", "location"), ("country", "location")]
    return _first_rule(F.lower(question), rules)


def direct_mentions(question: Column) -> Column:
    """Runs of two or more capitalised words of two letters or more, in order, repeats included."""
    return F.regexp_extract_all(question, F.lit(r"(?U)\b[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)+\b"), F.lit(0))


def row_entity(cells: Column) -> Column:
    """The entity of a row of ``struct(col_index, column_name, value)`` cells: the first non-blank cell of an
    entity column, else the first that is no rank; null if there is none."""
    name = lambda c: F.lower(c["column_name"])
    kept = F.filter(F.array_sort(cells), lambda c: clean(c["value"]) != "")
    named = F.filter(kept, lambda c: name(c).rlike("|".join(ENTITY_COLUMNS)))
    other = F.filter(kept, lambda c: ~F.contains(name(c), F.lit("rank")))
    return clean(F.coalesce(F.get(named, F.lit(0)), F.get(other, F.lit(0)))["value"])


def answer_column(cells: Column, question: Column) -> Column:
    """The column of a row that should hold the answer: the first entity-like column that the question names,
    else the first entity-like one, else the first."""
    names = F.transform(F.array_sort(cells), lambda c: clean(c["column_name"]))
    fit = F.filter(names, lambda n: F.lower(n).rlike("|".join(ANSWER_COLUMNS)))
    asked = F.filter(fit, lambda n: F.contains(F.lower(question), F.lower(n)))
    return F.coalesce(F.get(asked, F.lit(0)), F.get(fit, F.lit(0)), F.get(names, F.lit(0)))


def requests_column(question: Column, column: Column) -> Column:
    """Whether a which, what or who question names the column as a whole word."""
    x, key = F.lower(question), F.lower(clean(column))
    named = F.regexp_like(x, F.concat(F.lit(r"\b\Q"), key, F.lit(r"\E\b")))
    return x.rlike(r"\b(?:which|what|who)\b") & (key != "") & named


def operation_intent(question: Column, relations: Column) -> Column:
    """The operators a question prefers, given the relations at hand; in rule order, each once."""
    t = F.array_join(F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")
    has = lambda *words: t.rlike("|".join(words))
    combined = F.concat(F.lit(" "), t).rlike(" combined") | has("together")
    share = has("proportion", "percent")
    percent_cells = F.exists(relations, lambda r: r.rlike("percent"))
    years = has(r"\bfrom\s+20\d{2}\s+to\s+20\d{2}\b")
    rules = [
        (combined & share & percent_cells, "add"),
        (has("average"), "table_average"),
        (has("highest", "largest", "most "), "argmax"),
        (has("lowest", "smallest", "least "), "argmin"),
        (has(r"\btop\s+\d+\b"), "topk_argmax"),
        (has(r"\b(?:second|third|fourth)\s+(?:largest|highest)\b"), "kth_argmax"),
        (has(r"\b(?:second|third|fourth)\s+(?:smallest|lowest)\b"), "kth_argmin"),
        (has("range"), "range"),
        (has(r"\bhow many\b") & has("reported", "countries", "provinces", "territories", "groups"), "count"),
        (has("difference", "increase", "decline", "decrease"), "subtract"),
        (has("outperform", "greater than", "higher than"), "greater"),
        (share & ~combined, "divide"),
        (has("interest") & years & F.array_contains(relations, "annual_interest_amount"), "multiply"),
        (has("sum") | combined & ~share, "add"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, op) for rule, op in rules])))


def operation_constraints(question: Column, relations: Column) -> Column:
    """What a program for a question must heed, as codes in rule order; ``interest_years=n`` tells the length
    of the period in years, both ends included."""
    t = F.array_join(F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")
    combined = F.concat(F.lit(" "), t).rlike(" combined|together")
    share = t.rlike("proportion|percent")
    ends = [F.regexp_extract(t, r"\bfrom\s+(20\d{2})\s+to\s+(20\d{2})\b", i) for i in (1, 2)]
    rules = [
        (combined & share & F.exists(relations, lambda r: r.rlike("percent")), F.lit("add_displayed_shares")),
        (t.rlike("average"), F.lit("average_of_displayed_values")),
        (t.rlike("range"), F.lit("range_is_greatest_then_least")),
        (t.rlike("outperform|greater than|higher than"), F.lit("compare_both_values")),
        (share & ~combined, F.lit("share_needs_both_parts")),
        (t.rlike("interest") & (ends[0] != "") & F.array_contains(relations, "annual_interest_amount"), F.concat(F.lit("interest_years="), (ends[1].try_cast("int") - ends[0].try_cast("int") + 1).cast("string"))),
        (t.rlike(r"\bfrom\b.+\bto\b"), F.lit("change_is_last_less_first")),
        (t.rlike("total"), F.lit("total_may_name_a_row")),
    ]
    return F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules]))


def format_intent(operators: Column, constraints: Column) -> Column:
    """Operators and constraints of a question as one line, for a prompt."""
    listed = F.when(F.size(operators) > 0, F.array_join(operators, ", ")).otherwise("any")
    return F.when((F.size(operators) == 0) & (F.size(constraints) == 0), "no constraint").otherwise(F.concat(F.lit("operators: "), listed, F.lit("; heed: "), F.array_join(constraints, ", ")))


def query_expansions(question: Column, headers: Column) -> Column:
    """Extra retrieval queries of a question, and up to twenty headers as one more."""
    x = F.lower(question)
    rules = [
        F.when(x.rlike("interest"), "interest amount expense payable annually per year"),
        F.when(x.rlike("percent|ratio"), "percentage ratio total amount"),
        F.when(x.rlike(r"\b(?:19|20)\d{2}\b"), "annual annually year period from to"),
        F.nullif(F.array_join(F.slice(headers, 1, 20), " "), F.lit("")),
    ]
    return F.array_compact(F.array(*rules))


def relation_groups(question: Column) -> Column:
    """Term groups of which a supporting relation must hold one entirely; empty if any relation does."""
    t = normalize_key(F.coalesce(question, F.lit("")))
    group = lambda *gs: F.array(*[F.array(*[F.lit(w) for w in g.split()]) for g in gs])
    rules = [("middle name", group("middle name", "full name")), ("most populous city", group("most populous city")), ("nationality", group("nationality")), ("place of birth", group("place birth", "born in"))]
    return F.coalesce(*[F.when(F.contains(t, F.lit(k)), g) for k, g in rules], F.array().cast("array<array<string>>"))


def answer_shape(question: Column) -> Column:
    """The form an answer should have: year, date, count or short."""
    x = F.lower(question)
    return F.when(x.rlike("what year|which year"), "year").when(x.rlike(r"\bwhen\b"), "date").when(x.rlike("how many|how much"), "count").otherwise("short")


def value_key(values: Column) -> Column:
    """One text for equal lists of values, whatever their order."""
    return F.to_json(F.array_sort(values))


def _flat(value) -> set[str]:
    if isinstance(value, (list, dict)):
        return {t for x in (value.values() if isinstance(value, dict) else value) for t in _flat(x)}
    key = _key(str(value))
    return {key} if key else set()


@F.pandas_udf(ArrayType(StringType()))
def value_terms(value: pd.Series) -> pd.Series:
    """The sorted keys of all scalars in a JSON value, however deep; a text that is no JSON is one scalar."""
    import json

    def terms_of(x: str) -> list[str]:
        try:
            return sorted(_flat(json.loads(x)))
        except ValueError:
            return sorted(_flat(x))

    return value.map(terms_of, na_action="ignore")


def is_numeric(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(text, F.lit(","), F.lit(""))), r"%+$", "").try_cast("double").isNotNull()


def program_operators(program: Column) -> Column:
    return F.regexp_extract_all(program, F.lit(r"([A-Za-z_]+)\s*\("), F.lit(1))


def strip_fence(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parse_json_list(text: str | None) -> list | None:
    """The first JSON list in a text; null where there is none or it breaks off."""
    import json

    if text is None:
        return None
    at = text.find("[")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(text[at:])
            return found
        except ValueError:
            at = text.find("[", at + 1)
    return None


@F.pandas_udf(StringType())
def json_list(text: pd.Series) -> pd.Series:
    """The first JSON list of a text, as JSON."""
    import json

    return text.map(lambda x: None if (v := parse_json_list(x)) is None else json.dumps(v, ensure_ascii=False), na_action="ignore")
