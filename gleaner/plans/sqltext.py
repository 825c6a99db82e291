"""SQL expressions that several queries state their results with; written apart from the operators."""

from __future__ import annotations

from gleaner.functions import text as T

WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
#: Superscripts that are plain digits to a key.
_RAISED, _PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def key(x: str) -> str:
    """A name without accents, case and punctuation."""
    plain = f"translate({x}, {quoted(_WIDE + _RAISED)}, {quoted(_NARROW + _PLAIN)})"
    return rf"trim(regexp_replace(replace(lower(strip_accents({plain})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def case(x: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def relation(x: str) -> str:
    """A relation as its key, aliases replaced."""
    snake = rf"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim({x}, ' '), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g')), '^_+', ''), '_+$', '')"
    return case(snake, T.RELATION_ALIASES, snake)


def answer(x: str) -> str:
    """An answer without case, punctuation, articles and repeated spaces."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(?:a|an|the)\b', ' ', 'g'), '{WHITE}', ' ', 'g'), ' ')"


def number(x: str) -> str:
    """The first number of a text, negative in parentheses."""
    text = f"replace(trim({x}, ' '), '$', '')"
    n = rf"try_cast(replace(regexp_extract({text}, '[-+]?([0-9]+(,[0-9][0-9][0-9])*([.][0-9]+)?|[.][0-9]+)([eE][-+]?[0-9]+)?'), ',', '') AS DOUBLE)"
    return f"(CASE WHEN contains({text}, '(') AND contains({text}, ')') AND {n} > 0 THEN -{n} ELSE {n} END)"


def last_number(x: str) -> str:
    """The last run of digits and commas of a text, with its sign and decimals."""
    return rf"try_cast(replace(list_extract(regexp_extract_all({x}, '[-+]?[0-9][0-9,]*(?:[.][0-9]+)?'), -1), ',', '') AS DOUBLE)"


def entity_answer(x: str) -> str:
    return answer("(" + case(key(x), T.ENTITY_ALIASES, x) + ")")


def terms(x: str) -> str:
    """The distinct terms of letters and digits."""
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def shown(x: str) -> str:
    """How good a name is to show, as a list that compares as a whole."""
    return rf"[length({x}) - length(regexp_replace({x}, '[^\x00-\x7f]', '', 'g')), length({x}), length(regexp_replace({x}, '\P{{Lu}}', '', 'g'))]"


def canonical_relations(table: str) -> str:
    """A common table ``rel (relation, canonical)`` of all relations of ``table``: aliases replaced, then the
    canonical name with nine tenths of its letters in common, if there is one."""
    names = "[" + ", ".join(map(quoted, T.CANONICAL_RELATIONS)) + "]"
    near = f"list_sort([{{'r': 2.0 * (greatest(length(k), length(c)) - levenshtein(k, c)) / (length(k) + length(c)), 'n': c}} FOR c IN {names}])[-1]"
    return f"rel AS (SELECT relation, CASE WHEN list_contains({names}, k) THEN k WHEN b.r >= 0.9 THEN b.n ELSE k END AS canonical FROM (SELECT relation, k, {near} AS b FROM (SELECT DISTINCT relation, {relation('relation')} AS k FROM {table} WHERE relation IS NOT NULL)))"
