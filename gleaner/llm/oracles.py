"""The same results in SQL, for the queries that SQL can express on whole tables."""

from __future__ import annotations

from gleaner.llm import leakage, sampling
from gleaner.llm.lookalike import default_table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(column: str) -> str:
    """Look-alike characters in one form: single characters by ``translate``, the rest by composition."""
    table = default_table()
    kept = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    gone = "".join(k for k, v in table.items() if len(k) == 1 and not v)
    out = f"translate({column}, {_quoted(''.join(kept) + gone)}, {_quoted(''.join(kept.values()))})"
    for key, value in table.items():
        if len(key) == 1 and len(value) > 1:
            out = f"replace({out}, {_quoted(key)}, {_quoted(value)})"
    return f"nfc_normalize({out})"


def _words(column: str) -> str:
    return rf"array_to_string(regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), ' ')"


def _cue(rule: str, name: str) -> str:
    return f"CASE WHEN regexp_matches(lower(coalesce(question, '')), {_quoted(rule)}) THEN '{name}' END"


_STRIP = r"regexp_replace(answer_text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_PASSAGE = "list_filter(list_transform(list_filter(answer_node, lambda n: n.node_source = 'passage' AND n.entity IS NOT NULL), lambda n: " + _words("n.entity") + "), lambda w: w <> '')"
_ATTRIBUTES = f"""q AS (SELECT DISTINCT ON (question_id) * FROM sample_hybridqa WHERE question_id IS NOT NULL AND answer_text IS NOT NULL AND {_STRIP} <> '' ORDER BY question_id, ingested_at DESC),
b AS (SELECT *, list_distinct(list_transform(coalesce(answer_node, []), lambda n: coalesce(n.node_source, 'None'))) AS k, coalesce({_PASSAGE}, []) AS bridges, {_words("coalesce(question, '')")} AS asked FROM q),
a AS (SELECT question_id, CASE WHEN regexp_full_match(regexp_replace(regexp_replace(replace({_STRIP}, ',', ''), '\\.', ''), '-', ''), '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+') THEN 'numeric' ELSE 'text' END AS answer_kind,
CASE WHEN k = ['passage'] THEN 'passage' WHEN k = ['table'] THEN 'table' WHEN len(k) = 2 AND list_contains(k, 'passage') AND list_contains(k, 'table') THEN 'mixed' ELSE 'unknown' END AS answer_source,
CASE WHEN len(bridges) = 0 THEN 'table_answer' WHEN len(list_filter(bridges, lambda w: contains(asked, w))) > 0 THEN 'bridge_mentioned' ELSE 'table_to_text_likely' END AS cross_modal_proxy,
coalesce(nullif(concat_ws('+', {_cue(sampling.ORDINAL, 'ordinal')}, {_cue(sampling.SUPERLATIVE, 'superlative')}, {_cue(sampling.COMPARISON, 'comparison_or_count')}), ''), 'other') AS reasoning_cues FROM b),
c AS (SELECT strat_name, array_to_string(list_transform(string_split(strat_name, '|'), lambda s: CASE s WHEN 'answer_kind' THEN answer_kind WHEN 'answer_source' THEN answer_source WHEN 'cross_modal_proxy' THEN cross_modal_proxy WHEN 'reasoning_cues' THEN reasoning_cues END), '|') AS category, count(*) AS available FROM a, (SELECT DISTINCT strat_name FROM sample_target) GROUP BY ALL),
r AS (SELECT t.*, greatest(target_share * sample_rows, min_rows) AS wanted, coalesce(available, 0) AS available FROM sample_target t LEFT JOIN c USING (strat_name, category))"""

P3_FOUND = f"WITH {_ATTRIBUTES} SELECT plan_id, category FROM r WHERE available < wanted"
P3_REPORT = f"""WITH {_ATTRIBUTES}, e AS (SELECT *, target_share * sample_rows AS x, floor(target_share * sample_rows + 1e-9) AS f FROM r),
n AS (SELECT *, round(sum(x) OVER p) - sum(f) OVER p AS rest, row_number() OVER (PARTITION BY plan_id ORDER BY x - f DESC, strat_name, category) AS place FROM e WINDOW p AS (PARTITION BY plan_id))
SELECT plan_id, strat_name, category, wanted, CAST(greatest(f + CASE WHEN place <= rest THEN 1 ELSE 0 END, min_rows) AS BIGINT) AS n_target, CAST(available AS BIGINT) AS available, least(CAST(greatest(f + CASE WHEN place <= rest THEN 1 ELSE 0 END, min_rows) AS BIGINT), CAST(available AS BIGINT)) AS n_sampled, greatest(wanted - available, 0.0) AS deficit FROM n"""

P3_DRAWN = f"SELECT plan_id, category, n_sampled AS n, n_sampled AS n_different, n_sampled AS n_of_category FROM ({P3_REPORT}) WHERE n_sampled > 0"

P4_FOUND = f"""WITH t AS (SELECT triple_id, question_id, head, relation, tail, {plain("head")} AS h, {plain("relation")} AS r, {plain("tail")} AS t FROM triple)
SELECT a.triple_id AS triple_id_1, b.triple_id AS triple_id_2 FROM t a JOIN t b ON a.question_id = b.question_id AND a.h = b.h AND a.r = b.r AND a.t = b.t AND a.triple_id < b.triple_id WHERE a.head <> b.head OR a.relation <> b.relation OR a.tail <> b.tail"""

P4_CANONICAL = f"SELECT triple_id, {plain('head')} AS head, {plain('relation')} AS relation, {plain('tail')} AS tail FROM triple"

P5_FOUND = r"""WITH x AS (SELECT question_id, split, regexp_replace(regexp_replace(lower(strip_accents(url_decode(table_id))), '[\s\p{Z}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM sample_hybridqa),
y AS (SELECT question_id, split, regexp_replace(regexp_replace(x, '^\.?/*(tables/+)+_*', ''), '_*\.json$', '') AS x FROM x WHERE x <> ''),
p AS (SELECT question_id, split, CASE WHEN regexp_full_match(x, '.+_[0-9]+') THEN regexp_extract(x, '^(.+)_([0-9]+)$', 1) ELSE x END AS page FROM y)
SELECT DISTINCT question_id FROM p JOIN (SELECT page FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1) USING (page) WHERE split IS NOT NULL"""

P5_BALANCE = "SELECT split, true AS share_met, true AS labels_even, CAST(0 AS BIGINT) AS n_divided FROM split_target"

_LISTED = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
P7_FOUND = f"""WITH d AS (SELECT doc_id, {_LISTED.format(plain("text"))} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_LISTED.format(plain("text"))} AS w FROM eval_item),
dg AS (SELECT doc_id, array_to_string(w[i:i + 13], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 14)),
eg AS (SELECT item_id, array_to_string(w[i:i + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 12)) AS i FROM e WHERE len(w) >= 14))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""



def _p7_overlaps() -> str:
    """All windows of both sides, joined on the words each mask leaves, and the sums of each diagonal."""
    masks = leakage.masks_of(leakage.WINDOW, leakage.MISSES)
    kept = lambda m: ", ".join(f"w[i + {k}]" for k, one in enumerate(m) if one == "1")
    sides = [f"{n} AS (SELECT {key}, i, w[i:i + 13] AS w, m, CASE m " + " ".join(f"WHEN {k} THEN concat_ws(' ', {kept(m)})" for k, m in enumerate(masks)) + f" END AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 12)) AS i FROM {src} WHERE len(w) >= 14), range(0, {len(masks)}) r(m))" for n, key, src in (("dg", "doc_id", "d"), ("eg", "item_id", "e"))]
    return f"""WITH d AS (SELECT doc_id, {_LISTED.format(plain("text"))} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_LISTED.format(plain("text"))} AS w FROM eval_item),
{", ".join(sides)},
h AS (SELECT DISTINCT doc_id, item_id, dg.i AS a, eg.i AS b, list_transform(list_zip(dg.w, eg.w), lambda p: p[1] = p[2]) AS q FROM dg JOIN eg USING (m, g)),
v AS (SELECT *, len(list_filter(q, lambda x: x)) AS n FROM h WHERE len(list_filter(q, lambda x: x)) >= 12),
c AS (SELECT doc_id, item_id, a - b AS line, a + k - 1 AS p, bool_or(q[k]) AS same, bool_or(n = 14) AS exact FROM v, range(1, 15) s(k) GROUP BY ALL),
l AS (SELECT doc_id, item_id, line, CAST(count(*) FILTER (same) AS INTEGER) AS n_equal, CAST(count(*) AS INTEGER) AS n_words, bool_or(exact) AS exact FROM c GROUP BY ALL),
x AS (SELECT *, bool_or(exact) OVER (PARTITION BY doc_id, item_id) AS any_exact, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words DESC) AS r FROM l)
SELECT doc_id, item_id, n_equal, n_words, any_exact AS exact FROM x WHERE r = 1"""


P7_OVERLAPS = _p7_overlaps()

SQL = {"p3_found": P3_FOUND, "p3_report": P3_REPORT, "p3_drawn": P3_DRAWN, "p4_found": P4_FOUND, "p4_canonical": P4_CANONICAL, "p5_found": P5_FOUND, "p5_balance": P5_BALANCE, "p7_found": P7_FOUND, "p7_overlaps": P7_OVERLAPS}
