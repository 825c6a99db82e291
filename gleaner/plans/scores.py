"""Queries over retrieval, scoring and metrics, on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import ir
from gleaner.operators import retrieval as R
from gleaner.operators import score as S
from gleaner.plans import sqltext as Z
from gleaner.plans.graphs import Q, edges
from gleaner.plans.registry import query
from gleaner.session import table
from gleaner.sources import sinks

_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
_BM25 = f"""tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{_WS}')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{_WS}')) AS term FROM eval_item) WHERE term <> '' GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _best(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return R.bm25_top_k(table(spark, d, "eval_item"), "item_id", "text", docs, "doc_id", "text", k)


@query("bm25_topk", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM sc) WHERE r <= 3")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of every evaluation item."""
    return _best(spark, d, 3).select("item_id", "doc_id", F.round("score", 4).alias("score"))


_BOUNDED = """WITH RECURSIVE o AS (SELECT source_id, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS i FROM documents WHERE source_id IS NOT NULL),
r AS (SELECT source_id, 0 AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT source_id FROM o) UNION ALL SELECT o.source_id, CAST(o.i AS INTEGER), CASE WHEN used + n <= 2000 THEN used + n ELSE used END, CASE WHEN used + n <= 2000 THEN o.doc_id END FROM r JOIN o ON o.source_id = r.source_id AND o.i = r.i + 1)
SELECT source_id, doc_id FROM r WHERE doc_id IS NOT NULL"""


@query("bounded_context", _BOUNDED)
def bounded_context(spark: SparkSession, d: str) -> DataFrame:
    """Which documents of each source fit a budget of characters when the others are skipped."""
    rows = table(spark, d, "documents").where("source_id is not null").groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))).alias("x"))
    kept = R.greedy_budget(F.transform("x", lambda r: F.coalesce(r["n_chars"], F.lit(0))), 2000)
    return rows.select("source_id", F.inline(F.transform(kept, lambda i: F.get(F.col("x"), i)))).select("source_id", "doc_id")


@query("prefix_context", "SELECT source_id, doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE source_id IS NOT NULL) WHERE used <= 2000")
def prefix_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source_id is not null")
    return R.prefix_budget(rows, ["source_id"], "doc_id", F.col("n_chars"), 2000).select("source_id", "doc_id")


@query("first_edges", "SELECT question_id, edge_seq FROM (SELECT question_id, triple_id AS edge_seq, row_number() OVER (PARTITION BY question_id ORDER BY triple_id) AS r FROM triple) WHERE r <= 20")
def first_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.first_edges(edges(spark, d), Q, 20).select(*Q, "edge_seq")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_hybridqa").groupBy(*Q).agg(F.max_by("question", "ingested_at").alias("question"))


STOP = "a an and are as at by did for from how in is it of on or that the to was were what when which who with".split()


_STOPPED = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_RANKED = f"""WITH qs AS (SELECT question_id, arg_max(question, ingested_at) AS question FROM sample_hybridqa GROUP BY 1),
e AS (SELECT question_id, question, head, relation, tail, source_type, min(triple_id) AS edge_seq FROM triple JOIN qs USING (question_id) GROUP BY ALL),
w AS (SELECT *, list_filter({Z.terms("question")}, lambda t: length(t) > 1 AND t NOT IN {_STOPPED}) AS asked, lower(concat_ws(' ', head, relation, tail)) AS text FROM e),
s AS (SELECT *, len(list_intersect(asked, list_filter({Z.terms("text")}, lambda t: length(t) > 1 AND t NOT IN {_STOPPED}))) AS overlap, coalesce(list_sum([length(t) FOR t IN asked IF length(t) >= 4 AND contains(text, t)]), 0) AS phrase FROM w)
SELECT question_id, edge_seq, CAST(overlap AS INTEGER) AS overlap, CAST(phrase AS INTEGER) AS phrase, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, phrase DESC, edge_seq) AS rank FROM s) WHERE rank <= 10"""


@query("rank_edges", _RANKED)
def rank_edges(spark: SparkSession, d: str) -> DataFrame:
    """The ten edges of every graph nearest to its question."""
    return R.rank_edges(edges(spark, d).join(_questions(spark, d), Q), Q, "question", 10, STOP).drop("head", "relation", "tail")


_CODE = f"""WITH {Z.canonical_relations("triple")}, qs AS (SELECT question_id, arg_max(question, ingested_at) AS question FROM sample_hybridqa GROUP BY 1),
e AS (SELECT question_id, question, head, canonical AS relation, tail, min(triple_id) AS edge_seq FROM triple JOIN rel USING (relation) JOIN qs USING (question_id) GROUP BY ALL),
x AS (SELECT *, len(list_intersect({Z.terms("question")}, {Z.terms("concat_ws(' ', head, relation, tail)")})) + CASE WHEN relation = 'birth_date' THEN 3 ELSE 0 END AS s, head LIKE '% Bay' OR tail LIKE '% Bay' AS named FROM e)
SELECT question_id, edge_seq, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY named DESC, s DESC, edge_seq) AS rank FROM x) WHERE rank <= 8"""


@query("rank_code_edges", _CODE)
def rank_code_edges(spark: SparkSession, d: str) -> DataFrame:
    """The eight edges of every graph for the context of generated code: those of candidates first, one relation
    favoured."""
    e = edges(spark, d).where("question_id is not null and relation is not null")
    e = T.normalize_relations(e, "relation", "_r").withColumn("relation", F.col("_r")).drop("_r").join(_questions(spark, d), Q)
    named = edges(spark, d).select(*Q, F.explode(F.array("head", "tail")).alias("entity")).where("entity like '% Bay'").distinct()
    return R.rank_code_edges(e, Q, "question", 8, named, "birth_date").select(*Q, "edge_seq", "rank")


# -- scoring ---------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each question every tail as a candidate answer, with all facts that name it as evidence."""
    ref = F.struct("source_type", "source_id", "head", "relation", "tail")
    by = edges(spark, d).groupBy(*Q, F.col("tail").alias("value")).agg(F.array_sort(F.collect_set(ref)).alias("evidence"), F.count("*").alias("accessed"), F.min("edge_seq").alias("candidate_pos"))
    return by.withColumn("success", F.lit(True)).withColumn("n_steps", F.lit(2))


_SCORED = """ev AS (SELECT DISTINCT question_id, tail AS value, source_type, source_id, head, relation, tail FROM triple),
n AS (SELECT question_id, tail AS value, count(*) AS accessed, min(triple_id) AS candidate_pos FROM triple GROUP BY ALL),
s AS (SELECT question_id, value, count(DISTINCT (coalesce(source_type, '~'), coalesce(source_id, '~'))) AS sources, count(DISTINCT (head, relation, tail)) AS triples, count(*) AS size, string_agg(DISTINCT source_type, '+' ORDER BY source_type) AS kinds,
CAST(coalesce(bool_or(source_type = 'table'), false) AS INT) AS tab, CAST(coalesce(bool_or(source_type = 'text'), false) AS INT) AS txt, CAST(coalesce(bool_or(source_type = 'web'), false) AS INT) AS web FROM ev GROUP BY ALL),
sc AS (SELECT question_id, value, candidate_pos, kinds, tab, txt, size, accessed, 4.0 * least(sources / 3.0, 1) + 2 * tab + txt + 0.25 * web + 1.5 * tab * txt + 1.5 * least(triples / 4.0, 1) + 1.0 / count(*) OVER (PARTITION BY question_id) + size * 1.0 / greatest(accessed, size, 1) - 1.0 AS score
FROM s JOIN n USING (question_id, value))"""


@query("score_grounded", f"WITH {_SCORED} SELECT question_id, candidate_pos, round(score, 6) AS score FROM sc")
def score_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Grounded scores of the candidates of all questions."""
    return S.score_candidates(_candidates(spark, d), "question_id").select("question_id", "candidate_pos", F.round("score", 6).alias("score"))


@query("score_best", f"WITH {_SCORED} SELECT question_id, value, 'direct' AS mode, round(score, 6) AS score, round(greatest(0, least(1, score / 10)), 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, candidate_pos) AS r FROM sc) WHERE r = 1")
def score_best(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every question with its confidence."""
    best = S.score_candidates(_candidates(spark, d), "question_id").where("place = 1")
    return best.select("question_id", "value", "mode", F.round("score", 6).alias("score"), S.confidence(F.col("score")).alias("confidence"))


@query("path_metrics", f"WITH {_SCORED} SELECT question_id, true AS completed, CAST(2 AS INTEGER) AS length, CAST(size AS INTEGER) AS n_evidence, coalesce(kinds, '') AS kinds, tab + txt = 2 AS cross_modal, round(size * 1.0 / accessed, 6) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, candidate_pos) AS r FROM sc) WHERE r = 1")
def path_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What the best candidate of every question rests on."""
    c = _candidates(spark, d)
    scored = S.score_candidates(c, "question_id").join(c.select("question_id", "candidate_pos", "evidence", "accessed", "n_steps"), ["question_id", "candidate_pos"])
    out = S.path_metrics(scored, "question_id", F.col("evidence"), F.col("accessed"))
    return out.withColumn("precision", F.round("precision", 6))


_GATES = ["execution error", "empty result", "violates_table_candidate_constraint", "missing_required_table_evidence", "missing_target_relation_evidence", "ungrounded output"]


@query("score_gates", "SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(_GATES)) + " END AS reason, CASE c_custkey % 8 WHEN 7 THEN 'derived_boolean' WHEN 5 THEN 'none' WHEN 1 THEN 'none' ELSE 'direct' END AS mode FROM customer")
def score_gates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that each of the gates rejects, and two that pass."""
    k = F.col("c_custkey") % 8
    ref = F.struct(F.lit("text").alias("source_type"), F.lit("s").alias("source_id"), F.col("c_name").alias("head"), F.lit("lives in").alias("relation"), F.lit("somewhere").alias("tail"))
    rows = table(spark, d, "customer").select(
        "c_custkey", F.lit(1).alias("candidate_pos"), (k != 0).alias("success"), F.when(k == 1, "").when(k == 7, "true").otherwise(F.col("c_name")).alias("value"),
        F.when(k == 5, F.slice(F.array(ref), 1, 0)).otherwise(F.array(ref)).alias("evidence"), F.lit(1).alias("accessed"), F.lit(1).alias("n_steps"),
        F.when(k == 2, F.array(F.lit("someone else"))).alias("allowed"), (k == 3).alias("need_table"),
        F.when(k == 4, F.array(F.array(F.lit("middle"), F.lit("name")))).when(k == 6, F.array(F.array(F.lit("in"), F.lit("lives")))).otherwise(F.array().cast("array<array<string>>")).alias("groups"),
    )
    return S.score_candidates(rows, "c_custkey").select("c_custkey", "reason", "mode")


@query("score_lists", "SELECT p_brand, CAST(count(*) AS INTEGER) AS n_direct FROM part WHERE p_size <= 10 GROUP BY p_brand")
def score_lists(spark: SparkSession, d: str) -> DataFrame:
    """Values that are lists: the evidence that names one of their members."""
    ref = F.struct(F.lit("table").alias("source_type"), F.col("p_partkey").cast("string").alias("source_id"), F.lit("brand of").alias("head"), F.lit("part").alias("relation"), F.concat(F.lit("part no "), F.col("p_partkey"), F.lit("x")).alias("tail"))
    small = F.when(F.col("p_size") <= 10, F.concat(F.lit("Part No. "), F.col("p_partkey"), F.lit("X!")))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(ref).alias("e"), F.to_json(F.struct(F.collect_list(small).alias("parts"))).alias("v"))
    rows = rows.withColumn("terms", T.value_terms(F.col("v")))
    # an aggregate of one row: a filter on a plain column would find the evidence a second time
    return rows.groupBy("p_brand").agg(F.max(F.size(S.direct_evidence(F.col("e"), F.col("terms")))).alias("n_direct")).where("n_direct > 0")


@query("path_vote", "SELECT question_id, value, votes, CAST(row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, p) AS INTEGER) AS place FROM (SELECT question_id, relation AS value, count(*) AS votes, min(triple_id) AS p FROM triple WHERE relation <> '' GROUP BY question_id, relation)")
def path_vote(spark: SparkSession, d: str) -> DataFrame:
    """Relations of every graph by votes."""
    rows = edges(spark, d).select(*Q, F.col("relation").alias("value"), F.col("edge_seq").alias("candidate_pos"), F.lit(True).alias("success"))
    return S.vote(rows, "question_id").drop("first_pos")


@query(
    "rendered_answers",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.5' WHEN 2 THEN p_name ELSE upper(p_name) || '!' END AS answer FROM part",
)
def rendered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as text: truths, numbers, and names whose verbal form must say the same."""
    k = F.col("p_partkey") % 4
    verbal = F.when(k == 2, "something else").otherwise(F.concat(F.upper("p_name"), F.lit("!")))
    shown = S.render(F.col("p_name"), F.when(k == 1, F.col("p_size") + 0.5), F.when(k == 0, F.lit(True)), verbal)
    return table(spark, d, "part").select("p_partkey", shown.alias("answer"))


# -- metrics of stored programs read as answers to their examples -------------------------------------

_PAIRS = """(SELECT program_id, dataset, question, answer AS gold, CASE CAST(substr(program_id, 2) AS BIGINT) % 4 WHEN 0 THEN answer WHEN 1 THEN 'The ' || upper(answer) || '. ' ELSE c END AS answer, CASE WHEN CAST(substr(program_id, 2) AS BIGINT) % 3 > 0 THEN c END AS executed
FROM numericalprogram JOIN (SELECT DISTINCT ON (example_id) * FROM datasetexample WHERE answer IS NOT NULL ORDER BY example_id, ingested_at DESC) e USING (example_id) LEFT JOIN (SELECT program_id, arg_min(arguments, step_pos) AS c FROM irstep WHERE op = 'const' GROUP BY 1) USING (program_id))"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every program's example with its answer and a prediction: the answer itself, another way to write it, or the
    program's first constant."""
    e = table(spark, d, "datasetexample").where("answer is not null").groupBy("example_id").agg(F.max_by(F.struct("dataset", "question", "answer"), "ingested_at").alias("x")).select("example_id", "x.*")
    first = table(spark, d, "irstep").where("op = 'const'").groupBy("program_id").agg(F.min_by("arguments", "step_pos").alias("c"))
    k = F.substring("program_id", 2, 20).cast("long")
    rows = table(spark, d, "numericalprogram").select("program_id", "example_id").join(e, "example_id").join(first, "program_id", "left")
    told = F.when(k % 4 == 0, F.col("answer")).when(k % 4 == 1, F.concat(F.lit("The "), F.upper("answer"), F.lit(". "))).otherwise(F.col("c"))
    return rows.select("program_id", "dataset", "question", F.col("answer").alias("gold"), told.alias("answer"), F.when(k % 3 > 0, F.col("c")).alias("executed"))


def _f1(p: str, g: str) -> str:
    words = lambda x: f"list_filter(string_split({Z.answer(x)}, ' '), lambda w: w <> '')"
    return f"(SELECT CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(g, lambda x: x = w)), len(list_filter(p, lambda x: x = w))))), 0) / (len(p) + len(g)) END FROM (SELECT {words(p)} AS p, {words(g)} AS g))"


def _em(p: str, g: str) -> str:
    return f"CAST({Z.answer(p)} = {Z.answer(g)} AS DOUBLE)"


def _exact(p: str, g: str) -> str:
    a, b = Z.last_number(p), Z.last_number(g)
    return f"CAST(coalesce(CASE WHEN lower(trim({g}, ' ')) IN ('yes', 'no') THEN regexp_replace(lower(trim({p}, ' ')), '[.! ]+$', '') = lower(trim({g}, ' ')) ELSE abs({a} - {b}) < 5e-6 END, false) AS DOUBLE)"


def _ratio(p: str, g: str) -> str:
    a, b = Z.last_number(p), Z.last_number(g)
    return f"greatest({_exact(p, g)}, CAST(coalesce(abs({a} - {b}) < 5e-6 OR abs({a} / 100 - {b}) < 5e-6 OR abs({a} - {b} / 100) < 5e-6, false) AS DOUBLE))"


def _denoted(p: str, g: str, scaled: bool) -> str:
    listed = lambda x: f"CASE WHEN starts_with(trim({x}, ' '), '[') THEN [CASE WHEN json_type(y) = 'VARCHAR' THEN json_extract_string(y, '$') ELSE CAST(y AS VARCHAR) END FOR y IN CAST(CAST({x} AS JSON) AS JSON[])] ELSE [{x}] END"
    near = lambda a, b: f"abs({a} - {b}) <= greatest(1e-5 * greatest(abs({a}), abs({b})), 1e-5)"
    a, b = Z.last_number("p[1]"), Z.last_number("g[1]")
    fit = near(a, b) + (f" OR {near(a + ' / 100', b)} OR {near(a, b + ' / 100')}" if scaled else "")
    return f"(SELECT CAST(coalesce(CASE WHEN len(p) = 1 AND len(g) = 1 AND {a} IS NOT NULL AND {b} IS NOT NULL THEN {fit} ELSE list_sort([{Z.answer('x')} FOR x IN p]) = list_sort([{Z.answer('x')} FOR x IN g]) END, false) AS DOUBLE) FROM (SELECT {listed(p)} AS p, {listed(g)} AS g))"


def _listed(x: Column) -> Column:
    return F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x))


def _metric(name: str, sql: str, metric) -> None:
    @query(name, f"SELECT program_id, round({sql}, 6) AS score FROM {_PAIRS}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d).select("program_id", F.round(metric(F.col("answer"), F.col("gold")), 6).alias("score"))


_metric("exact_match", _em("answer", "gold"), S.exact_match)
_metric("semantic_match", f"CAST({Z.entity_answer('answer')} = {Z.entity_answer('gold')} AS DOUBLE)", S.semantic_match)
_metric("token_f1", _f1("answer", "gold"), S.token_f1)
_metric("execution_match", _exact("answer", "gold"), S.execution_match)
_metric("ratio_match", _ratio("answer", "gold"), S.ratio_match)
_metric("denotation_match", _denoted("answer", "gold", False), lambda p, g: S.denotation_match(_listed(p), _listed(g)))
_metric("denotation_scaled", _denoted("answer", "gold", True), lambda p, g: S.denotation_match(_listed(p), _listed(g), scaled=True))

_BY = {"exact_match": ("hybridqa", _em("answer", "gold")), "f1": ("hybridqa", _f1("answer", "gold")), "execution_exact_match": ("hybridqa", f"CASE WHEN executed IS NOT NULL THEN {_em('executed', 'gold')} END"), "official_execution_accuracy": ("finqa", _exact("answer", "gold")), "execution_accuracy": ("finqa", _ratio("answer", "gold")), "path_execution_accuracy": ("finqa", f"CASE WHEN executed IS NOT NULL THEN {_ratio('executed', 'gold')} END"), "official_denotation_accuracy": ("hitab", _denoted("answer", "gold", False)), "denotation_accuracy": ("hitab", _denoted("answer", "gold", True))}
_RECORDS = "SELECT program_id, dataset, " + ", ".join(f"CASE WHEN dataset = '{d}' THEN round({x}, 6) END AS {n}" for n, (d, x) in _BY.items()) + f" FROM {_PAIRS}"


@query("record_metrics", _RECORDS)
def record_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every prediction with the metrics of its data set."""
    return S.record_metrics(_pairs(spark, d)).select("program_id", "dataset", *[F.round(n, 6).alias(n) for n in _BY])


@query("run_summary", "SELECT dataset, count(*) AS n, CAST(0 AS BIGINT) AS n_failed, " + ", ".join(f"round(avg({n}), 6) AS mean_{n}" for n in _BY) + f" FROM ({_RECORDS}) GROUP BY dataset")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a run over all predictions, by data set."""
    rows = S.record_metrics(_pairs(spark, d)).withColumn("error", F.lit(None).cast("string"))
    return sinks.summarize(rows, list(_BY), "dataset").select("dataset", "n", "n_failed", *[F.round(f"mean_{n}", 6).alias(f"mean_{n}") for n in _BY])


@query(
    "grounding_pr",
    """WITH g AS (SELECT question_id, coalesce(list_distinct(list(source_id) FILTER (source_type = 'table')), []) AS gold, coalesce(list_distinct(list(source_id) FILTER (row_index IS NOT NULL OR source_type = 'web')), []) AS pred FROM triple WHERE source_id IS NOT NULL GROUP BY 1)
SELECT question_id, round(CASE WHEN len(gold) = 0 THEN NULL WHEN len(pred) = 0 THEN 0.0 ELSE len(list_intersect(gold, pred)) * 1.0 / len(pred) END, 6) AS prec, round(CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, pred)) * 1.0 / len(gold) END, 6) AS rec FROM g""",
)
def grounding_pr(spark: SparkSession, d: str) -> DataFrame:
    """Of the sources of a graph, those cited from tables against those with a row or from the web."""
    e = edges(spark, d).where("source_id is not null")
    g = e.groupBy(*Q).agg(F.collect_set(F.when(F.col("source_type") == "table", F.col("source_id"))).alias("gold"), F.collect_set(F.when(F.col("row_index").isNotNull() | (F.col("source_type") == "web"), F.col("source_id"))).alias("pred"))
    p, r = S.grounding(F.col("pred"), F.col("gold"))
    return g.select(*Q, F.round(p, 6).alias("prec"), F.round(r, 6).alias("rec"))


@query("evidence_ids", r"SELECT triple_id, CASE WHEN source_type = 'table' AND row_index IS NOT NULL THEN 'table_' || (row_index + 1) WHEN triple_id % 3 < 2 THEN 'text_' || triple_id END AS name FROM triple")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """Facts named as data sets name their evidence; every third as a paragraph after the table, which has no name."""
    k = F.col("triple_id") % 3
    source = F.concat(F.lit("r:"), F.when(k == 0, "text").when(k == 1, "pre").otherwise("post"), F.lit(":"), "triple_id")
    return table(spark, d, "triple").select("triple_id", S.evidence_id(F.coalesce("source_type", F.lit("")), F.col("row_index"), source).alias("name"))


_PROGRAMS = """SELECT o_orderkey, k, CAST(CASE WHEN k IN (4, 5) THEN NULL WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.5 WHEN k = 2 THEN 1.0 WHEN k = 3 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS operator_accuracy,
CAST(CASE WHEN k IN (4, 5) THEN NULL WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.5 WHEN k = 2 THEN 1.0 WHEN k = 3 THEN 0.0 ELSE 0.0 END AS DOUBLE) AS step_accuracy,
CAST(CASE WHEN k IN (3, 4, 5) THEN NULL WHEN k = 0 THEN 1.0 WHEN k = 2 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS strict_operator_accuracy, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 6 THEN 1 END AS INTEGER) AS aligned_steps FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Predicted programs over order prices beside gold ones: equal, shorter, an average said otherwise, lookups
    only, none, without gold, with another value."""
    k, p = F.col("o_orderkey") % 7, F.round("o_totalprice", 2)
    text = lambda x: F.format_string("%.2f", x)
    step = lambda i, op, v: F.struct(F.lit(i).alias("id"), F.lit(op).alias("op"), v.cast("double").alias("value"))
    look = step("v1", "lookup", F.lit(None))
    steps = F.when(k == 0, F.array(look, step("v2", "subtract", p - 100), step("v3", "divide", (p - 100) / 4))).when(k == 1, F.array(step("v1", "subtract", (p - 100) * 100))).when(k == 2, F.array(look, step("v2", "table_average", (p + 100) / 2))).when(k == 3, F.array(look)).when(k == 5, F.array(look)).when(k == 6, F.array(step("v1", "subtract", p + 1)))
    gold = F.when(k == 5, "table_max(x, none)").when(k == 2, F.concat(F.lit("add("), text(p), F.lit(", 100), divide(#0, const_2)"))).otherwise(F.concat(F.lit("subtract("), text(p), F.lit(", const_100), divide(#0, const_4)")))
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"), steps.alias("steps"), F.when(k == 0, "v3").when(k == 2, "v2").otherwise("v1").alias("result"), ir.gold_steps(gold).alias("gold"), F.when(k == 2, "What was the average price?").otherwise("What was it?").alias("question"))
    return rows.withColumn("m", S.program_metrics(F.col("steps"), F.col("result"), F.col("gold"), F.col("question")))


@query("program_metrics", _PROGRAMS)
def program_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Operator and step accuracy of programs against gold programs."""
    return _compared(spark, d).select("o_orderkey", "k", "m.operator_accuracy", "m.step_accuracy", "m.strict_operator_accuracy", "m.aligned_steps")


_KINDS = ["serialization_schema", "pipeline_failure", None, "serialization_schema", "arithmetic_execution", "grounding", "operand_or_operator_selection", "operand_selection", "operator_selection", "answer_rendering", "unit_scale_or_unclassified"]


@query("error_taxonomy", "SELECT o_orderkey, CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS) if k) + " END AS kind FROM orders")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Runs of all kinds of failure, by the first that fits."""
    k = F.col("o_orderkey") % 11
    number = lambda default, **at: F.coalesce(*[F.when(k == int(n[1:]), float(v)) for n, v in at.items()], F.lit(default))
    kind = S.error_category(k < 2, F.when(k == 0, "JSONDecodeError: x").otherwise("Timeout: y"), number(0.0, _2=1), number(1.0, _3=0), number(1.0, _3=0, _4=0), F.when(k != 8, number(1.0, _5=0.5)), F.when(k != 9, number(1.0, _6=0.5, _7=0.5)), number(1.0, _6=0.5, _8=0.0), number(0.0, _9=1))
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"))
