"""Samples whose categories have given shares.

Every row gets a fixed uniform number from a hash of its id and the plan.  A category's acceptance
probability is its target over its observed count, a little more than enough (oversampling); rows
below it are drawn independently of each other.  Counts are then made exact: a histogram of the drawn
numbers finds, for every category, the bin in which the target is reached; rows in lower bins stay,
and only the rows of that one bin are ranked.  Where fewer rows exist than asked for, all are taken
and the deficit is reported.

A question counts once by its id.  Rows with a null or blank answer, and rows without an id, are not
drawn.  Ties between equal numbers go to the smaller id.  A plan without rows draws nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import materialize

BINS = 1024
KEY = ["plan_id", "strat_name", "category"]
#: Words that hint at how an answer is found.
ORDINAL = r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d+(?:st|nd|rd|th))\b"
SUPERLATIVE = r"\b(most|least|largest|smallest|highest|lowest|oldest|youngest|earliest|latest|greatest|longest|shortest)\b"
COMPARISON = r"\b(between|difference|more than|less than|greater than|compared|how many times|total|sum)\b"
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"


def _words(text: Column) -> Column:
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.array_join(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def answer_kind(answer_text: Column) -> Column:
    """``numeric`` for digits with at most one point and one minus (commas aside), else ``text``."""
    x = F.regexp_replace(F.coalesce(answer_text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    x = F.regexp_replace(F.replace(x, F.lit(",")), r"^([^.]*)\.", "$1")
    return F.when(F.regexp_replace(x, r"^([^-]*)-", "$1").rlike(DIGITS), "numeric").otherwise("text")


def answer_source(nodes: Column) -> Column:
    """Where the nodes of an answer lie: passage, table, mixed or unknown."""
    real = F.filter(F.coalesce(nodes, F.array().cast("array<struct<entity:string,row_index:int,col_index:int,link_id:string,node_source:string>>")), lambda n: n.isNotNull())
    kinds = F.array_distinct(F.transform(real, lambda n: F.coalesce(n["node_source"], F.lit("None"))))
    has = lambda k: F.array_contains(kinds, k)
    one, two = F.size(kinds) == 1, F.size(kinds) == 2
    return F.when(one & has("passage"), "passage").when(one & has("table"), "table").when(two & has("passage") & has("table"), "mixed").otherwise("unknown")


def cross_modal_proxy(question: Column, nodes: Column) -> Column:
    """Whether the question names an entity that leads to the passage of the answer."""
    empty = F.array().cast("array<string>")
    passage = F.filter(nodes, lambda n: n.isNotNull() & (n["node_source"] == "passage") & n["entity"].isNotNull())
    bridges = F.coalesce(F.filter(F.transform(passage, lambda n: _words(n["entity"])), lambda w: w != ""), empty)
    asked = _words(F.coalesce(question, F.lit("")))
    named = F.exists(bridges, lambda w: F.contains(asked, w))
    return F.when(F.size(bridges) == 0, "table_answer").when(named, "bridge_mentioned").otherwise("table_to_text_likely")


def reasoning_cues(question: Column) -> Column:
    """The kinds of cue words in a question, joined by ``+``, or ``other``."""
    x = F.lower(F.coalesce(question, F.lit("")))
    found = [F.when(x.rlike("(?U)" + rule), name) for rule, name in ((ORDINAL, "ordinal"), (SUPERLATIVE, "superlative"), (COMPARISON, "comparison_or_count"))]
    cues = F.concat_ws("+", *found)
    return F.when(cues == "", "other").otherwise(cues)


def attributes() -> dict[str, Column]:
    """The attributes that plans may name, over the columns of the questions."""
    return {
        "answer_kind": answer_kind(F.col("answer_text")),
        "answer_source": answer_source(F.col("answer_node")),
        "cross_modal_proxy": cross_modal_proxy(F.col("question"), F.col("answer_node")),
        "reasoning_cues": reasoning_cues(F.col("question")),
    }


def eligible(questions: DataFrame) -> DataFrame:
    """``question_id`` and all attributes, one row a question: its latest delivery with an answer."""
    blank = F.regexp_replace("answer_text", r"[\s\p{Z}]+", "") == ""
    rows = questions.where(F.col("question_id").isNotNull() & F.col("answer_text").isNotNull() & ~blank)
    rows = rows.select("question_id", F.struct(F.col("ingested_at").alias("_at"), *[c.alias(n) for n, c in attributes().items()]).alias("_x"))
    rows = rows.groupBy("question_id").agg(F.max("_x").alias("_x"))
    return rows.select("question_id", *[F.col(f"_x.{n}").alias(n) for n in attributes()])


def strata(rows: DataFrame, names: list[str]) -> DataFrame:
    """``question_id, strat_name, category`` for each of the attribute names, joined ones by ``|``."""
    known = [n for n in names if n and all(p in attributes() for p in n.split("|"))]
    if not known:
        return rows.select("question_id", F.lit(None).cast("string").alias("strat_name"), F.lit(None).cast("string").alias("category")).where("false")
    each = F.array(*[F.struct(F.lit(n).alias("strat_name"), F.concat_ws("|", *[F.col(p) for p in n.split("|")]).alias("category")) for n in known])
    return rows.select("question_id", F.inline(each))


def plan_table(targets: DataFrame) -> DataFrame:
    """Targets with ``wanted`` (not rounded) and ``n_target`` (whole rows by largest remainder,
    raised to the minimum); repeated rows of a plan count once."""
    t = targets.dropDuplicates(["plan_id", "strat_name", "category"])
    exact = F.coalesce(F.col("target_share") * F.col("sample_rows"), F.lit(0.0))
    t = t.withColumn("_exact", exact).withColumn("_floor", F.floor(F.col("_exact") + 1e-9)).withColumn("_rest", F.col("_exact") - F.col("_floor"))
    plan = Window.partitionBy("plan_id")
    t = t.withColumn("_left", F.round(F.sum("_exact").over(plan)) - F.sum("_floor").over(plan))
    t = t.withColumn("_rank", F.row_number().over(plan.orderBy(F.desc("_rest"), "strat_name", "category")))
    t = t.withColumn("wanted", F.greatest("_exact", F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0))))
    n = F.greatest(F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0), F.coalesce("min_rows", F.lit(0)))
    return t.withColumn("n_target", n.cast("long")).drop("_exact", "_floor", "_rest", "_left", "_rank")


def _names(targets: DataFrame, limit: int = 1000) -> list[str]:
    names = [r[0] for r in targets.select("strat_name").where("strat_name is not null").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} attribute names in the plans")
    return sorted(names)


def draw(questions: DataFrame, targets: DataFrame, oversample: float = 1.05) -> tuple[DataFrame, DataFrame]:
    """The rows drawn for every row of the plans, and the plans with what the draw found.

    ``plan_id, strat_name, category, question_id, u, _bin`` are drawn independently with the acceptance
    probability of their category; where a draw comes out short of the target although more rows exist, its
    probability is doubled and it is drawn again.  ``drawn`` of the plans counts its rows: less than
    ``wanted`` only where all ``available`` rows are."""
    rows = materialize(eligible(questions), "eligible")
    names = _names(targets)
    counts = strata(rows, names).groupBy("strat_name", "category").agg(F.count("*").alias("available"))
    plans = plan_table(targets).join(counts, ["strat_name", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    need = F.least(F.greatest(F.ceil("wanted"), "n_target"), "available")
    # six standard deviations above the expectation: a shortage is next to impossible, and is mended below
    slack = need * oversample + 6 * F.sqrt(need.cast("double")) + 10
    p = F.when(F.col("available") > 0, F.least(F.lit(1.0), slack / F.col("available"))).otherwise(0.0)
    plans = materialize(plans.withColumn("need", need).withColumn("p", p).select(*KEY, "wanted", "n_target", "available", "need", "p"), "plans")
    u = F.pmod(F.xxhash64("question_id", "plan_id", "category"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    while True:
        open_ = plans.where("need > 0").select(*KEY, "p")
        drawn = strata(rows, names).join(open_, ["strat_name", "category"]).withColumn("u", u).where("u < p")
        drawn = materialize(drawn.withColumn("_bin", F.floor(F.col("u") / F.col("p") * BINS).cast("int")).select(*KEY, "question_id", "u", "_bin"), "drawn")
        have = plans.join(drawn.groupBy(*KEY).agg(F.count("*").alias("drawn")), KEY, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
        have = materialize(have, "have")
        if have.where("drawn < need").isEmpty():
            return drawn, have
        plans = materialize(have.withColumn("p", F.least(F.lit(1.0), F.col("p") * 2)).drop("drawn"), "plans")


def report(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row of the plans with ``available`` rows, ``wanted``, ``n_target``, ``n_sampled`` and
    ``deficit``, as the draw found them."""
    plans = draw(questions, targets)[1]
    return plans.select(*KEY, "wanted", "n_target", "available", F.least("n_target", "drawn").alias("n_sampled"), F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0.0)).alias("deficit"))


def unmet(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan_id, category`` of the targets that a draw of everything there is can't meet."""
    return report(questions, targets).where("deficit > 0").select("plan_id", "category")


def sample(questions: DataFrame, targets: DataFrame, oversample: float = 1.05) -> DataFrame:
    """``plan_id, category, question_id``: for each plan exactly ``min(n_target, available)`` rows of
    each category."""
    drawn, plans = draw(questions, targets, oversample)
    bins = drawn.groupBy(*KEY, "_bin").count().join(plans.select(*KEY, F.least("n_target", "drawn").alias("n")), KEY)
    bins = bins.withColumn("_upto", F.sum("count").over(Window.partitionBy(*KEY).orderBy("_bin")))
    # the first bin that reaches n; lower bins stay whole, its own rows are ranked for what is left
    edge = bins.where("_upto >= n and n > 0").groupBy(*KEY).agg(F.min(F.struct("_bin", (F.col("n") - F.col("_upto") + F.col("count")).alias("_need"))).alias("_edge"))
    drawn = drawn.join(edge, KEY).where("_bin <= _edge._bin")
    sure = drawn.where("_bin < _edge._bin").select(*KEY, "question_id")
    last = drawn.where("_bin = _edge._bin").withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("u", "question_id")))
    return sure.unionByName(last.where("_rank <= _edge._need").select(*KEY, "question_id")).select("plan_id", "category", "question_id")
