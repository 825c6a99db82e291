"""Splits that keep related records together.

Records and the entities they name form a bipartite graph.  The least label travels back and forth
until nothing changes, so that every record gets the component it belongs to.  Whole components are
then placed into splits such that sizes match the target shares and the distribution of a label
differs as little as possible between splits.

Records without an entity relate to nothing and are components of their own.  Rows repeated under
one record id count once.  Empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.lookalike import default_table
from gleaner.session import materialize

#: Items that the driver places: components below one in BUCKETS of all rows share a bucket.
BUCKETS = 2048
#: Labels beyond so many share bins, so that the driver's table stays bounded.
LABELS = 64
ROUNDS = 60


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """For ``translate``: characters and what stands for them, accents and look-alikes removed."""
    table: dict[str, str] = {}
    for code in range(0x80, 0x2000):
        base = unicodedata.normalize("NFD", chr(code).lower())[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            table[chr(code)] = base
    for member, best in default_table().items():
        if len(member) == 1 and len(best) <= 1:
            table.setdefault(member, best.lower())
    kept = {k: v for k, v in table.items() if v}
    gone = "".join(k for k, v in table.items() if not v)
    return "".join(kept) + gone, "".join(kept.values())


def page_of(table_id: Column) -> Column:
    """The page a table id names, in one form; null for null and blank ids.

    Percent escapes (also doubled), folders, ``.json``, case, accents, spaces against underscores,
    composed against decomposed and outer white space make no difference; the number of the table on
    its page is cut off.
    """
    x = table_id
    for _ in range(2):
        # only texts with an escape are decoded: a failing decoder is dear
        x = F.when(F.contains(x, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)).otherwise(x)
    source, target = _plain_letters()
    foreign = x.rlike(r"[^\x00-\x7f]")
    x = F.when(foreign, F.translate(F.lower(F.regexp_replace(x, r"\p{Mn}+", "")), source, target)).otherwise(F.lower(x))
    x = F.regexp_replace(x, r"[\s\p{Z}_]+", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^\.?/*(tables/+)+_*", ""), r"_*\.json$", "")
    page = F.regexp_extract(x, r"^(.+)_([0-9]+)$", 1)
    return F.when(F.trim(x) == "", None).otherwise(F.when(page != "", page).otherwise(x))


def components(edges: DataFrame, record: str, entity: str) -> DataFrame:
    """``(record, component)`` for every record with an entity, by least-label propagation.

    Only records naming two or more entities can join entities; the rest of the graph needs no
    iteration.  Labels move by minimum aggregates (combined before the shuffle, so hot entities cost
    one row a task) and jump to the label of their label, which halves the distance in every round.
    """
    edges = materialize(edges.select(F.col(record).alias("_r"), F.col(entity).alias("_e")).where("_r is not null and _e is not null"), "edges")
    ends = materialize(edges.groupBy("_r").agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi")), "ends")
    joined = ends.where("_lo <> _hi").select("_r")
    if joined.isEmpty():
        return ends.select(F.col("_r").alias(record), F.col("_lo").alias("component"))
    links = materialize(edges.join(joined, "_r", "left_semi").distinct(), "links")
    labels = links.select("_e", F.col("_e").alias("_l")).distinct()
    for _ in range(ROUNDS):
        records = links.join(labels, "_e").groupBy("_r").agg(F.min("_l").alias("_l"))
        moved = links.join(records, "_r").groupBy("_e").agg(F.min("_l").alias("_m"))
        moved = materialize(labels.join(moved, "_e").select("_e", "_l", F.least("_l", "_m").alias("_m")), "moved")
        if moved.where("_m <> _l").isEmpty():
            labels = moved.select("_e", "_l")
            break
        # labels jump to the label of their label
        jump = moved.select(F.col("_e").alias("_m"), F.col("_m").alias("_j"))
        labels = materialize(moved.join(jump, "_m", "left").select("_e", F.least(F.coalesce("_j", "_m"), "_m").alias("_l")), "labels")
    else:
        raise RuntimeError(f"labels still moved after {ROUNDS} rounds")
    return ends.join(labels, ends["_lo"] == labels["_e"], "left").select(F.col("_r").alias(record), F.coalesce("_l", "_lo").alias("component"))


def divided(records: DataFrame, record: str, component: str, split: str) -> DataFrame:
    """Records whose component holds records of another split; null splits count for nothing."""
    rows = records.where(F.col(component).isNotNull() & F.col(split).isNotNull()).select(record, F.col(component).alias("_c"), F.col(split).alias("_s"))
    mixed = rows.groupBy("_c").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where("_lo <> _hi").select("_c")
    return rows.join(mixed, "_c", "left_semi").select(record).distinct()


def place(sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For items with counts by label, the split of each: largest first, each where the squared
    deviation from the target counts, over all labels, falls the most; ties to the first split."""
    total = sizes.sum(0)
    target = shares[:, None] * total[None, :]
    weight = 1 / np.maximum(total, 1)
    have = np.zeros_like(target)
    out = np.zeros(len(sizes), int)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.sum(1))):
        gap = have - target
        change = ((2 * gap + sizes[i]) * sizes[i] * weight).sum(1) / np.maximum(shares, 1e-9)
        out[i] = int(np.argmin(change))
        have[out[i]] += sizes[i]
    return out


def assign(records: DataFrame, record: str, component: str, label: str, targets: list[tuple[str, float]]) -> DataFrame:
    """``(record, component, split)`` of every record.

    Components of at least one in ``BUCKETS`` of the rows are placed one by one, the others by hash
    buckets: the driver sees at most twice ``BUCKETS`` items with ``LABELS`` counts each.
    """
    spark = records.sparkSession
    own = F.coalesce(F.concat(F.lit("c:"), F.col(component).cast("string")), F.concat(F.lit("r:"), F.col(record).cast("string")))
    rows = records.select(F.col(record).alias("_r"), own.alias("_c"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).groupBy("_r").agg(F.min("_c").alias("_c"), F.min("_l").alias("_l"))
    rows = materialize(rows, "grouped")
    total = rows.count()
    kinds = [r["_l"] for r in rows.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LABELS - 1).collect()]
    # a component's rows are counted with a map-side combine: a hot one costs one row a task
    large = rows.groupBy("_c").count().where(F.col("count") * BUCKETS >= max(total, 1)).select("_c", F.lit(True).alias("_big"))
    bucket = F.concat(F.lit("b:"), F.pmod(F.xxhash64("_c"), F.lit(BUCKETS)))
    rows = rows.join(F.broadcast(large), "_c", "left").withColumn("_item", F.when(F.col("_big"), F.col("_c")).otherwise(bucket))
    label_id = F.lit(len(kinds))
    for i, kind in reversed(list(enumerate(kinds))):
        label_id = F.when(F.col("_l") == kind, i).otherwise(label_id)
    counts = rows.groupBy("_item", label_id.alias("_k")).count().collect()
    items = sorted({r["_item"] for r in counts})
    at = {x: i for i, x in enumerate(items)}
    sizes = np.zeros((len(items), len(kinds) + 1))
    for r in counts:
        sizes[at[r["_item"]], r["_k"]] = r["count"]
    names = [n for n, _ in targets]
    shares = np.array([s for _, s in targets], float)
    placed = place(sizes, shares / max(shares.sum(), 1e-9)) if items else []
    mapping = spark.createDataFrame([(x, names[k]) for x, k in zip(items, placed)], "_item string, split string")
    return rows.join(F.broadcast(mapping), "_item").select(F.col("_r").alias(record), F.when(F.col("_c").startswith("c:"), F.substring("_c", 3, 1 << 30)).alias("component"), "split")
