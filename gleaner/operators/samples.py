"""Balanced samples and shards of examples.

Greedy balancing looks only at a row's attribute values, so it runs over the counts of attribute
combinations on the driver (as many as there are combinations, not rows); rows of a combination are
then taken in a fixed pseudo-random order.  Ranks in that order are found in two levels, hash buckets
and places inside a bucket, so that no task ever holds a whole combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
MAX_CELLS = 100_000


def _join_on(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside the matching row of ``small``, null equal to null; ``small`` has few rows."""
    named = small.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in small.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(named, on).drop(*[f"_g{i}" for i in range(len(by))])


def ranked(df: DataFrame, by: list[str], key: str, seed: int = 0, out: str = "rank") -> DataFrame:
    """``out``: places from 0 inside each group, in an order fixed by ``seed``; ties go by ``key``."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    sizes = rows.groupBy(*by, "_b").count()
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(w), F.lit(0)))
    joined = _join_on(rows, starts.drop("count"), [*by, "_b"])
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return joined.withColumn(out, F.col("_start") + place - 1).drop("_h", "_b", "_start")


def greedy_cells(cells: dict[tuple, int], size: int, cover: int | None = None, taken: dict[tuple, int] | None = None) -> dict[tuple, int]:
    """How many rows of each attribute combination a balanced sample of ``size`` takes.

    Each draw goes to the combination whose values lack most, relative to their targets; with
    ``cover``, every value of that dimension comes once first, rare ones first.  ``taken`` rows are
    no longer there."""
    left = {c: n - (taken or {}).get(c, 0) for c, n in cells.items()}
    left = {c: n for c, n in left.items() if n > 0}
    total = sum(left.values())
    if not 0 < size <= total:
        raise ValueError(f"size must be between 1 and {total}")
    dims = len(next(iter(left)))
    full: list[dict] = [{} for _ in range(dims)]
    for c, n in left.items():
        for i, v in enumerate(c):
            full[i][v] = full[i].get(v, 0) + n
    have: list[dict] = [dict.fromkeys(f, 0) for f in full]
    out: dict[tuple, int] = {}

    def take(c: tuple) -> None:
        out[c] = out.get(c, 0) + 1
        left[c] -= 1
        if not left[c]:
            del left[c]
        for i, v in enumerate(c):
            have[i][v] += 1

    def lack(c: tuple) -> float:
        score = 0.0
        for i, v in enumerate(c):
            target = size * full[i][v] / total
            score += (target - have[i][v]) / max(target, 1.0)
        return score

    if cover is not None:
        for value in sorted(full[cover], key=lambda v: (full[cover][v], str(v))):
            if sum(out.values()) < size and (found := [c for c in left if c[cover] == value]):
                take(max(found, key=lambda c: (lack(c), str(c))))
    for _ in range(size - sum(out.values())):
        take(max(left, key=lambda c: (lack(c), str(c))))
    return out


def _cells(rows: DataFrame, columns: list[str]) -> dict[tuple, int]:
    found = rows.groupBy(*columns).count().limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of attributes")
    return {tuple(r[c] for c in columns): r["count"] for r in found}


def balanced_shards(df: DataFrame, key: str, columns: list[str], size: int, shards: int = 1, seed: int = 0, cover: int | None = None, distinct: str | None = None) -> DataFrame:
    """``df`` rows of disjoint balanced samples with their ``shard_index``; with ``distinct`` at most
    one row a value of that column is eligible."""
    rows = df
    if distinct:
        first = F.min(F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k")))
        rows = rows.join(rows.groupBy(distinct).agg(first.alias("_f")).select(F.col("_f.k").alias(key)), key, "left_semi")
    cells = _cells(rows, columns)
    taken: dict[tuple, int] = {}
    plan = []
    for shard in range(shards):
        for cell, n in greedy_cells(cells, size, cover, taken).items():
            start = taken.get(cell, 0)
            plan.append((*cell, start, start + n, shard))
            taken[cell] = start + n
    schema = [rows.schema[c] for c in columns]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _from long, _to long, shard_index int"
    ranges = df.sparkSession.createDataFrame(plan, ddl)
    r = _join_on(ranked(rows, columns, key, seed, "_rank"), F.broadcast(ranges), columns)
    return r.where("_rank >= _from and _rank < _to").select(*df.columns, "shard_index")


def stratified_shards(df: DataFrame, key: str, columns: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard_index``: the rows of every stratum dealt out in turn, so that a stratum's
    counts in two shards differ by at most one, and so do the shards' sizes."""
    sizes = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    # strata start where the ones before them ended: the deal goes on across strata
    order = Window.orderBy("_n", *columns).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    r = _join_on(ranked(df, columns, key, seed, "_rank"), starts.drop("_n"), columns)
    return r.select(*df.columns, F.pmod(F.col("_rank") + F.col("_s"), F.lit(shards)).cast("int").alias("shard_index"))


def chunks(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard_index``: chunks of ``size`` rows in a fixed order, the last one shorter."""
    rows = df.withColumn("_all", F.lit(1))
    return ranked(rows, ["_all"], key, seed, "_rank").withColumn("shard_index", F.floor(F.col("_rank") / size).cast("int")).drop("_rank", "_all")


def filter_steps(df: DataFrame, operators: Column, exact: int | None = None, least: int | None = None, most: int | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Rows whose program has the given number of steps and only allowed operators."""
    n = F.size(operators)
    for bound, keep in ((exact, lambda b: n == b), (least, lambda b: n >= b), (most, lambda b: n <= b)):
        if bound is not None:
            df = df.where(keep(bound))
    if allowed is not None:
        df = df.where(F.size(F.array_except(operators, F.array(*[F.lit(a) for a in allowed]))) == 0)
    return df


def marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, value, n`` of several columns in one pass over the data."""
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.inline(each)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
