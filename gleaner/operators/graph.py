"""Fact graphs as edge tables: insertion, look-ups with evidence, summaries, paths, resolution.

Edges are rows ``(keys..., edge_seq, head, relation, tail, provenance...)``; parallel edges stay.
Every function works on all graphs (all values of ``keys``) at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import materialize


TIERS = ["lexical", "alias", "structural", "semantic"]


def insert(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples as edges with canonical relations, and those rejected because both ends are one name by key,
    with the reason."""
    rows = T.normalize_relations(triples, "relation", "_rel").withColumn("relation", F.col("_rel")).drop("_rel")
    loop = F.coalesce(T.normalize_key(F.col("head")) == T.normalize_key(F.col("tail")), F.lit(False))
    return rows.where(~loop), rows.where(loop).withColumn("reason", F.lit("self_loop"))


def neighbors(edges: DataFrame, keys: list[str], outgoing: bool = True) -> DataFrame:
    """``keys, node, relation, other, edge_seq``: each neighbour once, at its first edge."""
    node, other = ("head", "tail") if outgoing else ("tail", "head")
    return edges.groupBy(*keys, F.col(node).alias("node"), "relation", F.col(other).alias("other")).agg(F.min("edge_seq").alias("edge_seq"))


def relations(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The sorted distinct outgoing relations of every node."""
    return edges.groupBy(*keys, F.col("head").alias("node")).agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def evidence(edges: DataFrame, keys: list[str]) -> DataFrame:
    """All parallel edges between two nodes as one sorted set."""
    ref = F.struct("source_type", "source_id", "head", "relation", "tail")
    return edges.groupBy(*keys, "head", "tail").agg(F.array_sort(F.collect_set(ref)).alias("evidence"), F.count("*").alias("n_edges"))


def nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, has_out, has_in, first_seq`` of every node."""
    ends = edges.select(*keys, "edge_seq", F.inline(F.array(F.struct(F.col("head").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tail").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy(*keys, "node").agg((F.max("o") > 0).alias("has_out"), (F.max("i") > 0).alias("has_in"), F.min("edge_seq").alias("first_seq"))


def summary(edges: DataFrame, keys: list[str], log: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Sizes and relations of every graph; with a resolution ``log`` also the number of aliases and of merges by
    tier, with ``rejected`` triples their number."""
    ends = edges.select(*keys, "relation", F.explode(F.array("head", "tail")).alias("node"))
    out = ends.groupBy(*keys).agg((F.count("*") / 2).cast("long").alias("n_edges"), F.countDistinct("node").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("relation")), "|").alias("relations"))
    if log is not None:
        tiers = log.groupBy(*keys).agg(F.countDistinct("node").alias("n_aliases"), *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS])
        out = out.join(tiers, keys, "left").na.fill(0, ["n_aliases", *(f"n_{t}" for t in TIERS)])
    if rejected is not None:
        out = out.join(rejected.groupBy(*keys).agg(F.count("*").alias("n_rejected")), keys, "left").na.fill(0, ["n_rejected"])
    return out


def nodes_by_key(found: DataFrame, names: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """``asked`` (``keys, name``) with the ``node`` that each name stands for: itself if it is a node, else the node
    of its key in ``names`` (see ``query_index``), else the name as it is."""
    own = found.select(*keys, F.col("node").alias("name"), F.lit(True).alias("_own"))
    rows = asked.join(own, [*keys, "name"], "left").withColumn("key", T.normalize_key(F.col("name"))).join(names.withColumnRenamed("node", "_node"), [*keys, "key"], "left")
    return rows.withColumn("node", F.when(F.col("_own"), F.col("name")).otherwise(F.coalesce("_node", "name"))).drop("_own", "_node", "key")


def structure(cells: DataFrame) -> DataFrame:
    """Typed edges of a table's structure: table to row, row to cell, cell to column."""
    t = F.concat(F.lit("table:"), F.col("table_name"))
    row = F.concat(t, F.lit(":row:"), F.col("row_index"))
    column = F.concat(t, F.lit(":column:"), F.col("column_name"))
    cell = F.concat(row, F.lit(":cell:"), F.col("column_name"))
    edge = lambda a, b, kind: F.struct(a.alias("head"), b.alias("tail"), F.lit(kind).alias("kind"))
    return cells.select(F.inline(F.array(edge(t, row, "row_contains"), edge(row, cell, "row_contains"), edge(cell, column, "column_of")))).distinct()


def hops(edges: DataFrame, keys: list[str], starts: DataFrame, limit: int) -> DataFrame:
    """``keys, start, node, hops``: distances up to ``limit`` over undirected edges.

    Each round joins only the nodes first reached in the round before, and nodes already reached are
    taken out by an anti join."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = materialize(edges.select(*keys, F.inline(F.array(pair("head", "tail"), pair("tail", "head")))).where("a <> b").distinct(), "ways")
    front = starts.select(*keys, "start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    reached = front
    for i in range(1, limit + 1):
        step = front.join(ways, [*[front[k] == ways[k] for k in keys], front["node"] == ways["a"]]).select(*[front[k] for k in keys], "start", F.col("b").alias("node"), F.lit(i).alias("hops")).distinct()
        front = materialize(step.join(reached, [*keys, "start", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        reached = materialize(reached.unionByName(front), "reached")
    return reached


def chain(edges: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """``keys, head, middle, tail``: two edges in a row with the given relations."""
    a = edges.where(F.col("relation") == first).select(*keys, "head", F.col("tail").alias("middle"))
    b = edges.where(F.col("relation") == second).select(*keys, F.col("head").alias("middle"), "tail")
    return a.join(b, [*keys, "middle"]).select(*keys, "head", "middle", "tail").distinct()


def middle_names(edges: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """``keys, player, middle_name``: from the node of a rank over its player to the full name."""
    player = edges.where((F.col("head") == rank) & (F.col("relation") == "player")).select(*keys, F.col("tail").alias("player"))
    full = edges.where(F.col("relation") == "full_name").select(*keys, F.col("head").alias("player"), F.split("tail", r"\s+").alias("w"))
    return player.join(full, [*keys, "player"]).where("size(w) >= 3").select(*keys, "player", F.col("w")[1].alias("middle_name"))


# -- entity resolution -----------------------------------------------------------------------------


def _best(column: str = "node") -> Column:
    """The most presentable name; ties go to the node met first, then to the greater name."""
    return F.max_by(F.col(column), F.struct(T.display_score(F.col(column)).alias("s"), (-F.col("first_seq")).alias("p"), F.col(column).alias("n")))


def lexical_aliases(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, canonical`` of nodes with equal keys."""
    rows = found.withColumn("_key", T.normalize_key(F.col("node")))
    best = rows.groupBy(*keys, "_key").agg(_best().alias("canonical"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(best, [*keys, "_key"]).where("node <> canonical").select(*keys, "node", "canonical")


def known_aliases(found: DataFrame, keys: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """Nodes whose key a table of aliases names; the canonical name may be new."""
    table = T.ENTITY_ALIASES | (extra or {})
    canonical = F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), T.normalize_key(F.col("node")))
    return found.withColumn("canonical", canonical).where("canonical is not null and canonical <> node").select(*keys, "node", "canonical")


def core_aliases(found: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that share a core name under different keys; literals never do."""
    rows = found.where(~T.is_literal(F.col("node"))).withColumn("_key", T.normalize_key(F.col("node"))).withColumn("_core", T.entity_core(F.col("_key"))).where("_core <> ''")
    best = rows.groupBy(*keys, "_core").agg(_best().alias("canonical"), F.min("_key").alias("_a"), F.max("_key").alias("_b")).where("_a <> _b").drop("_a", "_b")
    return rows.join(best, [*keys, "_core"]).where("node <> canonical").select(*keys, "node", "canonical")


def near_aliases(found: DataFrame, keys: list[str], threshold: float = 0.93, similar: Callable[[Column, Column], Column] = T.similarity) -> DataFrame:
    """Nodes nearly alike by ``similar`` (of two keys, 0 to 1): all pairs of one graph with equal role, numbers and negation.

    For the default similarity, pairs are dropped early only if they cannot reach ``threshold``: the matching blocks are a
    common subsequence, so the keys' edit distance is at most ``(1 - threshold)`` of their total length.  Any other
    similarity sees every pair.  A merged node takes its best partner."""
    rows = found.where(~T.is_literal(F.col("node"))).withColumn("_key", T.normalize_key(F.col("node")))
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("_key", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))), " ")
    rows = rows.withColumn("_nums", numbers).withColumn("_non", F.array_contains(F.split("_key", " "), "non"))
    by = [*keys, "has_out", "has_in", "_nums", "_non"]
    a, b = rows.select(*by, "node", "_key", "first_seq"), rows.select(*by, F.col("node").alias("node_b"), F.col("_key").alias("_key_b"), F.col("first_seq").alias("seq_b"))
    pairs = a.join(b, by).where("node < node_b")
    if similar is T.similarity:
        room = f"cast(floor({1 - threshold} * (length(_key) + length(_key_b)) + 1e-6) as int)"
        pairs = pairs.where(f"abs(length(_key) - length(_key_b)) <= {room} and levenshtein(_key, _key_b, {room}) >= 0")
    pairs = pairs.select(*keys, "node", "node_b", "_key", "_key_b", "first_seq", "seq_b").withColumn("score", similar(F.col("_key"), F.col("_key_b"))).where(F.col("score") >= threshold)
    left, right = (F.struct(T.display_score(F.col(n)).alias("s"), (-F.col(s)).alias("p")) for n, s in (("node", "first_seq"), ("node_b", "seq_b")))
    pairs = pairs.withColumn("canonical", F.when(left >= right, F.col("node")).otherwise(F.col("node_b"))).withColumn("alias", F.when(left >= right, F.col("node_b")).otherwise(F.col("node")))
    return pairs.groupBy(*keys, F.col("alias").alias("node")).agg(F.max_by("canonical", F.struct("score", "canonical")).alias("canonical"), F.max("score").alias("score"))


def merge(edges: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with aliases replaced by their canonical names at both ends."""
    a = aliases.select(*keys, F.col("node").alias("head"), F.col("canonical").alias("_h"))
    b = aliases.select(*keys, F.col("node").alias("tail"), F.col("canonical").alias("_t"))
    out = edges.join(a, [*keys, "head"], "left").join(b, [*keys, "tail"], "left")
    return out.withColumn("head", F.coalesce("_h", "head")).withColumn("tail", F.coalesce("_t", "tail")).select(*edges.columns)


def flat_aliases(log: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, canonical``: the aliases of a log with the name that they stand for in the end; a name merged in
    one tier may be merged again in a later one."""
    out = log.where(F.col("tier") == TIERS[-1]).select(*keys, "node", "canonical")
    for tier in reversed(TIERS[:-1]):
        own = log.where(F.col("tier") == tier).select(*keys, "node", "canonical")
        later = out.select(*keys, F.col("node").alias("canonical"), F.col("canonical").alias("_c"))
        moved = own.join(later, [*keys, "canonical"], "left").select(*keys, "node", F.coalesce("_c", "canonical").alias("canonical"))
        out = moved.unionByName(out.join(moved.select(*keys, "node"), [*keys, "node"], "left_anti"))
    return out


def settled(aliases: DataFrame, keys: list[str], rounds: int = 40) -> DataFrame:
    """Aliases of one tier whose canonical name is no alias itself: names follow each other to the last."""
    for _ in range(rounds):
        onward = aliases.select(*keys, F.col("node").alias("canonical"), F.col("canonical").alias("_c"))
        if aliases.join(onward, [*keys, "canonical"], "left_semi").isEmpty():
            return aliases
        moved = aliases.join(onward, [*keys, "canonical"], "left")
        aliases = materialize(moved.withColumn("canonical", F.coalesce("_c", "canonical")).drop("_c").where("node <> canonical"), "settled")
    raise RuntimeError(f"aliases still moved after {rounds} rounds")


def resolve(edges: DataFrame, keys: list[str], extra: dict[str, str] | None = None, similar: Callable[[Column, Column], Column] = T.similarity) -> tuple[DataFrame, DataFrame]:
    """Edges after all tiers, and the log ``keys, node, canonical, tier, score`` of what was merged.

    The tiers run over the nodes, which merge with their ends and first edges; the edges are rewritten once."""
    log = None
    left = materialize(nodes(edges, keys), "nodes")
    for tier, find in zip(TIERS, (lexical_aliases, lambda n, k: known_aliases(n, k, extra), core_aliases, lambda n, k: near_aliases(n, k, similar=similar))):
        found = settled(materialize(find(left, keys), tier), keys)
        entry = found.select(*keys, "node", "canonical", F.lit(tier).alias("tier"), F.round(F.col("score") if "score" in found.columns else F.lit(1.0), 4).alias("score"))
        log = entry if log is None else log.unionByName(entry)
        if tier != TIERS[-1]:
            merged = left.join(found.select(*keys, "node", F.col("canonical").alias("_c")), [*keys, "node"], "left").withColumn("node", F.coalesce("_c", "node"))
            left = materialize(merged.groupBy(*keys, "node").agg(F.max("has_out").alias("has_out"), F.max("has_in").alias("has_in"), F.min("first_seq").alias("first_seq")), "nodes")
    return merge(edges, materialize(flat_aliases(log, keys), "aliases"), keys), log


def query_index(found: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, key, node``: what a query may call a node: its key, its core if only one node has it,
    and aliases of existing nodes; the first of these wins."""
    own = found.select(*keys, T.normalize_key(F.col("node")).alias("key"), "node", F.lit(0).alias("_p"))
    core = found.select(*keys, T.entity_core(T.normalize_key(F.col("node"))).alias("key"), "node").where("key <> ''")
    core = core.groupBy(*keys, "key").agg(F.max("node").alias("node"), F.count("*").alias("_n")).where("_n = 1").select(*keys, "key", "node", F.lit(1).alias("_p"))
    other = aliases.join(found.select(*keys, F.col("node").alias("canonical")), [*keys, "canonical"], "left_semi").select(*keys, T.normalize_key(F.col("node")).alias("key"), F.col("canonical").alias("node"), F.lit(2).alias("_p"))
    return own.unionByName(core).unionByName(other).groupBy(*keys, "key").agg(F.min_by("node", F.struct("_p", "node")).alias("node"))


def to_trace(edges: DataFrame, keys: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """Each graph as one JSON document: nodes with their types (entities are heads, attributes tails), edges with
    their provenance, and aliases."""
    edge = F.struct("edge_seq", "head", "relation", "tail", *[c for c in ("source_type", "source_id", "source_group", "row_index") if c in edges.columns])
    listed = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    kinds = F.filter(F.array(F.when(F.col("has_in"), "Attribute"), F.when(F.col("has_out"), "Entity")), lambda x: x.isNotNull())
    typed = nodes(edges, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), kinds.alias("types")))).alias("nodes"))
    out = listed.join(typed, keys)
    if aliases is None:
        out = out.withColumn("aliases", F.array().cast("array<struct<alias: string, canonical: string>>"))
    else:
        named = aliases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("alias"), "canonical"))).alias("aliases"))
        out = out.join(named, keys, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast(named.schema["aliases"].dataType)))
    return out.select(*keys, F.to_json(F.struct("nodes", "edges", "aliases")).alias("trace"))


def to_dot(edges: DataFrame, keys: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """Each graph in the DOT language: values (never a head) as ellipses, table facts blue, others orange, aliases as
    dashed notes beside their names."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shape = F.when(F.col("has_out"), "box").otherwise("ellipse")
    lines = [nodes(edges, keys).select(*keys, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("s"), F.concat(quote("node"), F.lit(" [shape="), shape, F.lit("];")).alias("t")).alias("l"))]
    colour = F.when(F.col("source_type") == "table", "blue").otherwise("orange")
    line = F.concat(quote("head"), F.lit(" -> "), quote("tail"), F.lit(" [label="), quote("relation"), F.lit(", color="), colour, F.lit("];"))
    lines.append(edges.select(*keys, F.struct(F.lit(1).alias("k"), F.col("edge_seq").cast("long").alias("s"), line.alias("t")).alias("l")))
    if aliases is not None:
        note = F.concat(quote("node"), F.lit(" [shape=note, style=dashed];\n"), quote("node"), F.lit(" -> "), quote("canonical"), F.lit(" [style=dashed];"))
        lines.append(aliases.select(*keys, F.struct(F.lit(2).alias("k"), F.lit(0).cast("long").alias("s"), note.alias("t")).alias("l")))
    rows = lines[0]
    for more in lines[1:]:
        rows = rows.unionByName(more)
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit("digraph facts {\n"), body, F.lit("\n}")).alias("dot"))
