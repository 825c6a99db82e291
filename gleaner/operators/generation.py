"""The boundary to text generation: a provider is any callable from prompts to texts.

Nothing here runs a model: without a provider every step that needs one gives no rows, and the rest of
the engine works on deterministic facts, plans and programs alone.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import parse_json_list
from gleaner.operators import ir

Provider = Callable[[list[str]], list[str]]


def complete(df: DataFrame, key: str, prompt: str, provider: Provider | None) -> DataFrame:
    """``key, completion``: prompts answered batch by batch on the executors; none without provider.

    A batch that fails gives null completions and does not stop the others."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                texts = provider(batch.column(1).to_pylist())
            except Exception:  # one batch only: its rows stay unanswered
                texts = [None] * len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "completion"])

    rows = df.select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt"))
    if provider is None:
        return rows.where("false").select(F.col("_key").alias(key), F.lit(None).cast("string").alias("completion"))
    return rows.mapInArrow(run, f"_key {kind}, completion string").withColumnRenamed("_key", key)


def read_facts(completion: str | None) -> list[tuple[str, str, str]]:
    """Facts of a completion; entries without all three parts are dropped."""
    out = []
    for x in parse_json_list(completion) or []:
        if isinstance(x, dict) and all(x.get(k) not in (None, "") for k in ("head", "relation", "tail")):
            out.append((str(x["head"]), str(x["relation"]), str(x["tail"])))
    return out


def read_paths(completion: str | None) -> list[dict]:
    """Reasoning paths ``path_id, steps`` of a completion, steps numbered from one."""
    paths = []
    for i, p in enumerate(parse_json_list(completion) or []):
        steps = p.get("steps") if isinstance(p, dict) else None
        if isinstance(steps, list) and steps:
            goals = [s.get("goal", "") if isinstance(s, dict) else str(s) for s in steps]
            paths.append({"path_id": str(p.get("path_id") or f"p{i + 1}"), "steps": [{"step": n + 1, "goal": str(g), "depends_on": n or None} for n, g in enumerate(goals)]})
    return paths


def read_program(completion: str | None) -> dict | None:
    """A valid program of a completion, wrappers repaired; None if there is none."""
    import json

    try:
        text = (completion or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```")
        program, _ = ir.unwrap_operands(json.loads(text))
        ir.validate(program)
        return program
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


#: What a generated program may call.
GRAPH_CALLS = {"get_neighbors": 2, "get_sources": 2, "get_relations": 1, "filter": 2}
BUILTINS = frozenset("abs all any bool dict enumerate float int len list max min range round set sorted str sum tuple zip".split())


def code_problem(code: str, relations: set[str] | None = None) -> str | None:
    """Why generated code must not run: imports, unknown calls, a constant text as result, relations
    the graph lacks; None if nothing is wrong.  The code itself is never executed here."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return f"syntax: {e.msg}"
    constants: dict[str, object] = {}
    has_result = False
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            return "import"
        if isinstance(node, ast.Attribute) and node.attr.startswith("_"):
            return "private name"
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "kg":
                if f.attr not in GRAPH_CALLS:
                    return f"unknown call kg.{f.attr}"
                if not 1 <= len(node.args) + len(node.keywords) <= GRAPH_CALLS[f.attr]:
                    return f"wrong number of arguments of kg.{f.attr}"
                if relations is not None and len(node.args) == 2 and isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, str) and f.attr != "filter" and node.args[1].value not in relations:
                    return f"unknown relation {node.args[1].value}"
            elif isinstance(f, ast.Name) and f.id not in BUILTINS:
                return f"unknown call {f.id}"
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    constants[t.id] = node.value.value if isinstance(node.value, ast.Constant) else constants.get(node.value.id) if isinstance(node.value, ast.Name) else None
                    has_result |= t.id == "result"
    if not has_result:
        return "no result"
    return "constant result" if isinstance(constants.get("result"), str) else None


def _readers(df: DataFrame, key: str, read: Callable[[str | None], list[tuple]], fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in read(text):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], ["_key", *(n for n, _ in fields)])

    return df.select(F.col(key).alias("_key"), "completion").mapInArrow(run, f"_key {kind}, {ddl}").withColumnRenamed("_key", key)


def facts_of(completions: DataFrame, key: str) -> DataFrame:
    """``key, head, relation, tail`` of all completions."""
    text = pa.string()
    return _readers(completions, key, read_facts, [("head", text), ("relation", text), ("tail", text)], "head string, relation string, tail string")


def paths_of(completions: DataFrame, key: str) -> DataFrame:
    """``key, path_id, goals``: the reasoning paths of all completions, goals in order."""
    rows = lambda text: [(p["path_id"], [s["goal"] for s in p["steps"]]) for p in read_paths(text)]
    return _readers(completions, key, rows, [("path_id", pa.string()), ("goals", pa.list_(pa.string()))], "path_id string, goals array<string>")


def problems_of(code: Column, relations: list[str] | None = None) -> Column:
    """``code_problem`` of a column; the code is never run."""
    known = None if relations is None else set(relations)
    check = lambda s: s.map(lambda c: code_problem(c, known), na_action="ignore")
    return F.pandas_udf(check, StringType(), F.PandasUDFType.SCALAR)(code)


def batches_of(cells: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """``keys, batch, rows``: the rows of every table as JSON in batches of ``size`` rows, for prompts; a table
    without rows has one empty batch (batch 0) only where ``cells`` has a row of null ``row_index`` for it."""
    row = F.struct("col_index", "column_name", "value")
    rows = cells.groupBy(*keys, "row_index").agg(F.sort_array(F.collect_list(row)).alias("_cells"))
    text = F.to_json(F.transform("_cells", lambda c: F.struct(c["column_name"].alias("column"), c["value"].alias("value"))))
    rows = rows.withColumn("batch", F.coalesce(F.floor(F.col("row_index") / size), F.lit(0)).cast("int"))
    item = F.when(F.col("row_index").isNotNull(), F.struct("row_index", text.alias("t")))
    return rows.groupBy(*keys, "batch").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]).alias("rows"))


def logged(completions: DataFrame, path: str, content: bool = False) -> None:
    """Append one JSON line a completion: its key, length and, if asked for, its text."""
    columns = [c for c in completions.columns if c != "completion"]
    rows = completions.select(*columns, F.length("completion").alias("chars"), *([F.col("completion")] if content else []))
    rows.write.mode("append").json(path)
