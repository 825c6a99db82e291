"""Question-answering data sets read from JSON into long tables.

Each adapter gives a ``Dataset`` of ``questions``, ``cells`` and ``passages`` keyed by ``question_id``.
Records may be a list or lie under ``data``, ``examples`` or ``records``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import nested, tables
from gleaner.session import materialize

WRAPPERS = ["data", "examples", "records"]
QUESTION_DDL = "question_id string, position long, dataset string, question string, table_id string, answer string, metadata string"
CELL_DDL = "question_id string, table_name string, row_index int, col_index int, column_name string, value string"
PASSAGE_DDL = "question_id string, source_type string, source_id string, position int, text string"


@dataclass
class Dataset:
    questions: DataFrame
    cells: DataFrame
    passages: DataFrame


def records_of(payload: Any) -> list:
    """The records of a parsed file."""
    if isinstance(payload, list):
        return payload
    if isinstance(payload, dict):
        for name in WRAPPERS:
            if isinstance(payload.get(name), list):
                return payload[name]
    raise ValueError("no list of records")


def read_records(spark: SparkSession, path: str | DataFrame, lines: bool = False) -> DataFrame:
    """``position, record``: every record of JSON files as JSON text, in the order of files and records; a table of
    these is taken as it is.

    Whole files are split on the executors; with ``lines`` every line is a record."""
    if isinstance(path, DataFrame):
        return path
    if lines:
        rows = spark.read.text(path).where("trim(value) <> ''")
        return rows.select(F.monotonically_increasing_id().alias("position"), F.col("value").alias("record"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # positions of one file never meet those of another: files are numbered by name
    names = sorted(r["path"] for r in files.select("path").collect())
    numbered = spark.createDataFrame([(n, i << 32) for i, n in enumerate(names)], "path string, start long")
    files = files.join(F.broadcast(numbered), "path").select("start", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = records_of(json.loads(content))
                yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(found)), pa.int64()), pa.array([json.dumps(r, ensure_ascii=False) for r in found], pa.string())], ["position", "record"])

    return files.mapInArrow(split, "position long, record string")


def read_named(spark: SparkSession, folder: str | DataFrame) -> DataFrame:
    """``name, content`` of the JSON files of a folder, by file name without ending; a table of these is taken as it
    is."""
    if isinstance(folder, DataFrame):
        return folder
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_replace(F.regexp_extract(F.try_url_decode("path"), r"([^/]+)$", 1), r"\.json$", "")
    return files.select(name.alias("name"), F.decode("content", "UTF-8").alias("content"))


# -- cells and passages of one record ----------------------------------------------------------------


def cell_text(cell: Any) -> str:
    if isinstance(cell, dict):
        cell = cell.get("value", cell.get("text", ""))
    elif isinstance(cell, list):
        cell = cell[0] if cell else ""
    return "" if cell is None else str(cell)


def cell_links(cell: Any) -> list:
    links = cell.get("urls", cell.get("links")) if isinstance(cell, dict) else cell[1] if isinstance(cell, list) and len(cell) > 1 else None
    return [links] if isinstance(links, dict) else links if isinstance(links, list) else []


def link_passage(link: Any, name: str) -> tuple[str, str] | None:
    if isinstance(link, dict):
        text = next((link[k] for k in ("summary", "text", "passage") if link.get(k)), None)
        name = link.get("url") or link.get("id") or name
    elif isinstance(link, list) and len(link) > 1:
        name, text = link[0], link[1]
    else:
        return None
    return (str(name), str(text)) if text else None


def passage_text(value: Any) -> str:
    """A passage of any shape as text."""
    if isinstance(value, dict):
        return next((passage_text(value[k]) for k in ("text", "summary", "passage") if k in value), "")
    if isinstance(value, list):
        return " ".join(x for x in map(passage_text, value) if x)
    return "" if value is None else str(value)


def linked_table(table: dict, name: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Cells and linked passages (each id once) of a table whose cells may carry links.

    Repeated headers get suffixes, so no value is lost."""
    names, _ = tables.header_names([[cell_text(c) for c in table.get("header") or [""]]])
    cells, passages = [], {}
    for i, row in enumerate(table.get("data") or []):
        for j, column in enumerate(names):
            cells.append((i, j, column, cell_text(row[j]) if j < len(row) else ""))
        for j, cell in enumerate(row):
            for n, link in enumerate(cell_links(cell)):
                if found := link_passage(link, f"{name}:{i}:{j}:{n}"):
                    passages.setdefault(*found)
    for key in ("passages", "text_passages"):
        for n, p in enumerate(table.get(key) or []):
            if found := link_passage(p, f"{name}:passage:{n}"):
                passages.setdefault(*found)
    return cells, list(passages.items())


KINDS = {"questions": QUESTION_DDL, "cells": CELL_DDL, "passages": PASSAGE_DDL}


def _dataset(rows: DataFrame, parse) -> Dataset:
    """A data set from ``position, record, table, extra``: every record is parsed once, and the parsed rows are
    written before their parts are read."""
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    structs = {k: pa.list_(pa.struct([(f.split()[0], types[f.split()[1]]) for f in ddl.split(", ")])) for k, ddl in KINDS.items()}
    names = {k: [f.split()[0] for f in ddl.split(", ")] for k, ddl in KINDS.items()}
    load = lambda x: None if x is None else json.loads(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in KINDS}
            for r in batch.to_pylist():
                made = parse(r["position"], load(r["record"]), load(r["table"]), load(r["extra"]))
                for k in KINDS:
                    out[k].append([dict(zip(names[k], row)) for row in made[k]])
            yield pa.RecordBatch.from_arrays([pa.array(out[k], structs[k]) for k in KINDS], list(KINDS))

    ddl = ", ".join(f"{k} array<struct<" + ", ".join(f.replace(" ", ": ") for f in d.split(", ")) + ">>" for k, d in KINDS.items())
    parsed = materialize(rows.mapInArrow(run, ddl), "parsed")
    return Dataset(*(parsed.select(F.inline(k)) for k in KINDS))


def _json(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _linked(position: int, r: dict, table: dict | None, extra: Any) -> dict[str, list[tuple]]:
    qid = str(r.get("question_id") or r.get("id") or position)
    own = r["table"] if isinstance(r.get("table"), dict) else table or {}
    tid = str(r.get("table_id") or own.get("uid") or position)
    cells, passages = linked_table(own, tid)
    if extra is not None:
        more = extra.items() if isinstance(extra, dict) else enumerate(extra)
        known = {k for k, _ in passages}
        passages += [(str(k), t) for k, v in more if str(k) not in known and (t := passage_text(v))]
    answer = next((r[k] for k in ("answer_text", "answer-text", "answer") if k in r), None)
    name = own.get("title") or tid
    return {
        "questions": [(qid, position, "hybridqa", str(r.get("question", "")), tid, _json(answer), json.dumps({"answer_nodes": r.get("answer-node", [])}, ensure_ascii=False))],
        "cells": [(qid, name, *c) for c in cells],
        "passages": [(qid, "text", k, i, t) for i, (k, t) in enumerate(passages)],
    }


def load_linked(spark: SparkSession, path: str | DataFrame, tables_dir: str | DataFrame | None = None, passages_dir: str | DataFrame | None = None, question_ids: list[str] | None = None) -> Dataset:
    """Questions on tables with linked passages; tables and passages lie in the record or in folders,
    and are joined by table id only for the wanted questions."""
    rows = read_records(spark, path)
    tid = F.get_json_object("record", "$.table_id")
    if question_ids is not None:
        rows = rows.where(F.coalesce(F.get_json_object("record", "$.question_id"), F.get_json_object("record", "$.id"), F.col("position").cast("string")).isin(question_ids))
    rows = rows.withColumn("_tid", tid)
    for column, folder in (("table", tables_dir), ("extra", passages_dir)):
        if folder is not None:
            named = read_named(spark, folder).select(F.col("name").alias("_tid"), F.col("content").alias(column))
            rows = rows.join(named, "_tid", "left")
        else:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    return _dataset(rows.select("position", "record", "table", "extra"), _linked)


def load_reports(spark: SparkSession, path: str | DataFrame, table_format: str = "official") -> Dataset:
    """Questions on a report's table and its paragraphs before and after."""
    if table_format not in ("official", "raw"):
        raise ValueError("table_format is official or raw")
    order = ("table", "table_ori") if table_format == "official" else ("table_ori", "table")

    def parse(position: int, r: dict, _t: Any, _e: Any) -> dict[str, list[tuple]]:
        qid, qa = str(r.get("id") or r.get("filename") or position), r.get("qa") or {}
        matrix = next((r[k] for k in order if r.get(k)), [])
        names, skip = tables.header_names(matrix) if matrix and matrix[0] else ([], 1)
        cells = [(qid, qid, i, j, names[j] if j < len(names) else f"column_{j}", cell_text(v)) for i, row in enumerate(matrix[skip:]) for j, v in enumerate(row)]
        texts = [*(r.get("pre_text") or []), *(r.get("post_text") or [])]
        meta = {k: qa.get(k) for k in ("answer", "program", "program_re", "gold_inds")}
        return {"questions": [(qid, position, "finqa", str(qa.get("question", "")), qid, _json(qa.get("exe_ans", qa.get("answer"))), json.dumps(meta, ensure_ascii=False))], "cells": cells, "passages": [(qid, "text", f"{qid}:text:{i}", i, str(t)) for i, t in enumerate(texts)]}

    none = F.lit(None).cast("string")
    return _dataset(read_records(spark, path).withColumn("table", none).withColumn("extra", none), parse)


def load_hierarchical(spark: SparkSession, path: str | DataFrame, tables_dir: str | DataFrame) -> Dataset:
    """Questions (one a line) on hierarchical tables; texts that give the answer away are left out."""

    def parse(position: int, r: dict, table: Any, _e: Any) -> dict[str, list[tuple]]:
        qid, tid = str(r["id"]), str(r["table_id"])
        answer = r.get("answer")
        answer = answer[0] if isinstance(answer, list) and len(answer) == 1 else answer
        cells = []
        if table:
            t = nested.HierarchicalTable({**table, "left_root": json.dumps(table.get("left_root"))})
            cells = [(qid, tid, row, column, cp, text) for row, column, _, _, cp, text in t.data()]
            cells += [(qid, tid, row, 0, "row_path", t.row_header(row)[1]) for row in sorted({c[2] for c in cells})]
        meta = {k: r.get(k) for k in ("aggregation", "answer_formulas", "reference_cells_map", "linked_cells")}
        return {"questions": [(qid, position, "hitab", str(r.get("question", "")), tid, _json(answer), json.dumps(meta, ensure_ascii=False))], "cells": cells, "passages": []}

    rows = read_records(spark, path, lines=True).withColumn("_tid", F.get_json_object("record", "$.table_id"))
    named = read_named(spark, tables_dir).select(F.col("name").alias("_tid"), F.col("content").alias("table"))
    return _dataset(rows.join(named, "_tid", "left").select("position", "record", "table", F.lit(None).cast("string").alias("extra")), parse)


def oracle_evidence(data: Dataset) -> DataFrame:
    """``question_id, doc, text``: the evidence that a data set marks as gold, each once."""
    q = data.questions
    nodes = q.select("question_id", F.explode(F.from_json(F.get_json_object("metadata", "$.answer_nodes"), "array<array<string>>")).alias("n"))
    where = nodes.select("question_id", F.from_json(F.get("n", F.lit(1)), "array<int>")[0].alias("row_index"), F.get("n", F.lit(2)).alias("source_id"))
    rows = tables.row_documents(data.cells.join(where.select("question_id", "row_index").distinct(), ["question_id", "row_index"]), ["question_id"])
    texts = data.passages.join(where.select("question_id", "source_id").distinct(), ["question_id", "source_id"]).select("question_id", F.concat(F.lit("text:"), "source_id").alias("doc"), "text")
    gold = q.select("question_id", F.explode(F.from_json(F.get_json_object("metadata", "$.gold_inds"), "map<string,string>")).alias("doc", "text")).withColumn("doc", F.concat(F.lit("gold:"), "doc"))
    return rows.unionByName(texts).unionByName(gold).dropDuplicates(["question_id", "doc"])


def documents(data: Dataset) -> DataFrame:
    """``question_id, doc, text``: table rows and passages as comparable texts."""
    texts = data.passages.select("question_id", F.concat("source_type", F.lit(":"), "source_id").alias("doc"), "text")
    return tables.row_documents(data.cells, ["question_id"]).unionByName(texts)
