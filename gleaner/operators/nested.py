"""Deeply nested records as related flat tables.

Each record is parsed as a stream of path-value-ordinal triples: the path of a scalar (``[]`` for an
array step), the positions of the array steps on the way, and the value; an object or array that is an
element of an array announces itself by a triple of its own, so that no link is lost where it has no
scalar.  Paths with the same nearest repeated ancestor form a group, and each group is pivoted into one
flat table whose rows carry their own ordinals and the group and ordinals of the row they hang from; that
row always exists.  A repeated step inside itself (a tree's ``children``) is one group: its rows link to
rows of the same table.  In paths, ``\\``, ``.``, ``[`` and ``]`` of a key stand behind a ``\\``.

JSON text is read by a tokenizer without recursion, so that any depth works.  A word that is no JSON value
comes out as text; a text that breaks off gives what it holds up to there.  Both are reported, with the
place and the text from there on, in the group ``!``.  Null records and empty arrays give no rows but the
record's own; a missing member is null in the flat table; members of any scalar type come out as text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

Triple = tuple[str, tuple[int, ...], Any]
_token = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([{}\[\],:])|([^\s{}\[\],:"]+))', re.S)
_escape = re.compile(r"\\")
_special = re.compile(r"[\\.\[\]]")
_repeat = re.compile(r"((?:\.(?:\\.|[^\\.\[\]])*)?\[\])\1+")
ERRORS = "!"


class Element(NamedTuple):
    """What an element that is an object or an array announces."""


class Broken(NamedTuple):
    """Where a JSON text can't be read, and the text from there on."""

    at: int
    rest: str


def step(key: str) -> str:
    """A key as a step of a path."""
    return "." + (_special.sub(r"\\\g<0>", key) if _special.search(key) else key)


def json_triples(text: str, root: str) -> Iterator[Triple]:
    """Triples of a JSON text, in its order."""
    path: list[str] = [root]
    ordinals: list[int] = []
    stack: list[str] = []  # of open brackets
    key: str | None = None
    want_key = False
    at = 0
    while m := _token.match(text, at):
        string, mark, word = m.groups()
        if mark == "{" or mark == "[":
            if stack and stack[-1] == "[":
                yield "".join(path), tuple(ordinals), Element()
            stack.append(mark)
            if mark == "[":
                path.append("[]")
                ordinals.append(0)
            want_key = mark == "{"
        elif mark in ("}", "]"):
            if not stack:
                break
            if stack.pop() == "[":
                ordinals.pop()
                path.pop()
            if stack and stack[-1] == "{" and len(path) > 1:
                path.pop()
            want_key = False
        elif mark == ",":
            if stack and stack[-1] == "[":
                ordinals[-1] += 1
            want_key = bool(stack) and stack[-1] == "{"
        elif mark == ":":
            path.append(step(key or ""))
            want_key = False
        else:
            try:
                if word:
                    value = int(word) if word.isdecimal() and word[0] != "0" and word.isascii() else json.loads(word)
                else:
                    value = json.loads(string) if _escape.search(string) else string[1:-1]
            except ValueError:
                value = string or word
                yield root, (), Broken(m.start(), text[m.start() :])
            if want_key:
                key = str(value)
            else:
                yield "".join(path), tuple(ordinals), value
                if stack and stack[-1] == "{":
                    path.pop()
        at = m.end()
    if stack or text[at:].strip():
        yield root, (), Broken(at, text[at:])


def value_triples(value: Any, root: str) -> Iterator[Triple]:
    """Triples of nested lists and mappings, in their order."""
    todo: list[tuple[Any, str, tuple[int, ...]]] = [(value, root, ())]
    while todo:
        x, path, ordinals = todo.pop()
        if isinstance(x, dict):
            if path.endswith("[]"):
                yield path, ordinals, Element()
            todo.extend((v, path + step(k), ordinals) for k, v in reversed(x.items()))
        elif isinstance(x, (list, tuple)):
            if path.endswith("[]"):
                yield path, ordinals, Element()
            path += "[]"
            if any(isinstance(v, (dict, list, tuple)) for v in x):
                todo.extend((v, path, (*ordinals, i)) for i, v in reversed(list(enumerate(x))))
            else:
                for i, v in enumerate(x):
                    yield path, (*ordinals, i), v
        else:
            yield path, ordinals, x


def group_of(path: str) -> tuple[str, str]:
    """The group of a path (its nearest repeated ancestor, nested repetitions of one step as one) and
    the field inside the group."""
    return _group_of(path) if len(path) < 400 else _group_of.__wrapped__(path)


@lru_cache(20_000)
def _group_of(path: str) -> tuple[str, str]:
    head, found, field = path.rpartition("[]")
    group = _repeat.sub(r"\1", head + found) if found else ""
    return group, (field[1:] if field.startswith(".") else field) if found else path


def parent_group(path: str) -> str:
    """The group of the row that the row of a path hangs from."""
    return group_of(path.rpartition("[]")[0])[0]


class Shredded:
    """The flat tables of one record: group -> ordinals -> field -> value, and the parents of its rows."""

    def __init__(self, record: dict[str, Any], json_columns: frozenset[str] = frozenset()) -> None:
        self.tables: dict[str, dict[tuple[int, ...], dict[str, Any]]] = {"": {(): {}}}
        self.above: dict[tuple[str, tuple[int, ...]], str] = {}
        known: dict[str, tuple[dict, str, str, str]] = {}
        for name, value in record.items():
            if value is None:
                continue
            for path, ordinals, x in json_triples(value, name) if name in json_columns else value_triples(value, name):
                if isinstance(x, Broken):
                    errors = self.tables.setdefault(ERRORS, {})
                    errors[(len(errors),)] = {"column": name, "at": x.at, "rest": x.rest}
                    continue
                where = known.get(path)
                if where is None:
                    group, field = group_of(path)
                    where = known[path] = (self.tables.setdefault(group, {}), field, group, parent_group(path))
                rows, field, group, above = where
                row = rows.get(ordinals)
                if row is None:
                    row = rows[ordinals] = {}
                    if above != group:
                        self.above[group, ordinals] = above
                if not isinstance(x, Element):
                    row[field] = x

    def rows(self) -> Iterator[tuple[str, tuple[int, ...], str | None, tuple[int, ...] | None, dict[str, Any]]]:
        """``group, row, parent's group, parent, fields``; a record's own row has no parent."""
        for group, rows in self.tables.items():
            for place, fields in rows.items():
                own = None if not group else "" if group == ERRORS else self.above.get((group, place), group)
                yield group, place, own, place[:-1] if group else None, fields


def _text(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _keyed(df: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, str]:
    """The keys under names of their own before the columns, and their types."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.select(*named, *columns), ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in df.columns if not re.fullmatch(r"_k\d+", c)])


def triples(df: DataFrame, keys: list[str], columns: list[str], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, path, ordinals, kind, value)`` of every scalar (``value``), element (``element``) and
    break (``broken``, with the text from there on) in ``columns``."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, places, kinds, values = [], [], [], [], []
            for i, row in enumerate(batch.select(columns).to_pylist()):
                for name, value in row.items():
                    if value is None:
                        continue
                    for path, ordinals, x in json_triples(value, name) if name in json_columns else value_triples(value, name):
                        at.append(i)
                        paths.append(path)
                        places.append(ordinals)
                        kinds.append("element" if isinstance(x, Element) else "broken" if isinstance(x, Broken) else "value")
                        values.append(None if isinstance(x, Element) else x.rest if isinstance(x, Broken) else _text(x))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(paths, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], [*(f"_k{i}" for i in range(n)), "path", "ordinals", "kind", "value"])

    source, ddl = _keyed(df, keys, columns)
    return _renamed(source.mapInArrow(run, f"{ddl}, path string, ordinals array<int>, kind string, value string"), keys)


def related(df: DataFrame, keys: list[str], columns: list[str], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, group, row, parent_group, parent, fields)``: the rows of all flat tables, ``row`` and
    ``parent`` by ordinals, ``fields`` a map.  ``keys`` should tell records apart.  A record is taken apart
    where it lies: nothing is shuffled."""
    from_json, n = frozenset(json_columns), len(keys)
    places = pa.list_(pa.int32())
    kinds = [pa.string(), places, pa.string(), places, pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, record in enumerate(batch.select(columns).to_pylist()):
                for group, row, above, parent, fields in Shredded(record, from_json).rows():
                    at.append(i)
                    out.append((group, row, above, parent, [(k, _text(v)) for k, v in fields.items()]))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*own, *made], [*(f"_k{i}" for i in range(n)), "group", "row", "parent_group", "parent", "fields"])

    source, ddl = _keyed(df, keys, columns)
    return _renamed(source.mapInArrow(run, f"{ddl}, group string, row array<int>, parent_group string, parent array<int>, fields map<string,string>"), keys)


def pivot(rows: DataFrame, keys: list[str], group: str, fields: dict[str, str]) -> DataFrame:
    """One flat table: ``keys, row, parent`` and a column for each ``{field: type}`` of the group."""
    picked = [F.element_at("fields", F.lit(f)).try_cast(t).alias(f or "value") for f, t in fields.items()]
    return rows.where(F.col("group") == group).select(*keys, "row", "parent", *picked)


# -- tables with merged regions and a tree of row headers ------------------------------------------

NODES = "left_root.children[]"
TABLE = ["texts", "top_header_rows_num", "left_header_columns_num", "merged_regions", "left_root"]


def _int(x: Any, default: int = -1) -> int:
    if isinstance(x, bool) or x is None:
        return default
    try:
        return int(x)
    except (ValueError, OverflowError):
        try:
            return int(float(x))
        except (ValueError, OverflowError):
            return default


def _joined(labels: list[str], by: str) -> str:
    return by.join(x for i, x in enumerate(labels) if not i or labels[i - 1] != x)


def fill_regions(cells: list[list[str]], regions: list[dict[str, Any]]) -> None:
    """Give the first cell's text to every existing cell of each region, in the regions' order.

    Regions with a missing bound or whose first cell doesn't exist change nothing."""
    for r in regions:
        top, bottom, left, right = (_int(r.get(k)) for k in ("first_row", "last_row", "first_column", "last_column"))
        if 0 <= top < len(cells) and 0 <= left < len(cells[top]):
            text = cells[top][left]
            for row in cells[top : bottom + 1]:
                stop = min(right + 1, len(row))
                if stop > left:
                    row[left:stop] = [text] * (stop - left)


class HierarchicalTable:
    """A record's flat tables put together: filled cells, row nodes with labels, header paths."""

    def __init__(self, record: dict[str, Any]) -> None:
        tables = Shredded(record, frozenset(["left_root"])).tables
        scalars = tables[""][()]
        self.top = max(0, _int(scalars.get("top_header_rows_num"), 1))
        self.left = max(0, _int(scalars.get("left_header_columns_num"), 1))
        self.cells: list[list[str]] = [[] for _ in record.get("texts") or ()]
        for place, f in tables.get("texts[]", {}).items():  # in the order of the matrix
            if len(place) == 2:
                self.cells[place[0]].append((_text(f.get("")) or "").strip())
        fill_regions(self.cells, [f for _, f in sorted(tables.get("merged_regions[]", {}).items())])
        self.nodes: dict[tuple[int, ...], tuple[int, int, str]] = {}
        nodes = tables.get(NODES, {})
        if nodes or "left_root.row_index" in scalars or "left_root.column_index" in scalars:
            self._node((), {"row_index": scalars.get("left_root.row_index"), "column_index": scalars.get("left_root.column_index")})
        for place, f in nodes.items():
            self._node(place, f)
        self.deepest: dict[int, tuple[int, ...]] = {}
        for place, (row, _, _) in sorted(self.nodes.items()):
            if row >= 0 and (row not in self.deepest or len(place) >= len(self.deepest[row])):
                self.deepest[row] = place

    def _node(self, place: tuple[int, ...], fields: dict[str, Any]) -> None:
        row, column = _int(fields.get("row_index")), _int(fields.get("column_index"))
        inside = 0 <= row < len(self.cells) and 0 <= column < len(self.cells[row])
        self.nodes[place] = row, column, self.cells[row][column] if inside else ""

    def row_header(self, row: int) -> tuple[int, str]:
        """The row of the parent node (-1 if there is none) and the row's path."""
        place, parent, path = self.deepest.get(row), -1, ""
        if place is not None:
            above = (self.nodes.get(place[:i]) for i in range(len(place) + 1))
            path = _joined([n[2] for n in above if n and n[2]], " / ")
            if len(place) > 1:
                parent = self.nodes.get(place[:-1], (-1,))[0]
        path = path or _joined([x for x in self.cells[row][: self.left] if x], " / ")
        return parent, path or f"row_{row}"

    def column_header(self, column: int) -> str:
        labels = [r[column] for r in self.cells[: self.top] if column < len(r) and r[column]]
        return _joined(labels, "__") or f"column_{column}"

    def data(self) -> Iterator[tuple[int, int, int, str, str, str]]:
        """``row, column, parent row, row path, column path, text`` of every non-blank data cell."""
        columns: dict[int, str] = {}
        for row in range(self.top, len(self.cells)):
            header = None
            for column in range(self.left, len(self.cells[row])):
                if text := self.cells[row][column]:
                    header = header or self.row_header(row)
                    if column not in columns:
                        columns[column] = self.column_header(column)
                    yield row, column, header[0], header[1], columns[column], text


#: So many re-delivered keys are sent to the executors, so that only their records are shuffled.
SENT_KEYS = 1_000_000


def latest(df: DataFrame, key: str, at: str, columns: list[str], sent_keys: int = SENT_KEYS) -> DataFrame:
    """One row for each non-null ``key``: the delivery with the greatest ``at`` (nulls first).

    Keys that come more than once are found on the two narrow columns.  Only their records are shuffled,
    unless there are more than ``sent_keys`` of them."""
    rows = df.where(F.col(key).isNotNull())
    again = materialize(rows.groupBy(key).count().where("count > 1").select(key), "again")

    def best(some: DataFrame) -> DataFrame:
        order: Column = F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
        return some.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in columns])

    n = again.count()
    if not n:
        return rows.select(key, *columns)
    if n > sent_keys:
        return best(rows)
    sent = F.broadcast(again)
    return rows.join(sent, key, "left_anti").select(key, *columns).unionByName(best(rows.join(sent, key, "left_semi")))


def _per_table(df: DataFrame, rows_of, schema: pa.Schema, ddl: str) -> DataFrame:
    source = latest(df, "table_id", "ingested_at", TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                key = record.pop("table_id")
                out += [(key, *r) for r in rows_of(HierarchicalTable(record))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return source.mapInArrow(run, ddl)


def hierarchical_cells(df: DataFrame) -> DataFrame:
    """``table_id, row_index, column_index, parent_row_index, row_path, column_path, value`` of every
    non-blank cell under the top header and right of the left header, once a table."""
    names = ["table_id", "row_index", "column_index", "parent_row_index", "row_path", "column_path", "value"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    ddl = "table_id string, row_index int, column_index int, parent_row_index int, row_path string, column_path string, value string"
    return _per_table(df, HierarchicalTable.data, pa.schema(list(zip(names, kinds))), ddl)


def row_nodes(df: DataFrame) -> DataFrame:
    """``table_id, node, parent, row_index, column_index, label``: the nodes of the row tree; ``node``
    and ``parent`` are ordinals from the root, which is the empty list."""
    ddl = "table_id string, node array<int>, parent array<int>, row_index int, column_index int, label string"
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string()]

    def rows(t: HierarchicalTable) -> Iterator[tuple]:
        for place, (row, column, label) in t.nodes.items():
            yield place, place[:-1] if place else None, row, column, label

    return _per_table(df, rows, pa.schema(list(zip(["table_id", "node", "parent", "row_index", "column_index", "label"], kinds))), ddl)


def header_labels(df: DataFrame) -> DataFrame:
    """``table_id, column_index, level, label``: the non-blank top header cells once regions are filled."""

    def rows(t: HierarchicalTable) -> Iterator[tuple]:
        for level, cells in enumerate(t.cells[: t.top]):
            yield from ((j, level, x) for j, x in enumerate(cells) if x and j >= t.left)

    schema = pa.schema([("table_id", pa.string()), ("column_index", pa.int32()), ("level", pa.int32()), ("label", pa.string())])
    return _per_table(df, rows, schema, "table_id string, column_index int, level int, label string")
