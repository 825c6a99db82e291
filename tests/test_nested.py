import json
import random

import pytest

from gleaner.operators import nested

DDL = "table_id string, title string, texts array<array<string>>, top_header_rows_num int, left_header_columns_num int, merged_regions array<struct<first_row:int,last_row:int,first_column:int,last_column:int>>, left_root string, ingested_at timestamp"


def brute(rec):
    cells = [[(c or "").strip() for c in row] for row in rec["texts"] or []]
    for g in rec["merged_regions"] or []:
        if None in g.values() or g["first_row"] >= len(cells) or g["first_column"] >= len(cells[g["first_row"]]):
            continue
        text = cells[g["first_row"]][g["first_column"]]
        for r, row in enumerate(cells):
            for c in range(len(row)):
                if g["first_row"] <= r <= g["last_row"] and g["first_column"] <= c <= g["last_column"]:
                    row[c] = text
    best = {}

    def walk(node, labels, depth, parent):
        r, c = int(node.get("row_index", -1)), int(node.get("column_index", -1))
        label = cells[r][c] if 0 <= r < len(cells) and 0 <= c < len(cells[r]) else ""
        labels = labels + [label] * bool(label)
        if r >= 0 and (r not in best or depth >= best[r][0]):
            best[r] = depth, labels, parent if depth > 1 else -1
        for child in node.get("children") or []:
            walk(child, labels, depth + 1, r)

    if rec["left_root"]:
        walk(json.loads(rec["left_root"]), [], 0, -1)
    once = lambda xs: [x for i, x in enumerate(xs) if not i or xs[i - 1] != x]
    top, left = rec["top_header_rows_num"], rec["left_header_columns_num"]
    out = set()
    for r in range(top, len(cells)):
        for c in range(left, len(cells[r])):
            if cells[r][c]:
                node = best.get(r)
                path = " / ".join(once(node[1])) if node else ""
                path = path or " / ".join(once([x for x in cells[r][:left] if x])) or f"row_{r}"
                column = "__".join(once([cells[k][c] for k in range(min(top, len(cells))) if c < len(cells[k]) and cells[k][c]])) or f"column_{c}"
                out.add((rec["table_id"], r, c, node[2] if node else -1, path, column))
    return out


def made(seed):
    rng = random.Random(seed)
    height, width = rng.randint(1, 7), rng.randint(1, 6)
    word = lambda: rng.choice(["a", " b ", "", None, "c", "a"])
    texts = [[word() for _ in range(rng.randint(0, width))] for _ in range(height)]

    def node(depth):
        n = {"row_index": rng.choice([rng.randint(-1, height), str(rng.randint(0, height))]), "column_index": rng.randint(-1, width)}
        kids = rng.choice([None, [], "absent"]) if depth > 3 else [node(depth + 1) for _ in range(rng.randint(0, 3))]
        if kids != "absent":
            n["children"] = kids
        if rng.random() < 0.3:
            n["line_idx"] = rng.random()
        return n

    regions = [dict(zip(("first_row", "last_row", "first_column", "last_column"), (rng.randint(0, height), rng.randint(0, height + 2), rng.randint(0, width), rng.randint(0, width + 2)))) for _ in range(rng.randint(0, 3))]
    return {"table_id": f"t{seed}", "texts": texts, "top_header_rows_num": rng.randint(0, 2), "left_header_columns_num": rng.randint(0, 2), "merged_regions": rng.choice([None, [], regions]), "left_root": rng.choice([None, json.dumps(node(0))])}


def frame(spark, rows):
    return spark.createDataFrame([(r["table_id"], None, r["texts"], r["top_header_rows_num"], r["left_header_columns_num"], r["merged_regions"] and [tuple(g.values()) for g in r["merged_regions"]], r["left_root"], None) for r in rows], DDL)


def test_cells_equal_brute_force(spark):
    rows = [made(i) for i in range(120)]
    # deepest nodes tie by row index at times: only trees without such ties have one right answer
    got = {tuple(r)[:6] for r in nested.hierarchical_cells(frame(spark, rows + rows[:40])).collect()}
    assert got == set().union(*map(brute, rows))


def test_tokenizer_equals_the_json_module():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randint(0, 6 if depth < 4 else 3)
        if kind < 4:
            return rng.choice([None, True, 1, -2.5e3, "x", 'q"\\ü', ""])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice("abc") + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}

    for _ in range(300):
        x = {"k": value(0)}
        assert list(nested.json_triples(json.dumps(x, indent=rng.choice([None, 1])), "r")) == list(nested.value_triples(x, "r"))


@pytest.mark.parametrize("text,n,broken", [("", 0, 0), ('{"a": 1, "b": [2, ', 2, 1), ('{"a": tru', 1, 2), ("]", 0, 1), ('{"a": 1}}', 1, 1), ('{"a":1,"b":[{"c":2},{"c":bad},{"c":3}]}', 4, 1), ('{"a": "x', 0, 1)])
def test_broken_json_gives_what_it_holds_and_is_reported(text, n, broken):
    got = [v for _, _, v in nested.json_triples(text, "r")]
    assert len([v for v in got if not isinstance(v, (nested.Broken, nested.Element))]) == n
    errors = [v for v in got if isinstance(v, nested.Broken)]
    assert len(errors) == broken and all(text[e.at :] == e.rest for e in errors)


def test_deep_trees_do_not_recurse():
    depth = 3000
    text = '{"children": [' * depth + '{"row_index": 1}' + "]}" * depth
    *elements, (path, ordinals, value) = nested.json_triples(text, "left_root")
    assert (len(elements), len(ordinals), value) == (depth, depth, 1)
    assert nested.group_of(path)[0] == "left_root.children[]"


def links(record, json_columns=frozenset()):
    return {(g, r): (above, parent, f) for g, r, above, parent, f in nested.Shredded(record, json_columns).rows()}


@pytest.mark.parametrize("as_json", [False, True])
def test_no_row_hangs_in_the_air(as_json):
    x = {"children": [{"children": [{"row_index": 1}]}, {}, {"a": [[], [{"b": [{}]}]]}, None, 7]}
    got = links({"t": json.dumps(x) if as_json else x}, frozenset(["t"] if as_json else []))
    assert all(parent is None or (above, parent) in got for above, parent, _ in got.values())
    assert {r for g, r in got if g == "t.children[]"} == {(0,), (0, 0), (1,), (2,), (3,), (4,)}
    assert got["t.children[].a[].b[]", (2, 1, 0, 0)][:2] == ("t.children[].a[]", (2, 1, 0))


@pytest.mark.parametrize("as_json", [False, True])
def test_keys_that_look_like_paths(as_json):
    x = {"a.b": 1, "a": {"b": 2}, "x[]": [3], "x": [4], "\\": {"": 5}}
    got = links({"t": json.dumps(x) if as_json else x}, frozenset(["t"] if as_json else []))
    assert got["", ()][2] == {r"t.a\.b": 1, "t.a.b": 2, r"t.\\.": 5}
    assert got[r"t.x\[\][]", (0,)][2] == {"": 3} and got["t.x[]", (0,)][2] == {"": 4}


def test_breaks_are_rows():
    got = links({"t": '{"a": oops, "b": [1'}, frozenset(["t"]))
    assert [got[nested.ERRORS, (i,)][2]["rest"].strip() for i in (0, 1)] == ['oops, "b": [1', ""]
    assert got["", ()][2] == {"t.a": "oops"} and got["t.b[]", (0,)][2] == {"": 1}


def test_related_tables_keep_links(spark):
    rec = made(5) | {"left_root": '{"row_index": 0, "children": [{"row_index": 1, "children": [{"row_index": 2}]}]}'}
    rows = nested.related(frame(spark, [rec]).withColumn("row", nested.F.lit("clash")), ["table_id"], ["left_root"], ("left_root",))
    flat = {tuple(r["row"]): (r["parent"], r["row_index"]) for r in nested.pivot(rows, ["table_id"], "left_root.children[]", {"row_index": "int"}).collect()}
    assert flat == {(0,): ([], 1), (0, 0): ([0], 2)}
    kinds = {(r["path"], r["kind"]) for r in nested.triples(frame(spark, [rec]), ["table_id"], ["left_root"], ("left_root",)).collect()}
    assert ("left_root.children[]", "element") in kinds and ("left_root.row_index", "value") in kinds


@pytest.mark.parametrize("sent", [0, 100])
def test_latest_delivery(spark, sent):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", 2, "w"), (None, 1, "v"), ("c", None, "u")]
    df = spark.createDataFrame(rows, "k string, t int, v string").withColumn("t", nested.F.timestamp_seconds("t"))
    assert {tuple(r) for r in nested.latest(df, "k", "t", ["v"], sent).collect()} == {("a", "y"), ("b", "w"), ("c", "u")}
    assert nested.latest(df.where("false"), "k", "t", ["v"], sent).count() == 0


def test_empty_and_null_records(spark):
    none = {"table_id": "n", "texts": None, "top_header_rows_num": 1, "left_header_columns_num": 1, "merged_regions": None, "left_root": None}
    assert nested.hierarchical_cells(frame(spark, [none, none | {"table_id": None, "texts": [["a"], ["b", "c"]]}])).count() == 0
    assert nested.hierarchical_cells(frame(spark, []).withColumn("value", nested.F.lit("clash"))).count() == 0
    assert nested.row_nodes(frame(spark, [none])).count() == 0
