import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources import adapters, sinks
from gleaner.streaming.incremental import run_incremental


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_linked_tables(spark, tmp_path):
    write(tmp_path / "q.json", {"data": [{"question_id": "q1", "question": "Who?", "table_id": "T_0", "answer-text": "Ann", "answer-node": [["Ann", [0, 0], "/wiki/Ann", "table"]]}, {"question": "What?", "table": {"header": ["a", "", "a"], "data": [["1"]], "title": "own"}}]})
    write(tmp_path / "tables/T_0.json", {"header": [["Name", []], {"value": "Team"}], "data": [[["Ann", [{"url": "/wiki/Ann", "summary": "Ann runs."}]], {"text": "Reds"}]]})
    write(tmp_path / "passages/T_0.json", {"/wiki/Ann": "again", "/wiki/Bob": ["Bob", {"text": "walks"}], "/wiki/Nil": ""})
    data = adapters.load_linked(spark, str(tmp_path / "q.json"), str(tmp_path / "tables"), str(tmp_path / "passages"))
    assert {(r["question_id"], r["answer"]) for r in data.questions.collect()} == {("q1", "Ann"), ("1", None)}
    assert {(r["column_name"], r["value"]) for r in data.cells.where("question_id = 'q1'").collect()} == {("Name", "Ann"), ("Team", "Reds")}
    assert [r["column_name"] for r in data.cells.where("question_id = '1'").orderBy("col_index").collect()] == ["a", "column_1", "a__2"]
    assert {(r["source_id"], r["text"]) for r in data.passages.collect()} == {("/wiki/Ann", "Ann runs."), ("/wiki/Bob", "Bob walks")}
    assert {r["doc"] for r in adapters.oracle_evidence(data).collect()} == {"table:T_0:row:0", "text:/wiki/Ann"}
    assert adapters.documents(data).count() == 4
    assert adapters.load_linked(spark, str(tmp_path / "q.json"), question_ids=["q1"]).questions.count() == 1


def test_reports(spark, tmp_path):
    rec = {"id": "r", "pre_text": ["one"], "post_text": ["two"], "table": [["", "2012"], ["sales", "5"]], "table_ori": [["x"]], "qa": {"question": "?", "answer": "5%", "exe_ans": 0.05, "program": "divide(1, 20)", "gold_inds": {"text_1": "two"}}}
    write(tmp_path / "f.json", [rec])
    data = adapters.load_reports(spark, str(tmp_path / "f.json"))
    assert [(r["source_id"], r["text"]) for r in data.passages.orderBy("position").collect()] == [("r:text:0", "one"), ("r:text:1", "two")]
    assert data.questions.first()["answer"] == "0.05"
    assert {(r["column_name"], r["value"]) for r in data.cells.collect()} == {("column_0", "sales"), ("2012_period", "5")}
    assert [r["text"] for r in adapters.oracle_evidence(data).collect()] == ["two"]
    with pytest.raises(ValueError):
        adapters.load_reports(spark, str(tmp_path / "f.json"), "other")


def test_hierarchical(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"id": "h", "table_id": "t", "question": "?", "answer": [5], "sub_sentence": "secret"}) + "\n\n")
    write(tmp_path / "t/t.json", {"texts": [["", "x"], ["a", "1"]], "top_header_rows_num": 1, "left_header_columns_num": 1, "merged_regions": [], "left_root": {"row_index": -1, "column_index": -1, "children": [{"row_index": 1, "column_index": 0}]}})
    data = adapters.load_hierarchical(spark, str(tmp_path / "s.jsonl"), str(tmp_path / "t"))
    assert data.questions.first()["answer"] == "5" and "secret" not in str(data.questions.collect()) and data.passages.count() == 0
    assert {(r["column_name"], r["value"]) for r in data.cells.collect()} == {("row_path", "a"), ("x", "1")}


def test_resumable_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(6).select(F.col("id").cast("string").alias("id"))
    work = lambda x: x.withColumn("error", F.lit(None).cast("string")).withColumn("em", F.lit(1.0))
    sinks.run_resumable(df, out, "id", work, limit=2)
    sinks.run_resumable(df, out, "id", work)
    rows = spark.read.json(out)
    assert sorted(r["id"] for r in rows.collect()) == list("012345")
    assert sinks.pending(df, out, "id").count() == 0
    sinks.write_summary(rows.withColumn("error", F.lit(None).cast("string")), out, ["em"])
    assert spark.read.json(out + ".summary").first()["n"] == 6


def test_incremental_run(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for part in ([{"id": "a"}, {"id": "b"}], [{"id": "b"}, {"id": "c"}]):
        spark.createDataFrame(part).write.mode("append").json(src)
        run_incremental(spark, src, "id string", out, check, "id", lambda df: df).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(out).collect()) == ["a", "b", "c"]


def test_records_need_a_list():
    with pytest.raises(ValueError):
        adapters.records_of({"x": 1})
