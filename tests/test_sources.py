from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import readers as R
from tallyforge.sources import sinks as K


def test_files_and_stems(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name in ("b.json", "a.json", "c.yml", "below/d.yaml", "below/e.json"):
        (tmp_path / name).write_text("{}")
    assert [r["stem"] for r in R.stems(spark, str(tmp_path), ".json").collect()] == ["a", "b"]
    assert sorted(r["stem"] for r in R.specs(spark, [str(tmp_path)]).collect()) == ["c", "d"]
    assert sorted(r["stem"] for r in R.files(spark, [str(tmp_path)], "*.json").collect()) == ["a", "b", "e"]
    assert R.expanded(f"{tmp_path}/a.json, {tmp_path}/below") == [f"{tmp_path}/a.json", f"{tmp_path}/below/d.yaml", f"{tmp_path}/below/e.json"]
    assert R.expanded('["x", "y"]') == ["x", "y"]


def test_tools(spark, tmp_path):
    (tmp_path / "f_tool_spec_7__My_Tool.json").write_text('{"tool_name": "My Tool"}')
    (tmp_path / "odd.json").write_text("{broken")
    found = {r["id"]: r for r in R.tools(spark, [str(tmp_path)]).collect()}
    assert tuple(found["f_tool_spec_7__My_Tool"])[1:4] == ("f", 7, "My_Tool") and found["odd"]["tool"] is None and found["odd"]["field"] == "unknown"


def test_json_rows(spark, tmp_path):
    lines, whole, one = tmp_path / "l.json", tmp_path / "w.json", tmp_path / "o.json"
    lines.write_text('# note\n{"a": 1}\n\n[1]\n{"a": 2}\n')
    whole.write_text('[\n {"a": 3},\n 4\n]')
    one.write_text('{\n "a": 5\n}')
    assert sorted(r["a"] for r in R.json_rows(spark, str(lines)).collect()) == [1, 2]
    assert [r["a"] for r in R.json_rows(spark, str(whole)).collect()] == [3]
    assert [r["a"] for r in R.json_rows(spark, str(one)).collect()] == [5]


def test_embeddings(spark, tmp_path):
    np.savez(tmp_path / "x.npz", embedding=np.array([1.0, 2.0], np.float32), id="given", model="m", text_length=3)
    np.savez(tmp_path / "y.npz", embedding=np.ones((2, 2)))
    (tmp_path / "z.npz").write_bytes(b"no")
    found = {r["id"]: r for r in R.embeddings(spark, str(tmp_path)).collect()}
    assert list(found["given"]["embedding"]) == [1.0, 2.0] and found["given"]["text_length"] == 3
    assert found["y"]["embedding"] is None and found["z"]["embedding"] is None
    with pytest.raises(Exception):
        R.embeddings(spark, str(tmp_path), strict=True).collect()


def test_logs(spark, tmp_path):
    folder = tmp_path / "f_tool_spec_1__T"
    folder.mkdir()
    (folder / "meta_data_tool_call.json").write_text("{}")
    (folder / "meta_data_tool_call.judge.json").write_text('{"judgment": "correct"}')
    (folder / "Tool_call_12.json").write_text("{}")
    (folder / "tool_calls.json").write_text('{"Tool call 1": {"Failure mode": "m", "Tool parameters": "p", "Tool call message": "T[]"}}')
    rows = {r["file_name"]: r for r in R.evaluation_logs(spark, str(tmp_path)).collect()}
    assert {n: r["kind"] for n, r in rows.items()} == {"meta_data_tool_call.json": "log", "meta_data_tool_call.judge.json": "judge", "Tool_call_12.json": "log", "tool_calls.json": "other"}
    assert rows["meta_data_tool_call.judge.json"]["judgment"] == "correct" and rows["tool_calls.json"]["folder"] == folder.name
    assert tuple(R.tool_call_tests(spark, [str(tmp_path)]).first())[1:] == ("Tool call 1", "m", "p", "T[]")
    (tmp_path / "t.log.yml").write_text("interaction_1: {agent: 'f()', n: 3}\nother: 1\n")
    assert sorted(map(tuple, R.interaction_log(spark, [str(tmp_path)]).collect())) == [("t.log", 1, "agent", "f()"), ("t.log", 1, "n", "3")]


def test_environments_and_settings(spark, tmp_path):
    (tmp_path / "s.environment.yml").write_text("tool_set_yml: |\n  meta_data: {a: 1}\n  tasks:\n    - {task_type: x, task: do}\n")
    row = R.environments(spark, [str(tmp_path)]).first()
    assert (row["task_type"], json.loads(row["metadata"])) == ("x", {"a": 1})
    with pytest.raises(Exception):
        R.environment_files(spark, [str(tmp_path / "missing")]).collect()
    (tmp_path / "c.yml").write_text("a: {b: 1}")
    assert R.settings(str(tmp_path / "c.yml")) == {"a": {"b": 1}}
    (tmp_path / "bad.yml").write_text("3")
    with pytest.raises(ValueError):
        R.settings(str(tmp_path / "bad.yml"))
    for name in ("p", "q"):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"id": "{name}"}}\n\n')
    assert sorted(r["id"] for r in R.test_cases(spark, [f"{tmp_path}/p.jsonl", f"{tmp_path}/q.jsonl"]).collect()) == ["p", "q"]


def test_sinks(spark, tmp_path):
    tools = spark.createDataFrame([("b", "{}"), ("a", "{}")], "id string, tool string")
    flags = spark.createDataFrame([("a", "0.9", True), ("b", "0.9", False)], "id string, tau string, dropped boolean")
    K.tool_list(tools, f"{tmp_path}/list", flags, ["0.9"])
    assert [(r["id"], r["dropped_0.9"]) for r in spark.read.json(f"{tmp_path}/list").orderBy("id").collect()] == [("a", True), ("b", False)]
    K.survivors(tools, flags, f"{tmp_path}/left")
    assert [(r["id"], str(r["tau"])) for r in spark.read.json(f"{tmp_path}/left").collect()] == [("b", "0.9")]
    given = spark.createDataFrame([("a", "m", [3.0, 4.0], 2), ("z", "m", [0.0, 0.0], 1)], "id string, model string, embedding array<double>, text_length long")
    K.vectors(given, f"{tmp_path}/vectors")
    back = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/vectors").collect()}
    assert list(back["a"]["embedding"]) == pytest.approx([0.6, 0.8]) and back["z"]["embedding_dim"] == 2
    assert K.statistics({"some": tools, "none": tools.limit(0)}, f"{tmp_path}/csv") == ["some"]
    for _ in range(2):
        K.results(spark.createDataFrame([("a_b_1",), ("normal_multi_turn_x_y",)], "id string"), f"{tmp_path}/results")
    assert spark.read.json(f"{tmp_path}/results").count() == 4
    K.per_task(spark.createDataFrame([(1, 2, "x")], "spec int, n int, v string"), f"{tmp_path}/tasks")
    K.judged(spark.createDataFrame([("a", "correct", 1.0, "r")], "id string, judgment string, confidence double, reasoning string"), f"{tmp_path}/judged")
    assert spark.read.json(f"{tmp_path}/judged").first()["judgment"] == "correct"
    assert spark.createDataFrame([("a_b_1",)], "id string").select(K.category(F.col("id"))).first()[0] == "a_b"
    text = spark.createDataFrame([('{"a": "x\\ny", "b": 1}',)], "v string").select(K.literal_yaml(F.col("v"))).first()[0]
    assert text == "a: |-\n  x\n  y\nb: 1\n"
    assert K.dialogue([("u", "a", "日本" * 3)], 8).split("\n")[1:] == ["u      | a         | 日本日本", "       |           | 日本"]
    assert [r["index"] for r in K.chat_index(spark.createDataFrame([("g", 2), ("g", 1)], "g string, t int"), 5, "g", "t").orderBy("t").collect()] == [6, 7]
