from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import registry
from tallyforge.operators import reliability as R
from tallyforge.plans import model as M
from tallyforge.plans import prompts, steps
from tallyforge.streaming import turns as S


def test_reliability(spark):
    tools = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    verdicts = spark.createDataFrame([("a", "correct"), ("b", "unknown")], "id string, judgment string")
    found = R.with_reliability(tools, verdicts)
    assert {r["id"]: r["reliable"] for r in found.collect()} == {"a": 1, "b": 0, "c": None}
    assert tuple(R.reliability_counts(found).first()) == (1, 1, 1, 3)


def test_folder_counts(spark):
    rows = [("p", "log", None), ("p", "judge", "correct"), ("q", "log", None), ("r", "judge", "unknown"), ("s", "judge", None), ("t", None, None)]
    row = R.folder_counts(spark.createDataFrame(rows, "folder string, kind string, judgment string")).first()
    assert row.asDict() == {"folders": 5, "non_empty": 4, "correct": 1, "incorrect": 1, "missing_judge": 1, "unparsable": 1, "issues": 2}


def test_tasks_with_tools(spark):
    tasks = spark.createDataFrame([(1, "x", ["My Tool", "No"]), (1, "y", ["my-Tool", "My_Tool"])], "spec int, task_id string, tools_required array<string>")
    tools = spark.createDataFrame([(1, "My_Tool", "{}"), (2, "No", "{}")], "spec int, tool_name string, tool_json string")
    found = {r["task_id"]: r for r in R.task_documents(tasks, tools).collect()}
    assert not found["x"]["valid"] and [t["tool_json"] for t in found["x"]["tools"]] == ["{}", None]
    assert [t["tool_name"] for t in found["y"]["tools"]] == ["my-Tool", "My_Tool"]


def test_preferred_and_resume(spark):
    tools = spark.createDataFrame([("t", "My Tool", 2)], "tool_id string, tool_name string, spec long")
    files = spark.createDataFrame([("/m/f_tool_spec_1__My_Tool__output.json",), ("/m/f_tool_spec_2__My_Tool__output.json",)], "path string")
    assert R.metadata_files(tools, files).first()["path"].endswith("spec_2__My_Tool__output.json")
    assert R.metadata_files(tools.withColumn("spec", F.lit(9)), files).first()["path"].endswith("spec_1__My_Tool__output.json")
    todo, done = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)] * 6 + [("b",)] * 5, "id string")
    assert [r["id"] for r in R.not_done(todo, done, "id", 5).collect()] == ["b"] and R.not_done(todo, done, "id").count() == 0
    assert R.next_spec(spark.createDataFrame([("f_tool_spec_9__a",), ("g_tool_spec_10__b",)], "id string")).first()[0] == 11
    kept = R.first_distinct(spark.createDataFrame([("p", "b", 1), ("p", "a", 2), ("p", "b", 3), ("p", "c", 4)], "parent string, v string, n int"), "parent", "v", "n", 2)
    assert [r["v"] for r in kept.orderBy("place").collect()] == ["b", "a"]


class Stumbling:
    def complete(self, given):
        if len(given) > 1 or "bad" in given[0]:
            raise ValueError("no")
        return [f'{{"judgment": "correct", "confidence": 1, "reasoning": "{given[0]}"}}']


def test_models(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, prompt string")
    found = {r["k"]: r for r in M.completed(df.coalesce(1), Stumbling, tries=1, first_delay=0.0).collect()}
    assert found[1]["status"] == "ok" and found[2]["answer"] is None and "1 tries" in found[2]["status"]
    assert M.judged(df.where("k = 1"), Stumbling).first()["judgment"] == "correct"
    delays: list[float] = []
    with pytest.raises(RuntimeError):
        M.retried(lambda: 1 / 0, sleep=delays.append)
    assert delays == [2.0, 4.0]
    lists = M.expanded_lists(spark.createDataFrame([("f", '["a", "b", "c"]')], "field string, prompt string"), M.Echo, 2)
    assert sorted((r["position"], r["item"]) for r in lists.collect()) == [(1, "a"), (2, "b")]
    row = M.embedded(spark.createDataFrame([("a\nb a",)], "text string"), M.Hashed).first()
    assert row["text_length"] == 5 and sum(abs(x) for x in row["embedding"]) > 0
    assert M.objects(spark.createDataFrame([("x",)], "prompt string"), M.Echo).first()["parsed"] is False
    calls = spark.createDataFrame([("p", "PASS", 200, None), ("q", "FAIL", 400, "Unknown parameter: z.")], "prompt string, status string, code int, message string")
    assert sorted(r["response"][:16] for r in M.simulated(calls, M.Echo).collect()) == ["Status Code: 200", "Status Code: 400"]


def test_prompts(spark):
    df = prompts.from_template(spark.createDataFrame([("x", None)], "a string, b string"), "{a}-{b}-{{c}}", a="a", b="b")
    assert df.first()["prompt"] == "x--{c}"
    assert spark.range(1).select(prompts.multi_turn(F.lit("T:\n{{task}}\nD:\n{{tools_data}}"), F.lit("a"), F.lit("b\nc"))).first()[0] == "T:\n  a\nD:\n  b\n  c"


def test_steps(tmp_path):
    assert steps.arguments({"a_b": 1, "c": None, "d": False, "e": True, "f": [1, 2]}, {"e": "ee"}) == ["--a-b", "1", "--ee", "--f", "1", "2"]
    started = []
    codes = steps.run({"one": {}, "two": {}, "three": {}}, {"one": ["x"], "skipped": ["s"], "two": ["y"], "three": ["z"]}, start=lambda c: started.append(c) or int(c[0] == "y"))
    assert codes == {"one": 0, "two": 1} and started == [["x"], ["y"]]
    assert steps.run({"one": {}}, {"one": ["false"]}, dry=True) == {"one": 0}


def test_registry(spark):
    registry.register("double_it", F.udf(lambda x: x * 2, "long"))
    assert "double_it" in registry.install(spark) and spark.sql("SELECT double_it(4) AS x").first()[0] == 8
    with pytest.raises(KeyError):
        registry.known("nothing")


def test_streamed_turns(spark, tmp_path):
    rows = [("t", 1, "<ATTEMPT>g()<ATTEMPT>", ["f()"]), ("t", 2, "<ATTEMPT>f() x<ATTEMPT>", ["f()"]), ("t", 3, "<ATTEMPT>f()<ATTEMPT>", ["f()"]), ("t", 4, "<ATTEMPT>f()<ATTEMPT>", ["f()"]), ("u", 1, "none", ["f()"])]
    schema = "task string, n long, agent_text string, solution array<string>"
    for k in (0, 1):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    out = S.judged_turns(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    query = out.writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["n"], r["verdict"]) for r in spark.sql("SELECT * FROM judged").collect()) == [(1, "wrong"), (2, "extraneous"), (3, "correct")]
