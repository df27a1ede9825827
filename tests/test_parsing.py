from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyforge.functions import documents as D
from tallyforge.functions import text as T
from tallyforge.operators import parsing as P

SPEC = """field_name: books
tool_description: |
  ```json
  {"tool_name": "Find Book", "parameters": {"title": {"type": "string", "required": true}}}
  ```
  ```JSON
  [{"name": "B"}, 3, {"no": 1}]
  ```
  ```json
  {"broken": }
  ```
tools:
  - {tool_name: "Find Book", parameters: {title: {type: string, required: true}}}
  - {title: "C c"}
"""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()[0]


def test_extracted_tools_are_named_and_distinct():
    assert [D.tool_name(t) for t in D.extracted(SPEC)] == ["Find Book", "B", "C c"]
    assert [D.tool_name(t) for t in D.extracted('not: [yaml ```json\n{"id": "x"}\n```')] == ["x"]
    assert D.extracted(None) == []


def test_extraction_on_spark(spark):
    df = spark.createDataFrame([("s", SPEC), ("t", None)], "spec string, text string")
    rows = P.extract_tools(df).collect()
    assert [(r["spec"], r["position"], r["tool_name"]) for r in rows] == [("s", 1, "Find Book"), ("s", 2, "B"), ("s", 3, "C c")]
    named = {r["tool_name"]: r["slug"] for r in P.named_tools(P.extract_tools(df)).collect()}
    assert named == {"Find Book": "Find_Book", "B": "B", "C c": "C_c"}
    twice = spark.createDataFrame([("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b")], "spec string, position int, slug string")
    assert sorted(r["position"] for r in P.last_of_slug(twice).collect()) == [2, 3]


def test_coerced_json_and_verdicts():
    assert D.coerced('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert D.coerced('say {"a": {"b": 2}} now') == {"a": {"b": 2}}
    assert D.coerced("none") == {"_parse_error": True, "_raw": "none"}
    assert D.verdict('{"judgment": "Correct", "confidence": "0.5"}')[:2] == ("correct", 0.5)
    assert D.verdict("no")[:2] == ("unknown", 0.0)
    assert D.verdict('{"judgment": "odd", "confidence": "x"}')[:2] == ("unknown", 0.0)


def test_coerced_json_and_verdicts_on_spark(spark):
    for text in ('{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'say {"a": 1} now'):
        assert json.loads(one(spark, text, P.coerced_json)) == {"a": 1}
    assert one(spark, "none", P.coerced_json) is None
    assert json.loads(one(spark, "none", P.error_record)) == {"_parse_error": True, "_raw": "none"}
    found = one(spark, 'so ```json\n{"judgment": "CORRECT", "confidence": 0.9, "reasoning": "r"}\n```', P.judgments)
    assert tuple(found) == ("correct", 0.9, "r")
    assert tuple(one(spark, "no", P.judgments))[:2] == ("unknown", 0.0)


def test_environment_forms():
    assert D.balanced('a {"x": "}", "y": {"z": 1}} b') == '{"x": "}", "y": {"z": 1}}'
    lines = 'Task: "Do it", Task-difficulty: "easy", Number-tools-required: 2, Tools-required: [A, "B"], Task-validity: "valid"'
    assert D.task_lines(lines) == [{"task": "Do it", "task_difficulty": "easy", "number_tools_required": 2, "tools_required": ["A", "B"], "task_validity": "valid"}]
    markdown = '**Task 1**: "Plan"\nTask-difficulty: Hard\nTools-required: [A]\n\nTask-validity: Valid\n**Task 2**: Go'
    assert D.markdown_tasks(markdown) == [{"task_type": "Task 1", "task": "Plan", "task_difficulty": "hard", "tools_required": ["A"]}, {"task_type": "Task 2", "task": "Go"}]
    many = D.environment("note: 1\n---\nmetadata: {a: 1}\ntasks: {g: [{t: 1}, {t: 2}], h: x}\n")
    assert D.tasks_of(many) == [("g_1", {"t": 1}), ("g_2", {"t": 2}), ("h", {"task": "x"})]
    assert D.metadata_of(many) == {"a": 1}
    assert D.metadata_of({"tasks": [1], "b": 2}) == {"b": 2}
    assert D.got({"Task_Type": 1, "x": 2}, "id", "task_type") == 1


def test_listed_and_top_level():
    assert D.listed('```json\n["a", "b"]\n```') == ["a", "b"] and D.listed("- a\n- b") == ["a", "b"]
    assert D.top_level([{"a": 1}]) == {"a": 1} and D.top_level([]) is None
    assert D.shown_metadata({"meta_data": {"task": 1, "a": 2}}) == {"meta_data": {"a": 2}}
    assert D.context_metadata({"Tool Call": 1, "b": 2}) == {"b": 2}


def test_tool_texts():
    tool = {"tool_name": "T", "tool_description": "De sc", "parameters": {"b": {"type": "string", "description": "B"}, "A": {"type": "integer", "default": 3, "required": True}}, "error_messages": ["e"], "usage": "u", "output_details": {"o": {"type": "string", "description": "O"}}}
    assert D.search_text(tool).split("\n") == ["T", "De sc", "A", "", "integer", "3", "b", "B", "string", "e", "u", "o", "O", "string"]
    assert D.embedding_text(tool) == "name: t\ndescription: de sc\nparameters: [A|integer|True|3| ; b|string|none|none|b]\nusage: u"


def test_names_and_texts(spark):
    cases = [
        (T.id_name, "a_tool_spec_3__My_Tool", "My_Tool"), (T.id_name, "plain", "plain"), (T.id_field, "A_b_tool_spec_3__X", "A_b"), (T.id_field, "x", "unknown"), (T.id_spec, "a_tool_spec_3", 3), (T.id_spec, "x", None),
        (T.id_number_text, "a_tool_spec_3__x", "3"), (T.id_number_text, "a_tool_spec_3", "unknown"), (T.basic, "  Caé Bar--9 ", "ca bar 9"), (T.slug, "  a b c! ", "a_b_c"), (T.slug, "!!", "tool"), (T.slug, "x" * 99, "x" * 80),
        (T.safe_file_name, "a b/é", "a_b__"), (T.lookup_name, "My-Tool 2", "mytool2"), (T.joined_name, "-My  Tool-", "My_Tool"), (T.fingerprint, "abc", "a9993e364706"), (T.without_fence, "```yaml\na: 1\n```", "a: 1"), (T.without_fence, "```\nb: 2", "b: 2"), (T.without_fence, "c", "c"),
        (T.without_speaker, " user: hi ", "hi"), (T.one_line, "a\nb", "a b"), (T.after_thinking, "<think>x</think>y", "y"), (T.title, "my_field", "My Field"), (T.environment_path, "/a/b.yml", "/a/b.environment.yml"), (T.plain_file_name, "a b/c\\d", "a_b_c_d"),
    ]
    for f, given, wanted in cases:
        assert one(spark, given, f) == wanted, (f.__name__, given)
    for tau, wanted in ((0.9, "0.9"), (0.85, "0.85"), (1.0, "1")):
        assert one(spark, "", lambda c, t=tau: T.tau_key(F.lit(t))) == wanted
    assert one(spark, "a\nb", lambda c: T.indented(c, "> ")) == "> a\n> b"


def test_agent_response_and_templates(spark):
    answer = "noise\nStatus Code: 200\nmore\nResponse: {\n 1}\nExplanation: why"
    assert one(spark, answer, T.agent_response) == "Status Code: 200\nResponse: {\n 1}"
    assert one(spark, "no answer", T.agent_response) == "no answer"
    assert one(spark, "W", lambda c: T.filled(F.lit("{a} {{b}} {c}"), a=c)) == "W {b} {c}"
    assert one(spark, "x\ny", lambda c: T.filled_block(F.lit("top\n  {Data}\nend"), "Data", c)) == "top\n  x\n  y\nend"
