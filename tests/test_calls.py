from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import calls as C
from tallyforge.operators import calls as K
from tallyforge.operators.parameter_check import check


def test_scanning():
    text = 'first f(a=")", b=(1)) then g ( x = \'(\' ) and broken h(1'
    assert C.all_calls(text) == ['f(a=")", b=(1))', "g ( x = '(' )"]
    assert C.first_calls(text, 1, "Real") == ['Real(a=")", b=(1))']
    assert C.all_calls(None) == [] and C.all_calls("open(") == []


def test_normalising():
    assert C.normalised('T(a="x, y", b=[1, 2], c, a=3)') == ("T", {"a": "3", "b": "[1, 2]"})
    assert C.normalised("T(a='x, y=1')") == ("T", {"a": "'x", "y": "1'"})
    assert C.canonical("T(b=2,  a=X y)") == C.canonical("t(a=x Y, b=2)")


@given(st.dictionaries(st.from_regex(r"[a-z]{1,4}", fullmatch=True), st.integers(), max_size=4))
def test_order_of_parameters_does_not_matter(parameters):
    items = [f"{k}={v}" for k, v in parameters.items()]
    assert C.canonical(f"T({', '.join(items)})") == C.canonical(f"T({', '.join(reversed(items))})")


def test_verification():
    assert C.verified(["g(a=1)", "f()"], ["f()", "g(a=1)"], in_order=False)
    assert not C.verified(["g(a=1)", "f()"], ["f()", "g(a=1)"], in_order=True)
    assert not C.verified(["f()", "f()"], ["f()"], in_order=False)


def test_attempts():
    text = "a <ATTEMPT>f()<ATTEMPT> b <ATTEMPT_START>g()<ATTEMPT_END> <ATTEMPT>h()</ATTEMPT>"
    assert C.attempts(text) == ["f()", "g()"]
    assert C.without_attempts("a <ATTEMPT>f()<ATTEMPT> b") == "a  b"
    assert C.extraneous("f() and") and not C.extraneous(" f( ) \n g(a=1)")
    assert C.solution_calls(["f()", {"x": "g()"}, {"a": "b", "c": "d"}, 3]) == ["f()", "g()"]


def test_rendering_and_decoding():
    assert C.rendered("f_tool_spec_1__My", {"a": 1, "b": "x"}) == "My[a = 1, b = 'x']"
    with pytest.raises(ValueError):
        C.rendered("nothing", {})
    assert C.rendered_keywords("f", {"class": 'a"b', "x": None, "d": {"k": 1}}) == "[f(cabin = \"a'b\", d = [{'k': 1}])]"
    assert C.decoded("[f(a=1, b=[-2, 'x']), g()]") == [{"f": {"a": 1, "b": [-2, "x"]}}, {"g": {}}]
    assert C.decoded("f(a=1+2)") == [{"f": {"a": "1 + 2"}}]  # nothing is run
    for bad in ("f(", "1", "[x]"):
        with pytest.raises(ValueError):
            C.decoded(bad)
    assert C.rebuilt([{"f": {"a": "x", "b": {"g": {"c": 1}}}}]) == ["f(a='x', b=g(c=1))"]
    assert C.decoded_any('[{"f": "{\\"a\\": 1}"}]', "model-FC") == [{"f": {"a": 1}}]
    assert C.is_agent_turn("so [f(a=1)] now") and not C.is_agent_turn("[not a call") and C.is_agent_turn("[x] y", steps=True)


def test_verify_on_spark(spark):
    logs = spark.createDataFrame([("t", 1, "<ATTEMPT>g(a=1) f()<ATTEMPT>"), ("t", 2, "<ATTEMPT>f() g(a=1) so<ATTEMPT>"), ("t", 3, "<ATTEMPT>f()<ATTEMPT>"), ("t", 4, None)], "task string, n int, agent_text string")
    solutions = spark.createDataFrame([("t", ["f()", "g(A = 1)"])], "task string, solution array<string>")
    for in_order, wanted in ((False, ["correct", "extraneous", "wrong"]), (True, ["wrong", "extraneous", "wrong"])):
        assert [r["verdict"] for r in K.verify(logs, solutions, in_order).orderBy("n").collect()] == wanted


def test_resolve_and_ends(spark):
    tools = spark.createDataFrame([("b", "My Tool"), ("a", "my_tool")], "tool_id string, tool_name string")
    turns = spark.createDataFrame([(1, "MyTool(a=1)"), (2, "Other(1)"), (3, "none")], "n int, agent_text string")
    rows = {r["n"]: r for r in K.resolve(turns, tools).collect()}
    assert rows[1]["tool_id"] == "a" and rows[1]["error"] is None
    assert rows[2]["tool_id"] is None and "TOOL_NOT_FOUND" in rows[2]["error"]
    messages = spark.createDataFrame([(1, 0, "finish conversation"), (1, 1, "x"), (1, 2, "finish conversation"), (1, 3, "y")], "conv_id int, turn int, text string")
    assert sorted(r["turn"] for r in K.until_finished(messages).collect()) == [0, 1, 2]


def test_parameter_check(spark):
    schema = '{"n": {"type": "integer", "required": true}, "tags": {"type": "array", "minItems": 1, "maxItems": 2}, "ok": {"type": "boolean"}, "w": {"type": "number"}}'
    cases = [
        ("T", '{"n": 1}', None), ("T", '{"n": 1, "w": 2.5, "ok": true, "tags": ["a"]}', None), ("X", '{"n": 1}', "Invalid tool name: X."), ("T", "{}", "Missing required parameter: n."), ("T", '{"n": 1, "z": 2}', "Unknown parameter: z."),
        ("T", '{"n": "1"}', "Invalid type for n: expected integer."), ("T", '{"n": 1, "tags": []}', "Invalid type for tags: expected array."), ("T", '{"n": 1, "tags": ["a", "b", "c"]}', "Invalid type for tags: expected array."), ("T", '{"n": 1, "ok": "true"}', "Invalid type for ok: expected boolean."),
    ]
    df = spark.createDataFrame([(k, "T", schema, c, a) for k, (c, a, _) in enumerate(cases)], "k int, tool_name string, parameters string, called_name string, arguments string")
    for r in check(df).collect():
        wanted = cases[r["k"]][2]
        assert (r["message"], r["status"], r["code"]) == (wanted, "FAIL" if wanted else "PASS", 400 if wanted else 200)


def test_error_branch(spark):
    from tallyforge.operators.parameter_check import error_branch

    assert spark.range(1).select(error_branch(F.lit("x Status: PASS y"))).first()[0]
