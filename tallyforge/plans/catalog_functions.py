"""Queries of text functions, parsers, calls, model adapters and worlds, whose shapes vary by row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import documents as D
from ..functions import text as T
from ..functions.environments import run_calls
from ..operators import calls as calls_
from ..operators import dedup, parameter_check, parsing, reliability, similarity
from . import model, prompts
from .catalog import _PAIRS, _U, TAU, _vectors, query
from .spread import spread


def _udf(function, kind: str = "string"):
    """A function of texts as a pandas function; what it raises is null."""

    def one(*given):
        try:
            return function(*given)
        except (ValueError, KeyError):
            return None

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns)], dtype=object)

    return run


# names and texts


@query("normalized_name", """SELECT p_partkey, trim(regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END), '[^a-z0-9]+', ' ', 'g')) AS name FROM part""")
def _(t):
    third = F.col("p_partkey") % 3
    tool_name, name = F.when(third == 0, F.col("p_name")).otherwise(""), F.when(third == 1, F.col("p_brand"))
    return t("part").select("p_partkey", T.normalized_name(tool_name, name, F.concat(F.lit("x_tool_spec_1__"), "p_type")).alias("name"))


@query("line_forms", """SELECT conv_id, turn, '  ' || replace(text, chr(10), chr(10) || '  ') AS indented, replace(text, chr(10), ' ') AS one_line,
trim(text) AS spoken, CASE WHEN turn % 2 = 0 THEN text ELSE text || 'x' END AS thought FROM conversations""")  # fmt: skip
def _(t):
    text = F.col("text")
    said = F.concat(F.when(F.col("turn") % 2 == 0, " user: ").otherwise("agent:"), text)
    thought = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a</think>b</think>"), text)).otherwise(F.concat(text, F.lit("x")))
    return t("conversations").select("conv_id", "turn", T.indented(text, "  ").alias("indented"), T.one_line(text).alias("one_line"), T.without_speaker(said).alias("spoken"), T.after_thinking(thought).alias("thought"))


@query("title_and_path", """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Of ' || CASE WHEN c_nationkey % 2 = 0 THEN 'Trade' ELSE 'All' END AS title,
'/x.y/' || c_name || '.environment' || CASE WHEN c_nationkey % 2 = 0 THEN '.yml' ELSE '.json' END AS path FROM customer""")  # fmt: skip
def _(t):
    even = F.col("c_nationkey") % 2 == 0
    field = F.concat(F.lower("c_mktsegment"), F.lit("_of_"), F.when(even, "trade").otherwise("all"))
    return t("customer").select("c_custkey", T.title(field).alias("title"), T.environment_path(F.concat(F.lit("/x.y/"), "c_name", F.when(even, ".yml").otherwise(".json"))).alias("path"))


@query("without_fence", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || p_type WHEN 1 THEN p_name || chr(10) ELSE p_name END AS body FROM part""")
def _(t):
    third, name = F.col("p_partkey") % 3, F.col("p_name")
    closed, opened = F.concat(F.lit("so:\n```yaml\n"), name, F.lit("\n"), "p_type", F.lit("\n```\nend")), F.concat(F.lit(" ```json\n"), name, F.lit("\n"))
    return t("part").select("p_partkey", T.without_fence(F.when(third == 0, closed).when(third == 1, opened).otherwise(name)).alias("body"))


@query("filled_templates", """SELECT s_suppkey, 'Task for ' || s_name || ': {"n": 1}' AS plain, 'T:' || chr(10) || '  ' || s_name || chr(10) || 'D:' || chr(10) || '  ' || s_suppkey || chr(10) || '  two' AS turn,
'a' || chr(10) || '   ' || s_name || chr(10) || '   two' || chr(10) || 'b' AS block FROM supplier""")  # fmt: skip
def _(t):
    rows = prompts.from_template(t("supplier"), 'Task for {who}: {{"n": 1}}', who="s_name").withColumnRenamed("prompt", "plain")
    rows = rows.withColumn("__two", F.concat("s_name", F.lit("\ntwo")))
    rows = prompts.with_block(rows, "a\n   {tools}\nb", "tools", "__two").withColumnRenamed("prompt", "block")
    turn = prompts.multi_turn(F.lit("T:\n{{task}}\nD:\n{{tools_data}}"), F.col("s_name"), F.concat("s_suppkey", F.lit("\ntwo")))
    return rows.select("s_suppkey", "plain", turn.alias("turn"), "block")


# metadata


@query("shown_metadata", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"a": ' || s_nationkey || '}' ELSE '{"a": 1, "meta_data": {"b": ' || s_nationkey || '}}' END AS shown,
'{"k": ' || s_nationkey || '}' AS context FROM supplier""")  # fmt: skip
def _(t):
    flat = F.concat(F.lit('{"tool_budget": 3, "task": "x", "a": '), "s_nationkey", F.lit("}"))
    nested = F.concat(F.lit('{"a": 1, "meta_data": {"field_name": "f", "b": '), "s_nationkey", F.lit("}}"))
    context = F.concat(F.lit('{"Tool Call": 1, "Return Data": [2], "k": '), "s_nationkey", F.lit("}"))
    return t("supplier").select("s_suppkey", parsing.shown_metadata(F.when(F.col("s_suppkey") % 2 == 0, flat).otherwise(nested)).alias("shown"), parsing.context_metadata(context).alias("context"))


@query("merged_metadata", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'base' END AS a, s_name AS b FROM supplier")
def _(t):
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.col("s_name"))
    own = F.create_map(F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("c"), F.lit("own"))
    return t("supplier").select("s_suppkey", parsing.merged_metadata(base, own).alias("m")).select("s_suppkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("any_case_get", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE s_name END AS found FROM supplier")
def _(t):
    key = F.when(F.col("s_suppkey") % 3 == 0, "Meta_DATA").when(F.col("s_suppkey") % 3 == 1, "METADATA").otherwise("other")
    got = _udf(lambda text: D.got(json.loads(text), "meta_data", "metadata"))
    return t("supplier").select("s_suppkey", got(F.concat(F.lit('{"'), key, F.lit('": "'), "s_name", F.lit('"}'))).alias("found"))


# parsers


@query("bare_json", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS objects FROM part")
def _(t):
    one = F.concat(F.lit('{"name": "'), "p_name", F.lit('"}'))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), one, F.lit("\n"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("["), one, F.lit(", 3, "), one, F.lit("]"))).when(F.col("p_partkey") % 4 == 2, F.concat(one, F.lit("]"))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", _udf(lambda x: len(D.bare(x)), "int")(text).alias("objects"))


@query("string_leaves", "SELECT p_partkey, leaf FROM part, unnest([p_name, p_type, p_brand]) AS u(leaf) WHERE p_partkey % 3 < 2 OR leaf <> p_type")
def _(t):
    kind = F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit("'"), "p_type", F.lit("'"))).otherwise(F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("a: '"), "p_name", F.lit("'\nb: {c: ["), kind, F.lit(", 3, null, '"), "p_brand", F.lit("']}\n"))
    return parsing.string_leaves(t("part").select("p_partkey", text.alias("text")))


@query("tools_keys", "SELECT p_partkey, '{\"name\": \"' || n || '\"}' AS tool FROM part, unnest([p_name, p_type]) AS u(n) WHERE p_partkey % 3 > 0 OR n = p_name")
def _(t):
    one, two = F.concat(F.lit("{name: '"), "p_name", F.lit("'}")), F.concat(F.lit("{name: '"), "p_type", F.lit("'}"))
    third = F.col("p_partkey") % 3
    text = F.when(third == 0, F.concat(F.lit("x: [{' Tools ': "), one, F.lit("}]"))).when(third == 1, F.concat(F.lit("TOOLS: ["), one, F.lit(", 3, "), two, F.lit("]"))).otherwise(F.concat(F.lit("tools: {a: "), one, F.lit(", b: "), two, F.lit("}")))
    return parsing.tools_keys(t("part").select("p_partkey", text.alias("text")))


@query("chosen_names", """SELECT s_suppkey AS spec, CAST(p AS INTEGER) AS position, CASE p WHEN 1 THEN s_name ELSE 'tool 2' END AS chosen, CASE p WHEN 1 THEN regexp_replace(s_name, '[^A-Za-z0-9_-]', '', 'g') ELSE 'tool_2' END AS slug FROM supplier, range(1, 3) AS r(p)""")
def _(t):
    tool = F.explode(F.array(F.struct(F.lit(1).alias("position"), F.concat(F.lit('{"name": " '), "s_name", F.lit(' "}')).alias("tool")), F.struct(F.lit(2).alias("position"), F.lit('{"id": "tool 2", "name": ""}').alias("tool")), F.struct(F.lit(3).alias("position"), F.lit('{"id": "tool 2", "name": ""}').alias("tool"))))
    found = parsing.named_tools(t("supplier").select(F.col("s_suppkey").alias("spec"), tool.alias("x")).select("spec", "x.*"))
    return found.select("spec", "position", "chosen", "slug")


@query("top_level", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE '{\"name\": \"' || s_name || '\"}' END AS tool FROM supplier")
def _(t):
    one = F.concat(F.lit('{"name":"'), "s_name", F.lit('"}'))
    text = F.when(F.col("s_suppkey") % 3 == 0, one).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("["), one, F.lit(", 2]"))).otherwise(F.concat(F.lit("[4, "), one, F.lit("]")))
    return t("supplier").select("s_suppkey", parsing.top_level_tool(text).alias("tool"))


@query("listed_items", "SELECT p_partkey, CAST(n AS INTEGER) AS position, CASE n WHEN 1 THEN p_name ELSE p_type END AS item FROM part, range(1, 3) AS r(n) WHERE p_partkey % 4 < 3")
def _(t):
    kind = F.col("p_partkey") % 4
    fence = F.concat(F.lit('Here:\n```json\n["'), "p_name", F.lit('", "'), "p_type", F.lit('"]\n```\n'))
    yaml_ = F.concat(F.lit("- '"), "p_name", F.lit("'\n- '"), "p_type", F.lit("'\n"))
    json_ = F.concat(F.lit('["'), "p_name", F.lit('","'), "p_type", F.lit('"]'))
    return parsing.lists_in(t("part").select("p_partkey", F.when(kind == 0, fence).when(kind == 1, yaml_).when(kind == 2, json_).otherwise(F.col("p_name")).alias("text")))


@query("balanced_json", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{\"a\": {\"b\": \"' || p_name || ' }\"}}' WHEN 1 THEN '{' || p_size || '}' END AS body FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('so {"a": {"b": "'), "p_name", F.lit(' }"}} and }'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x {"), "p_size", F.lit("} {y}"))).otherwise(F.concat(F.lit("{open "), "p_name"))
    return t("part").select("p_partkey", _udf(D.balanced)(text).alias("body"))


@query("task_lines", "SELECT p_partkey, CASE n WHEN 1 THEN p_name ELSE p_type END AS task, CAST(p_size AS INTEGER) AS number, CASE n WHEN 1 THEN 'A|B' ELSE '' END AS tools, CASE n WHEN 1 THEN 'easy' ELSE 'hard' END AS difficulty FROM part, range(1, 3) AS r(n)")
def _(t):
    one = lambda name, level, tools: F.concat(F.lit('Task: "'), name, F.lit(f'", Task-difficulty: "{level}",\n Number-tools-required: '), F.col("p_size"), F.lit(f', Tools-required: [{tools}], Task-validity: "valid"\n'))
    text = F.concat(one(F.col("p_name"), "easy", "'A', \"B\""), F.lit("between\n"), one(F.col("p_type"), "hard", ""), F.lit('Task: "cut off", Task-difficulty: "x"'))
    found = F.pandas_udf(lambda values: pd.Series([D.task_lines(v) for v in values]), "array<struct<task:string,task_difficulty:string,number_tools_required:int,tools_required:array<string>>>")
    rows = t("part").select("p_partkey", F.explode(found(text)).alias("x"))
    return rows.select("p_partkey", F.col("x.task").alias("task"), F.col("x.number_tools_required").alias("number"), F.array_join("x.tools_required", "|").alias("tools"), F.col("x.task_difficulty").alias("difficulty"))


# calls


@query("first_calls", "SELECT event_id, 'new(a=' || user_id || ')|new(b=[1, 2])' AS renamed, CASE WHEN user_id % 2 = 0 THEN 'f(a=' || user_id || ')' ELSE 'f(a=' || user_id || ')|g (b=[1, 2])' END AS first FROM events")
def _(t):
    text = F.concat(F.lit("so f(a="), "user_id", F.lit(") and g (b=[1, 2]) then h(x"))
    first = _udf(lambda x, n: "|".join(C.first_calls(x, n)))(text, F.when(F.col("user_id") % 2 == 0, 1).otherwise(2))
    return t("events").select("event_id", _udf(lambda x: "|".join(C.first_calls(x, 2, "new")))(text).alias("renamed"), first.alias("first"))


@query("rendered_calls", """SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'Get_' || event_type || '[a = ' || user_id || ', b = ''x'']' END AS shown, '[get(a = ' || user_id || ', cabin = "x ''y''"' || CASE WHEN user_id % 2 = 0 THEN ', d = [{''k'': 1}]' ELSE '' END || ')]' AS keywords FROM events""")
def _(t):
    tool_id = F.concat(F.when(F.col("user_id") % 3 > 0, "f_tool_spec_3__").otherwise("f_spec_3__"), F.lit("Get_"), "event_type")
    shown = _udf(lambda i, n: C.rendered(i, {"a": n, "b": "x"}))(tool_id, F.col("user_id"))
    keywords = _udf(lambda n: C.rendered_keywords("get", {"a": n, "class": 'x "y"', "b": "", "c": None} | ({"d": {"k": 1}} if n % 2 == 0 else {})))(F.col("user_id"))
    return t("events").select("event_id", shown.alias("shown"), keywords.alias("keywords"))


@query("rebuilt_calls", "SELECT event_id, 'get(a=' || user_id || ', b=''x'', c=put(d=1))' AS again, CASE WHEN event_type = 'view' THEN 'get(a=' || user_id || ')' WHEN user_id % 2 = 0 THEN 'get(a=' || user_id || ')' END AS decoded FROM events")
def _(t):
    again = _udf(lambda x: "|".join(C.rebuilt(C.decoded(x))))(F.concat(F.lit("[get(a="), "user_id", F.lit(", b='x', c=put(d=1))]")))
    text = F.when(F.col("event_type") == "view", F.concat(F.lit('[{"get": "{\\"a\\": '), "user_id", F.lit('}"}]'))).when(F.col("user_id") % 2 == 0, F.concat(F.lit("get(a="), "user_id", F.lit(")"))).otherwise("no call")
    decoded = _udf(lambda x, m: "|".join(C.rebuilt(C.decoded_any(x, m))))(text, F.when(F.col("event_type") == "view", "model-FC").otherwise("model"))
    return t("events").select("event_id", again.alias("again"), decoded.alias("decoded"))


@query("agent_turns", "SELECT event_id, event_type IN ('view', 'click') AS agent FROM events")
def _(t):
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("I call [get(a="), "user_id", F.lit(")] now"))).when(F.col("event_type") == "click", "[f(), g(x='[')]").when(F.col("event_type") == "error", "[not a call").otherwise("see [1, 2]")
    return t("events").select("event_id", calls_.agent_turns(text).alias("agent"))


@query("solution_calls", "SELECT s_suppkey, 'f(a=' || s_nationkey || ')' || CASE WHEN s_suppkey % 2 = 0 THEN '|g()' ELSE '' END AS calls FROM supplier")
def _(t):
    items = F.concat(F.lit('["f(a='), "s_nationkey", F.lit(')", '), F.when(F.col("s_suppkey") % 2 == 0, '{"step": "g()"}').otherwise('{"a": 1, "b": 2}'), F.lit(", 3]"))
    return t("supplier").select("s_suppkey", _udf(lambda x: "|".join(C.solution_calls(json.loads(x))))(items).alias("calls"))


@query("error_branch", "SELECT event_id, event_type = 'view' AS passes FROM events")
def _(t):
    answer = F.when(F.col("event_type") == "view", "checked\nStatus: PASS").when(F.col("event_type") == "error", "Status: FAIL").otherwise("status: pass")
    return t("events").select("event_id", parameter_check.error_branch(answer).alias("passes"))


# statistics and joins


@query("similarity_by_spec", f"""WITH {_U} SELECT a.id % 5 AS spec, count(*) AS pairs, round(avg(array_cosine_similarity(a.v, b.v)), 6) AS within_mean, round(max(array_cosine_similarity(a.v, b.v)), 6) AS within_max
FROM u a JOIN u b ON a.id % 5 = b.id % 5 AND a.id < b.id GROUP BY a.id % 5""")  # fmt: skip
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("spec"), "embedding")
    found = similarity.by_group(vectors, ["spec"])
    pairs = F.col("count") * (F.col("count") - 1) / 2
    return found.select("spec", pairs.cast("long").alias("pairs"), F.round("within_mean", 6).alias("within_mean"), F.round("within_max", 6).alias("within_max"))


@query("active_ids", "SELECT doc_id AS id FROM labels WHERE toxic = 0")
def _(t):
    flags = t("labels").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("0.85"), F.lit("0.9"))).alias("tau"), "toxic").select("id", "tau", F.when(F.col("tau") == "0.9", F.col("toxic") == 1).otherwise(True).alias("dropped"))
    return similarity.active(flags, 0.9)


@query("loose_counts", """SELECT count(DISTINCT CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END) AS folders, count(*) FILTER (s_suppkey % 4 = 0) AS loose_json, count(*) FILTER (s_suppkey % 4 = 1 AND s_acctbal > 0) AS fixed_correct FROM supplier""")
def _(t):
    kind = F.col("s_suppkey") % 4
    name = F.when(kind == 1, "meta_data_tool_call_fixed.judge.json").when(kind == 0, F.concat("s_name", F.lit(".json"))).otherwise("notes.txt")
    return reliability.loose_counts(t("supplier").select(F.when(kind > 0, F.col("s_nationkey")).alias("folder"), name.alias("file_name"), F.when(F.col("s_acctbal") > 0, "correct").otherwise("unknown").alias("judgment")))


@query("available_tools", "SELECT l_orderkey AS task_id, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ', ' ORDER BY CAST(l_partkey AS VARCHAR)) AS tools FROM lineitem GROUP BY l_orderkey")
def _(t):
    return reliability.available(t("lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("tool_name")), "task_id")


# text models


class _Model:
    """Answers lists, records, verdicts and faults, by what the prompt says."""

    def complete(self, asked: list[str]) -> list[str]:
        if len(asked) > 1 and any("fault" in p for p in asked):
            raise ValueError("one of the batch")
        return [self.one(p) for p in asked]

    @staticmethod
    def one(prompt: str) -> str:
        kind, _, rest = prompt.partition(" ")
        if kind == "fault":
            raise ValueError("no answer")
        return {"list": f'```json\n["{rest} a", "{rest} b", "{rest} c"]\n```', "record": f'Here: {{"data": "{rest}"}}', "verdict": f'{{"judgment": "correct", "confidence": 0.5, "reasoning": "{rest}"}}'}.get(kind, rest)


def _asked(t, kind: Column) -> DataFrame:
    return t("supplier").select("s_suppkey", F.concat(kind, F.lit(" "), "s_name").alias("prompt"))


@query("model_lists", "SELECT s_suppkey, CAST(n AS INTEGER) AS position, s_name || CASE n WHEN 1 THEN ' a' ELSE ' b' END AS item FROM supplier, range(1, 3) AS r(n) WHERE s_suppkey % 3 > 0")
def _(t):
    return model.expanded_lists(_asked(t, F.when(F.col("s_suppkey") % 3 > 0, "list").otherwise("plain")), _Model, 2).select("s_suppkey", "position", "item")


@query("model_records", "SELECT s_suppkey, s_suppkey % 3 > 0 AS parsed, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS data FROM supplier")
def _(t):
    found = model.objects(_asked(t, F.when(F.col("s_suppkey") % 3 > 0, "record").otherwise("plain")), _Model)
    return found.select("s_suppkey", "parsed", F.get_json_object("record", "$.data").alias("data"))


@query("model_verdicts", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'correct' ELSE 'unknown' END AS judgment, CASE WHEN s_suppkey % 3 > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM supplier")
def _(t):
    return model.judged(_asked(t, F.when(F.col("s_suppkey") % 3 > 0, "verdict").otherwise("plain")), _Model).select("s_suppkey", "judgment", "confidence")


@query("model_faults", "SELECT s_suppkey, s_suppkey % 5 > 0 AS ok, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS answer FROM supplier")
def _(t):
    found = model.completed(_asked(t, F.when(F.col("s_suppkey") % 5 > 0, "plain").otherwise("fault")), _Model, tries=2, first_delay=0.0)
    return found.select("s_suppkey", (F.col("status") == "ok").alias("ok"), "answer")


@query("model_vectors", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN length(s_name) + 4 END AS text_length, CASE WHEN s_suppkey % 4 > 0 THEN 64 END AS size FROM supplier")
def _(t):
    texts = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 > 0, F.concat("s_name", F.lit("\nend"))).alias("text"))
    return model.embedded(texts, model.Hashed).select("s_suppkey", "text_length", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"))


@query("model_responses", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Status Code: 200' || chr(10) || 'Response: ' || s_name WHEN 1 THEN 'Status Code: 400' || chr(10) || 'Response: {"error": "Unknown parameter: z."}'
ELSE 'Status Code: 400' || chr(10) || 'Response: {"error": "The call was not checked."}' END AS response FROM supplier""")  # fmt: skip
def _(t):
    third = F.col("s_suppkey") % 3
    checked = _asked(t, F.lit("plain")).select("*", F.when(third == 0, "PASS").when(third == 1, "FAIL").alias("status"), F.when(third == 0, 200).when(third == 1, 400).alias("code"), F.when(third == 1, "Unknown parameter: z.").alias("message"))
    return model.simulated(checked, _Model).select("s_suppkey", "response")


# worlds


def _played(kind: str, state, calls):
    """A pandas function of a row's numbers: what the last of the calls answers, by a key of it."""

    def one(*given):
        results, saved = run_calls(state(*given), calls(*given))
        return "|".join(str(r.get(kind, r["message"]) if r["ok"] else r["message"]) for r in results)

    return _udf(one)


def _travel(balance: int) -> dict:
    flights = [{"flight_no": f"XA{k}", "origin": "Oslo", "destination": "Rome", "status": "available", "seats_available": 3, "economy_price": 100 + 50 * k, "business_price": 300, "depart_time": "2024-08-01 09:30:00", "arrival_time": "2024-08-01 12:00:00"} for k in (0, 1)]
    return {"travel": {"users": {"u": {"password": "p", "membership_level": "silver", "cash_balance": balance, "bank_balance": 0}}, "flights": flights, "reservations": []}}


@query("travel_calls", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'wrong user or password' END AS known, '50' AS fee, '200' AS more,
CASE WHEN c_nationkey * 20 < 100 THEN 'the cash balance is too low' ELSE '100' END AS cost, CASE WHEN c_nationkey * 20 < 100 THEN 'no such user, reservation or flight' ELSE '100' END AS refund FROM customer""")  # fmt: skip
def _(t):
    money, number = (F.col("c_nationkey") * 20).cast("int"), F.col("c_custkey")
    booking = ("reserve_flight", {"user_id": "u", "password": "p", "flight_no": "XA0", "cabin": "Economy Class", "payment_method": "cash", "baggage_count": 2})
    known = _played("authenticated", lambda m, n: _travel(m), lambda m, n: [("authenticate_user", {"user_id": "u", "password": "p" if n % 2 == 0 else "q"})])
    fee = _played("fee", lambda m: _travel(m), lambda m: [("calculate_baggage_fee", {"membership_level": "silver", "cabin_class": "Economy Class", "baggage_count": 3})])
    more = _played("difference", lambda m: _travel(m), lambda m: [("calculate_price_difference", {"flight": {"economy_price": 100, "business_price": 300}, "old_cabin": "Economy Class", "new_cabin": "Business Class"})])
    cost = _played("cost", lambda m: _travel(m), lambda m: [booking])
    refund = _udf(lambda m: (lambda r: f"{r['refund']:g}" if r["ok"] else r["message"])(run_calls(_travel(m), [booking, ("cancel_reservation", {"user_id": "u", "reservation_id": "res_1", "reason": "x"})])[0][-1]))
    return spread(t("customer").select("c_custkey", "c_nationkey")).select("c_custkey", known(money, number).alias("known"), fee(money).alias("fee"), more(money).alias("more"), cost(money).alias("cost"), refund(money).alias("refund"))


@query("travel_changes", """SELECT c_custkey, CASE WHEN c_nationkey * 20 < 100 THEN 'no such reservation of the user' ELSE 'flight changed; ' || CASE WHEN c_nationkey * 20 < 300 THEN 'cabin not paid' ELSE 'cabin paid 200' END END AS changed,
2 AS flights, CASE WHEN c_custkey % 2 = 0 THEN 'silver' ELSE 'wrong user or password' END AS level FROM customer""")  # fmt: skip
def _(t):
    money, number = (F.col("c_nationkey") * 20).cast("int"), F.col("c_custkey")
    booking = ("reserve_flight", {"user_id": "u", "password": "p", "flight_no": "XA0", "cabin": "Economy Class", "payment_method": "cash", "baggage_count": 0})
    change = ("modify_flight", {"user_id": "u", "reservation_id": "res_1", "new_flight_no": "XA1", "new_cabin": "Business Class"})
    changed = _udf(lambda m: run_calls(_travel(m), [booking, change])[0][-1]["message"])
    flights = _udf(lambda m: len(run_calls(_travel(m), [("get_flight_details", {"origin": "Oslo"})])[0][0]["flights"]), "int")
    level = _udf(lambda n: (lambda r: r["user"]["membership_level"] if r["ok"] else r["message"])(run_calls(_travel(0), [("get_user_details", {"user_id": "u", "password": "p" if n % 2 == 0 else "q"})])[0][0]))
    return spread(t("customer").select("c_custkey", "c_nationkey")).select("c_custkey", changed(money).alias("changed"), flights(money).alias("flights"), level(number).alias("level"))


def _food(balance: int, wifi: bool) -> dict:
    menu = [{"product": "Soup", "price": 4.0}, {"product": "Bread", "price": 1.5}]
    return {"device": {"wifi": wifi, "logged_in": True}, "food": {"users": {"u": {"password": "p", "balance": balance}}, "merchants": {"Corner": {"menu": menu}}}}


@query("food_calls", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'Wi-Fi is off|nobody is logged in|the user is not logged in|no orders' WHEN c_nationkey < 6 THEN 'logged in|[''u'']|the balance is too low|no orders' ELSE 'logged in|[''u'']|5.5|1' END AS answers, CASE WHEN c_custkey % 2 = 0 AND c_nationkey >= 6 THEN c_nationkey - 5.5::DOUBLE ELSE c_nationkey::DOUBLE END AS balance FROM customer""")
def _(t):
    order = {"username": "u", "merchant_name": "Corner", "items": [{"product": "Soup"}, {"product": "Bread", "quantity": 1}]}
    calls = [("login_food_platform", {"username": "u", "password": "p"}), ("view_logged_in_users", {}), ("add_food_delivery_order", order), ("search_orders", {"keyword": "soup"}), ("check_balance", {"user_name": "u"})]

    def answers(money, number):
        results = run_calls(_food(int(money), number % 2 == 0), calls)[0]
        shown = [r["message"] if not r["ok"] else str(r.get("users") or r.get("total") or (len(r["orders"]) if "orders" in r else r["message"])) for r in results[:-1]]
        return "|".join(shown), float(results[-1]["balance"])

    both = F.pandas_udf(lambda a, b: pd.DataFrame([answers(x, y) for x, y in zip(a, b)], columns=["answers", "balance"]), "answers string, balance double")
    return t("customer").select("c_custkey", both("c_nationkey", "c_custkey").alias("x")).select("c_custkey", "x.*")


@query("message_calls", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'sent' ELSE 'Wi-Fi is off' END AS sent, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS between_, 'deleted' AS deleted, 2 AS latest, 1 AS earliest, 1 AS found FROM customer""")
def _(t):
    def one(number: int):
        inbox = {"1": {"sender_id": "A", "receiver_id": "B", "message": "old note", "time": "2023-02-01"}, "2": {"sender_id": "B", "receiver_id": "A", "message": "new", "time": "2023-05-01"}}
        state = {"device": {"wifi": number % 2 == 0, "logged_in": True}, "messages": {"inbox": inbox, "users": {"a": {"user_id": "A"}, "b": {"user_id": "B"}}}}
        calls = [("get_latest_message_id", {}), ("get_earliest_message_id", {}), ("search_messages", {"user_name": "a", "keyword": "NOTE"}), ("send_message", {"sender_name": "a", "receiver_name": "b", "message": "hello"}), ("view_messages_between_users", {"sender_name": "a", "receiver_name": "b"}), ("delete_message", {"message_id": 1})]
        r = run_calls(state, calls)[0]
        return r[3]["message"], len(r[4]["messages"]), r[5]["message"], r[0]["message_id"], r[1]["message_id"], len(r[2]["messages"])

    names = ["sent", "between_", "deleted", "latest", "earliest", "found"]
    found = F.pandas_udf(lambda a: pd.DataFrame([one(x) for x in a], columns=names), "sent string, between_ int, deleted string, latest int, earliest int, found int")
    return t("customer").select("c_custkey", found("c_custkey").alias("x")).select("c_custkey", "x.*")


@query("reminder_calls", """SELECT c_custkey, CASE WHEN c_nationkey % 3 < 2 THEN 'added' ELSE 'there are too many reminders' END AS added, CAST(least(c_nationkey % 3 + 1, 2) AS INTEGER) AS there, CASE WHEN c_nationkey % 3 = 0 THEN 'no such reminder' ELSE 'marked' END AS marked, CASE WHEN c_nationkey % 3 < 2 THEN 'True' ELSE 'False' END AS found FROM customer""")
def _(t):
    def one(nation: int):
        state = {"device": {"logged_in": True}, "reminders": {"capacity": 2, "reminders": {}}}
        calls = [("add_reminder", {"title": f"old {k}", "description": "d", "time": "t"}) for k in range(nation % 3)]
        calls += [("add_reminder", {"title": "new one", "description": "d", "time": "t"}), ("view_all_reminders", {}), ("mark_as_notified", {"reminder_id": 1 if nation % 3 else 9}), ("search_reminders", {"keyword": "NEW"})]
        r = run_calls(state, calls)[0][-4:]
        return r[0]["message"], len(r[1]["reminders"]), r[2]["message"], str(r[3]["ok"])

    found = F.pandas_udf(lambda a: pd.DataFrame([one(x) for x in a], columns=["added", "there", "marked", "found"]), "added string, there int, marked string, found string")
    return t("customer").select("c_custkey", found("c_nationkey").alias("x")).select("c_custkey", "x.*")


@query("tool_configs", "SELECT s_suppkey, k AS parameter, k = 'a' OR s_suppkey % 2 = 0 AS required FROM supplier, unnest(['a', 'b']) AS u(k)")
def _(t):
    from ..operators.environments import tool_configs

    one = F.struct(F.lit("string").alias("type"), F.lit("d").alias("description"))
    given = t("supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.lit("d").alias("description"), F.create_map(F.lit("a"), one, F.lit("b"), one).alias("properties"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("required"))
    rows = tool_configs(given).select(F.col("name").cast("long").alias("s_suppkey"), F.explode("parameters").alias("parameter", "x"))
    return rows.select("s_suppkey", "parameter", F.col("x.required").alias("required"))


# steps and extension points


@query("steps_run", "SELECT 'one' AS step, CAST(0 AS BIGINT) AS code UNION ALL SELECT 'two', count(*) FROM region")
def _(t):
    from .steps import run

    spark = t("region").sparkSession
    fails = t("region").count()
    codes = run({"one": {"a": 1}, "two": {"b": [1, 2]}, "three": {}}, {"one": ["x"], "skipped": ["s"], "two": ["y"], "three": ["z"]}, start=lambda command: fails if command[0] == "y" else 0)
    return spark.createDataFrame(list(codes.items()), "step string, code long")


@query("registered_function", "SELECT s_suppkey, CAST(2 * s_nationkey AS BIGINT) AS twice FROM supplier")
def _(t):
    from ..functions import registry

    registry.register("tallyforge_twice", F.udf(lambda x: x * 2, "long"))
    registry.install(t("supplier").sparkSession)
    return t("supplier").select("s_suppkey", F.expr("tallyforge_twice(s_nationkey)").alias("twice"))


@query("degree_drop_pairs", f"""WITH {_PAIRS}, p AS (SELECT a, b, s FROM pairs WHERE s >= {TAU}), d AS (SELECT n, count(*) AS edges FROM (SELECT a AS n FROM p UNION ALL SELECT b FROM p) AS x GROUP BY n),
two AS (SELECT p.* FROM p JOIN d x ON x.n = a JOIN d y ON y.n = b WHERE x.edges = 1 AND y.edges = 1)
SELECT CASE WHEN sha256('42|' || a) > sha256('42|' || b) THEN a ELSE b END AS id, CASE WHEN sha256('42|' || a) > sha256('42|' || b) THEN b ELSE a END AS best_neighbor, round(s, 5) AS similarity, 1 AS step FROM two""")  # fmt: skip
def _(t):
    """What goes of the components of two, where the rule is the seeded hash."""
    pairs = dedup.similar_pairs(_vectors(t), TAU)
    single = dedup.degrees(pairs).where("degree = 1").select(F.col("node").cast("string").alias("id"))
    gone = dedup.near_duplicates_at(_vectors(t), TAU, tie_break="hash").where("step = 1")
    both = gone.join(single, "id", "left_semi").join(single.withColumnRenamed("id", "best_neighbor"), "best_neighbor", "left_semi")
    return both.select(F.col("id").cast("long"), F.col("best_neighbor").cast("long"), F.round("similarity", 5).alias("similarity"), "step")
