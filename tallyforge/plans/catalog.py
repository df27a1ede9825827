"""Every query over the driver's tables, and its SQL.

The tables stand in for a tool corpus: embeddings (label as field), documents (source as field), labels as
verdicts, conversations as logs. Where a parser needs text that no table has, both sides build it from columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as calls_
from ..operators import dedup, environments, parameter_check, parsing, reliability, similarity
from ..operators.components import connected_components
from ..sources.sinks import category
from .ranking import running_sum
from .scratch import cut

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TAU, TAUS = 0.25, [0.2, 0.25, 0.3]


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of a table reader, t("documents")."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _vectors(t, *keys) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("field"), "embedding", *keys)


# similarity statistics

_U = "u AS (SELECT vec_id AS id, label AS field, CAST(vec_id % 3 AS INTEGER) AS subfield, CAST(vec_id % 2 AS INTEGER) AS task, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings)"
_PAIRS = f"{_U}, pairs AS (SELECT a.id AS a, b.id AS b, a.field, array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.field = b.field AND a.id < b.id)"


def _spread_sql(prefix: str) -> str:
    return f"round(avg(s), 6) AS {prefix}_mean, round(stddev_pop(s), 6) AS {prefix}_std, round(min(s), 6) AS {prefix}_min, round(max(s), 6) AS {prefix}_max"


def _groups_sql(*keys: str) -> str:
    key = ", ".join(keys)
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""
WITH {_U}, counts AS (SELECT {key}, count(*) AS count FROM u GROUP BY ALL),
p AS (SELECT {", ".join(f"a.{k}" for k in keys)}, array_cosine_similarity(a.v, b.v) AS s, {same} AS same FROM u a JOIN u b ON (NOT ({same})) OR a.id < b.id),
w AS (SELECT {key}, {_spread_sql("within")} FROM p WHERE same GROUP BY ALL),
o AS (SELECT {key}, {_spread_sql("vs_others")} FROM p WHERE NOT same GROUP BY ALL)
SELECT * FROM counts LEFT JOIN w USING ({key}) LEFT JOIN o USING ({key})"""


@query("similarity_by_label", _groups_sql("field"))
def _(t):
    return _rounded(similarity.by_group(_vectors(t), ["field"]))


def _keyed(t) -> DataFrame:
    return _vectors(t, (F.col("vec_id") % 3).cast("int").alias("subfield"), (F.col("vec_id") % 2).cast("int").alias("task"))


@query("similarity_by_subfield", _groups_sql("field", "subfield"))
def _(t):
    return _rounded(similarity.by_group(_keyed(t), ["field", "subfield"]))


@query("similarity_by_task", _groups_sql("field", "subfield", "task"))
def _(t):
    return _rounded(similarity.by_group(_keyed(t), ["field", "subfield", "task"]))


@query("similarity_global", f"""WITH {_U} SELECT (SELECT count(*) FROM u) AS num_vectors, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max
FROM (SELECT array_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id < b.id)""")  # fmt: skip
def _(t):
    return _rounded(similarity.overall(_vectors(t)))


@query("similarity_plane")
def _(t):
    return similarity.plane(_vectors(t))


# similarity graph


@query("tau_pairs", f"WITH {_PAIRS} SELECT field, a, b, round(s, 6) AS similarity FROM pairs WHERE s >= {TAU}")
def _(t):
    return _rounded(dedup.similar_pairs(_vectors(t), TAU))


@query("tau_degree", f"""WITH {_PAIRS}, e AS (SELECT a AS node, s FROM pairs WHERE s >= {TAU} UNION ALL SELECT b, s FROM pairs WHERE s >= {TAU})
SELECT node, count(*) AS degree, round(sum(s), 6) AS incident FROM e GROUP BY node""")  # fmt: skip
def _(t):
    return _rounded(dedup.degrees(dedup.similar_pairs(_vectors(t), TAU)))


_REACH = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE s >= {TAU} UNION SELECT b, a FROM pairs WHERE s >= {TAU}),
reach AS (SELECT id AS node, id AS seen FROM u UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


@query("tau_components", f"{_REACH} SELECT node, component FROM comp WHERE node IN (SELECT a FROM e)")
def _(t):
    return connected_components(cut(dedup.spanning_pairs(_vectors(t), [TAU])))


@query("tau_components_count", f"{_REACH} SELECT field, count(*) AS nodes, count(DISTINCT component) AS components FROM comp JOIN u ON u.id = comp.node GROUP BY field")
def _(t):
    return dedup.component_counts(_vectors(t), cut(dedup.spanning_pairs(_vectors(t), [TAU])))


@query("degree_drop")
def _(t):
    return dedup.near_duplicates_at(_vectors(t), TAU)


@query("degree_drop_flags")
def _(t):
    tools = _vectors(t).select("id", "field", F.lit(False).alias("dropped_exact"))
    return dedup.drop_flags(tools, _vectors(t), TAUS)


@query("degree_drop_invariant", f"""{_REACH} SELECT 'drop below threshold' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'similar survivors', 0 UNION ALL SELECT 'drop of a node without an edge', 0
UNION ALL SELECT 'components with a survivor', count(DISTINCT component) FROM comp WHERE node IN (SELECT a FROM e)""")
def _(t):
    pairs = cut(dedup.spanning_pairs(_vectors(t), [TAU]))
    gone = cut(dedup.near_duplicates_at(_vectors(t), TAU, pairs=pairs))
    parts = cut(connected_components(pairs)).withColumn("__node", F.col("node").cast("string"))
    ids = gone.select(F.col("id").alias("__node"))
    alone = ids.join(parts, "__node", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("drop of a node without an edge").alias("rule"), "violations")
    left = parts.join(ids, "__node", "left_anti").agg(F.countDistinct("component").alias("violations")).select(F.lit("components with a survivor").alias("rule"), "violations")
    stay = _vectors(t).join(gone.select(F.col("id").alias("__gone")), F.col("id").cast("string") == F.col("__gone"), "left_anti")
    return dedup.violations(dedup.similar_pairs(stay, TAU), gone, TAU).union(alone).union(left)


@query("threshold_pivot")
def _(t):
    pairs = dedup.similar_pairs(_vectors(t), min(TAUS))
    frames = {x: pairs.where(F.col("similarity") >= x).groupBy("field").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean")) for x in TAUS}
    return similarity.over_thresholds(frames, ["field"])


SQL["threshold_pivot"] = f"WITH {_PAIRS} SELECT * FROM " + " FULL JOIN ".join(
    f'(SELECT field, count(*) AS "pairs_tau_{x}", round(avg(s), 6) AS "mean_tau_{x}" FROM pairs WHERE s >= {x} GROUP BY field) AS q{i}' + (" USING (field)" if i else "") for i, x in enumerate(("0.2", "0.25", "0.3"))
)


# exact duplicates


def _documents(t) -> DataFrame:
    return t("documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("field"), T.basic(F.element_at(F.split("text", "\n"), 1)).alias("norm_name"), T.basic(F.col("text")).alias("norm_text")
    )


_BASIC = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_EXACT = f"""WITH n AS (SELECT doc_id AS id, source AS field, {_BASIC.format("string_split(text, chr(10))[1]")} AS norm_name, {_BASIC.format("text")} AS norm_text FROM documents),
a AS (SELECT *, row_number() OVER w AS r, first(id) OVER w AS f FROM n WINDOW w AS (PARTITION BY field, norm_name ORDER BY id)),
b AS (SELECT id, row_number() OVER w AS r2, first(id) OVER w AS f2 FROM a WHERE r = 1 WINDOW w AS (PARTITION BY norm_text ORDER BY id)),
x AS (SELECT id, field, r > 1 AS dropped_name, CASE WHEN r > 1 THEN f END AS name_winner, coalesce(r2 > 1, false) AS dropped_text, CASE WHEN r2 > 1 THEN f2 END AS text_winner,
r > 1 OR coalesce(r2 > 1, false) AS dropped_exact FROM a LEFT JOIN b USING (id))"""


@query("exact_dedup", f"{_EXACT} SELECT * FROM x")
def _(t):
    return dedup.exact_duplicates(_documents(t))


@query("dedup_summary_by_field", f"{_EXACT} SELECT field, count(*) AS total, count(*) FILTER (dropped_exact) AS dropped, count(*) FILTER (NOT dropped_exact) AS remaining FROM x GROUP BY field")
def _(t):
    return dedup.drop_summary(dedup.exact_duplicates(_documents(t)))


@query("text_fingerprint", f"SELECT doc_id, substr(sha1({_BASIC.format('text')}), 1, 12) AS fingerprint FROM documents")
def _(t):
    return t("documents").select("doc_id", T.fingerprint(T.basic(F.col("text"))).alias("fingerprint"))


@query("seeded_tiebreak", "SELECT source, arg_max(doc_id, sha256('42|' || doc_id)) AS goes FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.max_by("doc_id", T.seeded_hash(42, F.col("doc_id"))).alias("goes"))


# names


@query("parse_ids", f"""SELECT doc_id, lang AS name, source AS field, doc_id AS spec, CAST(doc_id AS VARCHAR) AS number_text, 'unknown' AS end_number FROM documents""")
def _(t):
    tool_id = F.concat("source", F.lit("_tool_spec_"), F.col("doc_id"), F.lit("__"), F.col("lang"))
    cut = F.concat("source", F.lit("_tool_spec_"), F.col("doc_id"))
    return t("documents").select("doc_id", T.id_name(tool_id).alias("name"), T.id_field(tool_id).alias("field"), T.id_spec(tool_id).alias("spec"), T.id_number_text(tool_id).alias("number_text"), T.id_number_text(cut).alias("end_number"))


@query("name_forms", """SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_replace(regexp_replace('  ' || c_name || ' (x)_', '^\\s+|\\s+$', '', 'g'), '[^A-Za-z0-9]', '', 'g') AS bare,
lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS lookup, regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g') AS joined, replace(c_mktsegment, ' ', '_') AS plain FROM customer""")  # fmt: skip
def _(t):
    name = F.col("c_name")
    return t("customer").select("c_custkey", T.safe_file_name(name).alias("safe"), T.slug(F.concat(F.lit("  "), F.replace(name, F.lit("#"), F.lit("")), F.lit("(x)-"))).alias("bare"), T.lookup_name(name).alias("lookup"), T.joined_name(name).alias("joined"), T.plain_file_name(F.col("c_mktsegment")).alias("plain"))


@query("tau_keys", "SELECT DISTINCT l_discount AS tau, rtrim(rtrim(printf('%.6f', l_discount), '0'), '.') AS key FROM lineitem")
def _(t):
    return t("lineitem").select(F.col("l_discount").alias("tau"), T.tau_key(F.col("l_discount")).alias("key")).distinct()


@query("next_spec", "SELECT max(doc_id) + 1 AS next_spec FROM documents")
def _(t):
    return reliability.next_spec(t("documents").select(F.concat("source", F.lit("_tool_spec_"), F.col("doc_id"), F.lit("__x")).alias("id")))


@query("result_category", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'normal_multi_turn_' || role ELSE 'special_' || role END AS category, count(*) AS n FROM conversations GROUP BY ALL")
def _(t):
    test_id = F.when(F.col("conv_id") % 2 == 0, F.concat_ws("_", F.lit("normal_multi_turn"), "role", "turn", F.lit("0"))).otherwise(F.concat_ws("_", F.lit("special"), "role", "turn"))
    return t("conversations").groupBy("conv_id", category(test_id).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# parsers


@query("fenced_extract", """SELECT doc_id, CAST(1 AS INTEGER) AS position, json_extract_string(b, '$.tool_name') AS tool_name FROM (SELECT doc_id, regexp_extract('x' || chr(10) || '```json' || chr(10) || '{"tool_name": "d' || doc_id || '"}' || chr(10) || '```', '(?s)```json\\s*(.*?)\\s*```', 1) AS b FROM documents)""")
def _(t):
    spec = F.concat(F.lit('x\n```json\n{"tool_name": "d'), F.col("doc_id"), F.lit('"}\n```\n```JSON\n{bad}\n```'))
    return parsing.fenced_tools(t("documents").select("doc_id", spec.alias("text"))).select("doc_id", "position", F.get_json_object("block", "$.tool_name").alias("tool_name"))


@query("extract_tools", """SELECT doc_id, CAST(p AS INTEGER) AS position, CASE p WHEN 1 THEN 'first' WHEN 2 THEN lang ELSE source END AS tool_name FROM documents, range(1, 4) AS r(p)""")
def _(t):
    # a fence with an object and a list, one of them twice, a nameless one, and a tools key
    spec = F.concat(
        F.lit('tool_description: |\n  STEP 1\n  ```json\n  {"tool_name": "first", "usage": "u"}\n  ```\n  ```json\n  [{"name": "'), F.col("lang"), F.lit('"}, {"usage": "none"}, {"usage": "u", "tool_name": "first"}]\n  ```\nTools:\n  - title: '), F.col("source"), F.lit("\n")
    )
    return parsing.extract_tools(t("documents").select("doc_id", spec.alias("text"))).select("doc_id", "position", "tool_name")


@query("json_coerce", "SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type = 'error' AS failed FROM events")
def _(t):
    answer = F.when(F.col("event_type") == "error", F.concat(F.lit("Sorry {no} "), "event_type")).when(F.col("event_type") == "click", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` {x}"))).otherwise(F.concat(F.lit("So: "), "props", F.lit(" as asked")))
    found = parsing.coerced_json(answer)
    return t("events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), found.isNull().alias("failed"))


@query("judgment_parse", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 1 THEN 'correct' ELSE 'inappropriate_response' END AS judgment, CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM labels""")
def _(t):
    label = F.when(F.col("quality") == 1, " Correct").otherwise("INAPPROPRIATE_RESPONSE")
    answer = F.when(F.col("toxic") == 1, F.lit("I can't say")).otherwise(F.concat(F.lit('Verdict:\n```json\n{"judgment": "'), label, F.lit('", "confidence": 0.75}\n```\nThat is all {}.')))
    return t("labels").select("doc_id", parsing.judgments(answer).alias("j")).select("doc_id", "j.judgment", "j.confidence")


@query("agent_response", """SELECT event_id, 'Status Code: 200' || chr(10) || 'Response: {' || chr(10) || props || chr(10) || '}' AS response FROM events""")
def _(t):
    return t("events").select("event_id", T.agent_response(F.concat(F.lit("Thinking\nStatus Code: 200\nResponse: {\n"), "props", F.lit("\n}\nExplanation: because\nResponse: not this"))).alias("response"))


@query("markdown_tasks", """SELECT p_partkey, CAST(n AS INTEGER) AS position, CASE n WHEN 1 THEN p_name ELSE p_type END AS task FROM part, range(1, 3) AS r(n)""")
def _(t):
    text = F.concat(F.lit("# Tasks\n**Task 1**: "), "p_name", F.lit("\n- Task-difficulty: Easy\n- Tools-required: [A, B]\n\nignored: yes\n**Task 2**: "), "p_type", F.lit("\n- Number-tools-required: 2\n"))
    return parsing.markdown_tasks(t("part").select("p_partkey", text.alias("text"))).select("p_partkey", "position", F.get_json_object("task", "$.task").alias("task"))


@query("environment_tasks", """SELECT p_partkey, CAST(n AS INTEGER) AS position, CASE n WHEN 1 THEN 'easy_1' WHEN 2 THEN 'easy_2' ELSE 'hard_1' END AS task_type, CASE n WHEN 1 THEN p_name ELSE p_brand END AS task, p_size AS size FROM part, range(1, 4) AS r(n)""")
def _(t):
    text = F.concat(F.lit("metadata:\n  size: "), "p_size", F.lit("\ndata: {}\ntasks:\n  easy:\n    - task: "), "p_name", F.lit("\n    - task: '"), "p_brand", F.lit("'\n  hard:\n    - task: '"), "p_brand", F.lit("'\n"))
    found = parsing.environment_tasks(t("part").select("p_partkey", text.alias("text")))
    return found.select("p_partkey", "position", "task_type", F.get_json_object("task", "$.task").alias("task"), F.get_json_object("metadata", "$.size").cast("int").alias("size"))


@query("tool_texts", f"""SELECT p_partkey, 'name: ' || p_name || chr(10) || 'description: a ' || lower(p_type) || chr(10) || 'parameters: [A|integer|none|' || p_size || '| ; b|string|True|none|of ' || lower(p_brand) || ']' || chr(10) || 'usage: now' AS embedding_text,
substr(sha1({_BASIC.format("p_name || ' a ' || p_type || ' A  integer ' || p_size || ' b of ' || p_brand || ' string now'")}), 1, 12) AS fingerprint FROM part""")  # fmt: skip
def _(t):
    tool = F.concat(F.lit('{"tool_name": "'), "p_name", F.lit('", "tool_description": "A  '), "p_type", F.lit('", "parameters": {"b": {"type": "string", "required": true, "description": "Of '), "p_brand", F.lit('"}, "A": {"type": "integer", "default": '), "p_size", F.lit('}}, "usage": "Now"}'))
    return t("part").select("p_partkey", parsing.embedding_text(tool).alias("embedding_text"), T.fingerprint(T.basic(parsing.search_text(tool))).alias("fingerprint"))


# calls


@query("call_scan", """SELECT event_id, CAST(n AS INTEGER) AS position, CASE n WHEN 1 THEN '{"parameters":{"a":"' || user_id || '","b":"\\"x,(y\\""},"tool_name":"get_' || event_type || '"}' ELSE '{"parameters":{"q":"[1,2]"},"tool_name":"f"}' END AS canonical FROM events, range(1, 3) AS r(n)""")
def _(t):
    text = F.concat(F.lit("First get_"), "event_type", F.lit(' (b="x, (y", a = '), F.col("user_id"), F.lit(") then f(q=[1, 2]) and open(z"))
    return t("events").select("event_id", F.posexplode(calls_.calls(text)).alias("p", "c")).select("event_id", (F.col("p") + 1).alias("position"), "c.canonical")


@query("call_verify", """SELECT o_orderkey AS task, CAST(0 AS BIGINT) AS n, CAST(1 AS INTEGER) AS attempt, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'wrong' ELSE 'extraneous' END AS verdict FROM orders""")
def _(t):
    right = F.concat(F.lit("B(x=1) A(k = "), F.col("o_custkey"), F.lit(", z=2)"))
    body = F.when(F.col("o_orderstatus") == "F", right).when(F.col("o_orderstatus") == "O", F.concat(right, F.lit(" B(x=1)"))).otherwise(F.concat(F.lit("I try "), right))
    logs = t("orders").select(F.col("o_orderkey").alias("task"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("so <ATTEMPT_START> "), body, F.lit(" <ATTEMPT_END>")).alias("agent_text"))
    solutions = t("orders").select(F.col("o_orderkey").alias("task"), F.array(F.concat(F.lit("A(z=2, k="), F.col("o_custkey"), F.lit(")")), F.lit("B(x = 1)")).alias("solution"))
    return calls_.verify(logs, solutions)


@query("attempt_extract", """SELECT conv_id, turn, CAST(n AS INTEGER) AS attempt, CASE n WHEN 1 THEN role ELSE 'end' || turn END AS body FROM conversations, range(1, 3) AS r(n)""")
def _(t):
    text = F.concat(F.lit("<ATTEMPT_START>end"), F.col("turn"), F.lit("<ATTEMPT_END> and <ATTEMPT>"), "role", F.lit("<ATTEMPT> not <ATTEMPT>x</ATTEMPT>"))
    return t("conversations").select("conv_id", "turn", F.posexplode(calls_.attempts(text)).alias("p", "body")).select("conv_id", "turn", (F.col("p") + 1).alias("attempt"), "body")


@query("tool_resolve", """SELECT event_id, 'Get_' || event_type AS called, CASE WHEN event_type <> 'error' THEN 't_' || event_type END AS tool_id, event_type = 'error' AS missed FROM events""")
def _(t):
    tools = t("events").where("event_type <> 'error'").select(F.concat(F.lit("t_"), "event_type").alias("tool_id"), F.concat(F.lit("get "), "event_type").alias("tool_name")).distinct()
    turns = t("events").select("event_id", F.concat(F.lit("call Get_"), "event_type", F.lit("(x=1) or other()")).alias("agent_text"))
    return calls_.resolve(turns, tools).select("event_id", "called", "tool_id", F.col("error").isNotNull().alias("missed"))


@query("call_decode", """SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS a, CASE WHEN event_type <> 'error' THEN 2 END AS calls FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.lit("[not a call")).otherwise(F.concat(F.lit("[get(a=-"), F.col("user_id"), F.lit(", b=[1, {'c': (2,)}]), put(x=1+1)]")))
    found = F.from_json(calls_.decoded_calls(text), "array<map<string,map<string,string>>>")
    return t("events").select("event_id", (-F.try_element_at(found, F.lit(1))["get"]["a"].cast("long")).alias("a"), F.when(found.isNotNull(), F.size(found)).alias("calls"))


@query("ordered_vs_multiset_equal", """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(role ORDER BY turn DESC) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, a = b AS in_order, list_sort(a) = list_sort(b) AS as_multiset FROM c""")  # fmt: skip
def _(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    a = t("conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("a")).withColumn("b", F.reverse("a"))
    return a.select("conv_id", calls_.same_calls(F.col("a"), F.col("b"), True).alias("in_order"), calls_.same_calls(F.col("a"), F.col("b"), False).alias("as_multiset"))


@query("until_finished", """WITH m AS (SELECT conv_id, turn, role, min(CASE WHEN turn > 1 AND turn % 4 = 3 THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, role FROM m WHERE (last IS NULL OR turn <= last) AND turn < 20""")
def _(t):
    said = t("conversations").withColumn("text", F.when(F.col("turn") % 4 == 3, F.lit("please finish conversation now")).otherwise("on"))
    return calls_.until_finished(said, most=20).select("conv_id", "turn", "role")


@query("last_turn_by_role", "SELECT conv_id, role, max(turn) AS last_turn, arg_max(md5(text), turn) AS last_text FROM conversations GROUP BY conv_id, role")
def _(t):
    return t("conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("last_turn"), F.max_by(F.md5("text"), "turn").alias("last_text"))


# parameter check


@query("parameter_check", """SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 200 ELSE 400 END AS code,
CASE WHEN event_type = 'click' THEN 'Invalid tool name: Gt It.' WHEN event_type = 'error' THEN 'Missing required parameter: user_id.' WHEN event_type = 'view' AND user_id % 2 = 0 THEN NULL WHEN event_type = 'view' THEN 'Invalid type for tags: expected array.' ELSE 'Unknown parameter: userid.' END AS message FROM events""")  # fmt: skip
def _(t):
    schema = '{"user id": {"type": "integer", "required": true}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}, "note": {"type": "string", "required": false}}'
    kind, user = F.col("event_type"), F.col("user_id")
    arguments = (
        F.when(kind == "error", F.lit('{"note": 5, "userid": 1}'))
        .when((kind == "view") & (user % 2 == 0), F.concat(F.lit('{"user id": '), user, F.lit(', "tags": ["a", "b"], "note": "5"}')))
        .when(kind == "view", F.concat(F.lit('{"user_id": '), user, F.lit(', "tags": ["a", "b", "c"]}')))
        .otherwise(F.concat(F.lit('{"user_id": '), user, F.lit(', "userid": 1, "note": 5}')))
    )
    given = t("events").select("event_id", F.lit("Get It").alias("tool_name"), F.lit(schema).alias("parameters"), F.when(kind == "click", "Gt It").otherwise("Get_It").alias("called_name"), arguments.alias("arguments"))
    return parameter_check.check(given).select("event_id", "status", "code", "message")


# reliability and enrichment


def _verdicts(t) -> DataFrame:
    return t("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "correct").otherwise("inappropriate_response").alias("judgment"))


def _reliable(t) -> DataFrame:
    return reliability.with_reliability(t("documents").select(F.col("doc_id").alias("id"), "source"), _verdicts(t))


@query("reliability_tristate", "SELECT d.doc_id AS id, source, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END AS reliable FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return _reliable(t)


@query("reliability_summary", "SELECT count(*) FILTER (quality = 1) AS reliable_1, count(*) FILTER (quality = 0) AS reliable_0, count(*) FILTER (quality IS NULL) AS reliable_null, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return reliability.reliability_counts(_reliable(t))


@query("judge_folder_counts", """WITH d AS (SELECT n_chars, quality, toxic, doc_id, l.doc_id IS NOT NULL AS judged FROM documents LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS folders, count(*) FILTER (n_chars % 3 > 0 OR judged) AS non_empty, count(*) FILTER (judged AND toxic = 0 AND quality = 1) AS correct, count(*) FILTER (judged AND toxic = 0 AND quality = 0) AS incorrect,
count(*) FILTER (NOT judged AND n_chars % 3 > 0) AS missing_judge, count(*) FILTER (judged AND toxic = 1) AS unparsable, count(*) FILTER (NOT judged AND n_chars % 3 > 0) + count(*) FILTER (judged AND toxic = 0 AND quality = 0) AS issues FROM d""")  # fmt: skip
def _(t):
    none = F.lit(None).cast("string")
    logs = t("documents").select(F.col("doc_id").alias("folder"), F.when(F.col("n_chars") % 3 > 0, "log").alias("kind"), none.alias("judgment"))
    judges = t("labels").select(F.col("doc_id").alias("folder"), F.lit("judge").alias("kind"), F.when(F.col("toxic") == 0, F.when(F.col("quality") == 1, "correct").otherwise("inappropriate_response")).alias("judgment"))
    return reliability.folder_counts(logs.union(judges))


@query("task_tools", """WITH w AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey FROM lineitem)
SELECT 's' AS spec, task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY l_partkey) AS INTEGER) AS position, 'Part ' || l_partkey AS tool_name, CASE WHEN p_size > 10 THEN p_name END AS tool_json FROM w LEFT JOIN part ON p_partkey = l_partkey""")  # fmt: skip
def _(t):
    tasks = t("lineitem").groupBy(F.lit("s").alias("spec"), F.col("l_orderkey").alias("task_id")).agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda k: F.concat(F.lit("Part "), k)).alias("tools_required"))
    tools = t("part").where("p_size > 10").select(F.lit("s").alias("spec"), F.concat(F.lit("Part__"), F.col("p_partkey"), F.lit("_")).alias("tool_name"), F.col("p_name").alias("tool_json"))
    return reliability.with_tools(tasks, tools)


@query("task_validity", """WITH w AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey FROM lineitem) SELECT task_id, count(*) FILTER (p_size IS NULL OR p_size <= 10) = 0 AS valid, count(*) AS n_tools FROM w LEFT JOIN part ON p_partkey = l_partkey GROUP BY task_id""")
def _(t):
    tasks = t("lineitem").groupBy(F.lit("s").alias("spec"), F.col("l_orderkey").alias("task_id")).agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda k: F.concat(F.lit("Part "), k)).alias("tools_required"))
    tools = t("part").where("p_size > 10").select(F.lit("s").alias("spec"), F.concat(F.lit("Part_"), F.col("p_partkey")).alias("tool_name"), F.col("p_name").alias("tool_json"))
    return reliability.task_documents(tasks, tools).select("task_id", "valid", F.size("tools").cast("long").alias("n_tools"))


@query("spec_lookup", "SELECT o_orderkey, n_name AS subfield, r_name AS task FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    specs = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lit("f").alias("field"), F.col("c_custkey").alias("spec"), F.col("n_name").alias("subfield"), F.col("r_name").alias("task"))
    tools = t("orders").select("o_orderkey", F.lit("f").alias("field"), F.col("o_custkey").alias("spec"))
    return reliability.with_specs(tools, specs).select("o_orderkey", "subfield", "task")


@query("metadata_preferred", """WITH f AS (SELECT s_suppkey AS spec, s_nationkey AS k, 'n_tool_spec_' || s_suppkey || '__N_' || s_nationkey || '__output.json' AS path FROM supplier)
SELECT c_custkey AS tool_id, arg_min(path, (CASE WHEN spec = c_custkey THEN '0' ELSE '1' END) || path) AS path FROM customer JOIN f ON k = c_nationkey GROUP BY c_custkey""")  # fmt: skip
def _(t):
    files = t("supplier").select(F.concat(F.lit("n_tool_spec_"), F.col("s_suppkey"), F.lit("__N_"), F.col("s_nationkey"), F.lit("__output.json")).alias("path"))
    tools = t("customer").select(F.col("c_custkey").alias("tool_id"), F.concat(F.lit("n "), F.col("c_nationkey")).alias("tool_name"), F.col("c_custkey").alias("spec"))
    return reliability.metadata_files(tools, files)


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return reliability.not_done(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id")


@query("resume_more_than", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 5)")
def _(t):
    turns = t("conversations").select("conv_id")
    return reliability.not_done(turns.distinct(), turns, "conv_id", 5)


@query("topk_per_parent", "WITH d AS (SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, lang) AS INTEGER) AS place FROM d) SELECT * FROM r WHERE place <= 3")
def _(t):
    return reliability.first_distinct(t("documents"), "source", "lang", "doc_id", 3)


@query("set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")  # fmt: skip
def _(t):
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    n = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("both", a.intersect(b)).union(n("only documents", a.subtract(b))).union(n("either", a.union(b).distinct()))


@query("unknown_last", "SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN lang <> 'en' THEN n_chars END NULLS LAST, doc_id) AS INTEGER) AS place FROM documents")
def _(t):
    number = F.when(F.col("lang") != "en", F.col("n_chars").cast("string")).otherwise("unknown").try_cast("long")
    rows = cut(t("documents").select("doc_id", number.alias("number")))
    # buckets in the order of the rows, so that no task has them all; the unknown ones come last, by doc_id
    bucket = F.when(F.col("number").isNull(), F.lit(1 << 40) + F.floor(F.col("doc_id") / 1024)).otherwise(F.floor(F.col("number") / 64))
    placed = running_sum(rows, [], bucket, [F.col("number").asc_nulls_last(), F.col("doc_id")], F.lit(1), "place")
    return placed.select("doc_id", (F.col("place") + 1).cast("int").alias("place"))


@query("hierarchy_counts", """SELECT r_name AS field, n_name AS subfield, c_mktsegment AS task, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("field"), F.col("n_name").alias("subfield"), F.col("c_mktsegment").alias("task")).agg(F.count(F.lit(1)).alias("count"))


# environments


@query("transfer_pairs", "SELECT a.o_orderkey AS first_flight, b.o_orderkey AS second_flight FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'O'")
def _(t):
    city = F.col("o_custkey").cast("string")
    flights = t("orders").select(F.col("o_orderkey").alias("flight_no"), city.alias("origin"), city.alias("destination"), F.when(F.col("o_orderstatus") == "O", "available").otherwise("full").alias("status"), F.col("o_orderdate").alias("arrival_time"), F.col("o_orderdate").alias("depart_time"))
    return environments.transfers(flights).select("first_flight", "second_flight")


@query("order_totals", "SELECT l_orderkey AS order_id, round(sum(l_quantity * p_retailprice), 2) AS total, count(*) FILTER (p_retailprice IS NULL) AS missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5 GROUP BY l_orderkey")
def _(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.lit("m").alias("merchant"), F.col("l_partkey").alias("product"), F.col("l_quantity").alias("quantity"))
    menus = t("part").where("p_size > 5").select(F.lit("m").alias("merchant"), F.col("p_partkey").alias("product"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("position"))
    return _rounded(environments.order_totals(items, menus), 2)


@query("latest_earliest_by_key", "SELECT user_id, (list(event_id ORDER BY ts DESC, event_id))[1] AS latest, (list(event_id ORDER BY ts, event_id))[1] AS earliest FROM events GROUP BY user_id")
def _(t):
    return environments.extreme(t("events"), ["user_id"], "event_id", F.col("ts"), F.col("event_id"))


@query("first_match_join", "SELECT o_orderkey, (SELECT s.s_name FROM supplier s WHERE s.s_suppkey % 50 = o.o_custkey % 60 ORDER BY s_suppkey LIMIT 1) AS flight_name FROM orders o")
def _(t):
    flights = t("supplier").select((F.col("s_suppkey") % 50).alias("flight_no"), F.col("s_suppkey").alias("position"), "s_name")
    held = t("orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("flight_no"))
    return environments.reservation_details(held, flights).select("o_orderkey", F.col("flight_info.s_name").alias("flight_name"))


@query("baggage_fees", """SELECT c_custkey, CAST(greatest(c_nationkey - CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END, 0) * 50 AS INTEGER) AS fee FROM customer""")
def _(t):
    level = F.when(F.col("c_acctbal") < 0, "regular").when(F.col("c_acctbal") < 5000, "silver").otherwise("gold")
    return t("customer").select("c_custkey", environments.bag_fee(level, F.lit("Economy Class"), F.col("c_nationkey")).cast("int").alias("fee"))


@query("search_orders", """SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING bool_or(contains(lower(p_name), 'ring'))""")
def _(t):
    orders = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.lit("shop").alias("merchant_name"), F.collect_list(F.struct(F.col("p_name").alias("product"))).alias("items"))
    return environments.search_orders(orders, "RING").select("l_orderkey")


@query("messages_between", "SELECT event_id AS id, 'u1' AS sender, 'u2' AS receiver, event_type AS message FROM events WHERE user_id = 1 AND CAST(value AS BIGINT) % 5 = 2")
def _(t):
    messages = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("sender_id"), (F.floor("value") % 5).cast("long").alias("receiver_id"), F.col("event_type").alias("message"))
    users = t("events").select(F.concat(F.lit("u"), F.col("user_id")).alias("name"), "user_id").distinct()
    return environments.messages_between(messages, users, "u1", "u2")


SQL["messages_between"] = "SELECT event_id AS id, 'u1' AS sender, 'u2' AS receiver, event_type AS message FROM events WHERE user_id = 1 AND CAST(floor(value) AS BIGINT) % 5 = 2"


@query("environment_replay")
def _(t):
    states = t("events").groupBy(F.col("user_id").alias("test_id")).agg(F.lit('{"device": {"logged_in": true}, "reminders": {"capacity": 3}}').alias("state"))
    title = F.concat(F.lit('{"title": "'), "event_type", F.lit('", "description": "d", "time": "t"}'))
    name = F.when(F.col("event_type") == "error", "delete_reminder").when(F.col("event_type") == "view", "view_all_reminders").otherwise("add_reminder")
    arguments = F.when(F.col("event_type") == "error", F.format_string('{"reminder_id": %d}', F.col("event_id") % 3 + 1)).when(F.col("event_type") == "view", "{}").otherwise(title)
    return environments.replay(states, t("events").select(F.col("user_id").alias("test_id"), F.col("event_id").alias("step"), name.alias("name"), arguments.alias("arguments")))


# streams


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from ..streaming.turns import windowed_counts

    return windowed_counts(t("events"))


# text models


@query("model_calls", "SELECT doc_id, 'ok' AS status, quality AS verdict, 'judge ' || doc_id AS prompt FROM labels")
def _(t):
    from .model import Echo, completed
    from .prompts import from_template

    asked = from_template(t("labels"), "judge {id}", id="doc_id")
    return completed(asked, Echo).where(F.col("answer") == F.col("prompt")).select("doc_id", "status", F.col("quality").alias("verdict"), "prompt")


from . import catalog_files, catalog_functions  # noqa: E402, F401  (they register theirs)
