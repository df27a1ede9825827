"""Queries of readers and writers: files made from the driver's tables in the shared folder, read again, and compared with SQL."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing
from ..sources import readers, sinks
from .catalog import query
from .scratch import shared_dir
from .spread import spread


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession).rstrip('/').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def _put(df: DataFrame, name: str) -> str:
    """The folder that holds each row's text (or bytes) under its path; written by the executors."""
    folder = _folder(df, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for part in batches:
            for path, text in zip(part["path"], part["text"]):
                system.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{path}") as f:
                    f.write(text if isinstance(text, bytes) else text.encode())
            yield pd.DataFrame({"n": [len(part)]})

    df.select("path", "text").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return folder


def _named(t) -> DataFrame:
    """(path, text) of two files for each nation, one of them in a folder below."""
    tool = F.concat(F.lit('{"tool_name": "'), "n_name", F.lit('", "n": '), "n_nationkey", F.lit("}"))
    at = F.concat(F.lit("r"), "n_regionkey", F.lit("_tool_spec_"), "n_nationkey", F.lit("__"), T.joined_name(F.col("n_name")))
    top = t("nation").select(F.concat(at, F.lit(".json")).alias("path"), tool.alias("text"))
    below = t("nation").select(F.concat(F.lit("below/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ".yml").otherwise(".yaml")).alias("path"), F.lit("a: 1").alias("text"))
    return top.union(below)


_TOOL = "'r' || n_regionkey || '_tool_spec_' || n_nationkey || '__' || regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')"


@query("list_stems", f"SELECT {_TOOL} AS stem FROM nation")
def _(t):
    rows = _named(t)
    return readers.stems(rows.sparkSession, _put(rows, "stems"), ".json")


@query("find_yaml", "SELECT lower(n_name) AS stem FROM nation")
def _(t):
    import warnings

    rows = _named(t)
    folder = _put(rows, "yaml")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # one path isn't there, one is named twice, one is of another kind
        return readers.specs(rows.sparkSession, [folder, f"{folder}/missing", f"{folder}/below/", f"{folder}/below/", folder]).select("stem")


@query("find_json", f"SELECT {_TOOL} AS stem, length('{{\"tool_name\": \"' || n_name || '\", \"n\": ' || n_nationkey || '}}') AS length FROM nation")
def _(t):
    rows = _named(t)
    return readers.files(rows.sparkSession, [_put(rows, "json")], "*.json").select("stem", "length")


@query("expand_argument", "SELECT CAST(n_nationkey AS BIGINT) AS position, 'f' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS name FROM nation")
def _(t):
    rows = t("nation").select(F.concat(F.lit("f"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("path"), F.lit("x").alias("text"))
    names = readers.expanded(_put(rows, "argument"))
    return rows.sparkSession.createDataFrame([(k, n.rpartition("/")[2]) for k, n in enumerate(names)], "position long, name string")


@query("tool_files", f"SELECT {_TOOL} AS id, 'r' || n_regionkey AS field, CAST(n_nationkey AS BIGINT) AS spec, regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g') AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS tool_name FROM nation")
def _(t):
    rows = _named(t).where("path not like 'below%'").withColumn("text", F.when(T.id_spec(F.col("path")) % 3 == 0, F.concat(F.lit("{broken "), "text")).otherwise(F.col("text")))
    found = readers.tools(rows.sparkSession, [_put(rows, "tools")])
    return found.select("id", "field", "spec", "name", F.get_json_object("tool", "$.tool_name").alias("tool_name"))


@query("json_lines", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    line = F.concat(F.lit('{"s_suppkey": '), "s_suppkey", F.lit(', "s_name": "'), "s_name", F.lit('"}'))
    rows = t("supplier").groupBy(F.lit("a.jsonl").alias("path")).agg(F.concat(F.lit("# note\n\n[1]\n7\n"), F.array_join(F.collect_list(line), "\n\n"), F.lit("\n")).alias("text"))
    return readers.json_rows(rows.sparkSession, f"{_put(rows, 'lines')}/a.jsonl", "s_suppkey long, s_name string")


@query("json_whole", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    line = F.concat(F.lit('{"s_suppkey": '), "s_suppkey", F.lit(',\n "s_name": "'), "s_name", F.lit('"}'))
    rows = t("supplier").groupBy(F.lit("a.json").alias("path")).agg(F.concat(F.lit("[4,\n"), F.array_join(F.collect_list(line), ",\n"), F.lit("]\n")).alias("text"))
    return readers.json_rows(rows.sparkSession, f"{_put(rows, 'whole')}/a.json", "s_suppkey long, s_name string")


def _vectors(t, faulty: bool) -> str:
    @F.pandas_udf("binary")
    def packed(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        import numpy as np

        def one(i, v):
            out = io.BytesIO()
            if i % 7 == 1 and faulty:
                return b"no vector" if i % 2 else one(-1, np.ones((2, 2)))
            np.savez(out, embedding=np.asarray(v), text_length=len(v), **({} if i < 0 or i % 2 else {"id": f"v{i}"}))
            return out.getvalue()

        return pd.Series([one(i, v) for i, v in zip(ids, vectors)])

    rows = t("embeddings").select(F.concat("vec_id", F.lit(".npz")).alias("path"), packed("vec_id", "embedding").alias("text"))
    return _put(rows, "vectors")


_VECTOR_ID = "CASE WHEN vec_id % 2 = 0 {} THEN 'v' || vec_id ELSE CAST(vec_id AS VARCHAR) END"


@query("vectors_tolerant", f"""SELECT {_VECTOR_ID.format("AND vec_id % 7 <> 1")} AS id, CASE WHEN vec_id % 7 <> 1 THEN len(embedding) END AS size, CASE WHEN vec_id % 7 <> 1 THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings""")
def _(t):
    found = readers.embeddings(t("embeddings").sparkSession, _vectors(t, True))
    return found.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("vectors_strict", f"""SELECT {_VECTOR_ID.format("")} AS id, len(embedding) AS text_length, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def _(t):
    found = readers.embeddings(t("embeddings").sparkSession, _vectors(t, False), strict=True)
    return found.select("id", "text_length", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("evaluation_logs", """SELECT 's_tool_spec_' || s_suppkey || '__T' AS folder, n AS file_name, CASE WHEN n = 'meta_data_tool_call.judge.json' THEN 'judge' WHEN n = 'notes.json' THEN 'other' ELSE 'log' END AS kind,
CASE WHEN n = 'meta_data_tool_call.judge.json' THEN CASE WHEN s_acctbal > 0 THEN 'correct' ELSE 'inappropriate_response' END END AS judgment
FROM supplier, unnest(['meta_data_tool_call.json', 'meta_data_tool_call.judge.json', 'Tool_call_' || s_nationkey || '.json', 'notes.json']) AS u(n)""")  # fmt: skip
def _(t):
    names = F.array(F.lit("meta_data_tool_call.json"), F.lit("meta_data_tool_call.judge.json"), F.concat(F.lit("Tool_call_"), "s_nationkey", F.lit(".json")), F.lit("notes.json"))
    verdict = F.concat(F.lit('{"judgment": "'), F.when(F.col("s_acctbal") > 0, "correct").otherwise("inappropriate_response"), F.lit('"}'))
    rows = t("supplier").withColumn("name", F.explode(names)).select(F.concat(F.lit("s_tool_spec_"), "s_suppkey", F.lit("__T/"), "name").alias("path"), verdict.alias("text"))
    return readers.evaluation_logs(rows.sparkSession, _put(rows, "logs")).select("folder", "file_name", "kind", "judgment")


@query("tool_call_tests", "SELECT 's' || s_suppkey AS folder, 'Tool call ' || n AS name, 'mode ' || n AS failure_mode, s_name || '[a = ' || n || ']' AS message FROM supplier, range(1, 3) AS r(n)")
def _(t):
    one = lambda n: F.concat(F.lit(f'"Tool call {n}": {{"Failure mode": "mode {n}", "Tool parameters": "a", "Tool call message": "'), F.col("s_name"), F.lit(f'[a = {n}]"}}'))
    rows = t("supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit("/tool_calls.json")).alias("path"), F.concat(F.lit("{"), one(1), F.lit(", "), one(2), F.lit("}")).alias("text"))
    return readers.tool_call_tests(rows.sparkSession, [_put(rows, "tests")]).select("folder", "name", "failure_mode", "message")


@query("test_cases", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name FROM supplier")
def _(t):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(', "name": "'), "s_name", F.lit('"'))).otherwise("")
    line = F.concat(F.lit('{"id": '), "s_suppkey", name, F.lit("}"))
    rows = t("supplier").groupBy(F.concat(F.lit("c"), F.col("s_suppkey") % 2, F.lit(".jsonl")).alias("path")).agg(F.array_join(F.collect_list(line), "\n\n").alias("text"))
    folder = _put(rows, "cases")
    return readers.test_cases(rows.sparkSession, [f"{folder}/c1.jsonl", f"{folder}/c0.jsonl"], "id long, name string")


@query("environment_files", "SELECT 'e' || n_nationkey || '.environment' AS stem, CAST(1 AS INTEGER) AS position, 'only' AS task_type, n_name AS task, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def _(t):
    plain = F.concat(F.lit("meta_data: {region: "), "n_regionkey", F.lit("}\ntasks:\n  - {task_type: only, task: "), "n_name", F.lit("}\n"))
    inner = F.concat(F.lit("tool_set_yml: |\n"), T.indented(plain, "  "))
    rows = t("nation").select(F.concat(F.lit("below/e"), "n_nationkey", F.lit(".environment.yml")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, plain).otherwise(inner).alias("text"))
    rows = rows.union(t("region").select(F.concat("r_name", F.lit(".yml")).alias("path"), F.lit("tasks: [x]").alias("text")))
    found = readers.environments(rows.sparkSession, [_put(rows, "environments")])
    return found.select("stem", "position", "task_type", F.get_json_object("task", "$.task").alias("task"), F.get_json_object("metadata", "$.region").cast("long").alias("region"))


@query("settings_arguments", "SELECT '--r-' || lower(replace(r_name, ' ', '-')) AS argument, CAST(r_regionkey AS VARCHAR) AS value FROM region WHERE r_regionkey % 2 = 0")
def _(t):
    from .steps import arguments

    line = F.concat(F.lit("  r_"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit(": "), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey").cast("string")).otherwise("null"))
    rows = t("region").groupBy(F.lit("s.yml").alias("path")).agg(F.concat(F.lit("step:\n  off: false\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    given = arguments(readers.settings(f"{_put(rows, 'settings')}/s.yml".removeprefix("file:"))["step"])
    return rows.sparkSession.createDataFrame(list(zip(given[::2], given[1::2])), "argument string, value string")


@query("interaction_log", "SELECT 't' || s_suppkey || '.log' AS task, CAST(n AS INTEGER) AS n, 'agent' AS key, s_name || '()' AS value FROM supplier, range(1, 3) AS r(n)")
def _(t):
    one = lambda n: F.concat(F.lit(f"interaction_{n}:\n  agent: "), F.col("s_name"), F.lit("()\n"))
    rows = t("supplier").select(F.concat(F.lit("t"), "s_suppkey", F.lit(".log.yml")).alias("path"), F.concat(one(1), F.lit("other: 3\n"), one(2)).alias("text"))
    return readers.interaction_log(rows.sparkSession, [_put(rows, "interactions")])


# writers


def _flags(t) -> DataFrame:
    tau = F.explode(F.array(F.lit("0.75"), F.lit("0.9")))
    return t("labels").select(F.col("doc_id").alias("id"), tau.alias("tau"), "quality", "toxic").select("id", "tau", ((F.col("tau") == "0.9") & (F.col("toxic") == 1) | (F.col("tau") == "0.75") & (F.col("quality") == 0)).alias("dropped"))


@query("tool_list_file", 'SELECT doc_id AS id, quality = 0 AS "dropped_0.75", toxic = 1 AS "dropped_0.9" FROM labels')
def _(t):
    tools = t("labels").select(F.col("doc_id").alias("id"))
    sinks.tool_list(tools, folder := _folder(tools, "list"), _flags(t), ["0.75", "0.9"])
    return tools.sparkSession.read.schema("id long, `dropped_0.75` boolean, `dropped_0.9` boolean").json(folder)


@query("survivor_files", "SELECT tau, doc_id AS id FROM labels, unnest(['0.75', '0.9']) AS u(tau) WHERE NOT (tau = '0.9' AND toxic = 1 OR tau = '0.75' AND quality = 0)")
def _(t):
    tools = t("labels").select(F.col("doc_id").alias("id"), F.lit("{}").alias("tool"))
    sinks.survivors(tools, _flags(t), folder := _folder(tools, "survivors"))
    return tools.sparkSession.read.schema("id long, tool string, tau string").json(folder).select("tau", "id")


@query("last_of_slug", "SELECT n_regionkey AS spec, max(n_nationkey) AS position, 'Tool_' || n_regionkey AS slug FROM nation GROUP BY n_regionkey")
def _(t):
    given = t("nation").select(F.col("n_regionkey").alias("spec"), F.col("n_nationkey").alias("position"), T.slug(F.concat(F.lit(" Tool  "), "n_regionkey", F.lit("-"))).alias("slug"))
    return parsing.last_of_slug(given)


@query("vector_file", "SELECT vec_id AS id, 'm' AS model, len(embedding) AS embedding_dim, CAST(1.0 AS DOUBLE) AS length, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 5) AS first FROM embeddings")
def _(t):
    given = t("embeddings").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"), "embedding", F.lit(3).alias("text_length"))
    sinks.vectors(given, folder := _folder(given, "parquet"))
    back = given.sparkSession.read.parquet(folder)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return back.select("id", "model", "embedding_dim", F.round(F.sqrt(square), 5).alias("length"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("statistics_files", "SELECT 'sources' AS name, source AS key, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'languages', lang, count(*) FROM documents GROUP BY lang")
def _(t):
    count = lambda c: t("documents").groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    frames = {"sources": count("source"), "nothing": count("source").where("n < 0"), "languages": count("lang")}
    folder = _folder(frames["sources"], "statistics")
    written = sinks.statistics(frames, folder)
    read = t("documents").sparkSession.read.schema("key string, n long").option("header", "true")
    parts = [read.csv(f"{folder}/{name}").select(F.lit(name).alias("name"), "key", "n") for name in written]
    return parts[0].union(parts[1])


@query("literal_yaml", "SELECT p_partkey, 'name: |-' || chr(10) || '  ' || p_name || chr(10) || '  end' || chr(10) || 'size: ' || p_size || chr(10) AS text FROM part")
def _(t):
    record = F.to_json(F.struct(F.concat("p_name", F.lit("\nend")).alias("name"), F.col("p_size").alias("size")))
    return spread(t("part").select("p_partkey", record.alias("record"))).select("p_partkey", sinks.literal_yaml(F.col("record")).alias("text"))


@query("judged_files", "SELECT doc_id AS id, CASE quality WHEN 1 THEN 'correct' ELSE 'inappropriate_response' END AS judgment FROM labels")
def _(t):
    given = t("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "correct").otherwise("inappropriate_response").alias("judgment"), F.lit(1.0).alias("confidence"), F.lit("r").alias("reasoning"))
    sinks.judged(given, folder := _folder(given, "judged"))
    return given.sparkSession.read.schema("id long, judgment string").json(folder)


@query("appended_log", "SELECT conv_id, turn, role, 2 AS times FROM conversations")
def _(t):
    given = t("conversations").select("conv_id", "turn", "role")
    folder = _folder(given, "appended")
    for _ in range(2):
        sinks.appended(given, folder, ["role"])
    back = given.sparkSession.read.schema("conv_id long, turn long, role string").json(folder)
    return back.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("result_files", "SELECT CASE WHEN conv_id % 2 = 0 THEN 'normal_multi_turn_' || role ELSE 'special_' || role END AS category, count(*) AS n FROM conversations GROUP BY ALL")
def _(t):
    test_id = F.when(F.col("conv_id") % 2 == 0, F.concat_ws("_", F.lit("normal_multi_turn"), "role", "turn", F.lit("0"))).otherwise(F.concat_ws("_", F.lit("special"), "role", "turn"))
    given = t("conversations").select(test_id.alias("id"), "conv_id")
    sinks.results(given, folder := _folder(given, "results"))
    return given.sparkSession.read.schema("id string, conv_id long, category string").json(folder).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("chat_index", 'SELECT conv_id, turn, CAST(7 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS "index" FROM conversations')
def _(t):
    return sinks.chat_index(t("conversations").select("conv_id", "turn"), 7, "conv_id", "turn")


@query("task_files", "SELECT CAST(n_regionkey AS INTEGER) AS spec, CAST(n_nationkey AS BIGINT) AS n, n_name AS task FROM nation")
def _(t):
    given = t("nation").select(F.col("n_regionkey").alias("spec"), F.col("n_nationkey").alias("n"), F.col("n_name").alias("task"))
    sinks.per_task(given, folder := _folder(given, "tasks"))
    return given.sparkSession.read.schema("spec int, n long, task string").json(folder)


@query("dialogue_table", "SELECT n_nationkey, 'sender | recipient | message' || chr(10) || 'user   | agent     | ' || n_name || chr(10) || '       |           | end' AS text FROM nation")
def _(t):
    @F.pandas_udf("string")
    def table(names: pd.Series) -> pd.Series:
        return names.map(lambda n: sinks.dialogue([("user", "agent", f"{n}\nend")]))

    return t("nation").select("n_nationkey", table("n_name").alias("text"))
