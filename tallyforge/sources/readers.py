"""Readers. Files are listed and read by Spark; nothing but paths and settings comes to the driver."""

from __future__ import annotations

import io
import json
import re
import warnings
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import id_field, id_name, id_spec
from ..operators.parsing import environment_tasks


def stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def files(spark: SparkSession, paths: list[str], pattern: str = "*", recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, stem, length[, content]): files whose name matches the pattern, each once, below the paths."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = read.load(paths).withColumn("stem", stem(F.col("path")))
    return found.select("path", "stem", "length", *(["content"] if content else [])).dropDuplicates(["path"])


def stems(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(stem) of the files of one folder with the suffix, in order."""
    return files(spark, [path], f"*{suffix}", recursive=False).select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), suffix.replace(".", r"\.") + "$", "").alias("stem")).orderBy("stem")


def texts(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """(path, stem, text): one row a file."""
    read = spark.read.text(paths, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("stem", stem(F.col("path")))


def usable(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Of the paths the folders and the files with one of the suffixes, each once, in order; others are skipped with a warning."""
    context = spark.sparkContext
    out: dict[str, None] = {}
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(context._jsc.hadoopConfiguration())
        if not system.exists(at):
            warnings.warn(f"{path} isn't there and is skipped", stacklevel=2)
        elif not system.getFileStatus(at).isDirectory() and not path.lower().endswith(suffixes):
            warnings.warn(f"{path} is neither a folder nor a file of {', '.join(suffixes)} and is skipped", stacklevel=2)
        else:
            out.setdefault(system.resolvePath(at).toString())
    return list(out)


def specs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, stem, text): .yml and .yaml files, each once; paths that aren't there, or are other files, are skipped with a warning."""
    found = usable(spark, paths, (".yml", ".yaml"))
    if not found:
        return spark.createDataFrame([], "path string, stem string, text string").select("path", "text", "stem")
    return texts(spark, found, "*.{yml,yaml}").dropDuplicates(["path"])


def tools(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, field, spec, name, tool): a row for each .json file; tool is null for a file that is no JSON."""
    read = texts(spark, paths, "*.json")
    return read.select(F.col("stem").alias("id"), id_field(F.col("stem")).alias("field"), id_spec(F.col("stem")).alias("spec"), id_name(F.col("stem")).alias("name"), F.when(F.try_parse_json("text").isNotNull(), F.col("text")).alias("tool"))


def environment_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, stem, text) of *.environment.yml; a path that isn't there raises."""
    return texts(spark, paths, "*.environment.yml")


def environments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, stem, position, task_type, task, metadata) of environment files whose text lies under tool_set_yml, or is the file itself."""
    import yaml

    @F.pandas_udf("string")
    def inner(values: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = yaml.safe_load(text)
            except yaml.YAMLError:
                return text
            return value["tool_set_yml"] if isinstance(value, dict) and isinstance(value.get("tool_set_yml"), str) else text

        return values.map(one)

    return environment_tasks(environment_files(spark, paths).withColumn("text", inner("text")))


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The objects of a file: of each line, without blank and # lines; if any line is no JSON, of the whole file as one object or list of objects."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    bad = lines.where(F.try_parse_json("value").isNull()).limit(1).count()
    if not bad:
        rows = lines.where(F.ltrim("value").startswith("{")).select("value")
    else:
        whole = spark.read.text(path, wholetext=True)
        items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<variant>")).otherwise(F.array(F.try_parse_json("value")))
        rows = whole.select(F.explode(items).alias("item")).select(F.to_json("item").alias("value")).where(F.col("value").startswith("{"))
    if schema is None:
        found = rows.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
        schema = re.sub(r"\bVOID\b", "STRING", found.replace("OBJECT<", "STRUCT<"))
    return rows.select(F.from_json("value", schema).alias("__row")).select("__row.*")


def embeddings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(id, embedding, model, text_length): of .npz files. A file that can't be read, or isn't one vector, has a null embedding; with strict it raises.

    The id is that in the file, else the file's stem. strict gives doubles, else floats.
    """

    def read(content: bytes, name: str) -> tuple:
        try:
            with np.load(io.BytesIO(content), allow_pickle=False) as f:
                vector = np.asarray(f["embedding"], np.float64 if strict else np.float32)
                if vector.ndim != 1:
                    raise ValueError(f"{name}: the embedding has {vector.ndim} dimensions")
                text = lambda k: str(f[k]) if k in f else None
                return text("id") or name, vector.tolist(), text("model"), int(f["text_length"]) if "text_length" in f else None
        except Exception:
            if strict:
                raise
            return name, None, None, None

    def run(batches):
        for part in batches:
            yield pd.DataFrame([read(c, s) for c, s in zip(part["content"], part["stem"])], columns=["id", "embedding", "model", "text_length"])

    kind = "double" if strict else "float"
    return files(spark, [path], "*.npz", content=True).select("stem", "content").mapInPandas(run, f"id string, embedding array<{kind}>, model string, text_length long")


def evaluation_logs(spark: SparkSession, path: str) -> DataFrame:
    """(folder, kind, file_name, judgment, text): the judge and log files of each tool's folder; logs are meta_data_tool_call.json and Tool_call_<n>.json."""
    read = texts(spark, [path], "*.json").withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    judge = F.col("file_name").endswith(".judge.json")
    log = F.col("file_name").rlike(r"^(meta_data_tool_call|Tool_call_\d+)\.json$")
    return read.select("folder", F.when(judge, "judge").when(log, "log").otherwise("other").alias("kind"), "file_name", F.when(judge, F.get_json_object("text", "$.judgment")).alias("judgment"), "text")


def tool_call_tests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(folder, name, failure_mode, parameters, message): the entries of tool_calls.json files."""
    read = texts(spark, paths, "tool_calls.json").withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    rows = read.select("folder", F.explode(F.from_json("text", "map<string,struct<`Failure mode`:string,`Tool parameters`:string,`Tool call message`:string>>")).alias("name", "v"))
    return rows.select("folder", "name", F.col("v")["Failure mode"].alias("failure_mode"), F.col("v")["Tool parameters"].alias("parameters"), F.col("v")["Tool call message"].alias("message"))


def test_cases(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """JSON lines of several files, one after another, without blank lines; columns by name."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = None
    for path in paths:
        part = reader.json(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def interaction_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(task, n, key, value): the long form of interaction logs (interaction_<n>: mapping of texts)."""

    def run(batches):
        import yaml

        for part in batches:
            rows = []
            for name, text in zip(part["stem"], part["text"]):
                for k, v in (yaml.safe_load(text) or {}).items():
                    if str(k).startswith("interaction_") and isinstance(v, dict):
                        rows += [(name, int(str(k).rpartition("_")[2]), str(a), b if isinstance(b, str) else json.dumps(b, default=str)) for a, b in v.items()]
            yield pd.DataFrame(rows, columns=["task", "n", "key", "value"])

    return texts(spark, paths, "*.log.yml").mapInPandas(run, "task string, n int, key string, value string")


def expanded(argument: str) -> list[str]:
    """The files that one argument names: a JSON list, names with commas, a file, or the files of a folder (not below), in order."""
    argument = argument.strip()
    try:
        names = json.loads(argument) if argument.startswith("[") else [a.strip() for a in argument.split(",")]
    except ValueError:
        names = [argument]
    out = []
    for name in names:
        path = Path(name)
        out += sorted(str(p) for p in path.iterdir() if p.is_file()) if path.is_dir() else [str(path)]
    return out


def settings(path: str) -> dict:
    """A YAML file of settings; one that can't be read, or is no mapping, raises."""
    import yaml

    value = yaml.safe_load(Path(path).read_text())
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no settings")
    return value


def numbered(df: DataFrame, group: str, order: str, name: str = "n") -> DataFrame:
    """df with a number from 1 within each group, by order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))
