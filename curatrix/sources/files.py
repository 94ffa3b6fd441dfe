"""JSON, JSON lines and reference texts as tables, and small driver-side artifacts."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACTS = {name: f"{name}.{ext}" for ext, names in {"json": ["taxonomy", "strategies", "run_state", "eval_report", "cost_summary"], "jsonl": ["meta_prompts", "raw", "accepted", "final", "evaluated", "llm_calls"]}.items() for name in names}


def artifact(folder: str, name: str) -> str:
    return str(Path(folder) / ARTIFACTS[name])


def read_json(path: str, default: Any = None) -> Any:
    """A small JSON document; the default where the file is missing."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if os.path.exists(path) else default


def write_json(path: str, data: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_lines(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(value): the JSON lines of a file or folder as text. Blank lines are skipped, a missing path has none.

    Strict reading fails on a line that isn't JSON; tolerant reading leaves it out.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "value string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return valid_lines(lines) if tolerant else lines.filter(F.parse_json("value").isNotNull())


def valid_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.try_parse_json("value").isNotNull())


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Typed rows of JSON lines. The schema is given, not inferred: one pass over the files."""
    rows = json_lines(spark, path, tolerant)
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """Rows as JSON lines, nulls kept; appending adds files and leaves those there alone."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def reference_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text) of reference files, missing ones skipped.

    A JSON object gives its ``record`` (a string as it is, anything else as
    JSON) or itself where it has none; a line that isn't JSON is the text; a
    JSON value that isn't an object gives its own text.
    """
    have = [p for p in paths if _exists(spark, p)]
    if not have:
        return spark.createDataFrame([], "text string")
    lines = spark.read.text(have).filter(F.trim("value") != "")
    return lines.select(reference_text(F.col("value")).alias("text"))


def reference_text(line):
    parsed = F.try_parse_json(line)
    record = F.coalesce(F.try_variant_get(parsed, "$.record", "string"), F.to_json(F.try_variant_get(parsed, "$.record", "variant")))
    return F.coalesce(record, F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")), line)


def classify(name: str, text: str) -> str:
    """What an artifact is: by extension, then by its keys."""
    lower = name.lower()
    if lower.endswith((".yaml", ".yml")):
        return "config"
    head = text.lstrip().splitlines()[0] if text.strip() else ""
    try:
        data = json.loads(head if lower.endswith(".jsonl") else text)
    except json.JSONDecodeError:
        return "unknown"
    keys = set(data) if isinstance(data, dict) else set()
    for kind, needed in (("taxonomy", {"factors"}), ("cost", {"by_role_task_model"}), ("report", {"dedupe"}), ("calls", {"role", "task", "prompt"}), ("dataset", {"record"}), ("meta_prompts", {"meta_prompt"}), ("strategies", {"strategies"})):
        if needed <= keys:
            return kind
    return "strategies" if isinstance(data, list) else "unknown"
