"""Queries over model-driven generation, with the deterministic backend: its answers are md5 numbers of the call's key, so SQL can give most of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators import taxonomy as X
from ..session import materialise, table
from . import config
from . import generation as G
from .backend import Stub

QA = {"type": "object", "required": ["input", "output"], "properties": {"input": {"type": "string"}, "output": {"type": "string"}}}
#: What the stub generates breaks this schema, and what it repairs keeps to it.
MENDED = {"type": "object", "required": ["output"], "properties": {"input": {"type": "string"}, "output": {"type": "string", "enum": ["mended"]}}}


def settings(schema: dict[str, Any] | None = None, **generation: Any) -> config.Config:
    return config.parse({
        "description": "questions and answers", "models": {r: {"model": f"{r}-model"} for r in config.ROLES}, "schema": schema, "project": {"output_dir": "unused", "seed": 5},
        "taxonomy": {"max_depth": 2, "best_of": 2}, "generation": {"target_size": 60, "concurrency": 8, "max_refine_attempts": 1} | generation,
    })


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """A meta row for each document; those of ids divisible by ten have failed."""
    failed = F.col("doc_id") % 10 == 0
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("attempt_index"), F.col("source").alias("strategy_id"), F.array().cast(sampling.MIX_DDL).alias("taxonomy_mix"), F.when(failed, "").otherwise(F.concat(F.lit("Write like "), "lang")).alias("meta_prompt"),
        F.lit(False).alias("complexified"), F.when(failed, "no mix").alias("error"),
    )


def _n(task: str, key: str) -> str:
    return f"cast('0x' || substr(md5('{task}:' || {key}), 1, 8) as bigint)"


def _call(task: str, number: int) -> str:
    return _n(task, f"'row:' || doc_id || ':{number}'")


_LOOP = f"""a as (select doc_id, doc_id % 10 = 0 as failed, {_call('generate', 0)} as g0, {_call('semantic_critic', 1)} % 4 <> 0 as c1, {_call('refine', 2)} as r2,
  {_call('semantic_critic', 3)} % 4 <> 0 as c3, {_call('refine', 4)} as r4 from documents),
o as (select *, case when failed then 0 when c1 then 1 else 2 end as critiques, case when failed or c1 then 0 when c3 then 1 else 2 end as refinements from a)"""


def generated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all attempts: generation, check, critique and refinement; failed meta rows are rejected without a call."""
    rows = G.generate(_prompts(spark, d), settings(QA), Stub())
    return rows.select("attempt_index", "record", "output_format", "strategy_id", "meta_prompt", "schema_valid", "accepted", "rejection_reason", F.size("critic_verdicts").alias("critiques"), F.size("calls").alias("calls"))


GENERATED = f"""with {_LOOP}
select o.doc_id as attempt_index, case when failed then null else '{{"input": "question ' || (case refinements when 0 then g0 when 1 then r2 else r4 end) || '", "output": "' || (case refinements when 0 then 'answer ' || g0 % 7919 else 'refined' end) || '"}}' end as record,
  'json' as output_format, source as strategy_id, case when failed then '' else 'Write like ' || lang end as meta_prompt, not failed as schema_valid, not failed and (c1 or c3) as accepted,
  case when failed then 'no mix' when c1 or c3 then null else 'checked' end as rejection_reason, cast(critiques as integer) as critiques, cast(case when failed then 0 else 1 + critiques + refinements end as integer) as calls
from o join documents using (doc_id)"""


def generated_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same without a schema: records are texts, always valid."""
    return G.generate(_prompts(spark, d), settings(None), Stub()).select("attempt_index", "output_format", "schema_valid", "accepted", F.length("record").alias("length"), F.size("critic_verdicts").alias("critiques"))


TEXTS = f"""with {_LOOP}
select doc_id as attempt_index, 'text' as output_format, not failed as schema_valid, not failed and (c1 or c3) as accepted,
  cast(case when failed then null else length('{{"input": "question ' || (case refinements when 0 then g0 when 1 then r2 else r4 end) || '", "output": "' || (case refinements when 0 then 'answer ' || g0 % 7919 else 'refined' end) || '"}}') end as integer) as length,
  cast(critiques as integer) as critiques from o"""


def repaired_rows(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the schema is repaired once; a refinement that breaks it is rejected."""
    rows = G.generate(_prompts(spark, d), settings(MENDED), Stub())
    return rows.select("attempt_index", "record", "schema_valid", "accepted", F.size("critic_verdicts").alias("critiques"), F.size("calls").alias("calls"))


REPAIRED = f"""with a as (select doc_id, doc_id % 10 = 0 as failed, {_call('repair', 1)} as m, {_call('semantic_critic', 2)} % 4 <> 0 as ok, {_call('refine', 3)} as r from documents)
select doc_id as attempt_index, case when failed then null when ok then '{{"input": "question ' || m || '", "output": "mended"}}' else '{{"input": "question ' || r || '", "output": "refined"}}' end as record,
  not failed and ok as schema_valid, not failed and ok as accepted, cast(case when failed then 0 else 1 end as integer) as critiques, cast(case when failed then 0 when ok then 3 else 4 end as integer) as calls from a"""


def generation_calls(spark: SparkSession, d: str) -> DataFrame:
    """The call log of the rows, by role, task and model."""
    calls = G.call_log(G.generate(_prompts(spark, d), settings(QA), Stub()))
    return calls.groupBy("role", "task", "model").agg(F.count("*").alias("calls"))


CALLS = f"""with {_LOOP}
select 'bulk' as role, 'generate' as task, 'bulk-model' as model, count(*) as calls from o where not failed
union all select 'critic', 'semantic_critic', 'critic-model', cast(sum(critiques) as bigint) from o union all select 'bulk', 'refine', 'bulk-model', cast(sum(refinements) as bigint) from o"""


def nodes_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The node that the critic names for every document in each of two factors."""
    outlines = spark.createDataFrame([("lang", "- lang"), ("source", "- source")], "factor string, outline string")
    return G.assign_nodes(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), outlines, settings(QA), Stub())


ASSIGNED = f"""select cast(doc_id as varchar) as id, factor, 'kind' || n % 97 || '-' || n % 3 as wanted
from (select doc_id, factor, {_n('node_assign', "doc_id || ':' || factor || ':0'")} as n from documents, (values ('lang'), ('source')) f(factor))"""


def taxonomy_built(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy grown level by level: two proposals a node, merged by the critic."""
    return X.from_tree(spark, G.build_taxonomy(spark, settings(QA), Stub())).select("factor", "name", "level", "path_str", "weight")


def _kids(source: str, level: int) -> str:
    return f"""select factor, 'kind' || n % 97 || '-' || i as name, {level} as level, path_str || '/kind' || n % 97 || '-' || i as path_str
from (select *, {_n('taxonomy_critic', "path_str || ':2'")} as n from {source}), (values (0), (1)) k(i)"""


TREE = f"""with l0 as (select 'factor' || i as factor, 'factor' || i as name, 0 as level, 'factor' || i as path_str from (values (0), (1)) k(i)),
l1 as ({_kids('l0', 1)}), l2 as ({_kids('l1', 2)})
select *, cast(1 as double) as weight from (select * from l0 union all select * from l1 union all select * from l2)"""


def strategies_built(spark: SparkSession, d: str) -> DataFrame:
    """Where the model proposes no strategy there is one over all factors."""
    cfg = settings(QA)
    got, _ = G.build_strategies(spark, cfg, X.from_tree(spark, G.build_taxonomy(spark, cfg, Stub())), Stub())
    return G.strategies_frame(spark, got).select("id", F.array_join("roots", " ").alias("roots"), "weight", F.size("never_combine").alias("rules"))


STRATEGIES = "select 'general' as id, 'factor0 factor1' as roots, cast(1 as double) as weight, cast(0 as integer) as rules"


def attempts_planned(spark: SparkSession, d: str) -> DataFrame:
    """As many attempts as the target and the ratio ask for."""
    cfg = settings(QA, target_size=1000, overgenerate_ratio=1.25)
    return sampling.attempts(spark, cfg.generation.target_size, cfg.generation.overgenerate_ratio).select("attempt_index")


ATTEMPTS = "select range as attempt_index from range(1250)"


def meta_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Strategy, mix, prompt and coin of each attempt, by Python's generator: without SQL."""
    cfg = settings(QA)
    tree = G.build_taxonomy(spark, cfg, Stub())
    strategies = [{"id": "all", "roots": [f["name"] for f in tree["factors"]], "weight": 1.0, "never_combine": []}]
    attempts = materialise(sampling.attempts(spark, 200, 1.0))
    rows = G.meta_prompts(attempts, cfg, tree, strategies, Stub())
    return rows.select("attempt_index", "strategy_id", F.array_join(F.transform("taxonomy_mix", lambda m: F.array_join(m["path"], "/")), " ").alias("mix"), "meta_prompt", "complexified", "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (generated_rows, generated_texts, repaired_rows, generation_calls, nodes_assigned, taxonomy_built, strategies_built, attempts_planned, meta_prompts)}
SQL = {"generated_rows": GENERATED, "generated_texts": TEXTS, "repaired_rows": REPAIRED, "generation_calls": CALLS, "nodes_assigned": ASSIGNED, "taxonomy_built": TREE, "strategies_built": STRATEGIES, "attempts_planned": ATTEMPTS}
