"""Generation: meta prompts, records, critique and refinement, one row per attempt.

Each phase is one mapInPandas over the attempts that lack a row, so a run
resumes where it stopped. A worker runs a row's calls in order; rows run side
by side. Errors become columns of the row, never failures of the task.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S
from . import prompts as P
from .backend import Backend, Router
from .config import Config

CALL_DDL = "array<struct<role:string,task:string,model:string,in_tokens:long,out_tokens:long,duration_seconds:double>>"
META_DDL = f"attempt_index long, strategy_id string, taxonomy_mix {S.MIX_DDL}, meta_prompt string, complexified boolean, error string, calls {CALL_DDL}"
ROW_DDL = (
    f"id string, attempt_index long, record string, output_format string, taxonomy_mix {S.MIX_DDL}, strategy_id string, meta_prompt string, complexified boolean, generator_model string, "
    f"critic_verdicts array<struct<verdict:string,explanation:string>>, schema_valid boolean, accepted boolean, rejection_reason string, created_at timestamp, calls {CALL_DDL}"
)


def check_record(schema: dict[str, Any] | None, record: Any, at: str = "$") -> str | None:
    """The first violation of the schema subset by a parsed record; None where it is valid. Booleans are no numbers; 1.0 is an integer."""
    if schema is None:
        return None
    number = isinstance(record, (int, float)) and not isinstance(record, bool)
    fits = {
        "object": isinstance(record, dict), "array": isinstance(record, list), "string": isinstance(record, str), "boolean": isinstance(record, bool),
        "number": number, "integer": number and float(record).is_integer(),
    }[schema["type"]]
    if not fits:
        return f"{at} is not of type {schema['type']}"
    if "enum" in schema and record not in schema["enum"]:
        return f"{at} is not one of the allowed values"
    if schema["type"] == "object":
        for name in schema.get("required", []):
            if name not in record:
                return f"{at}['{name}'] is required"
        for name, inner in sorted((schema.get("properties") or {}).items()):
            if name in record and (error := check_record(inner, record[name], f"{at}['{name}']")):
                return error
    if schema["type"] == "array":
        for i, item in enumerate(record):
            if error := check_record(schema["items"], item, f"{at}[{i}]"):
                return error
    return None


def meta_row(cfg: Config, draws: S.Draws, strategies: list[dict[str, Any]], router: Router, builders: dict, index: int) -> tuple:
    """One attempt's strategy, mix and prompt; what fails is said in ``error``."""
    rng = random.Random(cfg.project.seed + index)
    strategy_id, mix, prompt, hard, error = "error", [], "", False, None
    try:
        strategy = S.draw_strategy(strategies, rng)
        strategy_id = strategy.get("id", "general")
        mix = draws.mix(strategy, rng)
        got = router.complete_json("bulk", "meta_prompt", P.JSON_SYSTEM, builders["meta_prompt_prompt"](cfg.description, cfg.schema, mix, cfg.generation.scenarios_per_mix))
        prompt = rng.choice(got.get("meta_prompts") or ["Write one item."])
        hard = rng.random() < cfg.generation.complexity_ratio
        if hard:
            prompt = router.complete_json("bulk", "complexify", P.JSON_SYSTEM, builders["complexify_prompt"](cfg.description, prompt)).get("meta_prompt", prompt)
    except Exception as failed:  # noqa: BLE001 - a failed attempt is a row, not a failed job
        error, prompt, hard = str(failed), "", False
    return index, strategy_id, mix, prompt, hard, error, router.calls


def make_record(cfg: Config, router: Router, builders: dict, prompt: str) -> tuple[Any, bool, str | None]:
    """(record, valid, reason): generate, parse, check, and one repair. An invalid repair is still the record."""
    raw = router.complete("bulk", "generate", P.JSON_SYSTEM, builders["generate_record_prompt"](cfg.description, cfg.schema, prompt))
    record = None
    from .backend import parse_json

    try:
        record = parse_json(raw)
        error = check_record(cfg.schema, record)
        if error is None:
            return record, True, None
    except ValueError as failed:
        error = str(failed)
    try:
        mended = router.complete_json("bulk", "repair", P.JSON_SYSTEM, builders["repair_json_prompt"](cfg.schema, raw, error))
    except Exception as failed:  # noqa: BLE001
        return record, False, f"JSON repair failed: {failed}"
    error = check_record(cfg.schema, mended)
    return mended, error is None, error


def critic_loop(cfg: Config, router: Router, builders: dict, prompt: str, record: Any) -> tuple[Any, bool, str | None, list[tuple]]:
    """(record, accepted, reason, verdicts) after at most max_refine_attempts + 1 critiques, each rejection followed by a refinement."""
    verdicts: list[tuple] = []
    for _ in range(cfg.generation.max_refine_attempts + 1):
        ask = builders["critique_text_prompt"](cfg.description, prompt, str(record)) if cfg.text_mode else builders["critique_prompt"](cfg.description, cfg.schema, prompt, record)
        got = router.complete_json("critic", "semantic_critic", P.JSON_SYSTEM, ask)
        verdicts.append((got.get("verdict"), got.get("explanation")))
        if got.get("verdict") == "accept":
            return record, True, None, verdicts
        why = got.get("explanation") or ""
        try:
            if cfg.text_mode:
                record = router.complete("bulk", "refine", P.TEXT_SYSTEM, builders["refine_text_prompt"](cfg.description, prompt, str(record), why)).strip()
            else:
                record = router.complete_json("bulk", "refine", P.JSON_SYSTEM, builders["refine_record_prompt"](cfg.schema, prompt, record, why))
        except Exception as failed:  # noqa: BLE001
            return record, False, f"Refinement failed: {failed}", verdicts
        if error := check_record(cfg.schema, record):
            return record, False, error, verdicts
    return record, False, verdicts[-1][1] or "The critic rejected the record.", verdicts


def dataset_row(cfg: Config, router: Router, builders: dict, meta: Any) -> tuple:
    """One attempt's dataset row. A failed meta row is rejected without a call."""
    record, valid, accepted, reason, verdicts = None, False, False, None, []
    try:
        if meta["error"] or not meta["meta_prompt"]:
            reason = meta["error"] or "There is no meta prompt."
        else:
            if cfg.text_mode:
                record, valid = router.complete("bulk", "generate", P.TEXT_SYSTEM, builders["generate_text_prompt"](cfg.description, meta["meta_prompt"])).strip(), True
            else:
                record, valid, reason = make_record(cfg, router, builders, meta["meta_prompt"])
            if valid:
                record, accepted, reason, verdicts = critic_loop(cfg, router, builders, meta["meta_prompt"], record)
                if not cfg.text_mode and (error := check_record(cfg.schema, record)):
                    valid, accepted, reason = False, False, error
    except Exception as failed:  # noqa: BLE001
        accepted, reason = False, str(failed)
    import hashlib

    index = int(meta["attempt_index"])
    name = f"item-{index}-{hashlib.md5(f'{cfg.project.seed}:{index}'.encode()).hexdigest()[:8]}"
    text = record if isinstance(record, str) or record is None else json.dumps(record, sort_keys=True, ensure_ascii=False)
    return name, index, text, "text" if cfg.text_mode else "json", meta["taxonomy_mix"], meta["strategy_id"], meta["meta_prompt"], bool(meta["complexified"]), router.models.get("bulk", "bulk"), verdicts, valid, accepted, reason, pd.Timestamp.now(), router.calls


def _router(cfg: Config, backend: Backend, key: str) -> Router:
    return Router(backend, key, {r: m.get("model", r) for r, m in cfg.models.items()})


def meta_prompts(attempts: DataFrame, cfg: Config, tree: dict[str, Any], strategies: list[dict[str, Any]], backend: Backend) -> DataFrame:
    builders_path = cfg.prompts

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        builders, draws = P.load_builders(builders_path), S.Draws(tree)
        for frame in it:
            yield pd.DataFrame([meta_row(cfg, draws, strategies, _router(cfg, backend, f"meta:{i}"), builders, int(i)) for i in frame["attempt_index"]], columns=_names(META_DDL))

    return attempts.repartition(cfg.generation.concurrency, "attempt_index").mapInPandas(run, META_DDL)


def generate(meta: DataFrame, cfg: Config, backend: Backend) -> DataFrame:
    builders_path = cfg.prompts

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        builders = P.load_builders(builders_path)
        for frame in it:
            rows = [dataset_row(cfg, _router(cfg, backend, f"row:{r['attempt_index']}"), builders, r) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=_names(ROW_DDL))

    return meta.repartition(cfg.generation.concurrency, "attempt_index").mapInPandas(run, ROW_DDL)


def _names(ddl: str) -> list[str]:
    """Column names of a DDL string, without a session (workers have none)."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out


def call_log(rows: DataFrame) -> DataFrame:
    """(role, task, model, in_tokens, out_tokens, duration_seconds) of all calls of meta or dataset rows."""
    return rows.select(F.explode("calls").alias("c")).select("c.*")


def build_taxonomy(spark: SparkSession, cfg: Config, backend: Backend) -> dict[str, Any]:
    """A taxonomy level by level: each level's nodes are expanded in one distributed pass, with one plan between levels."""
    builders = P.load_builders(cfg.prompts)
    router = _router(cfg, backend, "tree")
    found = router.complete_json("strategic", "factor_discovery", P.JSON_SYSTEM, builders["factor_prompt"](cfg.description, cfg.taxonomy.min_factors))
    factors = [{"name": f["name"], "description": f.get("description", ""), "level": 0, "children": []} for f in found.get("factors", [])]
    for factor in factors:
        level, plan = [(factor, [factor["name"]])], ""
        for depth in range(1, cfg.taxonomy.max_depth + 1):
            grown = {tuple(r["path"]): r["children"] for r in _expand(spark, cfg, backend, [p for _, p in level], plan).collect()}
            after = []
            for node, path in level:
                for kid in grown.get(tuple(path)) or []:
                    child = {"name": kid["name"], "description": kid["description"] or "", "level": depth, "path": [*path, kid["name"]], "weight": kid["weight"], "children": []}
                    node["children"].append(child)
                    after.append((child, child["path"]))
            level = after
            if depth < cfg.taxonomy.max_depth:
                plan = router.complete_json("strategic", "level_plan", P.JSON_SYSTEM, builders["level_plan_prompt"](cfg.description, factor["name"], [n["name"] for n, _ in level])).get("plan", "")
    return {"description": cfg.description, "factors": factors}


def _expand(spark: SparkSession, cfg: Config, backend: Backend, paths: list[list[str]], plan: str) -> DataFrame:
    """(path, children): best of N proposals merged by a critic; a node whose calls fail is a leaf."""
    builders_path = cfg.prompts

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        builders = P.load_builders(builders_path)
        for frame in it:
            out = []
            for path in frame["path"]:
                path, router = list(path), _router(cfg, backend, "/".join(path))
                try:
                    kids = [k for _ in range(max(1, cfg.taxonomy.best_of)) for k in router.complete_json("strategic", "node_expansion", P.JSON_SYSTEM, builders["expand_prompt"](cfg.description, path, plan)).get("children", [])]
                    if cfg.taxonomy.best_of > 1:
                        kids = router.complete_json("critic", "taxonomy_critic", P.JSON_SYSTEM, builders["refine_nodes_prompt"](cfg.description, path, kids)).get("children", kids)
                    seen: dict[str, tuple] = {}
                    for k in kids:
                        seen.setdefault(S.norm(k["name"]), (k["name"], k.get("description", ""), S.weight_of(k)))
                    out.append((path, list(seen.values())))
                except Exception:  # noqa: BLE001 - a node that can't be expanded stays a leaf
                    out.append((path, []))
            yield pd.DataFrame(out, columns=["path", "children"])

    rows = spark.createDataFrame([(p,) for p in paths] or [], "path array<string>")
    return rows.repartition(max(1, min(cfg.generation.concurrency, len(paths)))).mapInPandas(run, "path array<string>, children array<struct<name:string,description:string,weight:double>>")


def build_strategies(spark: SparkSession, cfg: Config, nodes: DataFrame, backend: Backend) -> tuple[list[dict[str, Any]], list[str]]:
    """(strategies, bad paths): proposed ones, once again where paths are wrong; one over all factors where there are none."""
    from ..operators import taxonomy as X

    builders, router, bad = P.load_builders(cfg.prompts), _router(cfg, backend, "strategies"), []
    listing = "\n".join(r["outline"] for r in X.outline(nodes).orderBy("factor").collect())
    got: list[dict[str, Any]] = []
    for _ in range(2):
        raw = router.complete_json("strategic", "strategy", P.JSON_SYSTEM, builders["strategy_prompt"](cfg.description, listing, bad)).get("strategies") or []
        got = [{"id": s.get("id", "general"), "description": s.get("description", ""), "roots": s.get("taxonomy_roots") or [], "weight": float(s.get("weight", 1.0)), "never_combine": s.get("never_combine") or []} for s in raw]
        frame = strategies_frame(spark, got)
        bad = [r["ref"] for r in X.invalid_paths(frame, nodes).orderBy("id", "pos").collect()]
        if not bad:
            break
    if not got:
        got = [r.asDict() for r in X.strategies_or_general(strategies_frame(spark, []), nodes).collect()]
    return got, bad


def strategies_frame(spark: SparkSession, strategies: list[dict[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(s["id"], s.get("description", ""), s.get("roots") or [], float(s.get("weight", 1.0)), s.get("never_combine") or []) for s in strategies], "id string, description string, roots array<string>, weight double, never_combine array<array<string>>")


def assign_nodes(rows: DataFrame, outlines: DataFrame, cfg: Config, backend: Backend) -> DataFrame:
    """(id, factor, wanted): the node a critic names for each row in each factor. ``rows`` has (id, text)."""
    builders_path = cfg.prompts

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        builders = P.load_builders(builders_path)
        for frame in it:
            out = []
            for r in frame.to_dict("records"):
                try:
                    name = _router(cfg, backend, f"{r['id']}:{r['factor']}").complete_json("critic", "node_assign", P.JSON_SYSTEM, builders["node_assign_prompt"](r["outline"], r["factor"], r["text"])).get("node_name")
                except Exception:  # noqa: BLE001
                    name = None
                out.append((r["id"], r["factor"], name))
            yield pd.DataFrame(out, columns=["id", "factor", "wanted"])

    pairs = rows.select(F.col("id").cast("string").alias("id"), "text").crossJoin(F.broadcast(outlines))
    return pairs.mapInPandas(run, "id string, factor string, wanted string").filter("wanted is not null")


def score_complexity(rows: DataFrame, plan: DataFrame, cfg: Config, backend: Backend) -> DataFrame:
    """The schedule ``plan`` (pass, batch, place, ord) with each row's id and its score in that batch; null where the critic gives none.

    ``rows`` has (ord, id, text). A batch is one call, and a task holds one batch.
    """
    builders_path = cfg.prompts

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        payload = [{"id": str(i), "item": t} for i, t in zip(frame["id"], frame["text"])]
        try:
            got = _router(cfg, backend, f"complexity:{key[0]}:{key[1]}").complete_json("critic", "complexity_score", P.JSON_SYSTEM, P.load_builders(builders_path)["complexity_prompt"](cfg.description, payload))
            scores = {str(s["id"]): float(s["score"]) for s in got.get("scores") or []}
        except Exception:  # noqa: BLE001 - rows without a score count as middling
            scores = {}
        return frame.assign(score=[scores.get(str(i)) for i in frame["id"]]).astype({"score": "float64"})[["pass", "batch", "place", "ord", "id", "score"]]

    joined = rows.join(plan, "ord").select("pass", "batch", "place", "ord", "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.groupBy("pass", "batch").applyInPandas(run, f"pass int, batch int, place int, ord long, id {kind}, score double")
