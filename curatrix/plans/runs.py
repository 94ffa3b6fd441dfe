"""Whole runs: taxonomy, generation with resume, evaluation, artifacts."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import browse, complexity, cost, coverage, diversity, sampling, similarity
from ..operators import taxonomy as X
from ..session import materialise
from ..sources import files
from . import generation as G
from .backend import Backend
from .config import Config, fingerprint


class Halt(SystemExit):
    """A stage that was asked to stop the run."""


def load_or_build_taxonomy(spark: SparkSession, cfg: Config, backend: Backend, rebuild: bool = False, review: Callable[[dict], bool] | None = None) -> dict[str, Any]:
    """The saved taxonomy, or a new one; a review that refuses it ends the run."""
    path = files.artifact(cfg.project.output_dir, "taxonomy")
    tree = None if rebuild else files.read_json(path)
    if tree is None:
        tree = G.build_taxonomy(spark, cfg, backend)
        files.write_json(path, tree)
        if cfg.taxonomy.review and review is not None and not review(tree):
            raise Halt(1)
    return tree


def load_or_build_strategies(spark: SparkSession, cfg: Config, nodes: DataFrame, backend: Backend) -> list[dict[str, Any]]:
    path = files.artifact(cfg.project.output_dir, "strategies")
    got = files.read_json(path)
    if got is None:
        got, bad = G.build_strategies(spark, cfg, nodes, backend)
        files.write_json(path, got)
        if bad:
            raise ValueError(f"strategies name paths that don't exist: {', '.join(bad)}")
    return got


def generate(spark: SparkSession, cfg: Config, backend: Backend, resume: bool = True, stop_after: str | None = None) -> DataFrame:
    """The final rows of a run. Only attempts without a row are made; all rows are appended by attempt."""
    out = cfg.project.output_dir
    tree = load_or_build_taxonomy(spark, cfg, backend)
    stop_at(stop_after, "taxonomy")
    nodes = X.from_tree(spark, tree)
    strategies = load_or_build_strategies(spark, cfg, nodes, backend)
    stop_at(stop_after, "strategies")
    state_path, mark = files.artifact(out, "run_state"), fingerprint(cfg, tree, strategies)
    state = files.read_json(state_path)
    if resume and state and state["fingerprint"] != mark:
        raise ValueError("the configuration's content has changed since this run began; use another folder or start afresh")
    attempts = sampling.attempts(spark, cfg.generation.target_size, cfg.generation.overgenerate_ratio)
    meta_path, raw_path = os.path.join(out, "meta_prompts"), os.path.join(out, "raw")
    if not resume and files._exists(spark, raw_path):
        _delete(spark, raw_path)
    batch, target = cfg.generation.checkpoint_every, attempts.count()

    def save(rows: DataFrame | None) -> None:
        counts = {"n": 0, "a": 0} if rows is None else rows.agg(F.count("*").alias("n"), F.count_if("accepted").alias("a")).first()
        files.write_json(state_path, {"attempted": counts["n"], "target_attempts": target, "accepted": counts["a"], "fingerprint": mark})

    meta = _append_missing(spark, meta_path, attempts, batch, lambda missing: G.meta_prompts(missing, cfg, tree, strategies, backend))
    stop_at(stop_after, "meta_prompts")
    # Before the first row too: rows never stand without the identity of what made them.
    save(spark.read.parquet(raw_path) if files._exists(spark, raw_path) else None)
    raw = _append_missing(spark, raw_path, attempts, batch, lambda missing: G.generate(meta.join(missing, "attempt_index", "left_semi"), cfg, backend), save)
    save(raw)
    final = finalise(spark, cfg, raw)
    files.write_jsonl(final.drop("calls"), os.path.join(out, "final"))
    return final


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _append_missing(spark: SparkSession, path: str, attempts: DataFrame, batch: int, make: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The table at ``path`` with the attempts that it lacks appended, ``batch`` attempt numbers in a commit: a run that dies keeps all batches before."""
    if files._exists(spark, path):
        missing = attempts.join(spark.read.parquet(path).select("attempt_index"), "attempt_index", "left_anti")
    else:
        missing = attempts
    missing = materialise(missing)
    part = F.floor(F.col("attempt_index") / batch)
    # One number for each commit, however many attempts a commit holds.
    for r in missing.select(part.alias("part")).distinct().orderBy("part").collect():
        make(missing.filter(part == r["part"])).write.mode("append").parquet(path)
        if done:
            done(spark.read.parquet(path))
    return spark.read.parquet(path)


def stop_at(wanted: str | None, stage: str) -> None:
    if wanted == stage:
        raise Halt(0)


def finalise(spark: SparkSession, cfg: Config, raw: DataFrame) -> DataFrame:
    """Accepted rows, without duplicates where asked, trimmed to the target for coverage."""
    rows = raw.filter("accepted")
    if cfg.generation.dedupe:
        rows, _ = similarity.dedupe(rows, "attempt_index", "record", cfg.evaluation.ngram, str(cfg.evaluation.threshold))
    rows = materialise(rows)
    order = coverage.trim(spark, rows.select(F.col("attempt_index").alias("ord"), T.mix_paths(F.col("taxonomy_mix")).alias("paths")), cfg.generation.target_size)
    return rows.join(order.select(F.col("ord").alias("attempt_index"), "rank"), "attempt_index").orderBy("rank").drop("rank")


def evaluate(spark: SparkSession, rows: DataFrame, nodes: DataFrame, cfg: Config, embeddings: DataFrame | None = None, scores: DataFrame | None = None, assigned: DataFrame | None = None, backend: Backend | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """(rows that survive, report): duplicates, contamination, coverage, diversity, complexity, each measured on what is left.

    ``embeddings`` (id, embedding), ``scores`` (attempt_index, score) and ``assigned`` (factor, wanted) switch their
    parts on; with a ``backend`` the critic gives scores and assignments where the configuration asks for them.
    """
    e = cfg.evaluation
    references = files.reference_texts(spark, e.reference_paths).withColumn("id", F.monotonically_increasing_id())
    clean, removed, gone = similarity.dedupe_decontaminate(rows, "attempt_index", "record", materialise(references), "id", "text", e.ngram, str(e.threshold))
    clean = materialise(clean)
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    report: dict[str, Any] = {"count": clean.count(), "dedupe": {"removed_ids": ids(removed)}, "decontamination": {"removed_ids": ids(gone)}}
    for part in ("dedupe", "decontamination"):
        report[part]["removed_count"] = len(report[part]["removed_ids"])
    report["coverage"] = _nested(coverage.coverage(coverage.lineage_paths(clean), nodes))
    if assigned is None and backend is not None and e.reassignment:
        texts = clean.select(F.col("attempt_index").alias("id"), T.record_text(F.col("record"), e.text_field).alias("text"))
        assigned = materialise(G.assign_nodes(texts, X.outline(nodes), cfg, backend))
    if assigned is not None:
        report["reassignment_coverage"] = _nested(coverage.reassigned_coverage(assigned, nodes))
    if embeddings is not None:
        u = materialise(diversity.units(diversity.capped(embeddings, "id", e.sample_cap), "id", "embedding"))
        report["diversity"] = diversity.global_diversity(u).first().asDict() | diversity.local_diversity(u, e.k_local).first().asDict()
        if report["diversity"]["count"] >= 2:
            report["diversity"] |= {"sample_cap": e.sample_cap, "k_local": e.k_local}
    judge = backend is not None and e.complexity and scores is None
    if scores is not None or judge:
        n = clean.count()
        given = scores if scores is not None else clean.select("attempt_index", F.lit(None).cast("double").alias("score"))
        numbered = clean.select("attempt_index", T.record_text(F.col("record"), e.text_field).alias("text")).join(given, "attempt_index", "left").withColumn("ord", F.row_number().over(Window.orderBy("attempt_index")) - 1)
        numbered = materialise(numbered.select(F.col("ord").cast("long").alias("ord"), F.col("attempt_index").alias("id"), "text", "score"))
        plan = complexity.schedule(spark, n, e.complexity_batch_size, e.complexity_samples_per_item)
        if judge:
            plan = materialise(G.score_complexity(numbered, plan, cfg, backend))
        ratings = complexity.elo(numbered, plan, e.complexity_samples_per_item)
        raw = complexity.raw_scores(plan if judge else numbered)
        report["complexity"] = {"raw_scores": {r["id"]: r["raw_score"] for r in raw.collect()}, "elo": {r["id"]: r["elo"] for r in ratings.collect()}}
    return clean, report


def _nested(table: DataFrame) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for r in table.orderBy("factor", "level").collect():
        out.setdefault(r["factor"], {})[str(r["level"])] = {"covered": r["covered"], "total": r["total"], "ratio": r["ratio"], "nodes": list(r["nodes"])}
    return out


def cost_report(calls: DataFrame) -> dict[str, Any]:
    rows = [r.asDict() for r in cost.summarize(calls).orderBy("role", "task", "model").collect()]
    total = next((r for r in rows if r["is_total"]), {"calls": 0, "input_tokens": 0, "output_tokens": 0, "duration_seconds": 0.0})
    return {"total_calls": total["calls"], "total_input_tokens": total["input_tokens"], "total_output_tokens": total["output_tokens"], "total_duration_seconds": total["duration_seconds"], "by_role_task_model": [{k: v for k, v in r.items() if k != "is_total"} for r in rows if not r["is_total"]]}


__all__ = ["browse", "cost_report", "evaluate", "finalise", "generate", "load_or_build_strategies", "load_or_build_taxonomy"]
