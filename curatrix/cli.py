"""Command line: validate, taxonomy, generate, evaluate or run a configuration."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curatrix")
    parser.add_argument("command", choices=["validate", "taxonomy", "generate", "evaluate", "run"])
    parser.add_argument("config")
    parser.add_argument("--quiet", action="store_true")
    parser.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    parser.add_argument("--stop-after", choices=["taxonomy", "strategies", "meta_prompts"])
    args = parser.parse_args(argv)
    say = (lambda *_: None) if args.quiet else print
    from .operators import sampling
    from .operators import taxonomy as X
    from .plans import config, generation, runs
    from .plans.backend import Stub
    from .session import session
    from .sources import files

    try:
        cfg = config.load(args.config)
        if args.command == "validate":
            say("valid")
            return 0
        spark, backend, out = session(), Stub(), cfg.project.output_dir
        if args.command == "taxonomy":
            runs.load_or_build_taxonomy(spark, cfg, backend, rebuild=True)
        if args.command in ("generate", "run"):
            final = runs.generate(spark, cfg, backend, args.resume, args.stop_after)
            calls = [generation.call_log(spark.read.parquet(os.path.join(out, t))) for t in ("meta_prompts", "raw")]
            files.write_json(files.artifact(out, "cost_summary"), runs.cost_report(calls[0].unionByName(calls[1])))
            say(f"{final.count()} rows")
        if args.command in ("evaluate", "run"):
            rows = files.read_jsonl(spark, os.path.join(out, "final"), "attempt_index long, record string, taxonomy_mix " + sampling.MIX_DDL, tolerant=True)
            nodes = X.from_tree(spark, files.read_json(files.artifact(out, "taxonomy"), {"factors": []}))
            clean, report = runs.evaluate(spark, rows, nodes, cfg, backend=backend)
            files.write_jsonl(clean.orderBy(F.col("attempt_index")), os.path.join(out, "evaluated"))
            files.write_json(files.artifact(out, "eval_report"), report)
            say(f"{report['count']} rows survive")
        return 0
    except Exception as failed:  # noqa: BLE001 - the command line reports, whatever failed
        print(f"error: {failed}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
