"""Configuration of a run: defaults, checks and decoding parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ..functions.schema import check_subset

TASKS = (
    "factor_discovery", "node_expansion", "taxonomy_critic", "level_plan", "strategy", "meta_prompt", "complexify",
    "generate", "repair", "semantic_critic", "refine", "complexity_score", "node_assign",
)
ROLES = ("strategic", "bulk", "critic")
TOP_LEVEL = ("temperature", "top_p", "max_tokens", "frequency_penalty", "presence_penalty", "stop", "seed")
DEFAULT_SAMPLING = {"temperature": 0.7, "max_tokens": 32768}
CONNECTION = {"base_url", "api_key", "api_key_env", "model", "timeout_seconds", "extra_body"}


@dataclass
class Project:
    name: str = "dataset"
    output_dir: str = "output"
    seed: int = 0


@dataclass
class Taxonomy:
    max_depth: int = 2
    best_of: int = 1
    review: bool = False
    min_factors: int = 2


@dataclass
class Generation:
    target_size: int = 100
    overgenerate_ratio: float = 1.2
    scenarios_per_mix: int = 3
    complexity_ratio: float = 0.3
    max_refine_attempts: int = 1
    concurrency: int = 8
    checkpoint_every: int = 1000
    dedupe: bool = True

    def check(self) -> list[str]:
        bad = [f"generation.{n}: must be at least {low}" for n, low in (("target_size", 1), ("scenarios_per_mix", 1), ("concurrency", 1), ("checkpoint_every", 1), ("max_refine_attempts", 0)) if getattr(self, n) < low]
        if self.overgenerate_ratio < 1:
            bad.append("generation.overgenerate_ratio: must be at least 1")
        if not 0 <= self.complexity_ratio <= 1:
            bad.append("generation.complexity_ratio: must be within 0 and 1")
        return bad


@dataclass
class Evaluation:
    ngram: int = 13
    threshold: float = 0.8
    reference_paths: list[str] = field(default_factory=list)
    text_field: str | None = None
    sample_cap: int = 1000
    k_local: int = 10
    complexity: bool = False
    complexity_batch_size: int = 5
    complexity_samples_per_item: int = 2
    reassignment: bool = False


@dataclass
class Config:
    description: str
    models: dict[str, dict[str, Any]]
    schema: dict[str, Any] | None = None
    project: Project = field(default_factory=Project)
    taxonomy: Taxonomy = field(default_factory=Taxonomy)
    generation: Generation = field(default_factory=Generation)
    evaluation: Evaluation = field(default_factory=Evaluation)
    sampling: dict[str, Any] = field(default_factory=dict)
    prompts: str | None = None

    @property
    def text_mode(self) -> bool:
        return self.schema is None


_SECTIONS = {"project": Project, "taxonomy": Taxonomy, "generation": Generation, "evaluation": Evaluation}


def parse(data: dict[str, Any]) -> Config:
    """A checked configuration; empty sections take their defaults, unknown keys are refused."""
    data, bad = dict(data or {}), []
    known = {f.name for f in fields(Config)}
    bad += [f"unknown key {k!r}" for k in data if k not in known]
    if not data.get("description"):
        bad.append("description: required")
    models = data.get("models") or {}
    bad += [f"models.{r}: required" for r in ROLES if r not in models]
    made: dict[str, Any] = {}
    for name, kind in _SECTIONS.items():
        given = data.get(name) or {}
        bad += [f"{name}: unknown key {k!r}" for k in given if k not in {f.name for f in fields(kind)}]
        made[name] = kind(**{k: v for k, v in given.items() if k in {f.name for f in fields(kind)} and v is not None})
    bad += made["generation"].check()
    if (schema := data.get("schema")) is not None:
        bad += check_subset(schema)
    sampling = data.get("sampling") or {}
    bad += [f"sampling.tasks: unknown task {t!r}" for t in sampling.get("tasks") or {} if t not in TASKS]
    if bad:
        raise ValueError("; ".join(bad))
    return Config(data["description"], models, schema, sampling=sampling, prompts=data.get("prompts"), **made)


def load(path: str) -> Config:
    """A configuration from YAML or JSON; its output folder is made."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    cfg = parse(data)
    Path(cfg.project.output_dir).mkdir(parents=True, exist_ok=True)
    return cfg


def sampling_for(models: dict[str, Any], sampling: dict[str, Any], role: str, task: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """(top-level parameters, extra body) of a call: defaults, then the role's own, then the task's."""
    layers = DEFAULT_SAMPLING | {k: v for k, v in models[role].items() if k not in CONNECTION} | ((sampling.get("tasks") or {}).get(task) or {})
    top = {k: v for k, v in layers.items() if k in TOP_LEVEL}
    return top, (models[role].get("extra_body") or {}) | {k: v for k, v in layers.items() if k not in TOP_LEVEL}


def fingerprint(cfg: Config, tree: Any = None, strategies: Any = None) -> str:
    """Identity of what decides a row's content, the tree, strategies and prompt module's text included.

    Sizes, pace and what is done with finished rows are left out, so a run can be resumed larger.
    """
    content = asdict(cfg)
    for key in ("target_size", "overgenerate_ratio", "concurrency", "checkpoint_every", "dedupe"):
        content["generation"].pop(key)
    for key in ("evaluation", "project"):
        content[key] = {"seed": cfg.project.seed} if key == "project" else None
    content |= {"prompts": Path(cfg.prompts).read_text(encoding="utf-8") if cfg.prompts else None, "tree": tree, "strategies": strategies}
    return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()[:16]
