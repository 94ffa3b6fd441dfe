"""Prompt builders, each replaceable by a module of the user's."""

from __future__ import annotations

import importlib.util
import inspect
import json
from collections.abc import Callable
from typing import Any

JSON_SYSTEM = "Answer with one JSON value and nothing else."
TEXT_SYSTEM = "Answer with the requested text and nothing else."


def schema_text(schema: Any) -> str:
    return json.dumps(schema, indent=2, sort_keys=True, ensure_ascii=False)


def factor_prompt(description: str, count: int) -> str:
    return f"Dataset: {description}\nName about {count} independent factors along which its items vary. JSON: {{\"factors\": [{{\"name\", \"description\"}}]}}"


def expand_prompt(description: str, path: list[str], plan: str) -> str:
    return f"Dataset: {description}\nList the distinct kinds of '{' / '.join(path)}'. {plan}\nJSON: {{\"children\": [{{\"name\", \"description\"}}]}}"


def refine_nodes_prompt(description: str, path: list[str], children: list[Any]) -> str:
    return f"Dataset: {description}\nUnder '{' / '.join(path)}' these kinds were proposed: {json.dumps(children, ensure_ascii=False)}\nMerge repeats, add what is missing. JSON: {{\"children\": [...]}}"


def level_plan_prompt(description: str, factor: str, names: list[str]) -> str:
    return f"Dataset: {description}\nFactor '{factor}' now has: {', '.join(names)}\nSay how to split them evenly. JSON: {{\"plan\": \"...\"}}"


def strategy_prompt(description: str, outline: str, problems: list[str]) -> str:
    fix = f"\nThese paths don't exist: {', '.join(problems)}" if problems else ""
    return f"Dataset: {description}\nTree:\n{outline}{fix}\nPropose sampling strategies. JSON: {{\"strategies\": [{{\"id\", \"description\", \"taxonomy_roots\", \"weight\", \"never_combine\"}}]}}"


def meta_prompt_prompt(description: str, schema: Any, mix: list[Any], count: int) -> str:
    return f"Dataset: {description}\nSchema: {schema_text(schema)}\nAttributes: {json.dumps(mix, ensure_ascii=False)}\nWrite {count} different instructions for one item. JSON: {{\"meta_prompts\": [...]}}"


def complexify_prompt(description: str, meta_prompt: str) -> str:
    return f"Dataset: {description}\nMake this instruction harder but still answerable: {meta_prompt}\nJSON: {{\"meta_prompt\": \"...\"}}"


def generate_record_prompt(description: str, schema: Any, meta_prompt: str) -> str:
    return f"Dataset: {description}\nSchema: {schema_text(schema)}\nWrite one record: {meta_prompt}"


def generate_text_prompt(description: str, meta_prompt: str) -> str:
    return f"Dataset: {description}\nWrite one text: {meta_prompt}"


def repair_json_prompt(schema: Any, response: str, error: str) -> str:
    return f"Schema: {schema_text(schema)}\nThis answer is invalid ({error}): {response}\nGive it corrected."


def critique_prompt(description: str, schema: Any, meta_prompt: str, record: Any) -> str:
    return f"Dataset: {description}\nSchema: {schema_text(schema)}\nInstruction: {meta_prompt}\nRecord: {json.dumps(record, ensure_ascii=False)}\nJSON: {{\"verdict\": \"accept\" or \"reject\", \"explanation\"}}"


def critique_text_prompt(description: str, meta_prompt: str, text: str) -> str:
    return f"Dataset: {description}\nInstruction: {meta_prompt}\nText: {text}\nJSON: {{\"verdict\": \"accept\" or \"reject\", \"explanation\"}}"


def refine_record_prompt(schema: Any, meta_prompt: str, record: Any, explanation: str) -> str:
    return f"Schema: {schema_text(schema)}\nInstruction: {meta_prompt}\nRecord: {json.dumps(record, ensure_ascii=False)}\nMend this: {explanation}"


def refine_text_prompt(description: str, meta_prompt: str, text: str, explanation: str) -> str:
    return f"Dataset: {description}\nInstruction: {meta_prompt}\nText: {text}\nMend this: {explanation}"


def complexity_prompt(description: str, payload: list[Any]) -> str:
    return f"Dataset: {description}\nScore each item's difficulty from 1 to 10: {json.dumps(payload, ensure_ascii=False)}\nJSON: {{\"scores\": [{{\"id\", \"score\"}}]}}"


def node_assign_prompt(outline: str, factor: str, text: str) -> str:
    return f"Factor '{factor}':\n{outline}\nWhich node fits this best? {text}\nJSON: {{\"node_name\": \"...\"}}"


BUILDERS: dict[str, Callable[..., str]] = {n: f for n, f in list(globals().items()) if n.endswith("_prompt")}


def load_builders(path: str | None = None) -> dict[str, Callable[..., str]]:
    """The builders, with those of the module at ``path`` in their place; its parameter names must be the same."""
    if not path:
        return dict(BUILDERS)
    spec = importlib.util.spec_from_file_location("user_prompts", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    out = dict(BUILDERS)
    for name, own in BUILDERS.items():
        if theirs := getattr(module, name, None):
            if not callable(theirs) or list(inspect.signature(theirs).parameters) != list(inspect.signature(own).parameters):
                raise ValueError(f"{name} must take {list(inspect.signature(own).parameters)}")
            out[name] = theirs
    return out
