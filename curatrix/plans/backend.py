"""Model backends: what answers a call, with retries and a log of calls."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class Backend(Protocol):
    """Answers one call. Must be picklable: it runs in Python workers."""

    def answer(self, role: str, task: str, system: str, prompt: str, key: str) -> str: ...


class Failed(Exception):
    """A call that failed with an HTTP status (None: no answer at all), and how long to wait if it said so."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def retry_wait(failed: Failed, attempt: int) -> float | None:
    """Seconds to wait before another try; None to give up."""
    if failed.status == 429:
        return min(60.0, failed.retry_after) if failed.retry_after else 2.0
    if failed.status is None or failed.status in (408, 409) or failed.status >= 500:
        return min(10.0, 0.5 * 2**attempt)
    return None


def parse_json(text: str) -> Any:
    """The JSON of an answer: the whole, else the first fenced block."""
    import re

    text = text.strip()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        block = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
        if not block:
            raise ValueError("the answer is no valid JSON") from None
        return json.loads(block[1].strip())


@dataclass
class Router:
    """Calls a backend for one row, retries, and keeps the row's calls for the log."""

    backend: Backend
    key: str
    models: dict[str, str]
    tries: int = 8
    sleep: Callable[[float], None] = time.sleep
    calls: list[tuple] = field(default_factory=list)

    def complete(self, role: str, task: str, system: str, prompt: str) -> str:
        for attempt in range(self.tries):
            began = time.time()
            try:
                text = self.backend.answer(role, task, system, prompt, f"{self.key}:{len(self.calls)}")
            except Failed as failed:
                wait = retry_wait(failed, attempt)
                if wait is None or attempt + 1 == self.tries:
                    raise
                self.sleep(wait)
                continue
            self.calls.append((role, task, self.models.get(role, role), max(1, len(prompt) // 4), max(1, len(text) // 4), time.time() - began))
            return text
        raise AssertionError("no try was made")

    def complete_json(self, role: str, task: str, system: str, prompt: str) -> Any:
        return parse_json(self.complete(role, task, system, prompt))


class Stub:
    """A deterministic backend: its answers depend on the task and the call's key only."""

    def answer(self, role: str, task: str, system: str, prompt: str, key: str) -> str:
        n = int(hashlib.md5(f"{task}:{key}".encode()).hexdigest()[:8], 16)
        return json.dumps({
            "factor_discovery": {"factors": [{"name": f"factor{i}", "description": f"factor {i}"} for i in range(2)]},
            "node_expansion": {"children": [{"name": f"kind{n % 97}-{i}", "description": "a kind"} for i in range(3)]},
            "taxonomy_critic": {"children": [{"name": f"kind{n % 97}-{i}", "description": "a kind"} for i in range(2)]},
            "level_plan": {"plan": "Split evenly."},
            "strategy": {"strategies": []},
            "meta_prompt": {"meta_prompts": [f"Write item {n % 1000}-{i}." for i in range(3)]},
            "complexify": {"meta_prompt": f"Write a harder item {n % 1000}."},
            "generate": {"input": f"question {n}", "output": f"answer {n % 7919}"},
            "repair": {"input": f"question {n}", "output": "mended"},
            "semantic_critic": {"verdict": "accept" if n % 4 else "reject", "explanation": "checked"},
            "refine": {"input": f"question {n}", "output": "refined"},
            "complexity_score": {"scores": []},
            "node_assign": {"node_name": f"kind{n % 97}-{n % 3}"},
        }[task])
