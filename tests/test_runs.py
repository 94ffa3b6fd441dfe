from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from curatrix.operators import sampling
from curatrix.operators import taxonomy as X
from curatrix.plans import config, generation, prompts, runs
from curatrix.plans.backend import Failed, Router, Stub, parse_json, retry_wait
from curatrix.sources import cache, files
from curatrix.streaming.resume import append_new

SCHEMA = {"type": "object", "required": ["input", "output"], "properties": {"input": {"type": "string"}, "output": {"type": "string"}}}


def cfg(out, schema=SCHEMA, **generation_):
    return config.parse({"description": "questions", "models": {r: {"model": f"m-{r}"} for r in config.ROLES}, "schema": schema, "project": {"output_dir": str(out), "seed": 3}, "generation": {"target_size": 5, "concurrency": 2} | generation_, "taxonomy": {"max_depth": 2}})


def test_configuration():
    with pytest.raises(ValueError, match="description"):
        config.parse({})
    with pytest.raises(ValueError, match="unknown task"):
        cfg_ = {"description": "d", "models": {r: {} for r in config.ROLES}, "sampling": {"tasks": {"nope": {}}}}
        config.parse(cfg_)
    with pytest.raises(ValueError, match="at least"):
        cfg("x", target_size=0)
    a, b, c = cfg("x"), cfg("y", target_size=50), cfg("x", complexity_ratio=0.9)
    assert config.fingerprint(a) == config.fingerprint(b) != config.fingerprint(c)
    top, extra = config.sampling_for({"bulk": {"temperature": 0.2, "top_k": 5, "model": "m"}}, {"tasks": {"refine": {"temperature": 0.1}}}, "bulk", "refine")
    assert top["temperature"] == 0.1 and extra == {"top_k": 5}


def test_prompts_can_be_replaced(tmp_path):
    own = tmp_path / "own.py"
    own.write_text("def complexify_prompt(description, meta_prompt):\n    return 'mine'\n")
    assert prompts.load_builders(str(own))["complexify_prompt"]("a", "b") == "mine" and len(prompts.BUILDERS) == 16
    own.write_text("def complexify_prompt(other):\n    return 'mine'\n")
    with pytest.raises(ValueError):
        prompts.load_builders(str(own))


def test_retries():
    class Shaky:
        def __init__(self, *fails):
            self.fails = list(fails)

        def answer(self, *_):
            if self.fails:
                raise self.fails.pop(0)
            return "ok"

    waits: list[float] = []
    router = Router(Shaky(Failed("busy", 429), Failed("down", 503), Failed("lost")), "k", {}, sleep=waits.append)
    assert router.complete("bulk", "generate", "", "p") == "ok" and waits == [2.0, 1.0, 2.0] and len(router.calls) == 1
    with pytest.raises(Failed):
        Router(Shaky(Failed("bad", 400)), "k", {}, sleep=waits.append).complete("bulk", "generate", "", "p")
    assert retry_wait(Failed("", 429, 600), 0) == 60 and parse_json('a\n```json\n{"b": 1}\n```') == {"b": 1}
    with pytest.raises(ValueError):
        parse_json('so {"b": 1}')


class Script(Stub):
    """Answers by task, in turn; the last one again and again."""

    def __init__(self, **answers):
        self.answers = answers

    def answer(self, role, task, system, prompt, key):
        mine = self.answers.get(task)
        return mine if isinstance(mine, str) else super().answer(role, task, system, prompt, key) if mine is None else mine.pop(0) if len(mine) > 1 else mine[0]


def _row(backend, **how):
    meta = {"attempt_index": 4, "error": None, "meta_prompt": "write", "taxonomy_mix": [], "strategy_id": "s", "complexified": False}
    got = generation.dataset_row(cfg("x", **how), Router(backend, "k", {}), prompts.load_builders(), meta)
    return dict(zip(generation._names(generation.ROW_DDL), got))


def test_one_repair_and_the_critics_loop():
    good, reject, accept = '{"input": "a", "output": "b"}', '{"verdict": "reject", "explanation": "weak"}', '{"verdict": "accept", "explanation": ""}'
    row = _row(Script(generate="no json", repair=good, semantic_critic=accept))
    assert row["accepted"] and row["schema_valid"] and json.loads(row["record"])["input"] == "a"
    row = _row(Script(generate='{"input": 1}', repair='{"input": 2}'))
    assert not row["schema_valid"] and json.loads(row["record"]) == {"input": 2} and row["critic_verdicts"] == []
    row = _row(Script(generate=good, semantic_critic=[reject, accept], refine='{"input": "c", "output": "d"}'))
    assert row["accepted"] and len(row["critic_verdicts"]) == 2 and json.loads(row["record"])["input"] == "c"
    row = _row(Script(generate=good, semantic_critic=reject, refine='{"input": "c", "output": "d"}'))
    assert not row["accepted"] and len(row["critic_verdicts"]) == 2 and json.loads(row["record"])["input"] == "c" and row["rejection_reason"] == "weak"
    row = _row(Script(generate=good, semantic_critic=reject, refine='{"input": 3}'))
    assert not row["accepted"] and len(row["critic_verdicts"]) == 1
    row = _row(Script(generate="  a text \n", semantic_critic=accept), schema=None)
    assert row["record"] == "a text" and row["output_format"] == "text"


def test_a_run_resumes_and_is_evaluated(spark, tmp_path):
    c = cfg(tmp_path)
    with pytest.raises(SystemExit) as halted:
        runs.generate(spark, c, Stub(), stop_after="meta_prompts")
    assert halted.value.code == 0 and not os.path.exists(tmp_path / "raw")
    final = runs.generate(spark, c, Stub())
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.count() == 6 and 1 <= final.count() <= 5 and final.filter("not schema_valid").count() == 0
    before = {r["attempt_index"]: r["record"] for r in raw.collect()}
    more = cfg(tmp_path, target_size=10)
    runs.generate(spark, more, Stub())
    after = {r["attempt_index"]: r["record"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()}
    assert len(after) == 12 and all(after[i] == r for i, r in before.items())
    with pytest.raises(ValueError, match="changed"):
        runs.generate(spark, cfg(tmp_path, complexity_ratio=0.9), Stub())
    state = json.load(open(tmp_path / "run_state.json"))
    assert state["attempted"] == 12 and state["target_attempts"] == 12
    nodes = X.from_tree(spark, files.read_json(str(tmp_path / "taxonomy.json")))
    clean, report = runs.evaluate(spark, after_rows := spark.read.parquet(str(tmp_path / "raw")).filter("accepted"), nodes, more)
    assert report["count"] == clean.count() <= after_rows.count() and report["coverage"]["factor0"]["0"]["ratio"] == 1.0
    calls = runs.cost_report(generation.call_log(after_rows))
    assert calls["total_calls"] == sum(r["calls"] for r in calls["by_role_task_model"]) > 0


def test_a_run_that_dies_keeps_its_batches(spark, tmp_path, monkeypatch):
    c = cfg(tmp_path, target_size=10, overgenerate_ratio=1.0, checkpoint_every=4, concurrency=1)
    whole, made = generation.generate, []

    def dies(*args):
        made.append(args[0])
        if len(made) == 2:
            raise OSError("lost")
        return whole(*args)

    monkeypatch.setattr(generation, "generate", dies)
    with pytest.raises(OSError):
        runs.generate(spark, c, Stub())
    state = files.read_json(str(tmp_path / "run_state.json"))
    assert state["attempted"] == 4 and state["target_attempts"] == 10
    before = {r["attempt_index"]: r["created_at"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()}
    monkeypatch.setattr(generation, "generate", whole)
    runs.generate(spark, c, Stub())
    after = {r["attempt_index"]: r["created_at"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()}
    assert sorted(before) == [0, 1, 2, 3] and sorted(after) == list(range(10)) and all(after[i] == t for i, t in before.items())
    strategies = files.read_json(str(tmp_path / "strategies.json"))
    files.write_json(str(tmp_path / "strategies.json"), [s | {"weight": 2.0} for s in strategies])
    with pytest.raises(ValueError, match="changed"):
        runs.generate(spark, c, Stub())


def test_proposed_nodes_keep_their_weights(spark):
    class Heavy(Stub):
        def answer(self, role, task, system, prompt, key):
            if task != "node_expansion":
                return super().answer(role, task, system, prompt, key)
            return json.dumps({"children": [{"name": "a", "weight": 3}, {"name": "b"}, {"name": "c", "weight": "none"}]})

    tree = generation.build_taxonomy(spark, cfg("x"), Heavy())
    assert [k["weight"] for k in tree["factors"][0]["children"]] == [3.0, 1.0, 1.0]


def test_a_failed_meta_row_is_rejected_without_calls():
    meta = {"attempt_index": 1, "error": "no mix", "meta_prompt": "", "taxonomy_mix": [], "strategy_id": "error", "complexified": False}
    got = dict(zip(generation._names(generation.ROW_DDL), generation.dataset_row(cfg("x"), Router(Stub(), "k", {}), prompts.load_builders(), meta)))
    assert not got["accepted"] and got["rejection_reason"] == "no mix" and got["calls"] == []


def test_node_assignment(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    outlines = spark.createDataFrame([("f", "- f"), ("g", "- g")], "factor string, outline string")
    assert generation.assign_nodes(rows, outlines, cfg("x"), Stub()).count() == 4


def test_complexity_is_judged_by_the_critic(spark):
    from curatrix.operators import complexity

    class Critic(Stub):
        def answer(self, role, task, system, prompt, key):
            if task != "complexity_score":
                return super().answer(role, task, system, prompt, key)
            return json.dumps({"scores": [{"id": i, "score": 2 * int(i)} for i in "01234" if f'"id": "{i}"' in prompt and i != "3"]})

    c = cfg("x")
    c.evaluation.complexity = c.evaluation.reassignment = True
    rows = spark.createDataFrame([(i, f"text number {i} stands alone") for i in range(5)], "id long, text string").withColumn("ord", F.col("id"))
    plan = generation.score_complexity(rows, complexity.schedule(spark, 5, 2, 2), c, Critic())
    scores = {r["id"]: r["raw_score"] for r in complexity.raw_scores(plan).collect()}
    assert scores == {0: 0.0, 1: 2.0, 2: 4.0, 3: 5.0, 4: 8.0} and plan.count() == 10
    table = rows.select(F.col("id").alias("attempt_index"), F.col("text").alias("record"), F.array().cast(sampling.MIX_DDL).alias("taxonomy_mix"))
    nodes = X.from_tree(spark, {"factors": [{"name": "f", "children": [{"name": "kind1-0", "level": 1, "path": ["f", "kind1-0"]}]}]})
    _, report = runs.evaluate(spark, table, nodes, c, backend=Critic())
    assert report["complexity"]["raw_scores"] == scores and abs(sum(report["complexity"]["elo"].values()) - 5000) < 1e-3
    assert "f" in report["reassignment_coverage"]


def test_files(spark, tmp_path):
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"a": 1}\n\n{"b": 2\n{"a": 3}\n')
    assert [r["a"] for r in files.read_jsonl(spark, str(lines), "a long", tolerant=True).orderBy("a").collect()] == [1, 3]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(lines), "a long").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    refs = tmp_path / "refs.jsonl"
    refs.write_text('{"record": "alpha"}\n{"x": 1}\nplain words\n"quoted"\n{"record": {"b": 2}}\n')
    assert sorted(r["text"] for r in files.reference_texts(spark, [str(refs), str(tmp_path / "gone")]).collect()) == ["alpha", "plain words", "quoted", '{"b":2}', '{"x": 1}']
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    files.write_jsonl(rows, str(tmp_path / "out"))
    files.write_jsonl(rows, str(tmp_path / "out"), append=True)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1,"b":null}'] * 2
    files.write_json(str(tmp_path / "d" / "x.json"), {"é": 1})
    assert files.read_json(str(tmp_path / "d" / "x.json")) == {"é": 1} and files.read_json("nowhere", 7) == 7
    assert files.classify("t.json", '{"factors": []}') == "taxonomy" and files.classify("c.yml", "") == "config" and files.classify("r.jsonl", '{"record": 1}\n') == "dataset"


def test_embedding_cache_embeds_only_misses(spark, tmp_path):
    seen: list[int] = []

    def embedder(misses):
        seen.append(misses.count())
        return misses.select("key", F.array(F.length("text").cast("float")).alias("embedding"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    for _ in range(2):
        got = cache.embed(spark, texts, str(tmp_path / "cache"), "m", embedder)
    assert seen == [2, 0] and got.count() == 2


def test_rows_are_appended_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    (source / "1.json").write_text('{"attempt_index": 1, "x": "a"}\n{"attempt_index": 2, "x": "b"}\n')
    append_new(spark, str(source), "attempt_index long, x string", target, str(tmp_path / "cp"))
    (source / "2.json").write_text('{"attempt_index": 2, "x": "late"}\n{"attempt_index": 3, "x": "c"}\n{"torn\n')
    got = append_new(spark, str(source), "attempt_index long, x string", target, str(tmp_path / "cp"))
    assert sorted((r["attempt_index"], r["x"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_command_line(tmp_path, capsys):
    from curatrix.cli import main

    path = tmp_path / "c.json"
    path.write_text(json.dumps({"description": "d", "models": {r: {} for r in config.ROLES}, "project": {"output_dir": str(tmp_path / "o")}}))
    assert main(["validate", str(path)]) == 0 and main(["validate", str(tmp_path / "none.json")]) == 1
