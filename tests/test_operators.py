from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import browse, complexity, cost, coverage, diversity, sampling, similarity
from curatrix.operators import taxonomy as X


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_a_chain_of_similar_rows_keeps_the_far_end(spark):
    w = [f"w{i}" for i in range(40)]
    a, b, c = w[:30], w[3:33], w[6:36]  # neighbours are similar at 0.8 by single words, the ends are not
    kept, removed = similarity.dedupe(rows(spark, *(" ".join(x) for x in (a, b, c))), "id", "text", n=1)
    assert ids(removed) == [1] and ids(kept) == [0, 2]


def test_rows_without_words_are_no_duplicates(spark):
    kept, removed = similarity.dedupe(rows(spark, "!", "?", "", None, "same words", "Same  words!"), "id", "text")
    assert ids(kept) == [0, 1, 2, 3, 4] and ids(removed) == [5]


def test_decontaminate(spark):
    kept, gone = similarity.decontaminate(rows(spark, "alpha beta gamma", "other words"), "id", "text", rows(spark, "Alpha, beta gamma."), "id", "text", 2)
    assert ids(kept) == [1] and ids(gone) == [0]
    kept, _ = similarity.decontaminate(rows(spark, "alpha beta gamma"), "id", "text", rows(spark), "id", "text")
    assert kept.count() == 1


@pytest.mark.parametrize("n,threshold", [(1, "0.8"), (2, "0.5"), (3, "0.3")])
def test_similar_pairs_against_brute_force(spark, n, threshold):
    from fractions import Fraction

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(60)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}

    g = list(map(grams, texts))
    want = {(i, j) for j in range(60) for i in range(j) if Fraction(len(g[i] & g[j]), len(g[i] | g[j])) >= Fraction(threshold)}
    got = similarity.similar_pairs(similarity.gram_sets(rows(spark, *texts), "id", "text", n), threshold).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == want


TREE = {
    "factors": [
        {"name": "pov", "children": [{"name": "big", "level": 1, "path": ["pov", "big"], "children": [{"name": f"b{i}", "level": 2, "path": ["pov", "big", f"b{i}"]} for i in range(10)]}, {"name": "small", "level": 1, "path": ["pov", "small"], "children": [{"name": f"s{i}", "level": 2, "path": ["pov", "small", f"s{i}"]} for i in range(2)]}]},
        {"name": "form", "children": [{"name": "CI/CD", "level": 1, "path": ["form", "CI/CD"], "weight": 0}, {"name": "plain", "level": 1, "path": ["form", "plain"], "weight": 3}]},
    ]
}


def strategies(spark, *some):
    return spark.createDataFrame([(s["id"], "", s.get("roots", []), float(s.get("weight", 1)), s.get("never_combine", [])) for s in some], "id string, description string, roots array<string>, weight double, never_combine array<array<string>>")


def test_tree(spark):
    nodes = X.from_tree(spark, TREE)
    assert nodes.count() == 18 and {r["factor"]: (r["nodes"], r["leaves"], r["depth"]) for r in X.statistics(nodes).collect()} == {"pov": (15, 12, 2), "form": (3, 2, 1)}
    again = X.to_tree(nodes)
    assert [n[2] for n in X.walk(again)] == [n[2] for f in sorted(TREE["factors"], key=lambda f: f["name"]) for n in X.walk({"factors": [f]})]
    bad = X.invalid_paths(strategies(spark, {"id": "s", "roots": ["pov/big", "pov/none", "form/CI/CD", "pov/none"], "never_combine": [["pov"], ["form/plain", "x"]]}), nodes)
    assert [r["ref"] for r in bad.orderBy("pos").collect()] == ["pov/none", "form/CI/CD", "pov/none", "x"]
    assert ids(X.uncovered_factors(strategies(spark, {"id": "s", "roots": ["POV/big"]}), nodes), "factor") == ["form"]
    assert X.strategies_or_general(strategies(spark), nodes).first()["roots"] == ["form", "pov"]
    assert X.parse_taxonomy('[{"name": "a"}]')["factors"] and X.parse_taxonomy('{"name": "a"}')["factors"]


def test_branches_are_drawn_evenly_whatever_their_leaves(spark):
    p = {r["path_str"]: r["probability"] for r in sampling.leaf_probability(X.from_tree(spark, TREE)).collect()}
    assert abs(sum(v for k, v in p.items() if k.startswith("pov/big")) - 0.5) < 1e-9 and p["form/CI/CD"] == 0 and p["form/plain"] == 1
    rng = random.Random(7)
    drawn = [sampling.descend(TREE["factors"][0], rng)["name"] for _ in range(4000)]
    assert 0.45 < sum(d[0] == "b" for d in drawn) / 4000 < 0.55


def test_portable_draws_follow_the_distribution(spark):
    nodes = X.from_tree(spark, TREE)
    plans = strategies(spark, {"id": "a", "roots": ["pov/small"], "weight": 3}, {"id": "b", "roots": ["pov"]})
    chosen = sampling.choose_strategy(spark.range(3000).toDF("attempt_index"), plans, 1)
    assert 0.7 < chosen.filter("strategy_id = 'a'").count() / 3000 < 0.8
    mix = sampling.sample_mix(chosen, sampling.strategy_distribution(plans, nodes), 1)
    assert mix.count() == 6000 and mix.filter("strategy_id = 'a' and factor = 'pov' and not path_str like 'pov/small/%'").count() == 0
    assert mix.filter("path_str = 'form/CI/CD'").count() == 0


def test_never_combine(spark):
    rule = {"id": "r", "roots": ["pov", "form"], "never_combine": [["pov/small", "form/plain"]]}
    nodes, plans = X.from_tree(spark, TREE), strategies(spark, rule)
    chosen = sampling.choose_strategy(spark.range(60).toDF("attempt_index"), plans, 2)
    mix = sampling.sample_valid_mix(chosen, sampling.strategy_distribution(plans, nodes), plans, 2)
    assert mix.count() == 120 and mix.filter("path_str like 'pov/small%'").count() == 0
    rng = random.Random(1)
    assert all(m[0]["path"][1] == "big" for m in (sampling.draw_mix(TREE, rule, rng) for _ in range(50)))
    with pytest.raises(ValueError):
        sampling.draw_mix(TREE, rule | {"never_combine": [["pov", "form"]]}, rng)


def test_seeded_mixes_replay_pythons_generator(spark):
    plans = [{"id": "a", "roots": []}, {"id": "b", "roots": ["pov/small"], "weight": 2}]
    got = {r["attempt_index"]: r for r in sampling.seeded_mixes(spark.range(50).toDF("attempt_index"), TREE, plans, 9).collect()}
    for i in range(50):
        rng = random.Random(9 + i)
        s = sampling.draw_strategy(plans, rng)
        assert got[i]["strategy_id"] == s["id"] and [m["path"] for m in got[i]["taxonomy_mix"]] == [m["path"] for m in sampling.draw_mix(TREE, s, rng)]


def _plain_mix(tree, strategy, rng):
    """The draws of one mix as they are defined, looking at the whole tree each time."""
    every = lambda n: [n] + [m for kid in n.get("children") or [] for m in every(kid)]
    key = lambda n: sampling.key_of_path(n.get("path") or [n["name"]])

    def leaf(factor):
        own, roots = sampling.key_of_path([factor["name"]]), [sampling.key_of_root(r) for r in strategy["roots"]]
        named = [] if own in roots else [n for n in every(factor) if key(n) in [r for r in roots if r[:1] == own]]
        return sampling.descend(sampling.pick(named, rng) if named else factor, rng)

    for _ in range(sampling.MAX_REDRAWS):
        got = [leaf(f) for f in tree["factors"]]
        under = lambda side: any(key(n)[: len(side)] == side for n in got)  # noqa: B023, E731
        if not any(under(sampling.key_of_root(a)) and under(sampling.key_of_root(b)) for a, b in strategy.get("never_combine", [])):
            return [n["path"] for n in got]
    return []


def test_seeded_mixes_look_at_the_tree_once_and_use_all_tasks(spark, monkeypatch):
    plans = [{"id": "a", "roots": []}, {"id": "b", "roots": ["pov/small", "pov.big", "pov/none"], "weight": 2}, {"id": "c", "roots": ["pov/small", "pov"], "never_combine": [["pov/small", "form/plain"]]}, {"id": "d", "roots": ["x"], "never_combine": [["pov", "form"]]}]
    mixes = sampling.seeded_mixes(spark.range(0, 400, 1, 1).toDF("attempt_index"), TREE, plans, 9)
    assert mixes.rdd.getNumPartitions() > 1
    for r in mixes.collect():
        rng = random.Random(9 + r["attempt_index"])
        s = sampling.draw_strategy(plans, rng)
        assert r["strategy_id"] == s["id"] and [m["path"] for m in r["taxonomy_mix"]] == _plain_mix(TREE, s, rng) and bool(r["error"]) == (s["id"] == "d")
    asked = []
    monkeypatch.setattr(sampling, "norm", lambda x, norm=sampling.norm: asked.append(x) or norm(x))
    draws, rng = sampling.Draws(TREE), random.Random(1)
    draws.mix(plans[1], rng)
    once = len(asked)
    for _ in range(100):
        draws.mix(plans[1], rng)
    assert len(asked) == once > 0


def test_coverage_counts_beginnings_and_strangers(spark):
    nodes = X.from_tree(spark, TREE)
    paths = spark.createDataFrame([("form", ["form", "plain"]), ("form", ["form", "x"]), ("form", ["form", "y"]), ("gone", ["gone"])], "factor string, path array<string>")
    got = {(r["factor"], r["level"]): r["ratio"] for r in coverage.coverage(paths, nodes).collect()}
    assert got["form", 0] == 1 and got["form", 1] == 1.5 and got["pov", 0] == 0 and ("gone", 0) not in got


def test_trim(spark):
    got = coverage.trim(spark, spark.createDataFrame([(0, ["x"]), (1, ["x"]), (2, ["y"]), (3, [])], "ord long, paths array<string>"), 3)
    assert [r["ord"] for r in got.orderBy("rank").collect()] == [0, 2, 1]
    rng = random.Random(3)
    sets = [sorted({rng.choice("abcdefghijkl") for _ in range(rng.randrange(4))}) for _ in range(30)]
    left, used, want = list(range(30)), set(), []
    while left:
        best = max(left, key=lambda i: (len(set(sets[i]) - used), -i))
        want.append(best)
        used |= set(sets[best])
        left.remove(best)
    got = coverage.trim(spark, spark.createDataFrame(list(enumerate(sets)), "ord long, paths array<string>"), 30)
    assert [r["ord"] for r in got.orderBy("rank").collect()] == want


def test_complexity(spark):
    plan = complexity.batches(3, 2, 2)
    assert {p: sorted(r for q, _, _, r in plan if q == p) for p in (0, 1)} == {0: [0, 1, 2], 1: [0, 1, 2]}
    assert all(sum((q, b) == (p, c) for q, b, _, _ in plan) >= 2 for p, c, _, _ in plan)
    scored = spark.createDataFrame([(0, 0, 9.0), (1, 1, 1.0), (2, 2, None)], "ord long, id long, score double")
    schedule = spark.createDataFrame([(0, 0, k, k) for k in range(3)], "pass int, batch int, place int, ord long")
    got = {r["id"]: r["elo"] for r in complexity.elo(scored, schedule, 1).collect()}
    r = [1000.0] * 3
    for a, b, actual in ((0, 1, 1), (0, 2, 1), (1, 2, 0)):
        e = 1 / (1 + 10 ** ((r[b] - r[a]) / 400))
        r[a], r[b] = r[a] + 16 * (actual - e), r[b] - 16 * (actual - e)
    assert all(abs(got[k] - r[k]) < 1e-5 for k in range(3)) and abs(sum(got.values()) - 3000) < 1e-5
    assert {x["id"]: x["raw_score"] for x in complexity.raw_scores(scored).collect()} == {0: 9.0, 1: 1.0, 2: 5.0}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 11, 40])
def test_portable_schedule(spark, n):
    plan = complexity.portable_schedule(spark.range(n).toDF("ord"), "ord", 5, 2).collect()
    sizes: dict = {}
    for r in plan:
        sizes.setdefault((r["pass"], r["batch"]), []).append(r["ord"])
    assert sorted(r["ord"] for r in plan if r["pass"] == 1) == (list(range(n)) if n > 1 else [])
    assert all(2 <= len(v) <= 6 for v in sizes.values())


def test_diversity(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    u = diversity.units(v, "id", "v")
    assert diversity.global_diversity(u).first()["global_diversity"] == 1.0 and diversity.local_diversity(u, 2).first()["local_diversity"] == 1.0
    assert diversity.global_diversity(u.limit(1)).first()["global_diversity"] == 0 and diversity.local_diversity(u.limit(0)).first()["count"] == 0
    picked = ids(diversity.capped_seeded(spark, spark.range(50), "id", 50, 7))
    assert picked == sorted(random.Random(0).sample(range(50), 7))


def test_cost_and_browsing(spark):
    calls = spark.createDataFrame([("bulk", "generate", "m", 3, 4, 1.25), ("bulk", "generate", "m", 1, 1, 0.5)], "role string, task string, model string, in_tokens long, out_tokens long, duration_seconds double")
    total = cost.summarize(calls).filter("is_total").first()
    assert (total["calls"], total["input_tokens"], total["duration_seconds"]) == (2, 4, 1.75)
    assert not cost.summarize(calls.limit(0)).collect()
    data = spark.range(35).select("id", F.lit("r").alias("record"), F.lit("S1").alias("strategy_id"), F.lit(None).cast("string").alias("meta_prompt"), (F.col("id") < 30).alias("accepted"), F.lit("m").alias("generator_model"))
    last = browse.page(data, 9, "id").collect()
    assert [r["id"] for r in last] == list(range(30, 35)) and last[0]["range_label"] == "31-35 of 35"
    assert browse.apply_filters(data, " s1 ", "S1", True).count() == 30 and browse.apply_filters(data, "nope").count() == 0
    assert browse.summary(data).first().asDict() == {"rows": 35, "accepted": 30, "strategies": 1, "models": 1}


def test_many_copies_cost_one_set(spark):
    """20,000 copies of one text, and one near copy: one class, one pair, all but the first row removed."""
    text = " ".join(f"w{i}" for i in range(120))
    table = spark.range(20_000).select("id", F.lit(text).alias("text")).union(spark.createDataFrame([(20_000, text + " more"), (20_001, "something else")], "id long, text string"))
    sets = similarity.gram_sets(table, "id", "text")
    removed, pairs, classed = similarity.removed_rows(sets)
    assert [(r["a_id"], r["b_id"]) for r in pairs.collect()] == [(0, 20_000)]
    assert classed.filter("class = 0").count() == 20_000
    assert sorted(r["id"] for r in removed.collect()) == list(range(1, 20_001))


def test_the_pass_in_rounds_is_the_pass_on_the_driver(spark, monkeypatch):
    import random

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(150)}
    edges = spark.createDataFrame(sorted(pairs), "a_id long, b_id long")
    want = sorted(r["id"] for r in similarity.greedy_removed(edges).collect())
    monkeypatch.setattr(similarity, "DRIVER_PAIRS", 0)
    assert sorted(r["id"] for r in similarity.greedy_removed(edges).collect()) == want and want


def test_the_trim_in_rounds_is_the_trim_on_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, [f"p{rng.randrange(12)}" for _ in range(rng.randrange(4))]) for i in range(60)], "ord long, paths array<string>")
    want = sorted(map(tuple, coverage.trim(spark, table, 20).collect()))
    monkeypatch.setattr(coverage, "DRIVER_SETS", 0)
    assert sorted(map(tuple, coverage.trim(spark, table, 20).collect())) == want and len(want) == 20


def test_local_diversity_by_blocks_and_by_pairs(spark, monkeypatch):
    rng = random.Random(5)
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)] if i else [0.0] * 4) for i in range(40)], "id long, v array<double>")
    u = diversity.units(table, "id", "v")
    want = diversity.local_diversity(u, 5).first()
    monkeypatch.setattr(diversity, "BLOCK_VALUES", 0)
    assert abs(diversity.local_diversity(u, 5).first()["local_diversity"] - want["local_diversity"]) < 2e-6 and want["count"] == 40


def test_sets_are_made_in_slices_of_a_batch(monkeypatch):
    import numpy as np
    import pyarrow as pa

    seen, lists = [], pa.array([[1, 2, 3], [], [4] * 50, [5, 6], [7], []] * 40, pa.list_(pa.int64()))
    monkeypatch.setattr(similarity, "_AT_ONCE", 64)
    run = similarity._sliced(lambda part: seen.append(len(part.flatten())) or pa.array([x[::-1] for x in part.to_pylist()], part.type))
    assert run(lists).to_pylist() == [x[::-1] for x in lists.to_pylist()]
    assert sum(seen) == len(lists.flatten()) and max(seen) <= 64 + 50
    assert len(run(lists.slice(3, 0))) == 0 and np.array_equal(run(lists.slice(2, 3)).to_pylist()[1], [6, 5])


def test_batches_are_bounded_where_sets_are_made(spark):
    similarity.gram_sets(rows(spark, "some words"), "id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
