"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from curatrix.plans import catalog

from .compare import differences


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, tiny, oracle, name):
    assert not differences(catalog.queries()[name](spark, tiny), catalog.oracle_sql()[name], oracle)


def test_without_sql(spark, tiny):
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"seeded_mixes", "elo_ratings", "meta_prompts"}
    mixes = catalog.queries()["seeded_mixes"](spark, tiny).collect()
    assert len(mixes) == 150 and all(r["error"] is None and r["mix"] for r in mixes)
    assert not any("EUROPE" in r["mix"] and "Brand#4/SMALL" in r["mix"] for r in mixes if r["strategy_id"] == "europe")


def test_meta_prompts_draw_as_one_attempt_does(spark, tiny):
    import random

    from curatrix.operators import sampling
    from curatrix.plans import generated, generation
    from curatrix.plans.backend import Stub

    tree = generation.build_taxonomy(spark, generated.settings(generated.QA), Stub())
    strategy = {"id": "all", "roots": [f["name"] for f in tree["factors"]], "weight": 1.0, "never_combine": []}
    got = {r["attempt_index"]: r for r in generated.meta_prompts(spark, tiny).collect()}
    assert len(got) == 200 and 0 < sum(r["complexified"] for r in got.values()) < 200
    for i in (0, 7, 199):
        rng = random.Random(5 + i)
        sampling.draw_strategy([strategy], rng)
        mix = sampling.draw_mix(tree, strategy, rng)
        assert got[i]["mix"] == " ".join("/".join(m["path"]) for m in mix) and got[i]["error"] is None


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["metric", "value"]


def test_durations_are_summed_in_order(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(3)
    events = [(i, i % 1500, None if i % 1500 == 0 else round(rng.expovariate(1 / 50), 2)) for i in range(90_000)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert not differences(catalog.queries()["duration_text"](spark, str(tmp_path)), catalog.oracle_sql()["duration_text"], con)


def test_evaluate_report_makes_ngrams_once(spark, tiny, monkeypatch):
    from curatrix.operators import similarity

    made = []
    monkeypatch.setattr(similarity, "gram_sets", lambda *a, make=similarity.gram_sets: made.append(a[1]) or make(*a))
    catalog.queries()["evaluate_report"](spark, tiny)
    assert sorted(made) == ["doc_id", "item_id"]
