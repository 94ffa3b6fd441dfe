from __future__ import annotations

import random

import numpy as np
import pytest

from curatrix.llm import linededup
from tests.compare import differences

from .conftest import documents


def brute(texts: dict[int, str | None]) -> dict[int, tuple[int, str | None]]:
    """(removed lines, text left) of each document, every line compared with all before it."""
    seen: list[frozenset] = []
    out = {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = (0, None)
            continue
        kept, gone = [], 0
        for line in texts[i].split("\n"):
            words = frozenset("".join(" " if ord(c) <= 32 else c for c in line).lower().split(" ")) - {""}
            again = bool(words) and any(5 * len(words & s) >= 4 * len(words | s) for s in seen)
            if words:
                seen.append(words)
            gone += again
            if not again:
                kept.append(line)
        left = "\n".join(kept)
        out[i] = (gone, left if left.strip() or not gone else "")
    return out


def _texts(seed: int, n: int, vocabulary: int) -> list[str]:
    rng = random.Random(seed)
    lines = [[f"t{int(rng.paretovariate(1.1)) % vocabulary}" for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    out = []
    for _ in range(n):
        own = []
        for _ in range(rng.randrange(1, 7)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = f"t{rng.randrange(vocabulary)}"
            own.append(" ".join(line))
        out.append("\n".join(own))
    return out


@pytest.mark.parametrize("seed,vocabulary", [(1, 300), (2, 5000), (3, 40)])
def test_against_brute_force(spark, seed, vocabulary):
    texts = _texts(seed, 150, vocabulary)
    got = {r["doc_id"]: (r["removed_lines"], r["text"]) for r in linededup.clean(documents(spark, texts)).collect()}
    want = brute(dict(enumerate(texts)))
    assert got == want and sum(n for n, _ in want.values()) > 50


def test_candidates_have_all_similar_pairs():
    rng = np.random.default_rng(8)
    base = [rng.choice(400, size=rng.integers(4, 40), replace=False) for _ in range(25)]
    sets = []
    for _ in range(200):
        s = list(base[rng.integers(25)])
        for _ in range(rng.integers(0, 5)):
            s[rng.integers(len(s))] = int(rng.integers(400))
        sets.append(np.unique(s))
    h = np.concatenate(sets).astype(np.uint64) * np.uint64(2654435761) & linededup._MASK42
    line = np.repeat(np.arange(200), [len(s) for s in sets])
    level = np.ones(1 << linededup.FREQ_BITS, np.uint8)
    _, e = linededup.entries(line, h, level)
    got = {(int(a), int(b)) for x, y, _ in linededup.candidates(e) for a, b in zip(x, y)}
    _, _, name = linededup._names(*linededup._sets(line, h))
    for i in range(200):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and name[i] != name[j] and len(sets[i]) > 3:
                assert (min(int(name[i]), int(name[j])), max(int(name[i]), int(name[j]))) in got


def test_against_sql(spark, tiny, oracle):
    assert not differences(linededup.query(spark, tiny), linededup.ORACLE, oracle)


def test_odd_rows(spark, odd, none):
    got = linededup.clean(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["removed_lines"], r["text"]))
    line = "one two three four five six"
    # The null id comes first; equal rows fare alike.
    assert sorted(by[None], key=repr) == [(0, line), (0, None)]
    assert by[4] == [(1, ""), (1, "")] and by[8] == [(1, "a\n\nb")]
    assert by[1] == [(0, None)] and by[2] == [(0, "")] and by[3] == [(0, "  \n\t")] and by[5][0][0] == 0
    kept = linededup.keep_lines(odd)
    assert kept.columns == odd.columns and 4 not in {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[8] == 4
    assert linededup.clean(none).count() == 0 and linededup.keep_lines(none).count() == 0


def test_many_copies_of_one_line(spark):
    """50,000 documents, a third of them listed twice, that share a line: all but the first lose it."""
    from pyspark.sql import functions as F

    docs = spark.range(50_000).select((F.lit(50_000) - F.col("id")).alias("doc_id"), F.concat(F.lit("all of these share this one\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = linededup.clean(docs.union(docs.filter("doc_id % 3 = 1"))).groupBy("removed_lines", F.regexp_count("text", F.lit("\n")).alias("n")).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 1), (1, 0, 66_665, 2)]
