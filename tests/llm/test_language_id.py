from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from curatrix.llm import langid

from .conftest import documents


def test_held_out_accuracy(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").filter("length(text) > 200")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    got = docs.filter("doc_id % 2 = 1").select("lang", langid.label(docs, model).alias("r")).select("lang", "r.*").toDF("truth", "lang", "sim", "ok").toPandas()
    assert got["ok"].mean() > 0.9
    assert (got[got["ok"]]["lang"] == got[got["ok"]]["truth"]).mean() > 0.95


def test_counts_match_a_plain_count():
    text = "Ab, bÉ ab"
    letters = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())
    grams = [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1) if n > 1 or letters[i] != " "]
    got = langid.counts([text.encode()])[0]
    # the text's end adds one trailing space
    assert len(grams) <= got.sum() <= len(grams) + 2
    assert np.array_equal(langid.counts([text.encode(), b"", b"zz"])[0], got)


def _bucket(gram: str) -> int:
    """The dimension of an n-gram, one character after another."""
    m, h = 0xFFFFFFFF, ord(gram[0]) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram[1:]:
        h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) & m
    return (h * 0x27D4EB2F & m) >> (32 - langid.BITS)


def _plain_counts(text: str) -> dict[int, int]:
    letters = re.sub(" +", " ", "".join(low if len(low := c.lower()) == 1 and c.isalpha() else c if c.isalpha() else " " for c in text)).strip() + " "
    letters = (" " if text and not text[0].isalpha() else "") + letters if letters.strip() else ""
    letters = letters.removeprefix(" ")
    return dict(Counter(_bucket(letters[i : i + n]) for n in (1, 2, 3) for i in range(len(letters) - n + 1) if n > 1 or letters[i] != " "))


def test_against_a_plain_dictionary_version(spark):
    """Counts, document frequencies, weights, cosines and rejection over whole texts, without arrays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()] + [(-1, "", None), (-2, "\U0001F600 \U0001F601!", None), (-3, None, None), (-4, "\U00010400\U00010401", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    tf = {i: _plain_counts(t or "") for i, t, _ in rows}
    df = Counter(d for c in tf.values() for d in c)
    assert all(abs(model.idf[d] - (math.log((1 + len(rows)) / (1 + n)) + 0.1)) < 1e-5 for d, n in df.items())
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    assert len(got) == len(rows)
    for i, c in tf.items():
        w = {d: math.log1p(n) * (math.log((1 + len(rows)) / (1 + df[d])) + 0.1) for d, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values())) or 1.0
        sims = [sum(x * float(cent[d]) for d, x in w.items()) / length for cent in model.centroids]
        best = max(range(len(sims)), key=lambda k: (sims[k], -k))
        assert abs(got[i]["similarity"] - sims[best]) < 2e-4, i
        floor = float(model.floor[min(15, int(math.log2(max(1, sum(c.values())))))])
        if abs(sims[best] - floor) > 1e-5:
            assert got[i]["accepted"] == (bool(c) and sims[best] >= floor)
            assert got[i]["lang"] == (model.langs[best] if got[i]["accepted"] else None) or sorted(sims)[-1] - sorted(sims)[-2] < 1e-5
    assert got[-2]["similarity"] == 0 and not got[-2]["accepted"]


def test_several_centroids_and_rejection(spark):
    en = [f"the house and the garden of the family number {i} were quiet in the morning light" for i in range(30)]
    fr = [f"la maison et le jardin de la famille numero {i} étaient calmes dans la lumière du matin" for i in range(30)]
    junk = ["zqxj kvvw qqqz xxjk zzqq wvkj xqzj qkxz jjqx", "12345 !!! 678", "", None]
    docs = documents(spark, en + fr + junk, langs=["en"] * 30 + ["fr"] * 30 + [None] * 4)
    model = langid.fit(docs)
    assert set(model.langs) == {"en", "fr"} and len(model.langs) > 2
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["lang"] == "en" for i in range(30)) and all(got[i]["lang"] == "fr" for i in range(30, 60))
    assert not any(got[i]["accepted"] for i in range(60, 64)) and got[60]["lang"] is None
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 60


def test_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert not by[1]["accepted"] and not by[2]["accepted"] and not by[3]["accepted"] and by[7]["similarity"] == 0
    assert langid.keep_known(odd).columns == odd.columns
    assert langid.identify(none).count() == 0 and langid.keep_known(none).count() == 0


def test_without_labels_all_are_rejected(spark):
    assert not any(r["accepted"] for r in langid.identify(documents(spark, ["some text here", "more"])).collect())

def test_languages_left_out_of_fitting_are_rejected(spark):
    """Each real language in turn has no labelled row, but for two texts under another language's label."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").select("doc_id", "text", "lang").toPandas()
    for out, other in (("de", "en"), ("en", "fr"), ("es", "de"), ("fr", "es")):
        alien = docs["lang"] == out
        langs = docs["lang"].mask(alien)
        stray = docs[alien].sort_values("doc_id").index[:2]
        langs[stray] = other
        frame = documents(spark, docs["text"].tolist(), docs["doc_id"].tolist(), [g if isinstance(g, str) else None for g in langs])
        got = {r["doc_id"]: r["accepted"] for r in langid.identify(frame).collect()}
        ok = docs["doc_id"].map(got)
        assert ok[alien].mean() < 0.1, out
        assert ok[~alien].mean() > 0.95, out
