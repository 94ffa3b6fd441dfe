from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatrix.functions import schema as J
from curatrix.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("r")).first()["r"]


def test_tokens_fold_case_and_keep_unicode_words(spark):
    assert one(spark, T.tokens(F.col("t")), t="Straße, ÉTÉ! snake_case 42 日本") == ["strasse", "été", "snake_case", "42", "日本"]
    assert one(spark, T.tokens(F.col("t")), t="!?") == []


def test_ngrams_of_short_and_empty_texts(spark):
    words = spark.createDataFrame([(["a", "b"],), ([],), (["a", "b", "a", "b"],)], "w array<string>")
    assert [len(r["g"]) for r in words.select(T.ngrams(F.col("w"), 2).alias("g")).collect()] == [1, 0, 2]
    assert [len(r["g"]) for r in words.select(T.ngrams(F.col("w"), 13).alias("g")).collect()] == [1, 0, 1]


@pytest.mark.parametrize("text,want", [('{"a": 1}', True), ("  [1]\n", True), ('said:\n```json\n{"a": 1}\n```', True), ('x {"a": 1} y', False), ("```\nnope\n```", False)])
def test_extract_json(spark, text, want):
    assert (one(spark, T.extract_json(F.col("t")), t=text) is not None) == want


def test_paths(spark):
    assert one(spark, T.root_key(F.col("t")), t="Topic / Al-pha..b!") == ["topic", "alpha", "b"]
    assert one(spark, T.path_key(F.col("t")), t=["A b", "#"]) == ["ab", ""]
    assert one(spark, T.prefixes(F.col("t")), t=["a", "b"]) == [["a"], ["a", "b"]]
    for root, want in ((["a"], True), (["a", "b"], True), (["b"], False), ([], True), (["a", "b", "c"], False)):
        got = spark.createDataFrame([(["a", "b"], root)], "p array<string>, r array<string>").select(T.starts_with(F.col("p"), F.col("r")).alias("x")).first()["x"]
        assert got is want


def test_small_ones(spark):
    assert one(spark, T.node_weight(F.col("t")), t="-2") == 0.0
    assert one(spark, T.node_weight(F.col("t")), t="many") == 1.0
    assert [one(spark, T.duration_text(F.col("s")), s=s) for s in (5.2, 123.0, 3725.0)] == ["5s", "2m03s", "1h02m"]
    assert one(spark, T.token_estimate(F.col("t")), t="abc") == 1
    assert one(spark, T.attempt_index(F.lit(None), F.col("t")), t="item-17-0a1b") == 17
    assert 0 <= one(spark, T.portable_uniform("7", F.col("t")), t="x") < 1
    assert one(spark, T.dotted_field(F.col("t"), "$.a.b"), t='{"a": {"b": "c"}}') == "c"
    assert one(spark, T.record_text(F.col("t"), "z"), t='{"a": 1}') == '{"a": 1}'


SCHEMA = {"type": "object", "required": ["x"], "properties": {"x": {"type": "string", "enum": ["ok", "fine"]}, "n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}}}


@pytest.mark.parametrize(
    "record,valid",
    [('{"x": "ok"}', True), ('{"x": "no"}', False), ('{"x": 1}', False), ("{}", False), ('{"x": "ok", "n": 1.0}', True), ('{"x": "ok", "n": 1.5}', False), ('{"x": "ok", "n": true}', False), ('{"x": "ok", "l": [1, 2.5]}', True), ('{"x": "ok", "l": ["a"]}', False), ('{"x": "fine", "more": 1}', True), ("torn", False)],
)
def test_schema(spark, record, valid):
    from curatrix.plans.generation import check_record

    ok, error = J.validate(SCHEMA, F.try_parse_json("t"))
    assert one(spark, ok, t=record) is valid and (one(spark, error, t=record) is None) is valid
    if record != "torn":
        import json

        assert (check_record(SCHEMA, json.loads(record)) is None) is valid


def test_schema_subset():
    assert not J.check_subset(SCHEMA) and J.check_subset({"type": ["string", "null"]}) and J.check_subset({"type": "array"}) and J.check_subset({}) and J.check_subset({"type": "object", "properties": {"a": {"type": "date"}}})


def test_schema_keywords_that_are_not_enforced_are_refused():
    for word, value in (("minLength", 2), ("pattern", "^a"), ("additionalProperties", False), ("maxItems", 3)):
        inner = {"type": "string", word: value}
        assert J.check_subset(inner) == [f"schema.{word}: unsupported keyword"]
        assert J.check_subset({"type": "object", "properties": {"a": {"type": "array", "items": inner}}}) == [f"schema.a[].{word}: unsupported keyword"]
    assert not J.check_subset({"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "string", "title": "t", "default": "x"})
