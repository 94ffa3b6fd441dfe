"""JSON Schema checks: the supported subset compiled to Column predicates over VARIANT.

Keywords that would constrain a record and are not in the subset (lengths,
pattern, bounds, item counts, additionalProperties ...) are refused, not ignored.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"object", "string", "number", "integer", "boolean", "array"}
WALKED = {"type", "enum", "properties", "required", "items", "title", "description"}
#: Keywords that constrain nothing by themselves.
NOTES = {"$schema", "$id", "$comment", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


def check_subset(schema: Any, at: str = "schema") -> list[str]:
    """What keeps a schema out of the supported subset; empty when it is fine."""
    if not isinstance(schema, dict):
        return [f"{at}: must be an object"]
    kind = schema.get("type")
    if not isinstance(kind, str) or kind not in TYPES:
        return [f"{at}: unsupported type {kind!r}"]
    bad = [f"{at}.{word}: unsupported keyword" for word in sorted(map(str, schema)) if word not in WALKED | NOTES]
    if "enum" in schema and not isinstance(schema["enum"], list):
        bad.append(f"{at}.enum: must be a list")
    if kind == "object":
        for name, inner in (schema.get("properties") or {}).items():
            bad += check_subset(inner, f"{at}.{name}")
    if kind == "array":
        bad += check_subset(schema["items"], f"{at}[]") if "items" in schema else [f"{at}: arrays must declare items"]
    return bad


def _quoted(path: str, name: str) -> str:
    return f"{path}['{name}']"


def _type_ok(kind: str, value: Column, text: Column) -> Column:
    # schema_of_variant tells ints, decimals, doubles, strings, booleans, arrays and objects apart.
    number = text.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return {
        "string": text == "STRING",
        "boolean": text == "BOOLEAN",
        "number": number,
        "integer": number & (F.try_variant_get(value, "$", "double") % 1 == 0),
        "array": text.startswith("ARRAY"),
        "object": text.startswith("OBJECT"),
    }[kind]


def first_error(schema: dict[str, Any] | None, record: Column) -> Column:
    """The first violation of a VARIANT record, by path; null where it is valid. No schema: always valid."""
    if schema is None:
        return F.lit(None).cast("string")
    bad = check_subset(schema)
    if bad:
        raise ValueError("; ".join(bad))
    return F.coalesce(*_errors(schema, record, "$"), F.lit(None).cast("string"))


def _errors(schema: dict[str, Any], root: Column, path: str) -> list[Column]:
    value = F.try_variant_get(root, path, "variant") if path != "$" else root
    there = value.isNotNull()
    kind = schema["type"]
    out = [F.when(there & ~F.coalesce(_type_ok(kind, value, F.schema_of_variant(value)), F.lit(False)), F.lit(f"{path} is not of type {kind}"))]
    if "enum" in schema:
        text = F.to_json(value)
        import json

        out.append(F.when(there & ~text.isin(*[json.dumps(v, ensure_ascii=False) for v in schema["enum"]]), F.lit(f"{path} is not one of the allowed values")))
    if kind == "object":
        for name in schema.get("required", []):
            inner = F.try_variant_get(root, _quoted(path, name), "variant")
            out.append(F.when(there & inner.isNull(), F.lit(f"{_quoted(path, name)} is required")))
        for name, inner_schema in sorted((schema.get("properties") or {}).items()):
            out += _errors(inner_schema, root, _quoted(path, name))
    if kind == "array":
        items = F.try_variant_get(root, path, "array<variant>")
        wrong = F.exists(items, lambda v: F.coalesce(*_errors(schema["items"], v, "$"), F.lit(None).cast("string")).isNotNull())
        out.append(F.when(there & F.coalesce(wrong, F.lit(False)), F.lit(f"{path} has an invalid item")))
    return out


def validate(schema: dict[str, Any] | None, record: Column) -> tuple[Column, Column]:
    """(valid, first error) of a VARIANT record; a missing record is invalid unless there is no schema."""
    if schema is None:
        return F.lit(True), F.lit(None).cast("string")
    error = F.when(record.isNull(), F.lit("no record")).otherwise(first_error(schema, record))
    return error.isNull(), error
