"""Column expressions over texts, records and paths. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def casefold(text: Column) -> Column:
    """Full case folding as far as letters occur in practice: lower case, and sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Case-folded words (letters, digits, underscore) in order."""
    return F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))


def ngrams(words: Column, n: int = 13) -> Column:
    """Distinct hashes of the n-word runs; a shorter text is one run; no words, no runs.

    ``words`` must be a materialised column: the lambda refers to it for each run.
    """
    count = F.greatest(F.size(words) - n, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), count), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(n))))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def field_path(field: str) -> str:
    """A dotted field ('query', 'extraction.intent', a leading '$.' allowed) as a JSON path."""
    parts = field.lstrip("$.").split(".")
    return "$" + "".join(f"['{p}']" for p in parts)


def dotted_field(record: Column, field: str) -> Column:
    """A nested field of a JSON object; null where it doesn't resolve. Arrays are not entered."""
    return F.get_json_object(record, field_path(field))


def record_text(record: Column, field: str | None = None) -> Column:
    """The text of a record: a dotted field of a JSON object where it resolves, else the record as it stands.

    JSON objects are expected in canonical form (sorted keys), as ``canonical`` makes them.
    """
    return F.coalesce(dotted_field(record, field), record) if field else record


def normal_segment(value: Column) -> Column:
    """Case-folded letters and digits of a path segment."""
    return F.regexp_replace(casefold(value), r"[^\p{L}\p{N}]", "")


def root_key(path: Column) -> Column:
    """A path written with '/' or '.' as normalised segments, empty ones dropped."""
    return F.filter(F.transform(F.split(F.replace(path, F.lit("/"), F.lit(".")), r"\."), normal_segment), lambda s: s != "")


def path_key(path: Column) -> Column:
    """The normalised elements of a path; empty ones stay."""
    return F.transform(path, normal_segment)


def prefixes(path: Column) -> Column:
    """All non-empty beginnings of a path."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))).otherwise(F.array().cast("array<array<string>>"))


def starts_with(path: Column, root: Column) -> Column:
    """Whether a path lies in the subtree of ``root``; the empty root holds everything."""
    return (F.size(root) <= F.size(path)) & (F.size(root) == 0) | (F.when(F.size(root) > 0, F.slice(path, F.lit(1), F.greatest(F.size(root), F.lit(1))) == root).otherwise(F.lit(False)))


def mix_paths(mix: Column) -> Column:
    """Distinct 'factor:a/b/c' of a mix."""
    return F.array_distinct(F.transform(mix, lambda m: F.concat(m["factor"], F.lit(":"), F.array_join(F.coalesce(m["path"], F.array(m["node"])), "/"))))


def extract_json(text: Column) -> Column:
    """The JSON of a model's answer: the whole trimmed text, else its first fenced block; null where neither parses."""
    whole = F.trim(text)
    fenced = F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(whole), ok(F.when(fenced != "", fenced)))


def node_weight(weight: Column) -> Column:
    """A node's weight as a number of at least 0; 1 where it is missing or no number."""
    return F.greatest(F.lit(0.0), F.coalesce(weight.try_cast("double"), F.lit(1.0)))


def token_estimate(text: Column, reported: Column | None = None) -> Column:
    """Reported tokens unless missing or 0, else a quarter of the characters, at least 1."""
    guess = F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
    return guess if reported is None else F.coalesce(F.nullif(reported.cast("long"), F.lit(0).cast("long")), guess)


def cache_key(model: Column, text: Column) -> Column:
    """Identity of an embedded text."""
    return F.sha2(F.concat(model, F.char(F.lit(0)), text), 256)


def attempt_index(index: Column, item_id: Column) -> Column:
    """The attempt of a row: its own index, else the one in an id 'item-<n>-...'."""
    return F.coalesce(index.cast("long"), F.regexp_extract(item_id, r"^item-(\d+)-", 1).try_cast("long"))


def duration_text(seconds: Column) -> Column:
    """Seconds as 1h02m, 2m03s or 5s; null stays null."""
    s = F.round(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.format_string("%dh%02dm", hours, minutes)).when(s >= 60, F.format_string("%dm%02ds", minutes, s % 60)).when(s.isNotNull(), F.format_string("%ds", s))


def cost_estimate(in_tokens: Column, out_tokens: Column, per_million_in: float = 0.05, per_million_out: float = 0.40) -> Column:
    return in_tokens / F.lit(1e6) * per_million_in + out_tokens / F.lit(1e6) * per_million_out


def portable_uniform(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) from an md5 of the parts: the same in any SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def key_difference(left: Column, right: Column) -> Column:
    """Keys of one JSON object that another lacks, sorted."""
    return F.sort_array(F.array_except(F.coalesce(F.json_object_keys(left), F.array().cast("array<string>")), F.coalesce(F.json_object_keys(right), F.array().cast("array<string>"))))
