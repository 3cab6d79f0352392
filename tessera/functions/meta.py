"""Typed comparison of JSON metadata: a value only compares with a filter of its own type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class MetaFilter:
    """key op value; with include_null, rows without the key (or without metadata) pass too."""

    key: str
    op: str
    value: object
    include_null: bool = False

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.key):
            raise ValueError(f"bad metadata key: {self.key!r}")
        if self.op not in OPERATORS:
            raise ValueError(f"bad operator: {self.op!r}")


def compare(column: Column, op: str, value: Column) -> Column:
    return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]


def meta_filter(metadata: Column, f: MetaFilter) -> Column:
    v = F.try_variant_get(F.try_parse_json(metadata), f"$.{f.key}", "variant")
    kind = F.schema_of_variant(v)
    if isinstance(f.value, bool):
        good = (kind == "BOOLEAN") & compare(F.try_variant_get(v, "$", "boolean"), f.op, F.lit(f.value))
    elif isinstance(f.value, (int, float)):
        good = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)") & compare(F.try_variant_get(v, "$", "double"), f.op, F.lit(float(f.value)))
    else:
        good = (kind == "STRING") & compare(F.try_variant_get(v, "$", "string"), f.op, F.lit(f.value))
    good = F.coalesce(good, F.lit(False))
    return good | v.isNull() if f.include_null else good


def meta_text(metadata: Column, key: str) -> Column:
    """A top-level string value; null if absent or of another type."""
    v = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def patched(metadata: Column, patch: Column) -> Column:
    """Shallow patch of a JSON object: a value sets its key, null deletes it; stored nulls stay. Keys come out sorted; values keep their JSON text.

    What isn't a JSON object counts as an empty one.
    """
    kind = "map<string,variant>"
    old = F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$", kind), F.create_map().cast(kind))
    new = F.coalesce(F.try_variant_get(F.try_parse_json(patch), "$", kind), F.create_map().cast(kind))
    kept = F.filter(F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: ~(F.array_contains(F.map_keys(new), k) & F.coalesce(F.is_variant_null(new[k]), F.lit(True))))
    value = lambda k: F.coalesce(F.to_json(F.when(F.array_contains(F.map_keys(new), k), new[k]).otherwise(old[k])), F.lit("null"))
    quoted = lambda k: F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(kept), lambda k: F.concat(quoted(k), F.lit(":"), value(k))), ","), F.lit("}"))


def conflicts(a: Column, b: Column) -> Column:
    """Whether two metadata objects share a key with different values, compared as printed."""
    kind = "map<string,string>"
    x, y = F.from_json(a, kind), F.from_json(b, kind)
    differs = F.exists(F.map_keys(x), lambda k: F.array_contains(F.map_keys(y), k) & (F.coalesce(x[k], F.lit("null")) != F.coalesce(y[k], F.lit("null"))))
    return F.coalesce(differs, F.lit(False))
