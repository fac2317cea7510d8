"""Operators on open JSON objects, held as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def text_at(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def has_key(c: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def as_map(c: Column) -> Column:
    """Top-level keys to the text of their values; malformed and null give an empty map."""
    return F.coalesce(F.from_json(c, _MAP), F.create_map().cast(_MAP))


def merge(*parts: Column) -> Column:
    """Shallow merge of maps, the rightmost value of a key wins, keys in the order they appear first."""
    keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(p) for p in parts])))
    value = lambda k: F.coalesce(*[F.when(F.map_contains_key(p, k), F.struct(F.element_at(p, k).alias("v"))) for p in reversed(parts)])["v"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def set_key(m: Column, key: str, value: Column) -> Column:
    return merge(m, F.create_map(F.lit(key), value))


def strip_empty(m: Column) -> Column:
    """Without null values and empty arrays."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != "[]"))


def strings(c: Column) -> Column:
    """A JSON array as strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
