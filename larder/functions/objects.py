"""JSON objects of any shape as VARIANT columns: read by path, merge, set, delete, and the two kinds of nothing.

An object's fields are a map from names to variants; changing one gives a new map, cast back. Values keep their types (numbers, strings,
arrays, objects, JSON null). A SQL null is no document at all; a field that holds JSON null is there, and one that isn't there is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

FIELDS = "map<string,variant>"


def parse(json: Column) -> Column:
    """The document; null where the text is none."""
    return F.try_parse_json(json)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def fields(v: Column) -> Column:
    """The fields of an object; of anything else, none."""
    return F.when(is_object(v), v.cast(FIELDS)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def _only(m: Column, names: Column, wanted: bool) -> Column:
    return F.map_filter(m, lambda k, _: F.array_contains(names, k) if wanted else ~F.array_contains(names, k))


def merge(a: Column, b: Column) -> Column:
    """The fields of both; those of b win, one level deep. Null with either."""
    both = let(F.struct(fields(a).alias("a"), fields(b).alias("b")), lambda x: F.to_variant_object(F.map_concat(_only(x["a"], F.map_keys(x["b"]), False), x["b"])))
    return F.when(a.isNotNull() & b.isNotNull(), both)


def without(v: Column, *names: str) -> Column:
    """The object less some fields."""
    return F.when(v.isNotNull(), F.to_variant_object(_only(fields(v), F.array(*(F.lit(n) for n in names)), False)))


def put(v: Column, path: Sequence[str], value: Column, create: bool = True) -> Column:
    """v with the value (a variant) at a path of names. Objects on the way must be there, else v stays as it is; create: a last name that is missing is added."""
    name, rest = path[0], path[1:]

    def changed(m: Column) -> Column:
        has, held = F.array_contains(F.map_keys(m), F.lit(name)), F.map_filter(m, lambda k, _: k == name)[F.lit(name)]
        new, does = (put(held, rest, value, create), has & is_object(held)) if rest else (value, has | F.lit(create))
        return F.when(does, F.to_variant_object(F.map_concat(_only(m, F.array(F.lit(name)), False), F.create_map(F.lit(name), new))))

    return F.coalesce(F.when(is_object(v), let(fields(v), changed)), v)


def text_at(v: Column, path: str) -> Column:
    """The value at a path ($.a.b[0]) as text; null where it is JSON null or not there."""
    return F.try_variant_get(v, path, "string")


def present(v: Column, name: str) -> Column:
    """Whether an object has a field, be it JSON null; null without a document."""
    return F.when(v.isNotNull(), F.array_contains(F.map_keys(fields(v)), F.lit(name)))


def json_null(v: Column, path: str) -> Column:
    """Whether the value at a path is JSON null: there, but nothing."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))
