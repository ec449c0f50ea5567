"""Field maps: an item's translatable strings by key, packed and unpacked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Custom fields' keys start so in drafts.
CUSTOM = "com_fields:"


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.coalesce(value, F.lit("")).alias("value"))


def strings(fields: list[str], json_fields: dict[str, list[str]], separator: str = ".") -> Column:
    """Map of the strings that are not blank: columns by name, JSON sub-keys by column, separator and key."""
    made = [_entry(f, F.col(f)) for f in fields]
    made += [_entry(f"{c}{separator}{k}", F.get_json_object(F.col(c), f"$.{k}")) for c, keys in json_fields.items() for k in keys]
    return F.map_from_entries(F.filter(F.array(*made), lambda e: trimmed(e.value) != ""))


def flattened(fields: list[str], json_fields: dict[str, list[str]]) -> Column:
    """Map of all columns and JSON sub-keys (by the bare key), empty ones too. A sub-key gives way to an earlier key of its name."""
    made, seen = [], set()
    for key, value in [*((f, F.col(f)) for f in fields), *((k, F.get_json_object(F.col(c), f"$.{k}")) for c, keys in json_fields.items() for k in keys)]:
        if key not in seen:
            seen.add(key)
            made.append(_entry(key, value))
    return F.map_from_entries(F.array(*made))


def union(left: Column, right: Column) -> Column:
    """Map union; the left one's entries win."""
    return F.map_concat(left, F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k)))


def packed(column: Column, translated: Column, prefix: str) -> Column:
    """A JSON column with its translated sub-keys (keys of ``translated`` that start with the prefix) set; others survive with their
    types (numbers, booleans, null, lists, objects), and without a translated one the column stays as it is."""
    values = "map<string,variant>"
    old = F.coalesce(F.from_json(F.when(F.startswith(F.ltrim(column), F.lit("{")), column), values), F.create_map().cast(values))
    own = F.map_filter(translated, lambda k, _: k.startswith(prefix))
    new = F.transform_values(F.transform_keys(own, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k))), lambda _, v: v.cast("variant"))
    return F.when(F.size(own) > 0, F.to_json(union(new, old), {"ignoreNullFields": "false"})).otherwise(column)


def overlaid(current: Column, submitted: Column, key: str) -> Column:
    """The submitted translation of a field, or what it has now."""
    return F.coalesce(F.try_element_at(submitted, F.lit(f"translation_{key}")), current)


def kept(answer: Column, asked: Column) -> Column:
    """The entries of an answer whose keys were asked for."""
    return F.map_filter(answer, lambda k, v: F.map_contains_key(asked, k) & v.isNotNull())


def custom(names: Column) -> Column:
    """A map with its keys in the custom fields' name space."""
    return F.transform_keys(names, lambda k, _: F.concat(F.lit(CUSTOM), k))


def merged_ids(stored: Column, new: Column) -> Column:
    """Two arrays of ids as one, each id once, the stored ones first."""
    empty = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.coalesce(stored, empty), F.coalesce(new, empty)))


def ids_of_json(x: Column) -> Column:
    """The ids of a JSON list; anything else is an empty list."""
    return F.coalesce(F.from_json(x, "array<bigint>"), F.array().cast("array<bigint>"))


def snapshot(values: Column) -> Column:
    """A map as JSON; an empty one is an empty list."""
    return F.when(F.size(values) > 0, F.to_json(values)).otherwise(F.lit("[]"))


def of_snapshot(x: Column) -> Column:
    """The map of a snapshot; an empty map for an empty list or anything else."""
    own = F.when(F.startswith(F.ltrim(F.coalesce(x, F.lit(""))), F.lit("{")), x)
    return F.coalesce(F.from_json(own, "map<string,string>"), F.create_map().cast("map<string,string>"))
