"""Typed access to JSON metadata (VARIANT), timestamps and identifiers.

Casts from VARIANT are lenient ("5" becomes 5.0), so every typed reading is
guarded by the kind that the value really has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = "^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$"
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
FIELD_TYPES = ("string", "int", "float", "bool", "datetime", "uuid")


def path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def kind(md: Column, key: str) -> Column:
    """string, number, int, bool, null, array, object, or SQL NULL where the key is missing."""
    s = F.schema_of_variant(F.try_variant_get(md, path(key), "variant"))
    return (
        F.when(s.isNull(), F.lit(None))
        .when(s == "VOID", "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "bool")
        .when(s == "BIGINT", "int")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def number(md: Column, key: str) -> Column:
    return F.when(kind(md, key).isin("int", "number"), F.try_variant_get(md, path(key), "double"))


def string(md: Column, key: str) -> Column:
    return F.when(kind(md, key) == "string", F.try_variant_get(md, path(key), "string"))


def boolean(md: Column, key: str) -> Column:
    return F.when(kind(md, key) == "bool", F.try_variant_get(md, path(key), "boolean"))


def equals(md: Column, key: str, value: object) -> Column:
    """JSON equality, numbers by value; false where the key is missing."""
    if value is None:
        test = kind(md, key) == "null"
    elif isinstance(value, bool):
        test = boolean(md, key) == F.lit(value)
    elif isinstance(value, (int, float)):
        test = number(md, key) == F.lit(float(value))
    else:
        test = string(md, key) == F.lit(str(value))
    return F.coalesce(test, F.lit(False))


def facet(md: Column, key: str) -> Column:
    """A value as facet text: strings as they are, anything else as JSON, null as 'null', missing as NULL."""
    k = kind(md, key)
    return F.when(k == "string", string(md, key)).when(k == "null", "null").when(k.isNotNull(), F.to_json(F.try_variant_get(md, path(key), "variant")))


def epoch_ms(text: Column) -> Column:
    """Milliseconds of an RFC 3339 timestamp; NULL for anything else, also for dates that don't exist."""
    iso = F.regexp_replace(F.upper(text), "^(.{10})[T ]", "$1T")
    return F.when(text.rlike(_RFC3339), F.unix_millis(F.try_to_timestamp(iso)))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(_UUID), F.lit(False))


def matches_type(md: Column, key: str, name: str) -> Column:
    """Whether a present value has the declared type; missing values do."""
    k = kind(md, key)
    tests = {
        "string": k == "string",
        "int": (k == "int") | ((k == "number") & (F.floor(number(md, key)) == number(md, key))),
        "float": k.isin("int", "number"),
        "bool": k == "bool",
        "datetime": (k == "string") & epoch_ms(string(md, key)).isNotNull(),
        "uuid": (k == "string") & is_uuid(string(md, key)),
    }
    return k.isNull() | F.coalesce(tests[name], F.lit(False))


def shape_key(json: Column) -> Column:
    """Sorted ``field:type`` list of a JSON object's top level; types are JSON's own."""
    fields = F.map_entries(F.from_json(json, "map<string,variant>"))
    return F.array_join(F.array_sort(F.transform(fields, lambda e: F.concat(e["key"], F.lit(":"), json_kind(F.schema_of_variant(e["value"]))))), ",")


def json_kind(s: Column) -> Column:
    """The JSON type of a value whose variant schema is ``s``."""
    return (
        F.when(s.isNull() | (s == "VOID"), "null")
        .when(s == "BOOLEAN", "bool")
        .when(s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("string")
    )
