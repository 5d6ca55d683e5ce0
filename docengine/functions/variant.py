"""Typed reads of JSON held as VARIANT, as expressions; where a type does not fit they give a neutral value.

``Json`` wraps a column: ``Json.parse(F.col("doc"))["a"][0].int64()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.operators.jsonschema import fields_of, items_of, kind


def lenient(text: Column) -> Column:
    """JSON with comments (``//`` and ``/* */``) and raw tabs in strings as strict JSON; other faults stay faults."""
    # possessive: Java matches other repeated groups by recursion
    string, comment = r'"(?:[^"\\]++|\\.)*+"', r"//[^\n]*|/\*(?s:.*?)\*/"
    bare = F.regexp_replace(text, f"({string})|{comment}", "$1 ")
    parts = F.regexp_extract_all(bare, F.lit(f'{string}|[^"]+|"'), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(p, F.lit("\t"), F.lit("\\t"))).otherwise(p)), "")


class Json:
    """A JSON value in a VARIANT column, null where there is none."""

    def __init__(self, value: Column):
        self.value = value

    @classmethod
    def parse(cls, text: Column, comments: bool = False) -> Json:
        """The value of a text; none where it is no JSON."""
        return cls(F.try_parse_json(lenient(text) if comments else text))

    def __getitem__(self, key: str | int) -> Json:
        if isinstance(key, int):
            return Json(F.get(items_of(self.value), F.lit(key)))
        return Json(F.try_variant_get(self.value, "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant"))

    def has(self, key: str) -> Column:
        return F.coalesce(F.array_contains(F.map_keys(fields_of(self.value)), key), F.lit(False))

    def type(self) -> Column:
        """null, boolean, int, double, string, array or object; an absent value is null."""
        t = F.schema_of_variant(self.value)
        number = F.when(t.rlike(r"\A(TINYINT|SMALLINT|INT|BIGINT)"), "int").when(t.rlike(r"\A(DECIMAL|DOUBLE|FLOAT)"), "double")
        return F.coalesce(number, kind(self.value), F.lit("null"))

    def is_type(self, name: str) -> Column:
        return self.type() == name

    def int64(self) -> Column:
        number = F.when(kind(self.value).isin("integer", "number"), F.try_variant_get(self.value, "$", "double"))
        cut = F.when(F.abs(number) < 2.0**63, number.cast("long"))
        return F.coalesce(F.when(self.type() == "int", F.try_variant_get(self.value, "$", "long")), cut, F.try_variant_get(self.value, "$", "boolean").cast("long"), F.lit(0))

    def double(self) -> Column:
        return F.coalesce(F.when(kind(self.value).isin("integer", "number"), F.try_variant_get(self.value, "$", "double")), F.lit(0.0))

    def boolean(self) -> Column:
        """True for true and for numbers but zero."""
        return F.coalesce(F.when(kind(self.value) == "boolean", F.try_variant_get(self.value, "$", "boolean")), self.double() != 0)

    def string(self) -> Column:
        """A string as it is, anything else as JSON text, an absent value as an empty text."""
        return F.coalesce(F.when(kind(self.value) == "string", F.try_variant_get(self.value, "$", "string")), F.to_json(self.value), F.lit(""))

    def length(self) -> Column:
        """Items of an array or members of an object, else 0."""
        return F.coalesce(F.size(items_of(self.value)), F.size(fields_of(self.value)), F.lit(0))
