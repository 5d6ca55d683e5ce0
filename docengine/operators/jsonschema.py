"""JSON Schema keywords as Column expressions over a VARIANT: no Python worker, no shuffle.

``problems(value, schema)`` walks the schema once, on the driver, and gives one expression:
an array of structs (path, keyword), one for each failed assertion, with the path of the
instance as a JSON pointer. Arrays and objects of any size are handled by ``transform`` and
``filter``, so the expression grows with the schema and not with the data. Schemas that
refer to themselves have no such expression; the kernel in ``functions.validate`` takes these,
and annotations (``unevaluated*``), formats and remote references.

A null value (no document) has no problems. Objects are read as VARIANT has them: of
repeated names one counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBLEM = "array<struct<path:string,keyword:string>>"
#: References followed one inside another.
MAX_REFS = 16


class SchemaError(ValueError):
    """A schema that has no expression."""


def kind(value: Column) -> Column:
    """The JSON type of a VARIANT: null, boolean, integer, number, string, array or object."""
    t = F.schema_of_variant(value)
    number = t.rlike(r"\A(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = F.try_variant_get(value, "$", "double")
    return (
        F.when(t == "VOID", "null")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .when(number & (t.rlike("INT") | (whole % 1 == 0)), "integer")
        .when(number, "number")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
    )


def items_of(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def fields_of(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def field(value: Column, name: str) -> Column:
    """A member of an object, null where there is none."""
    return F.try_variant_get(value, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def canonical(value: Column) -> Column:
    """A text that is equal for equal values: numbers by value, objects in any order."""
    number = F.try_variant_get(value, "$", "decimal(38,18)")
    text = F.coalesce(F.regexp_replace(number.cast("string"), r"\.?0+\z", ""), F.try_variant_get(value, "$", "double").cast("string"))
    return F.when(kind(value).isin("integer", "number"), F.concat(F.lit("n"), F.when(number == 0, "0").otherwise(text))).otherwise(F.concat(F.lit("v"), F.to_json(value)))


def literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _pointer(name: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def problems(value: Column, schema, path: Column | None = None) -> Column:
    """The failed assertions of ``schema`` (a dict, boolean or JSON text) on a VARIANT."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    return _Compiler(schema).of(value, schema, F.lit("") if path is None else path, 0)


def is_valid(value: Column, schema) -> Column:
    return F.size(problems(value, schema)) == 0


class _Compiler:
    def __init__(self, root):
        self.root = root

    def follow(self, ref: str):
        if not ref.startswith("#"):
            raise SchemaError(f"{ref}: only references into the schema itself have an expression")
        at = self.root
        for part in ref.removeprefix("#").split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            at = at[int(part)] if isinstance(at, list) else at[part]
        return at

    def of(self, v: Column, schema, path: Column, refs: int) -> Column:
        none = F.array().cast(PROBLEM)
        fail = lambda keyword, at=path: F.array(F.struct(at.alias("path"), F.lit(keyword).alias("keyword")))
        if schema is True:
            return none
        if schema is False:
            return F.when(v.isNotNull(), fail("false")).otherwise(none)
        if refs > MAX_REFS:
            raise SchemaError("a schema that refers to itself has no expression")
        sub = lambda x, s, at=path: self.of(x, s, at, refs)
        ok = lambda x, s: F.size(sub(x, s)) == 0
        t, out = kind(v), []

        def bad(keyword: str, condition: Column, at: Column = path) -> None:
            out.append(F.when(F.coalesce(condition, F.lit(False)), fail(keyword, at)).otherwise(none))

        def more(found: Column) -> None:
            out.append(F.coalesce(found, none))

        number = F.when(t.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        string = F.when(t == "string", F.try_variant_get(v, "$", "string"))
        items, fields = items_of(v), fields_of(v)
        names = F.map_keys(fields)
        has = lambda name: F.array_contains(names, name)
        for keyword, s in schema.items():
            if keyword == "type":
                wanted = s if isinstance(s, list) else [s]
                bad(keyword, ~t.isin(*wanted, *(["integer"] if "number" in wanted else [])))
            elif keyword in ("enum", "const"):
                bad(keyword, ~canonical(v).isin(*(canonical(literal(x)) for x in (s if keyword == "enum" else [s]))))
            elif keyword == "maximum":
                bad(keyword, number > s)
            elif keyword == "exclusiveMaximum":
                bad(keyword, number >= s)
            elif keyword == "minimum":
                bad(keyword, number < s)
            elif keyword == "exclusiveMinimum":
                bad(keyword, number <= s)
            elif keyword == "multipleOf":
                exact = F.try_variant_get(v, "$", "decimal(38,12)")
                bad(keyword, number.isNotNull() & (exact % F.lit(s).cast("decimal(24,12)") != 0))
            elif keyword == "maxLength":
                bad(keyword, F.length(string) > s)
            elif keyword == "minLength":
                bad(keyword, F.length(string) < s)
            elif keyword == "pattern":
                bad(keyword, ~string.rlike(s))
            elif keyword == "maxItems":
                bad(keyword, items.isNotNull() & (F.size(items) > s))
            elif keyword == "minItems":
                bad(keyword, items.isNotNull() & (F.size(items) < s))
            elif keyword == "uniqueItems" and s:
                bad(keyword, items.isNotNull() & (F.size(F.array_distinct(F.transform(items, canonical))) < F.size(items)))
            elif keyword == "prefixItems":
                for k, x in enumerate(s):
                    at = F.concat(path, F.lit(f"/{k}"))
                    more(F.when(items.isNotNull() & (F.size(items) > k), self.of(F.get(items, F.lit(k)), x, at, refs)))
            elif keyword == "items":
                skip = len(schema.get("prefixItems", []))
                each = F.transform(items, lambda x, i: F.when(i >= skip, self.of(x, s, F.concat(path, F.lit("/"), i.cast("string")), refs)).otherwise(none))  # noqa: B023
                more(F.flatten(each))
            elif keyword == "contains":
                hits = F.size(F.filter(items, lambda x: ok(x, s)))
                bad("contains", items.isNotNull() & (hits < schema.get("minContains", 1)))
                if "maxContains" in schema:
                    bad("maxContains", items.isNotNull() & (hits > schema["maxContains"]))
            elif keyword == "maxProperties":
                bad(keyword, fields.isNotNull() & (F.size(fields) > s))
            elif keyword == "minProperties":
                bad(keyword, fields.isNotNull() & (F.size(fields) < s))
            elif keyword == "required":
                for name in s:
                    bad(keyword, ~has(name), F.concat(path, _pointer(F.lit(name))))
            elif keyword == "properties":
                for name, x in s.items():
                    more(F.when(has(name), self.of(field(v, name), x, F.concat(path, _pointer(F.lit(name))), refs)))
            elif keyword in ("patternProperties", "additionalProperties", "propertyNames"):
                rows = F.map_entries(fields)
                at = lambda e: F.concat(path, _pointer(e["key"]))
                if keyword == "patternProperties":
                    for pattern, x in s.items():
                        chosen = F.filter(rows, lambda e: e["key"].rlike(pattern))
                        more(F.flatten(F.transform(chosen, lambda e: self.of(e["value"], x, at(e), refs))))  # noqa: B023
                elif keyword == "additionalProperties":
                    known, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

                    def other(e):
                        free = ~e["key"].isin(*known) if known else F.lit(True)  # noqa: B023
                        for pattern in patterns:  # noqa: B023
                            free = free & ~e["key"].rlike(pattern)
                        return free

                    if s is False:
                        more(F.transform(F.filter(rows, other), lambda e: F.struct(at(e).alias("path"), F.lit("additionalProperties").alias("keyword"))))  # noqa: B023
                    else:
                        more(F.flatten(F.transform(F.filter(rows, other), lambda e: self.of(e["value"], s, at(e), refs))))  # noqa: B023
                else:
                    name = lambda e: F.try_variant_get(F.parse_json(F.to_json(F.array(e["key"]))), "$[0]", "variant")
                    more(F.transform(F.filter(rows, lambda e: ~ok(name(e), s)), lambda e: F.struct(at(e).alias("path"), F.lit("propertyNames").alias("keyword"))))  # noqa: B023
            elif keyword == "dependentRequired":
                for name, needed in s.items():
                    for x in needed:
                        bad(keyword, has(name) & ~has(x), F.concat(path, _pointer(F.lit(x))))
            elif keyword == "dependentSchemas":
                for name, x in s.items():
                    more(F.when(has(name), sub(v, x)))
            elif keyword == "allOf":
                for x in s:
                    more(sub(v, x))
            elif keyword in ("anyOf", "oneOf"):
                hits = sum((ok(v, x).cast("int") for x in s), F.lit(0))
                bad(keyword, (hits == 0) if keyword == "anyOf" else (hits != 1))
            elif keyword == "not":
                bad(keyword, ok(v, s))
            elif keyword == "if":
                more(F.when(ok(v, s), sub(v, schema.get("then", True))).otherwise(sub(v, schema.get("else", True))))
            elif keyword == "$ref":
                more(self.of(v, self.follow(s), path, refs + 1))
            elif keyword.startswith("unevaluated") or keyword == "$dynamicRef":
                raise SchemaError(f"{keyword} has no expression")
        found = F.concat(*out) if out else none
        return F.when(v.isNotNull(), found).otherwise(none)
