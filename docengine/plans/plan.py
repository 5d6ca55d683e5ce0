"""Extraction plans: rows and typed columns out of documents by a small declarative spec.

Spec: ``{"kind": "seq"|"map", "path": "k" | ["a", "b"], "children": [{"name", "kind"}]}`` with
leaf kinds int, float, str, bool. The path leads to a container; its items, or the values
of a mapping, that are mappings are the rows. Missing, null, mistyped or container leaves
are null. int takes integers only, float any number, str any scalar (numbers verbatim),
bool only booleans. Of repeated keys the last that is not null counts.

Texts that are strict JSON without repeated keys stay on Spark expressions (VARIANT); all
others go through the YAML kernel. A document without the container has no rows; its
status is in ``statuses``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import resolve as R
from docengine.functions import tree as tr
from docengine.functions import yamlparse as Y
from docengine.operators.tables import decoded, expand

SQL_TYPES = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}


class PlanError(ValueError):
    """A faulty spec; status ARG."""

    status = Y.ARG


@dataclass(frozen=True)
class Plan:
    path: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {SQL_TYPES[k]}" for n, k in self.columns)


def compile_plan(spec: str | dict) -> Plan:
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise PlanError(str(e)) from None
    if not isinstance(spec, dict) or set(spec) - {"kind", "path", "children"} or spec.get("kind") not in ("seq", "map"):
        raise PlanError("a plan has kind (seq or map), path and children")
    path = spec.get("path", [])
    path = [path] if isinstance(path, str) else path
    if not isinstance(path, list) or not all(isinstance(p, str) and p for p in path):
        raise PlanError("a path is a key or a list of keys, none of them empty")
    leaves = spec.get("children")
    if not isinstance(leaves, list) or not leaves:
        raise PlanError("a plan has children")
    for leaf in leaves:
        if not isinstance(leaf, dict) or set(leaf) != {"name", "kind"} or not isinstance(leaf["name"], str) or leaf["kind"] not in SQL_TYPES:
            raise PlanError("a child has a name and a kind (int, float, str, bool)")
    return Plan(tuple(path), tuple((x["name"], x["kind"]) for x in leaves))


def strict_json(text: Column) -> Column:
    """Whether a text is one RFC 8259 value. Spark's own readers also take text after the value, raw control characters in strings, and lone surrogates."""
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    # possessive, since Java matches other repeated groups by recursion, and long strings would overflow the stack
    bare = F.regexp_replace(text, r'"(?:[^"\\\x00-\x1f]++|\\.)*+"', "")
    return F.coalesce(alone & ~bare.contains('"') & ~text.rlike(tr.JSON_TRAPS), F.lit(False))


def leaf_column(row: Column, name: str, kind: str) -> Column:
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    found = F.try_variant_get(row, path, "variant")
    type_ = F.schema_of_variant(found)
    number = type_.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "int":
        return F.when(type_ == "BIGINT", F.try_variant_get(row, path, "long"))
    if kind == "float":
        return F.when(number, F.try_variant_get(row, path, "double"))
    if kind == "bool":
        return F.when(type_ == "BOOLEAN", F.try_variant_get(row, path, "boolean"))
    return F.when(number | type_.isin("STRING", "BOOLEAN"), F.try_variant_get(row, path, "string"))


def json_rows(df: DataFrame, text: str, plan: Plan, keep: list[str]) -> DataFrame:
    """The JSON leg: a generator and a projection."""
    at = "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in plan.path)
    whole = F.try_variant_get(F.try_parse_json(F.col(text)), at, "variant")
    shape = F.schema_of_variant(whole)
    items = F.when(shape.startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
    if plan.path:
        items = items.when(shape.startswith("OBJECT"), F.map_values(F.try_variant_get(whole, "$", "map<string,variant>")))
    rows = F.filter(items, lambda row: F.schema_of_variant(row).startswith("OBJECT"))
    # leaves, not variants, leave the generator: Spark takes a variant for 2 KB, so dropping one would make its estimate of these rows far too small
    leaves = F.transform(rows, lambda row: F.struct(*(leaf_column(row, n, k).alias(f"_{i}") for i, (n, k) in enumerate(plan.columns))))
    return df.select(*(f"`{c}`" for c in keep), F.inline(leaves).alias(*(n for n, _ in plan.columns)))


def container(root: tr.Node, plan: Plan) -> tr.Node | None:
    node = root.real()
    for part in plan.path:
        node = node.get(part) if node.kind == tr.MAPPING else None
        if node is None:
            return None
        node = node.real()
    if node.kind == tr.SEQUENCE or (node.kind == tr.MAPPING and plan.path):
        return node
    return None


def leaf_value(node: tr.Node, kind: str):
    if node.kind != tr.SCALAR or node.tag_id == R.NULL:
        return None
    i, d, b = tr.typed(node)
    if kind == "str":
        return node.text
    if kind == "bool":
        return b
    if kind == "int":
        return i
    return d if d is not None else R.to_float(node.text) if node.tag_id == R.INT else None


def walk(root: tr.Node, plan: Plan) -> list[dict] | None:
    """The rows of a tree; None if it has no such container."""
    node = container(root, plan)
    if node is None:
        return None
    out = []
    for item in node.items if node.kind == tr.SEQUENCE else [v for _, v in node.pairs()]:
        item = item.real()
        if item.kind != tr.MAPPING:
            continue
        row = dict.fromkeys(n for n, _ in plan.columns)
        for k, v in item.pairs():
            for name, kind in plan.columns:
                if k.real().text == name and (value := leaf_value(v.real(), kind)) is not None:
                    row[name] = value
        out.append(row)
    return out


def kernel_rows(df: DataFrame, text: str, plan: Plan, keep: list[str], form: str = "yaml", family: str = "core") -> DataFrame:
    """The YAML leg; only the first document of a text is read."""

    def make(value):
        for index, _, _, _, _, _, root in decoded(value, form, family, "PERMISSIVE"):
            if index == 0 and root is not None:
                yield from walk(root, plan) or []
            return

    return expand(df, text, make, plan.ddl(), keep, form == "yaml")


def extract(df: DataFrame, text: str, spec: str | dict | Plan, keep: list[str] | None = None, form: str = "auto", family: str = "core") -> DataFrame:
    """Rows of all documents. ``form`` json or yaml takes one leg, auto either by the text; lenient is JSON with comments and raw tabs."""
    plan = spec if isinstance(spec, Plan) else compile_plan(spec)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if form == "lenient":
        from docengine.functions.variant import lenient

        df, form = df.withColumn(text, lenient(F.col(text))), "json"
    if form == "json":
        return json_rows(df, text, plan, keep)
    if form != "auto":
        return kernel_rows(df, text, plan, keep, form, family)
    plain = strict_json(F.col(text)) & F.try_parse_json(F.col(text)).isNotNull()
    return json_rows(df.where(plain), text, plan, keep).unionByName(kernel_rows(df.where(~plain), text, plan, keep, family=family))


def statuses(df: DataFrame, text: str, spec: str | dict | Plan, keep: list[str] | None = None, form: str = "yaml", family: str = "core") -> DataFrame:
    """(status, rows) of each text: OK, or PARSE if it has no such container or is faulty."""
    plan = spec if isinstance(spec, Plan) else compile_plan(spec)

    def make(value):
        for _, status, _, _, _, _, root in decoded(value, form, family, "PERMISSIVE"):
            rows = walk(root, plan) if root is not None else None
            yield {"status": status if rows is None and status else Y.PARSE if rows is None else Y.OK, "rows": 0 if rows is None else len(rows)}
            return
        yield {"status": Y.PARSE, "rows": 0}

    return expand(df, text, make, "status int, rows int", keep, form == "yaml")
