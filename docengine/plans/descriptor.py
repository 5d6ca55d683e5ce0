"""Column descriptors: ragged typed columns out of a document, an array for each column.

A descriptor is a tree of ``Field``: a scalar fills a column, a sequence applies its child to
every item, a mapping applies children by key, ``raw`` keeps the text of what it meets. Two
keys may fill one column. Repeated keys all count unless ``first_wins``. If a document's
shape disagrees with the descriptor the walk stops there and keeps what it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docengine.functions import resolve as R
from docengine.functions import tree as tr
from docengine.functions import yamlparse as Y
from docengine.operators.tables import decoded, expand

SQL_TYPES = {"str": "string", "int": "long", "float": "double", "bool": "boolean", "null": "int", "any": "string"}


@dataclass
class Field:
    kind: str  # scalar, seq, map or raw
    column: str | None = None
    type: str = "str"
    children: dict = field(default_factory=dict)  # of a mapping by key; of a sequence under ""
    required: bool = False
    first_wins: bool = False

    def columns(self) -> dict[str, str]:
        own = {self.column: "string" if self.kind == "raw" else SQL_TYPES[self.type]} if self.column else {}
        for child in self.children.values():
            own |= child.columns()
        return own


class Stop(Exception):
    def __init__(self, status: int):
        self.status = status


def convert(node: tr.Node, type_: str):
    """The value of a scalar for a column; raises Stop for text that is no number."""
    text = node.text
    if type_ == "int":
        value = R.to_int(text)
        if value is None:
            number = R.to_float(text)
            if number is None or number != number or abs(number) >= 2**63:
                raise Stop(Y.PARSE)
            value = int(number)
        return value
    if type_ == "float":
        value = R.to_float(text)
        if value is None:
            raise Stop(Y.PARSE)
        return value
    if type_ == "bool":
        # by the first letter only, so that on and off are both true
        return text[:1] in set("tTyYo1")
    if type_ == "null":
        return 1
    return text


def fill(plan: Field, node: tr.Node, out: dict) -> None:
    node = node.real()
    if plan.kind == "raw":
        out[plan.column].append(node.text if node.kind == tr.SCALAR else tr.to_json(node))
    elif plan.kind == "scalar":
        if node.kind != tr.SCALAR:
            raise Stop(Y.OK)
        out[plan.column].append(convert(node, plan.type))
    elif plan.kind == "seq":
        if node.kind != tr.SEQUENCE:
            raise Stop(Y.OK)
        for item in node.items:
            fill(plan.children[""], item, out)
    else:
        if node.kind != tr.MAPPING:
            raise Stop(Y.OK)
        done = set()
        for k, v in node.pairs():
            name = k.real().text
            child = plan.children.get(name)
            if child is None or (child.first_wins and name in done):
                continue
            done.add(name)
            fill(child, v, out)


def load(root: tr.Node, plan: Field) -> tuple[int, dict]:
    """(status, columns) of a tree."""
    out: dict = {c: [] for c in plan.columns()}
    status = Y.OK
    try:
        fill(plan, root, out)
    except Stop as stop:
        status = stop.status

    def missing(p: Field) -> bool:
        return bool(p.required and p.column and not out[p.column]) or any(map(missing, p.children.values()))

    return (Y.SCHEMA if status == Y.OK and missing(plan) else status), out


def materialize(df: DataFrame, column: str, plan: Field, keep: list[str] | None = None, form: str = "yaml", family: str = "core") -> DataFrame:
    """One row for each document: status and an array for each column."""
    family = family if family == "compat" else "core"

    def make(value):
        for index, status, _, _, _, _, root in decoded(value, form, family, "PERMISSIVE"):
            if root is None:
                yield {"doc_index": index, "status": status}
            else:
                state, out = load(root, plan)
                yield {"doc_index": index, "status": state, **out}

    columns = ", ".join(f"`{n}` array<{t}>" for n, t in plan.columns().items())
    return expand(df, column, make, f"doc_index int, status int, {columns}", keep)
