"""Accessors and a generator in the manner of two C libraries for JSON, as plain functions.

Accessors give a neutral value where the type does not fit; the generator is a state
machine that refuses what would make no JSON.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import resolve as R
from docengine.functions import tree as tr


def get_type(node: tr.Node | None) -> str:
    if node is None or node.tag_id == R.NULL:
        return "null"
    kinds = {R.INT: "int", R.FLOAT: "double", R.BOOL: "boolean", R.SEQ: "array", R.MAP: "object"}
    return kinds.get(node.tag_id, "array" if node.kind == tr.SEQUENCE else "object" if node.kind == tr.MAPPING else "string")


def get_int64(node: tr.Node | None) -> int:
    if node is None or node.kind != tr.SCALAR:
        return 0
    i, d, b = tr.typed(node)
    return i if i is not None else int(d) if d is not None and abs(d) < 2**63 else int(b) if b is not None else 0


def get_double(node: tr.Node | None) -> float:
    if node is None or node.kind != tr.SCALAR:
        return 0.0
    i, d, _ = tr.typed(node)
    return d if d is not None else float(i) if i is not None else 0.0


def get_boolean(node: tr.Node | None) -> bool:
    i, d, b = tr.typed(node) if node is not None else (None, None, None)
    return bool(b or i or d)


def get_string(node: tr.Node | None) -> str:
    return "" if node is None else node.text if node.kind == tr.SCALAR else tr.to_json(node)


def object_get(node: tr.Node | None, key: str) -> tr.Node | None:
    return node.get(key) if node is not None and node.kind == tr.MAPPING else None


def array_get(node: tr.Node | None, i: int) -> tr.Node | None:
    return node.items[i] if node is not None and node.kind == tr.SEQUENCE and 0 <= i < len(node.items) else None


def length(node: tr.Node | None) -> int:
    return 0 if node is None else len(node.items) // (2 if node.kind == tr.MAPPING else 1)


def variant_int64(value: Column, path: str) -> Column:
    """``get_int64`` on a VARIANT."""
    return F.coalesce(F.try_variant_get(value, path, "long"), F.lit(0))


def variant_double(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "double"), F.lit(0.0))


def variant_string(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


class GeneratorError(ValueError):
    pass


class Generator:
    """Builds JSON text by calls. Keys must be strings, containers must end, and one value is all."""

    def __init__(self, pretty: bool = False):
        self.stack: list[list] = []
        self.out: str | None = None
        self.pretty = pretty

    def value(self, text: str, is_string: bool = False) -> Generator:
        if self.out is not None:
            raise GeneratorError("the generator is done")
        if not self.stack:
            self.out = text
        else:
            kind, parts = self.stack[-1]
            if kind == "map" and len(parts) % 2 == 0 and not is_string:
                raise GeneratorError("a key must be a string")
            parts.append(text)
        return self

    def null(self):
        return self.value("null")

    def bool(self, b):
        return self.value("true" if b else "false")

    def integer(self, i):
        return self.value(str(int(i)))

    def double(self, d):
        if R.float_word(d):
            raise GeneratorError("JSON has no such number")
        return self.value(R.json_float(d))

    def number(self, text):
        return self.value(text)

    def string(self, text):
        return self.value(tr.quote(text), True)

    def open(self, kind: str):
        if self.out is not None or (self.stack and self.stack[-1][0] == "map" and len(self.stack[-1][1]) % 2 == 0):
            raise GeneratorError("a container may not stand here")
        self.stack.append([kind, []])
        return self

    def close(self):
        if not self.stack:
            raise GeneratorError("no container is open")
        kind, parts = self.stack.pop()
        if kind == "map":
            if len(parts) % 2:
                raise GeneratorError("a key without a value")
            return self.value("{" + ",".join(f"{k}:{v}" for k, v in zip(parts[::2], parts[1::2], strict=True)) + "}")
        return self.value("[" + ",".join(parts) + "]")

    def text(self) -> str:
        if self.out is None or self.stack:
            raise GeneratorError("the text is not complete")
        return self.out


def error_text(source: str, line: int, col: int, message: str) -> str:
    """A message with its line, that line whole, and a caret under the place."""
    rows = source.split("\n")
    row = rows[line - 1] if 0 < line <= len(rows) else ""
    return f"{message} at line {line}:\n{row}\n{' ' * max(0, col - 1)}^"


def parse_json_callbacks(text: str, comments: bool = False):
    """(callback, value) of a JSON text, in order."""
    root = tr.strict_json(tr.mask_comments(text) if comments else text)
    names = {"null": "null", "bool": "boolean", "int": "integer", "float": "double", "str": "string"}
    stack: list[str] = []
    for row in tr.value_rows(root):
        kind = row["kind"]
        if kind in ("seq_open", "map_open"):
            stack.append("end_array" if kind == "seq_open" else "end_map")
            yield ("start_array" if kind == "seq_open" else "start_map"), None
        elif kind == "close":
            yield stack.pop(), None
        elif row["is_key"]:
            yield "map_key", row["text"]
        elif kind in names:
            value = row["i"] if kind == "int" else row["d"] if kind == "float" else row["b"] if kind == "bool" else row["text"]
            yield names[kind], None if kind == "null" else value


def plain_number(text: str) -> bool:
    return bool(re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", text))
