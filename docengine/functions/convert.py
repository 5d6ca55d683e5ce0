"""Conversions of whole columns between formats, and their names in Spark SQL.

Each is an Arrow UDF: batches of texts or bytes in, a column out; null, or what cannot be
read, gives null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import cbor, emit, marshal
from docengine.functions import tree as tr
from docengine.functions import yamlparse as Y
from docengine.functions.shapes import KEPT, SHORT, Shapes, filled, text_of
from docengine.functions.validate import compile_schema, output_unit, validate_tree

FAULTS = (Y.YamlError, tr.JsonError, cbor.CborError, marshal.MarshalError)


class Kept:
    """What a task keeps of short cells that may come again, up to ``KEPT`` of them."""

    def __init__(self):
        self.cells: dict = {}

    def __getstate__(self):
        return {"cells": {}}


def column_function(one, result, shaped=False):
    """An Arrow UDF of a function of one cell; with ``shaped``, the digits of integers that are values come back as they are (``shapes``)."""

    def tried(value):
        try:
            return one(value)
        except FAULTS:
            return None

    shapes, kept = Shapes(text_of(tried)) if shaped else None, Kept()

    def run(cells: pa.Array) -> pa.Array:
        out, known = [], kept.cells
        for value in cells.to_pylist():
            if value is None:
                out.append(None)
            elif shaped and isinstance(value, str) and (found := shapes.find(value)) is not None:
                out.append(filled(*found))
            elif value in known:
                out.append(known[value])
            else:
                made = tried(value)
                if len(value) <= SHORT and len(known) < KEPT and (made is None or made is True or made is False or len(made) <= 4 * SHORT):
                    known[value] = made
                out.append(made)
        return pa.array(out, {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[result])

    # a type, not its name: workers import this module, and names are parsed by a session
    return F.arrow_udf(run, {"string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}[result])


def first(value, family="core") -> tr.Node:
    roots = tr.load_yaml(value, family)
    if not roots:
        raise Y.YamlError("there is no document")
    return roots[0]


yaml_to_json = column_function(lambda v: emit.json_compact(first(v)), "string", shaped=True)
yaml_to_json_spaced = column_function(lambda v: emit.json_spaced(first(v)), "string", shaped=True)
yaml_to_json_pretty = column_function(lambda v: emit.json_pretty(first(v)), "string", shaped=True)
yaml_canonical = column_function(lambda v: emit.yaml_text(tr.load_yaml(v), canonical_form=True), "string", shaped=True)
yaml_serialize = column_function(lambda v: emit.yaml_text(tr.load_yaml(v)), "string", shaped=True)
yaml_value_key = column_function(lambda v: tr.canonical(first(v)), "string")
yaml_to_cbor = column_function(lambda v: cbor.encode(first(v)), "binary")
yaml_to_cbor_canonical = column_function(lambda v: cbor.encode(first(v), True), "binary")
yaml_to_cbor_sequence = column_function(lambda v: cbor.encode_sequence(tr.load_yaml(v)), "binary")
yaml_to_marshal = column_function(lambda v: marshal.dump(first(v)), "binary")
json_compact = column_function(lambda v: emit.json_compact(tr.strict_json(v)), "string")
cbor_to_json = column_function(lambda v: tr.to_json(cbor.decode(bytes(v))), "string")
cbor_sequence_to_json = column_function(lambda v: "[" + ",".join(map(tr.to_json, cbor.decode_sequence(bytes(v)))) + "]", "string")
cbor_to_yaml = column_function(lambda v: emit.yaml_text([cbor.decode(bytes(v))]), "string")
marshal_to_json = column_function(lambda v: tr.to_json(marshal.load(bytes(v))), "string")
marshal_to_cbor = column_function(lambda v: cbor.encode(marshal.load(bytes(v))), "binary")
bytes_to_text = column_function(lambda v: tr.to_text(bytes(v)), "string")


def strict(value) -> bool:
    try:
        tr.strict_json(value)
        return True
    except tr.JsonError:
        return False


is_strict_json = column_function(strict, "boolean")


def yaml_options(indent: int = 2, width: int = 80, explicit_start: bool = False, canonical: bool = False):
    """Serialisation with options."""
    return column_function(lambda v: emit.yaml_text(tr.load_yaml(v), canonical, explicit_start, indent, width), "string")


def schema_output(schema):
    """The basic output of a JSON Schema for each text of a column; the schema is compiled once, here."""
    compiled = compile_schema(schema)
    return column_function(lambda v: output_unit(validate_tree(compiled, tr.load_yaml(v))), "string")


NAMES = (
    "yaml_to_json yaml_to_json_spaced yaml_to_json_pretty yaml_canonical yaml_serialize yaml_value_key yaml_to_cbor yaml_to_cbor_canonical "
    "yaml_to_cbor_sequence yaml_to_marshal json_compact cbor_to_json cbor_sequence_to_json cbor_to_yaml marshal_to_json marshal_to_cbor "
    "bytes_to_text is_strict_json"
).split()


def register(spark: SparkSession) -> list[str]:
    """Makes the conversions and table functions known to Spark SQL; returns their names."""
    for name in NAMES:
        spark.udf.register(name, globals()[name])
    from pyspark.sql.functions import udtf

    from docengine.operators import tables

    def table_function(rows, schema):
        class Rows:
            def eval(self, value):
                if value is not None:
                    for row in rows(value):
                        yield row if isinstance(row, tuple) else tuple(row.get(n) for n in names)

        names = T.StructType.fromDDL(schema).names
        return udtf(Rows, returnType=schema)

    spark.udtf.register("yaml_nodes", table_function(tables.rows_of_roots(tr.node_tuples, "yaml", "core", "PERMISSIVE"), tables.NODES))
    spark.udtf.register("yaml_values", table_function(tables.rows_of_roots(tr.value_tuples, "yaml", "core", "PERMISSIVE", True), tables.VALUES))

    def documents(value):
        for i, status, line, col, message, text, _ in tr.tolerant(value):
            yield {"doc_index": i, "status": status, "err_line": line, "err_col": col, "err_msg": message, "text": text}

    spark.udtf.register("yaml_documents", table_function(documents, tables.DOCUMENTS))
    return [*NAMES, "yaml_nodes", "yaml_values", "yaml_documents"]
