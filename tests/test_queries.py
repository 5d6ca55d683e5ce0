"""Every query against its SQL, and tables, sources and streams end to end."""

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docengine import queries as reference
from docengine.functions import convert
from docengine.operators import navigate, tables
from docengine.sources import docs as source

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return str(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", list(reference.QUERIES))
def test_query(spark, sf, duck, name):
    df = reference.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert got
    result = duck.execute(reference.SQL[name])
    names, kinds = [d[0] for d in result.description], {d[0]: str(d[1]) for d in result.description}
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert all(KINDS.get(k, kinds[c]) == kinds[c] for c, k in df.dtypes)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_stays_on_expressions(spark, sf):
    """The JSON leg has no Python, reads one column and shuffles only to aggregate."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.concat(F.lit("["), "props", F.lit("]")).alias("doc"))
    from docengine.plans.plan import extract

    text = extract(ev, "doc", {"kind": "seq", "children": [{"name": "k", "kind": "int"}]}, form="json")._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "ReadSchema: struct<event_type:string,props:string>" in text and "Exchange" not in text


def test_source_reads_writes_and_streams(spark, tmp_path):
    source.register(spark)
    (tmp_path / "a.yaml").write_text("--- ok_one\n--- {{{{ bad\n--- ok_two\n")
    (tmp_path / "b.yaml").write_bytes("﻿k: é\n".encode("utf-16"))
    read = spark.read.format("docs").load(str(tmp_path))
    rows = [(os.path.basename(r["source"]), r["doc_index"], r["status"], r["json"]) for r in read.orderBy("source", "doc_index").collect()]
    assert rows == [("a.yaml", 0, 0, '"ok_one"'), ("a.yaml", 1, 1, None), ("a.yaml", 2, 0, '"ok_two"'), ("b.yaml", 0, 0, '{"k":"é"}')]
    assert source.read_documents(spark, str(tmp_path), mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="flow collection"):
        spark.read.format("docs").option("mode", "failfast").load(str(tmp_path)).collect()
    out = str(tmp_path / "out")
    for mode, want in (("append", 2), ("append", 4), ("overwrite", 2)):
        spark.createDataFrame([("a: 1",), ("b: 2",)], "t string").write.format("docs").mode(mode).option("form", "yaml").save(out)
        assert spark.read.format("docs").load(out).count() == want
    run = spark.readStream.format("docs").load(out).writeStream.format("memory").queryName("docs_stream").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("docs_stream").count() == 2


def test_tables_of_odd_cells(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a: [1, &x b, *x]"), (4, "\x01"), (5, "---\n---\n")], "k int, t string")
    states = {(r["k"], r["doc_index"]): r["status"] for r in tables.documents(df, "t").collect()}
    assert states == {(3, 0): 0, (4, 0): 1, (5, 0): 0, (5, 1): 0}
    assert tables.nodes(df, "t").where("k = 3").count() == 6 and tables.events(df.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        tables.nodes(df.withColumnRenamed("k", "path"), "t")
    empty = tables.nodes(df.where("k < 0"), "t")
    assert navigate.duplicate_keys(empty, ["k", "doc_index"]).count() == 0


def test_values_of_json_and_yaml_agree(spark):
    text = '{"a": [1, 2.5, true, null, "x", {"b": {}}], "c": "d"}'
    df = spark.createDataFrame([(text,)], "t string")
    key = lambda d: [tuple(r)[1:] for r in d.orderBy("seq").collect()]
    assert key(tables.values(df, "t", form="json")) == key(tables.values(df, "t"))


def test_sql_names(spark):
    convert.register(spark)
    row = spark.sql("SELECT yaml_to_json('a: [1, ~]') j, hex(yaml_to_cbor('a: 1')) c, marshal_to_json(yaml_to_marshal('- 1')) m, is_strict_json('{} x') s, yaml_to_json('[') f").first()
    assert tuple(row) == ('{"a":[1,null]}', "A1616101", "[1]", False, None)
    assert [r[0] for r in spark.sql("SELECT path FROM yaml_nodes('a: {b: 1}') WHERE role = 'value' ORDER BY node_id").collect()] == ["/a", "/a/b"]


def test_streams_of_files_and_writer_on_spark_files(spark, tmp_path):
    """New files in any order of names are read once; what is written comes back."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.yaml").write_text("a: 1\n---\nb: 2\n")
    source.register(spark)
    for kind, made in (("docs", lambda: spark.readStream.format("docs").load(str(folder))), ("files", lambda: source.stream_documents(spark, str(folder)))):
        run = lambda made=made, kind=kind: made().select("doc_index", "status").writeStream.format("parquet").option("path", str(tmp_path / kind)).option("checkpointLocation", str(tmp_path / f"{kind}-state")).trigger(availableNow=True).start().awaitTermination()
        run()
        early = folder / f"a-{kind}.yaml"
        early.write_text("c: 3\n")
        run()
        assert spark.read.parquet(str(tmp_path / kind)).count() == (3 if kind == "docs" else 4)
    out = str(tmp_path / "out")
    source.write_documents(spark.createDataFrame([("x: 1\n",), ("--- y\n",), (None,)], "t string"), "t", out)
    assert source.read_documents(spark, out).where("status = 0").count() == 2


def test_emission_of_nodes_agrees_with_the_trees(spark):
    """Every shape of document, with repeated and complex keys, as the plain emitter writes it."""
    from docengine.functions import tree as T
    from docengine.operators import emission, tables

    texts = [
        "{}", "[]", "x", "[[], {}, [{}]]", "a: {b: [1, {c: d}], e: {}}\nf: [[1, 2], [3]]\n", "a: [1]\na: [2]\n", "k: 1.50\nl: 1e30\nm: .inf\nn: 0x10\no: ~\np: 'q\"\\'\n",
        "- true\n- False\n- 99999999999999999999\n- \n", "a/b: {c~d: 1}\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "no int, doc string")
    out = {r["no"]: r["text"] for r in emission.text_of(tables.nodes(docs, "doc"), ["no", "doc_index"]).collect()}
    assert out == {i: T.to_json(T.load_yaml(t)[0]) for i, t in enumerate(texts)}


def test_changes_of_nodes(spark):
    from docengine.operators import emission, tables

    docs = spark.createDataFrame([(1, "a: {b: 1, c: [1, 2]}\nd: 3\n"), (2, "[]")], "no int, doc string")
    n = tables.nodes(docs, "doc")

    def after(*edits):
        frame = spark.createDataFrame(list(edits), "path string, op string, name string, json string")
        return {r["no"]: r["text"] for r in emission.text_of(emission.changed(n, frame, ["no", "doc_index"]), ["no", "doc_index"]).collect()}

    assert after(("/a", "set", None, "7"), ("/d", "del", None, None)) == {1: '{"a":7}', 2: "[]"}
    assert after(("/a/b", "del", None, None), ("/a/c", "add", None, '"x"'), ("/a", "add", "z", "{}")) == {1: '{"a":{"c":[1,2,"x"],"z":{}},"d":3}', 2: "[]"}
    assert after(("", "add", "n", "null")) == {1: '{"a":{"b":1,"c":[1,2]},"d":3,"n":null}', 2: "[null]"}
    assert after(("/a/c/0", "del", None, None), ("/a", "del", None, None)) == {1: '{"d":3}', 2: "[]"}


def test_keywords_agree_with_the_kernel(spark):
    """Expressions and the kernel on the same schemas and values."""
    import json

    from docengine.functions import tree as T
    from docengine.functions import validate as V
    from docengine.operators.jsonschema import SchemaError, is_valid, problems
    from pyspark.sql import functions as F

    values = [None, True, 0, 1, 1.5, 3, -2, 9 * 10**19, "", "ab", "abc", [], [1], [1, 1.0], [1, "a", None], {}, {"a": 1}, {"a": "x", "b": [1, {"c": 2}]}, {"b": 1, "a": 1}]
    schemas = [
        {"type": ["integer", "array"]}, {"enum": [1, {"a": 1}, "ab"]}, {"minimum": 1, "maximum": 3}, {"exclusiveMinimum": 0, "multipleOf": 1.5}, {"minLength": 1, "maxLength": 2}, {"pattern": "^a.?$"},
        {"items": {"type": "integer"}, "minItems": 1}, {"uniqueItems": True, "maxItems": 2}, {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, {"contains": {"type": "string"}},
        {"required": ["a"], "properties": {"a": {"type": "integer"}}}, {"additionalProperties": False, "properties": {"a": True}}, {"patternProperties": {"^b": {"type": "array"}}}, {"propertyNames": {"const": "a"}},
        {"minProperties": 1, "maxProperties": 1}, {"dependentRequired": {"b": ["a"]}}, {"anyOf": [{"type": "string"}, {"type": "integer"}]}, {"oneOf": [{"type": "number"}, {"minimum": 2}]},
        {"not": {"type": "object"}}, {"if": {"type": "string"}, "then": {"minLength": 3}, "else": {"not": {"const": 0}}}, {"$defs": {"x": {"type": "string"}}, "items": {"$ref": "#/$defs/x"}}, False,
    ]
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, doc string").withColumn("v", F.parse_json("doc"))
    made = [is_valid(F.col("v"), s).alias(f"s{i}") for i, s in enumerate(schemas)]
    for row in frame.select("k", *made).collect():
        for i, s in enumerate(schemas):
            found = V.validate_tree(V.compile_schema(s), [T.strict_json(json.dumps(values[row["k"]]))])
            assert row[f"s{i}"] == (not list(found)), (values[row["k"]], s)
    with pytest.raises(SchemaError):
        problems(F.col("v"), {"properties": {"a": {"$ref": "#"}}})


def test_long_strings_do_not_overflow_the_stack(spark):
    """Strings of many characters and escapes on the JSON legs, strict and lenient."""
    from docengine.plans.plan import extract, strict_json
    from pyspark.sql import functions as F

    spec = {"kind": "seq", "children": [{"name": "t", "kind": "str"}]}
    body = F.concat(F.lit('[{"t":"'), F.repeat(F.lit('a \\" '), 50_000), F.lit('"}]'))
    docs = spark.range(2).select("id", body.alias("doc"))
    assert docs.where(strict_json(F.col("doc"))).count() == 2
    for form in ("auto", "lenient"):
        assert [r[0] for r in extract(docs, "doc", spec, form=form).select(F.length("t")).collect()] == [200_000] * 2


def test_few_changes_and_joins_agree(spark, monkeypatch):
    """Edits as one expression and as joins; text of nodes needs no window, and repeated keys are found once nodes are written."""
    from docengine.operators import emission, tables

    docs = spark.createDataFrame([(1, "a: {b: 1, c: [1, 2]}\nd: 3\n"), (2, "[x, {}]")], "no int, doc string")
    edits = spark.createDataFrame([("/a/b", "set", None, "[7]"), ("/d", "del", None, None), ("/a/c", "add", None, '"n"'), ("", "add", "z", "{}")], "path string, op string, name string, json string")
    n, doc = tables.nodes(docs, "doc"), ["no", "doc_index"]
    made = lambda: {r["no"]: r["text"] for r in emission.text_of(emission.changed(n, edits, doc), doc).collect()}
    few = made()
    monkeypatch.setattr(emission, "FEW", 0)
    assert few == made() == {1: '{"a":{"b":[7],"c":[1,2,"n"]},"z":{}}', 2: '["x",{},{}]'}
    assert "Window" not in emission.text_of(n, doc)._jdf.queryExecution().toString()
    same = spark.createDataFrame([(1, "1: a\n1.0: b\n99999999999999999999: c\n99999999999999999999.0: d\n? [1]\n: e\n? [1.0]\n: f\n")], "no int, doc string")
    assert navigate.duplicate_keys(tables.nodes(same, "doc"), doc).count() == 3


def size_estimated(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_rows_of_json_are_not_taken_for_small(spark):
    """Spark's estimate of extracted rows follows that of their texts, so that a join does not broadcast many rows for a few."""
    from docengine.plans.plan import extract

    docs = spark.range(100_000).select(F.concat(F.lit('{"r":[{"a":'), "id", F.lit(',"b":"x"},7,null,{}]}')).alias("doc"))
    spec = {"kind": "seq", "path": "r", "children": [{"name": "a", "kind": "int"}, {"name": "b", "kind": "str"}]}
    rows = extract(docs, "doc", spec, form="json")
    assert size_estimated(rows) >= size_estimated(docs) / 2
    assert sorted(map(tuple, rows.where("a < 2 or a is null").groupBy("a", "b").count().collect()), key=str) == [(0, "x", 1), (1, "x", 1), (None, None, 100_000)]


def test_cube_broadcasts_nations_alone(spark, sf):
    """Orders and customers grow with the input and are shuffled."""
    plan = reference.QUERIES["cube_of_extracted"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cust#" in plan and plan.count("BroadcastExchange") == 1 and plan.index("FileScan parquet [n_nationkey") > plan.index("BroadcastExchange")
