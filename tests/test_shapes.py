"""Documents of one shape are made at once, and are what the reader makes of each."""

import pytest
from pyspark.sql import functions as F

from docengine.functions import convert, shapes
from docengine.functions import tree as tr
from docengine.functions.validate import Report, check_family
from docengine.operators import navigate as nav
from docengine.operators import tables
from docengine.plans import plan

ODD = [
    "a: 0\n", "a: 00\n", "a: 0", "a: 9\na: 10\n", "- 1\n- 22\n", "- a - 5\n", "a: x - 7\n", "a: [1, 2]\nb: 3\n", "a: 'x: 5'\nb: 5\n", "a: |\n  b: 5\n", "a: b: 5\n", "a: 123456789012345678\n",
    "a: 1234567890123456789\n", "a: -5\n", "? 5\n: 6\n", "5: 6\n", "a: \"q\n  x: 5\"\n", "a: &x 5\nb: *x\n", "# c: 5\n", "", "a: {b: 1}\nc: 1\n", "a:\n  b: 7\n  c: [x]\nd: 8\n", "a: 5\x00\n", "a\x00b: 5\n", "--- 5\n--- 6\n",
]


def texts():
    digits = str.maketrans("0123456789", "7345678912")
    return [x for t in ODD for x in (t, t.translate(digits), t.replace("5", "8"), t)] * 2


def test_rows_of_shapes_equal_rows_of_each(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    for family in ("core", "compat", "json", "full"):
        for form, make in ((tables.nodes, tr.node_tuples), (tables.values, tr.value_tuples)):
            expected = [(k, *r) for k, t in rows for r in tables.rows_of_roots(make, "yaml", family, "PERMISSIVE", make is tr.value_tuples)(t)]
            found = [tuple(r) for r in form(df, "t", family=family).collect()]
            assert sorted(map(repr, found)) == sorted(map(repr, map(tuple, expected))), (family, form)
    some = tables.nodes(df, "t", only=["text", "i"]).where("i is not null")
    assert some.columns == ["k", "text", "i"] and some.where("cast(text as long) <> i").isEmpty()


def test_events_and_plans_of_shapes(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    spec = plan.compile_plan({"kind": "seq", "children": [{"name": "a", "kind": "int"}, {"name": "s", "kind": "str"}, {"name": "f", "kind": "float"}]})
    nested = spark.createDataFrame([(k, f"- a: {k}\n  s: {k * 7}\n  f: {k}\n  a: {k + 1}\n") for k in range(50)], "k long, t string")
    assert sorted(map(tuple, plan.extract(nested, "t", spec, form="yaml").collect())) == [(k, k + 1, str(k * 7), float(k)) for k in range(50)]
    together, alone = tables.events(df, "t").collect(), []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shapes.Shapes, "find", lambda self, text: None)
        alone = [r for k, t in rows for r in tables_events(t, k)]
    assert sorted(map(repr, map(tuple, together))) == sorted(map(repr, alone))


def tables_events(text, k):
    """The events of one text by the parser alone."""
    from docengine.functions import resolve as R
    from docengine.functions import yamlparse as Y

    try:
        parser = Y.Parser(tr.normal_breaks(tr.to_text(text)))
    except Y.YamlError:
        return
    try:
        parser.parse()
    except Y.YamlError:
        pass
    doc = -1
    for seq, e in enumerate(parser.events):
        doc += e.type == "doc+"
        kind = tables.NODE_KINDS.get(e.type)
        tag = tr.type_of(tr.Node(kind, e.value or "", style=e.style, tag=e.tag), "core") if kind else None
        yield (k, max(doc, 0), seq, e.type, e.style, e.flow, e.explicit, e.tag is None, tag, e.value, e.anchor, e.tag, e.line, e.col, e.end_line, e.end_col)


def test_text_of_shapes_equals_text_of_each(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").coalesce(1)
    for name, one in (("yaml_to_json", lambda v: convert.emit.json_compact(convert.first(v))), ("yaml_serialize", lambda v: convert.emit.yaml_text(tr.load_yaml(v))), ("yaml_canonical", lambda v: convert.emit.yaml_text(tr.load_yaml(v), canonical_form=True))):

        def tried(v, one=one):
            try:
                return one(v)
            except convert.FAULTS:
                return None

        assert [r[0] for r in df.select(getattr(convert, name)(F.col("t"))).collect()] == [tried(t) for t in texts()], name


def test_a_shape_is_built_once():
    """Before, every document was read."""
    reads = []

    def one(text):
        reads.append(text)
        return text.upper()

    found = shapes.Shapes(shapes.text_of(one))
    made = [found.find(f"a: {100 + k}\nb: {200 + k}\n") for k in range(500)]
    assert made[0] is None and [shapes.filled(*m) for m in made[1:]] == [f"A: {100 + k}\nB: {200 + k}\n" for k in range(1, 500)]
    assert len(reads) == 4  # the shape with ones, with twos in each place, and the text itself
    # a text that depends on more than the digits has no shape
    found = shapes.Shapes(shapes.text_of(lambda t: str(1 + sum(map(int, shapes.INTEGER.findall(t))))))
    assert [found.find(f"a: {k}\n") for k in range(10)] == [None] * 10


def test_nodes_near_a_question_are_those_of_the_whole_tree(spark):
    rows = [(k, t) for k, t in enumerate(texts() + ["a: {b: 1, x/y: 2}\nab: 3\nb: {a: [a, {b: ~}]}\n--- {b: 4}\n"])]
    df = spark.createDataFrame(rows, "k long, t string")
    whole = tables.nodes(df, "t")
    for paths, keys in ((["/a"], None), (None, ["b"]), (["/a", "/b/a/1"], ["ab"]), ([""], []), ([], [])):
        wanted = F.col("role") == "root"
        for p in paths or []:
            wanted |= nav.is_in(p)
        wanted |= F.coalesce(F.col("key").isin(keys or []), F.lit(False))
        found = tables.nodes(df, "t", paths=paths, keys=keys)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.where(wanted).collect())), (paths, keys)


def test_family_diagnostics_of_shapes_equal_those_of_each(spark, monkeypatch):
    odd = ["a: 1\nb: 2\na: 3\n", "? - 1\n: a\n? - 2\n: b\n", "? - 3\n: a\n? - 3\n: b\n", "a: &x 5\n*x : 1\n5: 2\n", "a: &x 6\n*x : 1\n5: 2\n", "1: 1\n1: 2\n1.0: 3\n", "- a: 1\n  a: 2\n- {b: 1, b: 1}\n", "a: !!int 5\na: !!str 5\n", "a: !!int x\nb: 5\n"]
    digits = str.maketrans("0123456789", "7345678912")
    rows = [(k, t) for k, t in enumerate((odd + [t.translate(digits) for t in odd] + texts()) * 3)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    for family in ("core", "json", "full"):
        expected = []
        for k, t in rows:
            roots, report = [root for *_, root in tables.decoded(t, "yaml", family, "PERMISSIVE") if root is not None], Report()
            for i, root in enumerate(roots):
                report.prefix = f"/{i}" if len(roots) > 1 else ""
                check_family(root, family, report)
            expected += [(k, seq, *r.values()) for seq, r in enumerate(report.rows)]
        found = tables.diagnostics(df, "t", family=family)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected)), family
        assert tables.diagnostics(df, "t", family=family, only=["name"]).columns == ["k", "name"]
    seen = []
    monkeypatch.setattr(tables, "expand", lambda *given: seen.append(given[5]))
    tables.diagnostics(df, "t")
    assert seen == [True]


def test_shapes_without_integers_in_their_rows_are_built_by_few_readings():
    from docengine.functions.shapes import Shapes, rows_of

    calls = []

    def make(value):
        calls.append(value)
        yield from ((len(line), line.split(":")[0]) for line in value.splitlines())

    found = Shapes(rows_of(make, ["int", "string"]))
    for k in range(1000, 1100):
        got = found.find("".join(f"k{i}: {k + i}\n" for i in range(12)))
    assert got[0][1] == {} and len(got[0][0]) == 12 and len(calls) == 3


def test_rows_of_one_row_group_are_dealt_at_any_size(spark, tmp_path):
    """Before, inputs of ``split`` bytes or more for each core stayed as they were read, and one task read a whole row group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 50_000
    pq.write_table(pa.table({"k": list(range(n)), "t": [f"text {i * 7919}" for i in range(n)]}), tmp_path / "one.parquet", row_group_size=n)
    df = spark.read.parquet(str(tmp_path / "one.parquet"))
    for columns in (["k", "t"], ["k"]):
        for split in (1 << 12, 1 << 14, 1 << 30):
            given = df.select(*columns)
            size = int(str(given._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            parts = tables.spread(given, 1, split).groupBy(F.spark_partition_id().alias("p")).count().collect()
            cores = spark.sparkContext.defaultParallelism
            assert len(parts) >= max(cores, size / split) and len(parts) % cores == 0
            assert sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) < 1.5 * n / len(parts) + cores
    assert sorted(tables.spread(df, 1, 1 << 14).collect()) == sorted(df.collect())
    # a small one stays where it is read
    assert "Exchange" not in tables.spread(df, 1 << 40)._jdf.queryExecution().executedPlan().toString()
