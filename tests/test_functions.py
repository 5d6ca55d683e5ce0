"""Parser, types, trees, formats and validation on written cases."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.functions import cbor, compat, emit, marshal, mutate
from docengine.functions import resolve as R
from docengine.functions import tree as T
from docengine.functions import validate as V
from docengine.functions import yamlparse as Y
from docengine.plans import descriptor as D
from docengine.plans import plan as P
from docengine.streaming import feed as S


def events(text):
    """The stream in one line, without its frame."""
    return " ".join(x.strip() for x in Y.tree(Y.parse(text)).split("\n")[1:-1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 1\nb:\n  - x\n  - y\n", "+DOC +MAP =VAL :a =VAL :1 =VAL :b +SEQ =VAL :x =VAL :y -SEQ -MAP -DOC"),
        ("a:\n- x\nb: y\n", "+DOC +MAP =VAL :a +SEQ =VAL :x -SEQ =VAL :b =VAL :y -MAP -DOC"),
        ("- - a\n  - b\n- c: d\n  e: f\n", "+DOC +SEQ +SEQ =VAL :a =VAL :b -SEQ +MAP =VAL :c =VAL :d =VAL :e =VAL :f -MAP -SEQ -DOC"),
        ("--- |\n a\n  b\n\n c\n...\n", "+DOC --- =VAL |a\\n b\\n\\nc\\n -DOC ..."),
        (">-\n a\n b\n\n c\n", "+DOC =VAL >a b\\nc -DOC"),
        ("? k\n: v\n? l\n", "+DOC +MAP =VAL :k =VAL :v =VAL :l =VAL : -MAP -DOC"),
        ("[a: b, {c: , d}, 'e':f]", "+DOC +SEQ [] +MAP {} =VAL :a =VAL :b -MAP +MAP {} =VAL :c =VAL : =VAL :d =VAL : -MAP +MAP {} =VAL 'e =VAL :f -MAP -SEQ -DOC"),
        ("&a k: &b !!str v\nl: *a\n", "+DOC +MAP =VAL &a :k =VAL &b <tag:yaml.org,2002:str> :v =VAL :l =ALI *a -MAP -DOC"),
        ("%TAG !e! tag:x,1:\n---\n!e!y z\n", "+DOC --- =VAL <tag:x,1:y> :z -DOC"),
        ("&m\nk: v\n", "+DOC +MAP &m =VAL :k =VAL :v -MAP -DOC"),
        ("a\nb\n\nc\n", "+DOC =VAL :a b\\nc -DOC"),
        ('"a\\n\\x41 \\\n  b"', '+DOC =VAL "a\\nA b -DOC'),
        ("'it''s\n  so'", "+DOC =VAL 'it's so -DOC"),
        ("a: # none\nb: x # y\n", "+DOC +MAP =VAL :a =VAL : =VAL :b =VAL :x -MAP -DOC"),
        ("--- a\n--- b\n", "+DOC --- =VAL :a -DOC +DOC --- =VAL :b -DOC"),
        ("", ""),
        ("# only\n", ""),
    ],
)
def test_events(text, want):
    assert events(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "a: b: c\n", "a: 'b': c\n", "key: - x\n", "[a, b\n", "[a,, b]", "{a: b} c\n", "a:\n\tb: c\n", "*x\n", "&a &b c\n", "!!str !!int c\n", "!x!y z\n", "a\nb: c\n",
        "%YAML 1.2\n", "%YAML 1.2\n%YAML 1.2\n---\n", '"\\q"', '"a', "|1 2\n", "- a\nb\n", "a: b\n  c: d\n", "@x", "a: &x *y\n", "[a\n]: b\nc: |x\n",
        "'a\n--- b'\n", "]", "k: ]\n", "a: \x01\n",
    ],
)
def test_faults(text):
    with pytest.raises(Y.YamlError) as e:
        Y.parse(text)
    assert e.value.status == Y.PARSE


def test_depth():
    assert T.load_yaml("[" * 900 + "]" * 900)
    with pytest.raises(Y.YamlError) as e:
        Y.parse("[" * 1100 + "]" * 1100)
    assert e.value.status == Y.DEPTH


def test_marks():
    parsed = {e.value: (e.line, e.col, e.end_line, e.end_col) for e in Y.parse("a: 1\nbb:\n  - ccc\n") if e.type == "val"}
    assert parsed == {"a": (1, 1, 1, 2), "1": (1, 4, 1, 5), "bb": (2, 1, 2, 3), "ccc": (3, 5, 3, 8)}


def spellings(seed=11):
    """(text, {family: tag}) drawn for each class of spelling that YAML 1.1, YAML 1.2's core schema and JSON tell apart."""
    rng = random.Random(seed)
    for _ in range(12):
        n, k = rng.randrange(1000, 10**6), rng.randrange(10, 60)
        sign = rng.choice("+-")
        yield str(n), {"core": R.INT, "full": R.INT, "compat": R.INT, "json": R.INT}
        yield f"-{n}", {"core": R.INT, "full": R.INT, "compat": R.INT, "json": R.INT}
        yield f"+{n}", {"core": R.INT, "full": R.INT, "compat": R.INT, "json": R.STR}
        yield f"0x{n:x}", {"core": R.INT, "full": R.INT, "compat": R.INT, "json": R.STR}
        yield f"0o{n:o}", {"core": R.INT, "full": R.INT, "json": R.STR}
        yield f"0{n:o}", {"core": R.INT, "full": R.INT, "compat": R.INT, "json": R.STR}
        yield f"0b{n:b}", {"core": R.STR, "full": R.STR, "compat": R.INT, "json": R.STR}
        yield f"{n:_}", {"core": R.STR, "full": R.STR, "compat": R.INT, "json": R.STR}
        yield f"{n}:{k}", {"core": R.STR, "full": R.STR, "compat": R.INT, "json": R.STR}
        yield f"{n}.{k}", {"core": R.FLOAT, "full": R.FLOAT, "compat": R.FLOAT, "json": R.FLOAT}
        yield f"{n}.", {"core": R.FLOAT, "full": R.FLOAT}
        yield f".{n}", {"core": R.FLOAT, "full": R.FLOAT, "compat": R.FLOAT, "json": R.STR}
        yield f"{n}e{sign}{k}", {"core": R.FLOAT, "full": R.FLOAT, "json": R.FLOAT}
        yield f"{sign}.{rng.choice(['inf', 'Inf', 'INF'])}", {"core": R.FLOAT, "full": R.FLOAT, "compat": R.FLOAT, "json": R.STR}
        yield f".{rng.choice(['nan', 'NaN', 'NAN'])}", {"core": R.FLOAT, "full": R.FLOAT, "compat": R.FLOAT, "json": R.STR}
        yield f"19{k}-{k % 12 + 1:02}-{k % 28 + 1:02}", {"core": R.STR, "full": R.TIMESTAMP, "compat": R.TIMESTAMP, "json": R.STR}
        yield "w" + "".join(rng.choice("aeiou") for _ in range(6)), dict.fromkeys(R.FAMILIES, R.STR)
    for word, kind in (("null", R.NULL), ("true", R.BOOL), ("false", R.BOOL)):
        yield word, dict.fromkeys(R.FAMILIES, kind)
        yield word.upper(), {"core": kind, "compat": kind, "json": R.STR}
    for word in ("yes", "no", "on", "off"):
        yield word, {"core": R.STR, "compat": R.BOOL, "json": R.STR}
    yield "<<", {"core": R.STR, "full": R.MERGE, "compat": R.MERGE, "json": R.STR}
    yield "=", {"core": R.STR, "full": R.VALUE, "compat": R.VALUE, "json": R.STR}


@pytest.mark.parametrize("family", ["core", "full", "compat", "json"])
def test_tags(family):
    for text, tags in spellings():
        if family in tags:
            assert R.resolve(text, family) == tags[family], text


def test_numbers():
    rng = random.Random(3)
    for _ in range(50):
        n, m = rng.randrange(1, 10**6), rng.randrange(60)
        for text in (str(n), hex(n), f"0o{n:o}", f"0{n:o}", bin(n), f"{n:_}", f"{n:,}", f"+{n}"):
            assert R.to_int(text) == n and R.to_int(("-" + text).replace("-+", "-")) == -n
        assert R.to_int(f"{n}:{m:02}") == n * 3600 + m * 60 and R.to_int(f"{n}:{m:02}:{m:02}") == n * 3600 + m * 61
        assert R.to_float(f"{n}:{m:02}.5") == n * 3600 + (m + 0.5) * 60 and R.to_float(f"{n}.{m:02}e2") == float(f"{n}.{m:02}e2")
    assert R.to_int(str(1 << 63)) is None and R.to_int(str(-(1 << 63))) == -(1 << 63) and R.to_int("0" + "9" * 3) is None
    assert math.isnan(R.to_float(".nan")) and R.to_float("-.INF") == -math.inf
    assert [R.json_float(x) for x in (3.0, 0.25, 1e30, 2.5e-9, 1234567.0)] == ["3.0", "0.25", "1.0e+30", "2.5e-09", "1234567.0"]


def test_columns_agree_with_functions(spark):
    from pyspark.sql import functions as F

    texts = sorted({text for text, _ in spellings()} | {"9223372036854775:30", "9223372036854775807:59:59", "~", "", "a\n", "1\n", "0x8000000000000000", "-0x8000000000000000", "99999999999999999999", "1,0", "2001-12-14 21:59:43.10 Z"})
    t = F.col("t")
    made = [R.resolve_column(t, f).alias(f) for f in R.FAMILIES] + [R.to_int_column(t).alias("i"), R.to_float_column(t).alias("d"), R.to_bool_column(t, True).alias("b"), R.to_timestamp_column(t).alias("at")]
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", *made).collect():
        assert [r[f] for f in R.FAMILIES] == [R.resolve(r["t"], f) for f in R.FAMILIES], r
        want = R.to_float(r["t"])
        assert r["i"] == R.to_int(r["t"]) and r["b"] == R.to_bool(r["t"], True) and (r["d"] == want or want != want), r
        assert (r["at"] is not None) == (R.resolve(r["t"], "compat") == R.TIMESTAMP)


plain = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats() | st.text(st.characters(exclude_categories=["Cs", "Cc"], exclude_characters="\ufeff\ufffe\uffff"), max_size=12),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc: #-'\"", max_size=4), x, max_size=4),
    max_leaves=12,
)


def same(a, b):
    return T.canonical(a) == T.canonical(b)


@settings(max_examples=300, deadline=None)
@given(plain)
def test_round_trips(value):
    node = T.build(value)
    text = emit.yaml_text([node])
    again = T.load_yaml(text)[0]
    assert same(node, again), text
    assert emit.yaml_text([again]) == text
    fixed = emit.yaml_text([node], canonical_form=True)
    assert emit.yaml_text(T.load_yaml(fixed), canonical_form=True) == fixed
    compact = emit.json_compact(node)
    assert same(T.strict_json(compact), T.load_yaml(compact)[0]) and emit.json_compact(T.strict_json(compact)) == compact
    assert json.loads(emit.json_pretty(node)) == json.loads(compact) == json.loads(emit.json_spaced(node))
    if not any(s in compact for s in ("e+", ".inf", ".nan")) and all(abs(x) < 2**63 for x in numbers(value)):
        assert same(cbor.decode(cbor.encode(node)), node) and same(marshal.load(marshal.dump(node)), node)


def numbers(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in numbers(v)]
    if isinstance(value, list):
        return [x for v in value for x in numbers(v)]
    return [value] if isinstance(value, int | float) and value == value and abs(value) != math.inf else []


@pytest.mark.parametrize("text", ["a: 1\nb: two\n", "- x\n- y\n", "k:\n  nested: v\n", "- a: 1\n  b: 2\n", "a:\n- 1\n- 2\n", "empty: {}\nlist: []\n", "a: [1, 2, 3]\n", "m: {x: 1, y: 2}\n", "t: |\n  one\n  two\n", "'q': \"d\"\n", "a: &x 1\nb: *x\n", "--- 1\n--- 2\n"])
def test_fidelity(text):
    assert emit.yaml_text(T.load_yaml(text)) == text


def test_emission_forms():
    one = lambda t: T.load_yaml(t)[0]
    canon = lambda t: emit.yaml_text([one(t)], canonical_form=True)
    assert canon("fish: carp\nweights:\n- 3\n- 'four'\n") == '---\n{"fish": "carp", "weights": [3, "four"]}\n'
    assert canon("on shore: False\nowner:\ndepth: 2.5E+3\nlimit: -.Inf\n") == '---\n{"on shore": false, "owner": ~, "depth": 2500.0, "limit": -.inf}\n'
    assert emit.yaml_text([one("pond: deep\n")], explicit_start=True) == "---\npond: deep\n"
    assert emit.yaml_text([one("carp\n")], explicit_start=True) == "--- carp\n"
    wide = emit.yaml_text([one("fish: [" + ", ".join(["7"] * 30) + "]\n")], width=30, indent=4)
    assert max(map(len, wide.split("\n"))) < 40 and "\n    7" in wide
    assert emit.json_pretty(one("pond: 5\nfish: [6]\nnets: {}\n")) == '{\n  "pond": 5,\n  "fish": [\n    6\n  ],\n  "nets": {}\n}\n'


#: Examples of RFC 8949, appendix A.
@pytest.mark.parametrize(("raw", "text"), [("00", "0"), ("1b7fffffffffffffff", "9223372036854775807"), ("3903e7", "-1000"), ("f93c00", "1.0"), ("f5", "true"), ("83010203", "[1,2,3]"), ("9f018202039f0405ffff", "[1,[2,3],[4,5]]"), ("bf6346756ef563416d7421ff", '{"Fun":true,"Amt":-2}'), ("7f657374726561646d696e67ff", '"streaming"'), ("a201020304", '{"1":2,"3":4}'), ("f7", '"undefined"'), ("f0", '"simple(16)"'), ("1bffffffffffffffff", "1.8446744073709552e+19")])
def test_cbor(raw, text):
    assert T.to_json(cbor.decode(bytes.fromhex(raw))) == text


@pytest.mark.parametrize("raw", ["", "18", "1c", "62c328", "f818", "ff", "a1", "9f", "0000", "a1810000", "5f01ff", "9bffffffffffffffff"])
def test_cbor_faults(raw):
    with pytest.raises(cbor.CborError):
        cbor.decode(bytes.fromhex(raw))


def test_cbor_forms():
    with pytest.raises(cbor.CborError):
        cbor.decode(bytes.fromhex("1800"), strict=True)
    assert cbor.encode(T.build({"bb": 1, "a": 2}), canonical=True).hex() == "a261610262626201"
    assert [len(cbor.float_bytes(x)) for x in (1.5, 100000.0, 1.1)] == [3, 5, 9]
    assert [T.to_json(n) for n in cbor.decode_sequence(bytes.fromhex("0102f6"))] == ["1", "2", "null"]


@pytest.mark.parametrize(("text", "fits"), [('{"a":1}', True), ("[]", True), ("3", True), ('"\\ud83d\\ude00"', True), ('"\\ud800"', False), ('{"a":1} x', False), ("[1,]", False), ("01", False), ("1.", False), ("NaN", False), ("'a'", False), ('"\t"', False), ("", False), ('{"a":1,"a":2}', True), ("[1", False), ("{1:2}", False), ('{"a" 1}', False), ("tru", False)])
def test_strict_json(spark, text, fits):
    from docengine.functions.convert import strict

    assert strict(text) is fits


def test_strict_json_column(spark):
    from pyspark.sql import functions as F

    cases = [('{"a":1}', True), ('{"a":1} x', False), ("[1,]", False), ('"\\ud800"', False), ('"\\ud83d\\ude00"', True), ("01", False), ('["\t"]', False), ("1,2", False), ("", False)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t, _ in cases], "t string").select("t", P.strict_json(F.col("t"))).collect()}
    assert got == dict(cases)


def test_plans():
    spec = {"kind": "seq", "path": ["d", "i"], "children": [{"name": "id", "kind": "int"}, {"name": "s", "kind": "str"}]}
    plan = P.compile_plan(json.dumps(spec))
    rows = P.walk(T.load_yaml("d: {i: [&x {id: 1, s: yes}, *x, 3, {id: x, s: ~}, {id: 1.5, id: 4, id: ~, s: [1]}]}")[0], plan)
    assert rows == [{"id": 1, "s": "yes"}, {"id": 1, "s": "yes"}, {"id": None, "s": None}, {"id": 4, "s": None}]
    assert P.walk(T.load_yaml("d: 1")[0], plan) is None and P.walk(T.load_yaml("d: {i: {a: {id: 9}}}")[0], plan) == [{"id": 9, "s": None}]
    for bad in ("[", "{}", {"kind": "x", "children": []}, {"kind": "seq"}, {"kind": "seq", "children": []}, {"kind": "seq", "path": [""], "children": spec["children"]}, {**spec, "more": 1}, {"kind": "seq", "children": [{"name": "a"}]}, {"kind": "seq", "path": [1], "children": spec["children"]}):
        with pytest.raises(P.PlanError):
            P.compile_plan(bad)


def test_legs_agree(spark):
    """Strict JSON by expressions and by the kernel gives the same rows."""
    rng = random.Random(2)
    leaf = lambda: rng.choice([1, -5, 2.5, "x", "1", True, None, [1], {"a": 1}, 10**20, ""])
    docs = [(k, json.dumps([rng.choice([{n: leaf() for n in rng.sample("abcd", 3)}, 5]) for _ in range(4)])) for k in range(60)]
    df = spark.createDataFrame(docs, "k int, t string")
    spec = P.compile_plan({"kind": "seq", "children": [{"name": "a", "kind": "int"}, {"name": "b", "kind": "float"}, {"name": "c", "kind": "bool"}]})
    key = lambda d: sorted(map(str, d.collect()))
    assert key(P.extract(df, "t", spec, form="json")) == key(P.extract(df, "t", spec, form="yaml")) == key(P.extract(df, "t", spec))


def test_descriptor():
    node = D.Field("map", children={"id": D.Field("scalar", "id", "int", required=True), "on": D.Field("scalar", "flag", "bool", first_wins=True), "raw": D.Field("raw", "raw")})
    load = lambda t: D.load(T.load_yaml(t)[0], node)
    assert load("id: 7.9\non: off\non: no\nraw: [1, a]\nmore: 1\n") == (Y.OK, {"id": [7], "flag": [True], "raw": ['[1,"a"]']})
    assert load("on: x\n")[0] == Y.SCHEMA and load("id: x\n")[0] == Y.PARSE and load("id: 1\nid: 2\n")[1]["id"] == [1, 2]


def test_changes():
    apply = lambda ops: T.to_json(mutate.apply(T.load_yaml("a: 1\nl: [1, 2]\n")[0], ops))
    assert apply([("map_set", "", "a", 9), ("seq_set", "/l", 0, "x"), ("seq_del", "/l", 1), ("map_add", "", "n", None)]) == '{"a":9,"l":["x"],"n":null}'
    for bad in ([("map_add", "", "a", 1)], [("seq_set", "/l", 5, 1)], [("seq_add", "/a", 1)], [("map_del", "/zz", "a")]):
        with pytest.raises(Y.YamlError):
            apply(bad)
    ops = [("map",), ("scalar", "k"), ("seq",), ("tag", "!t"), ("scalar", 1), ("end",), ("scalar", "k"), ("scalar", 2), ("end",)]
    assert T.to_json(T.bulk(ops)) == '{"k":2}'


def test_marshal():
    assert marshal.dump(T.build([1, "a", None, True, 300, -129])).hex() == "04085b0b69064922066106" + "3a064554" + "305469022c01" + "69ff7f"
    assert T.to_json(marshal.load(bytes.fromhex("04087b063a0661690a"))) == '{"a":5}'
    with pytest.raises(marshal.MarshalError):
        marshal.load(b"\x04\x08o:\x06A\0")
    with pytest.raises(marshal.MarshalError):
        marshal.dump(T.load_yaml("{a: 1, a: 2}")[0], strict_keys=True)


def test_compat():
    node = T.strict_json('{"i":5,"s":"x","l":[1],"d":2.5}')
    assert compat.get_int64(node.get("s")) == 0 and compat.get_double(node.get("i")) == 5.0 and compat.array_get(node.get("l"), 3) is None and compat.length(node) == 4
    g = compat.Generator()
    g.open("map").string("a").open("seq").integer(1).null().close().string("b").double(1.5).close()
    assert g.text() == '{"a":[1,null],"b":1.5}'
    for bad in (lambda g: g.open("map").integer(1), lambda g: g.open("map").string("a").close(), lambda g: g.null().null(), lambda g: g.close(), lambda g: g.double(math.inf)):
        with pytest.raises(compat.GeneratorError):
            bad(compat.Generator())
    assert list(compat.parse_json_callbacks('{"a": /* x */ [1, "//"]}', comments=True)) == [("start_map", None), ("map_key", "a"), ("start_array", None), ("integer", 1), ("string", "//"), ("end_array", None), ("end_map", None)]
    assert compat.error_text("a: [\n  b", 2, 3, "no").split("\n")[2] == "  ^"


@pytest.mark.parametrize("name", ["utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_encodings(name):
    mark = {v: k for k, v in T.BOMS}[name]
    assert T.to_text(mark + "ké: 1".encode(name)) == "ké: 1" == T.to_text("ké: 1".encode(name))
    with pytest.raises(Y.YamlError):
        T.to_text(b"\xc3(")


CASES = [
    ({"type": "integer"}, [("1", ""), ("1.0", ""), ("1.5", "TYPE"), ('"1"', "TYPE")]),
    ({"const": 1, "enum": [1, "a"]}, [("1.0", ""), ("2", "CONST ENUM")]),
    ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.5}, [("1.5", ""), ("0", "MINIMUM"), ("3", "EXCLUSIVE_MAXIMUM"), ("1.2", "MULTIPLE_OF"), ('"x"', "")]),
    ({"minLength": 2, "pattern": "^\\d+$"}, [('"12"', ""), ('"\U0001f600"', "MIN_LENGTH PATTERN")]),
    ({"uniqueItems": True, "contains": {"const": 1}, "maxContains": 1}, [("[1, 2]", ""), ("[2]", "CONTAINS"), ("[1, 1.0]", "UNIQUE_ITEMS MAX_CONTAINS")]),
    ({"prefixItems": [{"type": "string"}], "items": False}, [('["a"]', ""), ("[1, 2]", "TYPE FALSE_SCHEMA")]),
    ({"required": ["a"], "properties": {"a": {"type": "null"}}, "additionalProperties": False}, [('{"a": null}', ""), ('{"b": 1}', "REQUIRED ADDITIONAL_PROPERTY")]),
    ({"oneOf": [{"minimum": 2}, {"maximum": 3}], "not": {"const": 9}}, [("1", ""), ("2.5", "ONE_OF"), ("9", "NOT")]),
    ({"if": {"minimum": 5}, "then": {"maximum": 7}, "else": {"const": 0}}, [("6", ""), ("8", "MAXIMUM"), ("1", "CONST")]),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [('{"a": 1}', ""), ('{"b": 1}', "UNEVALUATED_PROPERTY")]),
    ({"$defs": {"n": {"type": "array", "items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"}, [("[[], [[]]]", ""), ("[1]", "TYPE")]),
    ({"$ref": "#/nope"}, [("1", "REF")]),
    ({"dependentRequired": {"a": ["b"]}, "propertyNames": {"maxLength": 1}, "minProperties": 1}, [('{"a": 1, "b": 1}', ""), ('{"a": 1}', "DEPENDENT_REQUIRED"), ('{"xx": 1}', "MAX_LENGTH"), ("{}", "MIN_PROPERTIES")]),
    ({"patternProperties": {"^x": {"type": "integer"}, "(?=a)": False}}, [('{"x1": 1, "a": 2}', ""), ('{"x1": "s"}', "TYPE")]),
]


@pytest.mark.parametrize(("schema", "cases"), CASES)
def test_json_schema(schema, cases):
    for text, want in cases:
        assert " ".join(r["name"] for r in V.validate(json.dumps(schema), text)) == want, text


def test_diagnostics():
    rows = V.validate('{"items": {"properties": {"a/b": {"type": "string"}}}}', "- {a/b: 1}\n---\n- {a/b: x}\n- {a/b: 2}\n")
    assert [(r["path"], r["line"], r["col"]) for r in rows] == [("/0/0/a~1b", 1, 9), ("/1/1/a~1b", 4, 9)]
    assert [r["name"] for r in V.validate_family("a: 1\na: 2\n1: x\n1.0: y\nz: !!int q\n")] == ["DUPLICATE_KEY", "DUPLICATE_KEY", "TAG_MISMATCH"]
    assert [r["name"] for r in V.validate_family("1: x\n", "json")] == ["KEY_NOT_STRING", "NON_JSON_TYPE"]
    assert len(V.validate('{"items": false}', "[" + "1," * 400 + "1]")) == 256
    assert V.output_unit([]) == '{"valid":true}'
    with pytest.raises(ValueError):
        V.validate_family("a", "compat")


STREAM = "a: 1\n---\n- x\n- y\n...\n%YAML 1.2\n---\nz: |\n  t\n  --- no\n--- {{{ bad\n---\nlast"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(STREAM)), max_size=8))
def test_chunks_never_matter(cuts):
    def run(cuts):
        rest, index, line, out = "", 0, 0, []
        edges = [0, *sorted(cuts), len(STREAM)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            made, rest, index, line = S.feed(rest, STREAM[a:b], index, line, k == len(edges) - 2)
            out += made
        return out

    whole = run([])
    assert run(cuts) == whole and [d["status"] for d in whole] == [0, 0, 0, 1, 0] and whole[3]["err_line"] == 12


def test_cbor_chunks():
    data, rest, out = cbor.encode_sequence([T.build([1, {"a": "xyz"}]), T.build("q")]), b"", []
    for i in range(len(data)):
        made, rest = S.feed_cbor(rest, data[i : i + 1])
        out += made
    assert out == ['[1,{"a":"xyz"}]', '"q"'] and rest == b""


def test_plain_documents_line_by_line():
    """The events that lines give are the parser's, and what is not in plain spelling is left to the parser."""
    from docengine.functions import yamlparse as Y

    plain = ["key: 1\nprio: '5-LOW'\ntags: [x, O]\n", "- a: b c\n  d:\n  - 1\n  - {x: 'y', \"q\": []}\n- 2", "  a:\n    b: {}\n  c:\n", "k:\n- a\nl:\n", "[a, [b]]", "- - 1\n  - -5\n- .5 \n", "k é: ~\n"]
    assert [t for t in plain if Y.quick(t) != Y.Parser(t).parse()] == []
    other = ["", "a", "---\na: 1\n", "a: &x b\n", "a: b: c\n", "a: b\n c\n", "a: 1 # c\n", "a: [x\n", "a: [x,]\n", "a: 'it''s'\n", 'a: "\\n"\n', "a: b\n- c\n", "a:\n  b\n", "a: 1\n\nb: 2\n", "? a\n: b\n", "a:\tb\n", "a: \x01\n", "...: a\n"]
    assert [t for t in other if Y.quick(t) is not None] == []


def test_equal_cells_give_equal_rows(spark, monkeypatch):
    from docengine.operators import tables

    monkeypatch.setattr(tables, "KEPT", 4)
    docs = spark.createDataFrame([(i, f"a: {i % 3}\nb: [1, x]\n") for i in range(30)], "k int, doc string").coalesce(1)
    rows = tables.nodes(docs, "doc").where("path = '/a' and role = 'value'").select("k", "i", "last_id").collect()
    assert sorted(tuple(r) for r in rows) == [(i, i % 3, 2) for i in range(30)]
