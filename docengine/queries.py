"""Queries over the driver's tables, one or more for each group of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import compat as js
from docengine.functions import convert, mutate
from docengine.functions import resolve as R
from docengine.functions.variant import Json
from docengine.operators import emission
from docengine.operators import navigate as nav
from docengine.operators import tables
from docengine.operators.jsonschema import problems
from docengine.plans import descriptor as desc
from docengine.plans import plan
from docengine.shared import work_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count() -> F.Column:
    return F.count(F.lit(1)).alias("n")


def text(*parts) -> F.Column:
    """Parts joined: strings as they are, columns cast."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def leaf(name: str, kind: str) -> dict:
    return {"name": name, "kind": kind}


def order_yaml(spark, sf_dir, of: F.Column | None = None) -> DataFrame:
    """Each order as a block YAML document, or those ``of`` a condition."""
    c = F.col
    o = table(spark, sf_dir, "orders")
    # columns are dealt, not the longer texts
    o = tables.spread((o if of is None else o.where(of)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    body = text("key: ", c("o_orderkey"), "\ncust: ", c("o_custkey"), "\nstatus: ", c("o_orderstatus"), "\nprio: '", c("o_orderpriority"), "'\ntags: [x, ", c("o_orderstatus"), "]\n")
    return o.select("o_orderkey", body.alias("doc"))


# extraction plans


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def json_extract_sum(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", text("[", F.col("props"), "]").alias("doc"))
    rows = plan.extract(ev, "doc", {"kind": "seq", "children": [leaf("k", "int")]})
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), count())


@query("SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, round(sum(l_quantity), 4) AS qty, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey")
def json_plan_path(spark, sf_dir):
    """Items of an order as one JSON document, extracted again through a path."""
    item = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("qty"), (F.col("l_returnflag") == "R").alias("back"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("order"))).alias("doc"))
    spec = {"kind": "seq", "path": ["order", "items"], "children": [leaf("no", "int"), leaf("qty", "float"), leaf("back", "bool")]}
    rows = plan.extract(docs, "doc", spec)
    return rows.groupBy("l_orderkey").agg(count(), F.sum("no").alias("lines"), F.round(F.sum("qty"), 4).alias("qty"), F.count_if("back").alias("returned"))


@query("SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS prio FROM orders")
def yaml_plan_rows(spark, sf_dir):
    docs = order_yaml(spark, sf_dir).select(text("- ", F.regexp_replace("doc", "\n(?=.)", "\n  ")).alias("doc"))
    spec = {"kind": "seq", "children": [leaf("key", "int"), leaf("cust", "int"), leaf("status", "str"), leaf("prio", "str")]}
    return plan.extract(docs, "doc", spec, form="yaml")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 3) AS bal FROM customer GROUP BY c_mktsegment")
def yaml_plan_mapping_rows(spark, sf_dir):
    """Values of a mapping as rows, one document for each nation."""
    c = F.col
    line = text("  c", c("c_custkey"), ": {seg: ", c("c_mktsegment"), ", bal: ", c("c_acctbal"), "}\n")
    docs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(text("rows:\n", F.array_join(F.collect_list(line), "")).alias("doc"))
    spec = {"kind": "map", "path": "rows", "children": [leaf("seg", "str"), leaf("bal", "float")]}
    rows = plan.extract(docs, "doc", spec, keep=[])
    return rows.groupBy(F.col("seg").alias("segment")).agg(count(), F.round(F.sum("bal"), 3).alias("bal"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS status, count(*) AS n FROM orders GROUP BY 1")
def plan_statuses(spark, sf_dir):
    """Documents without the container have status PARSE."""
    docs = order_yaml(spark, sf_dir).select(F.when(F.col("o_orderkey") % 3 == 0, F.col("doc")).otherwise(text("- ", F.regexp_replace("doc", "\n(?=.)", "\n  "))).alias("doc"))
    return plan.statuses(docs, "doc", {"kind": "seq", "children": [leaf("key", "int")]}).groupBy("status").agg(count())


@query("SELECT n_regionkey AS region, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS ids, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def descriptor_columns(spark, sf_dir):
    """Ragged columns: arrays of ids and names of each region's document."""
    c = F.col
    line = F.struct(c("n_nationkey").alias("k"), text("- {id: ", c("n_nationkey"), ", name: '", c("n_name"), "'}\n").alias("t"))
    docs = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["t"]), "").alias("doc"))
    shape = desc.Field("seq", children={"": desc.Field("map", children={"id": desc.Field("scalar", "ids", "int", required=True), "name": desc.Field("scalar", "names")})})
    return desc.materialize(docs, "doc", shape).select("region", "ids", "names")


# typing


def part_texts(spark, sf_dir) -> DataFrame:
    size, c = F.col("p_size"), F.col
    shapes = [
        size.cast("string"), text("0x", F.lower(F.hex(size.cast("long")))), text("0o", F.conv(size, 10, 8)), text(size, ".5"), text(size, "e2"), text("0b1", size),
        text("2001-01-0", size % 9 + 1), text(size, ":30"), F.when(size % 2 == 0, "true").otherwise("No"), F.lit("~"), text("1_", size), text("0", size), text(".", size), c("p_brand"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.posexplode(F.array(*shapes)).alias("shape", "text"))


PART_TEXTS = """
texts AS (
  SELECT p_partkey, p_size, unnest(range(14)) AS shape,
         unnest([p_size::VARCHAR, '0x' || lower(printf('%X', p_size)), '0o' || printf('%o', p_size), p_size || '.5', p_size || 'e2', '0b1' || p_size,
                 '2001-01-0' || (p_size % 9 + 1), p_size || ':30', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'No' END, '~', '1_' || p_size, '0' || p_size,
                 '.' || p_size, p_brand]) AS text
  FROM part
)"""


def tag_sql(cases: str) -> str:
    return f"WITH {PART_TEXTS} SELECT shape::INTEGER AS shape, ({cases})::INTEGER AS tag_id, count(*) AS n FROM texts GROUP BY ALL"


def counted_tags(spark, sf_dir, family):
    return part_texts(spark, sf_dir).groupBy("shape", R.resolve_column(F.col("text"), family).alias("tag_id")).agg(count())


CORE_SQL = """CASE WHEN text IN ('', '~', 'null', 'Null', 'NULL') THEN 4 WHEN text IN ('true', 'True', 'TRUE', 'false', 'False', 'FALSE') THEN 3
WHEN regexp_full_match(text, '[-+]?0x[0-9a-fA-F]+|[-+]?0o[0-7]+|[-+]?[0-9]+') THEN 1
WHEN regexp_full_match(text, '[-+]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?|[-+]?[0-9]+[eE][-+]?[0-9]+|[-+]?\\.(inf|Inf|INF)|\\.(nan|NaN|NAN)') THEN 2 ELSE 0 END"""


@query(tag_sql(CORE_SQL))
def resolve_core(spark, sf_dir):
    return counted_tags(spark, sf_dir, "core")


@query(tag_sql("CASE WHEN regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 5 ELSE " + CORE_SQL + " END"))
def resolve_full(spark, sf_dir):
    return counted_tags(spark, sf_dir, "full")


@query(tag_sql("CASE WHEN text = 'null' THEN 4 WHEN text IN ('true', 'false') THEN 3 WHEN regexp_full_match(text, '-?(0|[1-9][0-9]*)') THEN 1 WHEN regexp_full_match(text, '-?(0|[1-9][0-9]*)(\\.[0-9]*)?([eE][-+]?[0-9]+)?') THEN 2 ELSE 0 END"))
def resolve_json(spark, sf_dir):
    return counted_tags(spark, sf_dir, "json")


@query(
    tag_sql(
        "CASE WHEN text = '~' THEN 4 WHEN lower(text) IN ('true', 'no') THEN 3 WHEN regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 5 "
        "WHEN regexp_full_match(text, '[-+]?[0-9][0-9_]*(:[0-5]?[0-9]){1,2}') THEN 1 "
        "WHEN regexp_full_match(text, '[-+]?0b[0-9_,]+|[-+]?0x[0-9a-fA-F_,]+|[-+]?0[0-7_,]*|[-+]?[1-9][0-9_,]*') THEN 1 "
        "WHEN regexp_full_match(text, '[0-9]*\\.[0-9]+') THEN 2 ELSE 0 END"
    )
)
def resolve_compat(spark, sf_dir):
    return counted_tags(spark, sf_dir, "compat")


@query(
    f"WITH {PART_TEXTS} SELECT shape::INTEGER AS shape, sum(CASE WHEN shape IN (0, 1, 2) THEN p_size WHEN shape = 5 THEN CASE p_size WHEN 1 THEN 3 WHEN 10 THEN 6 WHEN 11 THEN 7 END "
    "WHEN shape = 7 THEN p_size * 3600 + 1800 WHEN shape = 10 THEN ('1' || p_size)::BIGINT WHEN shape = 11 AND p_size // 10 < 8 AND p_size % 10 < 8 THEN p_size // 10 * 8 + p_size % 10 END)::BIGINT AS total, "
    "count(*) AS n FROM texts GROUP BY shape"
)
def convert_ints(spark, sf_dir):
    """Texts of every shape as 64-bit integers; those that are none are null."""
    return part_texts(spark, sf_dir).groupBy("shape").agg(F.sum(R.to_int_column(F.col("text"))).alias("total"), count())


@query(
    f"WITH {PART_TEXTS} SELECT shape::INTEGER AS shape, round(sum(CASE WHEN shape IN (0, 1, 2, 11) THEN p_size WHEN shape = 3 THEN p_size + 0.5 WHEN shape = 4 THEN p_size * 100 "
    "WHEN shape = 5 THEN CASE p_size WHEN 1 THEN 3 WHEN 10 THEN 6 WHEN 11 THEN 7 END WHEN shape = 7 THEN p_size * 3600 + 1800 WHEN shape = 10 THEN ('1' || p_size)::BIGINT "
    "WHEN shape = 12 THEN ('0.' || p_size)::DOUBLE END), 3)::DOUBLE AS total, count(*) AS n FROM texts GROUP BY shape"
)
def convert_floats(spark, sf_dir):
    t = part_texts(spark, sf_dir)
    return t.groupBy("shape").agg(F.round(F.sum(R.to_float_column(F.col("text"))), 3).alias("total"), count())


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size * 3600 + 60 * p_size + 30 END::BIGINT AS seconds FROM part")
def convert_sixties(spark, sf_dir):
    """Hours, minutes and seconds; what is beyond 64 bits is null and ends no job."""
    size = F.col("p_size")
    t = F.when(size % 2 == 0, text("92233720368547758", size % 10, ":30")).otherwise(text(size, ":", size, ":30"))
    return table(spark, sf_dir, "part").select("p_partkey", R.to_int_column(t).alias("seconds"))


@query("SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n, min(o_orderdate) AS first FROM orders GROUP BY 1")
def convert_timestamps(spark, sf_dir):
    stamp = text(F.date_format("o_orderdate", "yyyy-MM-dd't'HH:mm:ss.SSSSSS"), " Z")
    at = R.to_timestamp_column(stamp).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(at.alias("at")).groupBy(F.year("at").alias("y")).agg(count(), F.min("at").alias("first"))


# tables of documents


@query("SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS doc_index, CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 0 END::INTEGER AS status FROM nation")
def tolerant_documents(spark, sf_dir):
    """Streams with faulty documents: each fault takes an index, the next document still comes."""
    c = F.col
    body = F.when(c("n_nationkey") % 4 == 1, "--- {{{ bad\n").otherwise(text("--- {name: '", c("n_name"), "'}\n"))
    docs = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", body.alias("t")))).alias("l"))
    docs = docs.select("region", F.array_join(F.transform("l", lambda s: s["t"]), "").alias("doc"))
    return tables.documents(docs, "doc").select("region", "doc_index", "status")


@query(
    "SELECT depth::INTEGER AS depth, kind, n FROM (SELECT 0 AS depth, 'map' AS kind, count(*) AS n FROM orders UNION ALL SELECT 1, 'scalar', count(*) * 9 FROM orders "
    "UNION ALL SELECT 1, 'seq', count(*) FROM orders UNION ALL SELECT 2, 'scalar', count(*) * 2 FROM orders)"
)
def node_statistics(spark, sf_dir):
    return tables.nodes(order_yaml(spark, sf_dir), "doc", keep=[], only=["depth", "kind"]).groupBy("depth", "kind").agg(count())


@query(
    "SELECT kind, n FROM (SELECT 'doc' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'map_open', count(*) FROM orders UNION ALL SELECT 'seq_open', count(*) FROM orders "
    "UNION ALL SELECT 'close', 2 * count(*) FROM orders UNION ALL SELECT 'int', 2 * count(*) FROM orders UNION ALL SELECT 'str', 9 * count(*) FROM orders)"
)
def value_statistics(spark, sf_dir):
    return tables.values(order_yaml(spark, sf_dir), "doc", keep=[], only=["kind"]).groupBy("kind").agg(count())


@query(
    "SELECT type, n FROM (SELECT unnest(['stream+', 'doc+', 'doc-', 'stream-', 'map+', 'map-', 'seq+', 'seq-']) AS type, count(*) AS n FROM orders UNION ALL SELECT 'val', count(*) * 11 FROM orders)"
)
def event_statistics(spark, sf_dir):
    return tables.events(order_yaml(spark, sf_dir), "doc", keep=[], only=["type"]).groupBy("type").agg(count())


@query("SELECT s_nationkey AS nation, s_suppkey AS supplier, s_nationkey::VARCHAR AS target FROM supplier")
def alias_targets(spark, sf_dir):
    """Aliases bind to the last definition before them; here each to the anchor of its own supplier's nation."""
    c = F.col
    docs = table(spark, sf_dir, "supplier").select(
        c("s_nationkey").alias("nation"), c("s_suppkey").alias("supplier"), text("base: &b x\nnow: &b ", c("s_nationkey"), "\nuse: *b\nlater: &b y\n").alias("doc")
    )
    keys = ["nation", "supplier", "doc_index"]
    return nav.resolve_aliases(tables.nodes(docs, "doc"), keys).select("nation", "supplier", F.col("target_text").alias("target"))


@query("SELECT s_suppkey AS supplier, s_nationkey::BIGINT AS base, s_name AS name FROM supplier")
def alias_merge_join(spark, sf_dir):
    """Anchored defaults read through aliases by an extraction plan."""
    c = F.col
    docs = table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("supplier"), text("- &d {base: ", c("s_nationkey"), ", name: '", c("s_name"), "'}\n- *d\n").alias("doc")
    )
    spec = {"kind": "seq", "children": [leaf("base", "int"), leaf("name", "str")]}
    return plan.extract(docs, "doc", spec).groupBy("supplier", "base", "name").agg(count()).where("n = 2").drop("n")


# navigation


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey AS cust FROM orders")
def navigate_keys(spark, sf_dir):
    """Two questions about each document in one pass over its nodes."""
    n = tables.nodes(order_yaml(spark, sf_dir), "doc", only=["node_id", "role", "key", "path", "tag_id", "text"], paths=["/cust"], keys=["status"])
    # the root keeps documents that have neither
    n = n.where((F.col("role") == "root") | nav.is_value_of("status") | nav.is_at("/cust"))
    return nav.picked(n, ["o_orderkey"], status=F.when(nav.is_value_of("status"), F.col("text")), cust=F.when(nav.is_at("/cust"), nav.as_int()))


@query("SELECT o_orderkey, o_orderstatus AS item, 2::BIGINT AS items FROM orders")
def navigate_items(spark, sf_dir):
    n = nav.subtree(tables.nodes(order_yaml(spark, sf_dir), "doc", only=["node_id", "role", "ord", "path", "text"], paths=["/tags"]), "/tags")
    second = F.min_by("text", F.when(nav.is_item(1), F.col("node_id"))).alias("item")
    return n.groupBy("o_orderkey").agg(second, F.count_if(F.col("role") == "item").alias("items"))


@query("SELECT count(*) AS documents, 5 * count(*) AS children, 2 * count(*) AS pairs FROM orders")
def navigate_counts(spark, sf_dir):
    n = tables.nodes(order_yaml(spark, sf_dir), "doc", keep=[], only=["role", "ord", "path", "depth"])
    return n.agg(F.count_if(F.col("role") == "root").alias("documents"), F.count_if(nav.is_child("")).alias("children"), F.count_if(nav.is_pair(0)).alias("pairs"))


@query("SELECT o_orderkey, o_orderpriority AS prio, 4::BIGINT AS below FROM orders WHERE o_orderkey % 2 = 0")
def navigate_by_filters(spark, sf_dir):
    """The operators as conditions of one pass: first value of a key among the root's children, and the size of a subtree."""
    docs = order_yaml(spark, sf_dir, F.col("o_orderkey") % 2 == 0)
    n = tables.nodes(docs, "doc", only=["doc_index", "node_id", "role", "key", "path", "depth", "text"], paths=["/tags"], keys=["prio"])
    prio, below = nav.is_child("") & nav.is_value_of("prio"), nav.is_in("/tags")
    n = n.where(prio | below).groupBy("o_orderkey", "doc_index")
    found = n.agg(F.min_by("text", F.when(prio, F.col("node_id"))).alias("prio"), F.count_if(below).alias("below"), F.count_if(prio).alias("found"))
    return found.where("found > 0 and below > 0").select("o_orderkey", "prio", "below")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k, 0::BIGINT AS missing, '' AS nothing FROM events")
def accessors_on_variants(spark, sf_dir):
    """Neutral values where a type does not fit."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", js.variant_int64(v, "$.k").alias("k"), js.variant_int64(v, "$.z").alias("missing"), js.variant_string(v, "$.z").alias("nothing"))


@query(
    "SELECT CASE WHEN event_id % 2 = 0 THEN 'object' ELSE 'array' END AS root, CASE WHEN event_id % 2 = 0 THEN 'int' ELSE 'null' END AS kind, "
    "sum(CASE WHEN event_id % 2 = 0 THEN 5 ELSE 3 END)::BIGINT AS members, sum(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END)::BIGINT AS k, "
    "sum(CASE WHEN event_id % 2 = 0 THEN 2.5 ELSE 0 END)::DOUBLE AS d, count(*) FILTER (event_id % 2 = 0) AS yes, "
    "CASE WHEN event_id % 2 = 0 THEN '[1,\"two\",3.5]' ELSE '' END AS list, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'two' END AS second FROM events GROUP BY ALL"
)
def typed_reads(spark, sf_dir):
    """Objects and arrays by the wrapper: types, lengths, members, items, text of containers, neutral values."""
    k = F.get_json_object("props", "$.k")
    doc = F.when(F.col("event_id") % 2 == 0, text('{"k":', k, ',"d":2.5,"b":true,"n":null,"list":[1,"two",3.5]}')).otherwise('[1,"two",null]')
    j = Json.parse(F.col("doc"))
    rows = table(spark, sf_dir, "events").select(doc.alias("doc"))
    by = [j.type().alias("root"), j["k"].type().alias("kind"), j["list"].string().alias("list"), j[1].string().alias("second")]
    yes = F.count_if(j["b"].boolean() & j.has("n") & j["list"].is_type("array") & (j["list"][0].int64() == 1)).alias("yes")
    return rows.groupBy(*by).agg(F.sum(j.length()).alias("members"), F.sum(j["k"].int64()).alias("k"), F.sum(j["d"].double()).alias("d"), yes)


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n, 'a' || chr(9) || '// b' AS note FROM events GROUP BY event_type")
def lenient_json_rows(spark, sf_dir):
    """Comments and raw tabs are taken, and what looks like a comment in a string stays."""
    k = F.get_json_object("props", "$.k")
    doc = text('// head\n[{"k": /* a "quoted" word */ ', k, ',\t"note": "a\t// b"} // end\n]')
    rows = plan.extract(table(spark, sf_dir, "events").select("event_type", doc.alias("doc")), "doc", {"kind": "seq", "children": [leaf("k", "int"), leaf("note", "str")]}, form="lenient")
    return rows.groupBy("event_type", "note").agg(F.sum("k").alias("k"), count())


@query("SELECT o_orderkey, 'map+ key int key int key str key str key seq+ str str seq- map-' AS events FROM orders")
def visit_order(spark, sf_dir):
    """Callbacks of a visitor, in order, from the nodes table."""
    n = tables.nodes(order_yaml(spark, sf_dir), "doc", only=["node_id", "last_id", "role", "depth", "kind", "tag_id", "text"])
    calls = F.sort_array(F.collect_list(nav.callback()))
    return nav.callbacks(n, ["o_orderkey"]).groupBy("o_orderkey").agg(F.array_join(F.transform(calls, lambda e: e["event"]), " ").alias("events"))


# validation


@query(
    "SELECT code::INTEGER AS code, path, count(*) AS n FROM (SELECT 11 AS code, '/price' AS path FROM orders WHERE round(o_totalprice, 2) > 200000 "
    "UNION ALL SELECT 7, '/status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 6, '/note' FROM orders WHERE o_orderkey % 10 = 0 "
    "UNION ALL SELECT 9, '/prio' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-')) GROUP BY ALL"
)
def schema_diagnostics(spark, sf_dir):
    from docengine.functions.validate import compile_schema

    schema = compile_schema(
        {
            "type": "object",
            "required": ["note"],
            "properties": {"price": {"type": "number", "maximum": 200000}, "status": {"enum": ["O", "F"]}, "prio": {"type": "string", "pattern": "^[12]-"}},
        }
    )
    c = F.col
    note = F.when(c("o_orderkey") % 10 != 0, F.lit("x"))
    docs = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.round("o_totalprice", 2).alias("price"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("prio"), note.alias("note"))).alias("doc"))
    return tables.diagnostics(docs, "doc", schema, form="json", keep=[]).groupBy("code", "path").agg(count())


@query("SELECT CASE WHEN o_orderstatus = 'O' THEN '{\"valid\":true}' ELSE '{\"valid\":false,\"errors\":[{\"instanceLocation\":\"/s\",\"keyword\":\"CONST\",\"error\":\"the value is not the constant\"}]}' END AS unit, count(*) AS n FROM orders GROUP BY 1")
def schema_output_unit(spark, sf_dir):
    unit = convert.schema_output({"properties": {"s": {"const": "O"}}})
    docs = table(spark, sf_dir, "orders").select(text("s: ", F.col("o_orderstatus")).alias("doc"))
    return docs.groupBy(unit("doc").alias("unit")).agg(count())


@query("SELECT l_orderkey, (count(*) - count(DISTINCT l_returnflag))::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_returnflag)")
def duplicate_keys_kernel(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(text(F.col("l_returnflag"), ": ", F.col("l_linenumber"), "\n")), "").alias("doc"))
    return tables.diagnostics(docs, "doc", only=["name"]).where("name = 'DUPLICATE_KEY'").groupBy("l_orderkey").agg(count())


@query("SELECT l_orderkey, (count(*) - count(DISTINCT l_returnflag))::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_returnflag)")
def duplicate_keys_set(spark, sf_dir):
    """The same rule as a window over the nodes table."""
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(text(F.col("l_returnflag"), ": ", F.col("l_linenumber"), "\n")), "").alias("doc"))
    return nav.duplicate_keys(tables.nodes(docs, "doc"), ["l_orderkey", "doc_index"]).groupBy("l_orderkey").agg(count())


@query("SELECT 'TAG_MISMATCH' AS rule, count(*) AS n FROM part WHERE p_size % 2 = 1 UNION ALL SELECT 'NON_JSON_TYPE', count(*) FROM part")
def family_rules(spark, sf_dir):
    c = F.col
    body = text("tagged: !!int ", F.when(c("p_size") % 2 == 1, "x").otherwise(c("p_size").cast("string")), "\nplain: word\n'quoted': 'word'\n")
    n = tables.nodes(tables.spread(table(spark, sf_dir, "part").select(body.alias("doc"))), "doc")
    rules = F.array(F.when(nav.is_tag_mismatch(), "TAG_MISMATCH"), F.when(nav.json_code() == 3, "NON_JSON_TYPE"))
    return n.select(F.explode(rules).alias("rule")).where("rule is not null").groupBy("rule").agg(count())


@query("SELECT p_partkey, 3 + CASE WHEN p_size IN (1, 16) THEN 2 ELSE 1 END::BIGINT AS n FROM part")
def duplicate_keys_mixed(spark, sf_dir):
    """Keys of several tags, beyond the integers of doubles, and collections: 1 and 1.0 are equal, true and 'true', ~ and null are not."""
    size = F.col("p_size")
    body = text(
        "1: a\n1.0: b\n'1': c\ntrue: d\n'true': e\n9007199254740993: f\n9007199254740992: g\n? [1, {x: 1, y: 2}]\n: h\n? [1.0, {y: 2, x: 1}]\n: i\n"
        "~: j\nnull: k\n0x10: l\n16: m\n", size, "e0: n\n", size, ".0: o\n",
    )
    n = tables.nodes(tables.spread(table(spark, sf_dir, "part").select("p_partkey", body.alias("doc"))), "doc")
    return nav.duplicate_keys(n, ["p_partkey", "doc_index"]).groupBy("p_partkey").agg(count())


@query("SELECT p_size, count(*) AS n, 1::BIGINT AS kinds FROM part GROUP BY p_size")
def node_hashes(spark, sf_dir):
    """Documents that say the same in another order and spelling have one hash, others have others."""
    size, odd = F.col("p_size"), F.col("p_partkey") % 2 == 1
    body = F.when(odd, text("{a: [", size, ", x], b: {c: 1, d: '2'}}")).otherwise(text("b:\n  d: '2'\n  c: 1.0\na:\n- ", size, ".0\n- x\n"))
    n = tables.nodes(tables.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", body.alias("doc"))), "doc")
    doc = ["p_partkey", "doc_index"]
    hashes = nav.node_hashes(n, doc, nav.roots(n).select(*doc, "node_id"))
    sizes = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # of one hash all documents have one size, and of one size all have one hash
    return hashes.join(sizes, "p_partkey").groupBy("p_size").agg(count(), F.count_distinct("hash").alias("kinds"))


@query("SELECT r_regionkey AS region, 5::INTEGER AS code FROM region WHERE r_regionkey > 1")
def registry_by_tag(spark, sf_dir):
    """Nodes with a registered tag are validated by its schema."""
    from docengine.functions.validate import Registry

    registry = Registry()
    registry.register("!point", {"type": "object"})
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.when(F.col("r_regionkey") > 1, "a: !point 3").otherwise("a: !point {x: 1}").alias("doc"))
    return tables.expand(docs, "doc", registry.validate, "code int").select("region", "code")


# keywords of JSON Schema as expressions


def order_variants(spark, sf_dir) -> DataFrame:
    """Each order as a JSON document, as VARIANT."""
    c = F.col
    note = F.when(c("o_orderkey") % 10 == 0, "").otherwise(',"note":"x"')
    body = text(
        '{"key":', c("o_orderkey"), ',"mixed":', F.when(c("o_orderkey") % 3 == 0, text('"', c("o_orderkey"), '"')).otherwise(text(c("o_orderkey"), F.when(c("o_orderkey") % 3 == 1, ".0").otherwise(".5"))),
        ',"status":"', c("o_orderstatus"), '","prio":"', c("o_orderpriority"), '","tags":["', c("o_orderstatus"), '","x","', F.substring("o_orderpriority", 1, 1), '"],"dims":{"a":', c("o_orderkey") % 7, ',"b":', c("o_orderkey") % 5, "}", note, "}",
    )
    return table(spark, sf_dir, "orders").select(F.parse_json(body).alias("v"))


def _props(**schemas) -> dict:
    return {"properties": schemas}


S_, P_ = "o_orderstatus", "o_orderpriority"
#: keyword (or variant of it): schema, then (path, SQL condition of a failure) for each place.
KEYWORDS: dict[str, tuple] = {
    "type": (_props(mixed={"type": "integer"}), [("/mixed", "o_orderkey % 3 IN (0, 2)")]),
    "type_list": (_props(mixed={"type": ["number", "null"]}), [("/mixed", "o_orderkey % 3 = 0")]),
    "enum": (_props(status={"enum": ["O", "F", 1]}), [("/status", f"{S_} NOT IN ('O', 'F')")]),
    "const": (_props(dims={"const": {"b": 2.0, "a": 3}}), [("/dims", "NOT (o_orderkey % 7 = 3 AND o_orderkey % 5 = 2)")]),
    "maximum": (_props(key={"maximum": 300}), [("/key", "o_orderkey > 300")]),
    "exclusive_maximum": (_props(key={"exclusiveMaximum": 300}), [("/key", "o_orderkey >= 300")]),
    "minimum": (_props(key={"minimum": 300}), [("/key", "o_orderkey < 300")]),
    "exclusive_minimum": (_props(key={"exclusiveMinimum": 300}), [("/key", "o_orderkey <= 300")]),
    "multiple_of": (_props(mixed={"multipleOf": 0.5}, key={"multipleOf": 3}), [("/key", "o_orderkey % 3 <> 0")]),
    "max_length": (_props(prio={"maxLength": 6}), [("/prio", f"length({P_}) > 6")]),
    "min_length": (_props(prio={"minLength": 7}), [("/prio", f"length({P_}) < 7")]),
    "pattern": (_props(prio={"pattern": "^[12]-"}), [("/prio", f"NOT regexp_matches({P_}, '^[12]-')")]),
    "items": (_props(tags={"items": {"enum": ["O", "x", "1", "2"]}}), [("/tags/0", f"{S_} <> 'O'"), ("/tags/2", f"{P_}[1] NOT IN ('1', '2')")]),
    "prefix_items": (_props(tags={"prefixItems": [{"const": "O"}, {"const": "x"}], "items": {"const": "1"}}), [("/tags/0", f"{S_} <> 'O'"), ("/tags/2", f"{P_}[1] <> '1'")]),
    "contains": (_props(tags={"contains": {"enum": ["F", "3"]}}), [("/tags", f"{S_} <> 'F' AND {P_}[1] <> '3'")]),
    "contains_counts": (
        _props(tags={"contains": {"enum": ["F", "3", "x"]}, "minContains": 2, "maxContains": 2}),
        [("/tags", f"({S_} = 'F')::INT + ({P_}[1] = '3')::INT <> 1")],
    ),
    "item_counts": (_props(tags={"maxItems": 2}, dims={"minItems": 9}), [("/tags", "true")]),
    "unique_items": ({"allOf": [_props(tags={"uniqueItems": True}), {"const": 1}]}, [("", "true")]),
    "required": ({"required": ["note", "key"]}, [("/note", "o_orderkey % 10 = 0")]),
    "pattern_properties": (_props(dims={"patternProperties": {"^[ab]$": {"maximum": 3}}}), [("/dims/a", "o_orderkey % 7 > 3"), ("/dims/b", "o_orderkey % 5 > 3")]),
    "additional_properties": (
        {"properties": {"key": True, "mixed": True, "dims": {"properties": {"a": True}, "additionalProperties": {"minimum": 1}}}, "patternProperties": {"^[pst]": True}, "additionalProperties": False},
        [("/note", "o_orderkey % 10 <> 0"), ("/dims/b", "o_orderkey % 5 = 0")],
    ),
    "property_names": ({"propertyNames": {"maxLength": 5}, "properties": {"dims": {"propertyNames": {"enum": ["a"]}}}}, [("/status", "true"), ("/dims/b", "true")]),
    "property_counts": ({"minProperties": 7}, [("", "o_orderkey % 10 = 0")]),
    "max_properties": ({"maxProperties": 6}, [("", "o_orderkey % 10 <> 0")]),
    "dependent_required": ({"dependentRequired": {"key": ["note"], "none": ["other"]}}, [("/note", "o_orderkey % 10 = 0")]),
    "dependent_schemas": ({"dependentSchemas": {"note": _props(key={"maximum": 300})}}, [("/key", "o_orderkey % 10 <> 0 AND o_orderkey > 300")]),
    "all_of": ({"allOf": [_props(key={"minimum": 100}), _props(key={"maximum": 300})]}, [("/key", "o_orderkey < 100 OR o_orderkey > 300")]),
    "any_of": ({"anyOf": [_props(key={"maximum": 100}), _props(status={"const": "O"})]}, [("", f"o_orderkey > 100 AND {S_} <> 'O'")]),
    "one_of": ({"oneOf": [_props(key={"maximum": 300}), _props(status={"const": "O"})]}, [("", f"(o_orderkey <= 300) = ({S_} = 'O')")]),
    "not": ({"not": _props(status={"const": "O"})}, [("", f"{S_} = 'O'")]),
    "if_then_else": (
        {"if": _props(status={"const": "O"}), "then": _props(key={"maximum": 300}), "else": _props(key={"minimum": 100})},
        [("/key", f"CASE WHEN {S_} = 'O' THEN o_orderkey > 300 ELSE o_orderkey < 100 END")],
    ),
    "ref": ({"$defs": {"small": {"maximum": 300}, "again": {"$ref": "#/$defs/small"}}, "properties": {"key": {"$ref": "#/$defs/again"}, "dims": False}}, [("/key", "o_orderkey > 300"), ("/dims", "true")]),
}


def _keyword_query(name: str, schema: dict, places: list) -> None:
    def run(spark, sf_dir):
        found = order_variants(spark, sf_dir).select(F.explode(problems(F.col("v"), schema)).alias("p"))
        return found.groupBy("p.path").agg(count())

    run.__doc__ = f"Failures of a schema with {name}, by place."
    run.__name__ = f"keyword_{name}"
    query(" UNION ALL ".join(f"SELECT '{path}' AS path, count(*) AS n FROM orders WHERE {condition} HAVING count(*) > 0" for path, condition in places))(run)


for _name, (_schema, _places) in KEYWORDS.items():
    _keyword_query(_name, _schema, _places)


# emission and conversion


@query("SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"cust\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\",\"prio\":\"' || o_orderpriority || '\",\"tags\":[\"x\",\"' || o_orderstatus || '\"]}' AS json FROM orders")
def emit_json(spark, sf_dir):
    return order_yaml(spark, sf_dir).select("o_orderkey", convert.yaml_to_json("doc").alias("json"))


@query("SELECT o_orderkey, '---' || chr(10) || '{\"key\": ' || o_orderkey || ', \"cust\": ' || o_custkey || ', \"status\": \"' || o_orderstatus || '\", \"prio\": \"' || o_orderpriority || '\", \"tags\": [\"x\", \"' || o_orderstatus || '\"]}' || chr(10) AS yaml FROM orders")
def emit_yaml_canonical(spark, sf_dir):
    return order_yaml(spark, sf_dir).select("o_orderkey", convert.yaml_canonical("doc").alias("yaml"))


@query("SELECT o_orderkey, 'key: ' || o_orderkey || chr(10) || 'cust: ' || o_custkey || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'prio: ''' || o_orderpriority || '''' || chr(10) || 'tags: [x, ' || o_orderstatus || ']' || chr(10) AS yaml FROM orders")
def emit_yaml_fidelity(spark, sf_dir):
    """Recorded styles come back, bytes and all."""
    return order_yaml(spark, sf_dir).select("o_orderkey", convert.yaml_serialize("doc").alias("yaml"))


@query("SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"cust\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\",\"prio\":\"' || o_orderpriority || '\",\"tags\":[\"x\",\"' || o_orderstatus || '\"]}' AS json FROM orders")
def emit_json_nodes(spark, sf_dir):
    """JSON text put together from the nodes table."""
    n = tables.nodes(order_yaml(spark, sf_dir), "doc")
    return emission.text_of(n, ["o_orderkey", "doc_index"]).select("o_orderkey", F.col("text").alias("json"))


@query("SELECT o_orderkey, '---' || chr(10) || '{\"key\": ' || o_orderkey || ', \"cust\": ' || o_custkey || ', \"status\": \"' || o_orderstatus || '\", \"prio\": \"' || o_orderpriority || '\", \"tags\": [\"x\", \"' || o_orderstatus || '\"]}' || chr(10) AS yaml FROM orders")
def emit_canonical_nodes(spark, sf_dir):
    n = tables.nodes(order_yaml(spark, sf_dir), "doc")
    return emission.text_of(n, ["o_orderkey", "doc_index"], ": ", ", ", head="---\n", tail="\n").select("o_orderkey", F.col("text").alias("yaml"))


@query("SELECT p_partkey, '{' || chr(10) || '  \"k\": ' || p_size || ',' || chr(10) || '  \"l\": [' || chr(10) || '    1.5,' || chr(10) || '    {},' || chr(10) || '    true,' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}' AS json FROM part")
def emit_pretty_nodes(spark, sf_dir):
    docs = tables.spread(table(spark, sf_dir, "part").select("p_partkey", text("{k: ", F.col("p_size"), ", l: [1.5, {}, true, ~]}").alias("doc")))
    return emission.text_of(tables.nodes(docs, "doc"), ["p_partkey", "doc_index"], ": ", ", ", 2).select("p_partkey", F.col("text").alias("json"))


@query("SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"cust\":7,\"status\":\"' || o_orderstatus || '\",\"tags\":[\"x\",\"' || o_orderstatus || '\",\"new\"],\"extra\":{\"a\":[1,true]}}' AS json FROM orders")
def mutate_nodes(spark, sf_dir):
    """The same changes as joins on the path of nodes."""
    edits = [("/cust", "set", None, "7"), ("/prio", "del", None, None), ("/tags", "add", None, '"new"'), ("", "add", "extra", '{"a":[1,true]}')]
    edits = spark.createDataFrame(edits, "path string, op string, name string, json string")
    doc = ["o_orderkey", "doc_index"]
    n = emission.changed(tables.nodes(order_yaml(spark, sf_dir), "doc"), F.broadcast(edits), doc)  # as many rows as were written above
    return emission.text_of(n, doc).select("o_orderkey", F.col("text").alias("json"))


@query("SELECT n_name AS name, '{' || chr(10) || '  \"k\": ' || n_nationkey || ',' || chr(10) || '  \"l\": [' || chr(10) || '    1' || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS json FROM nation")
def emit_json_pretty(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), text("{k: ", F.col("n_nationkey"), ", l: [1]}").alias("doc"))
    return docs.select("name", convert.yaml_to_json_pretty("doc").alias("json"))


@query("SELECT p_partkey, 'A2616B18' || printf('%02X', p_size + 100) || '6176F93E00' AS cbor FROM part")
def emit_cbor(spark, sf_dir):
    docs = tables.spread(table(spark, sf_dir, "part").select("p_partkey", text("k: ", F.col("p_size") + 100, "\nv: 1.5\n").alias("doc")))
    return docs.select("p_partkey", F.hex(convert.yaml_to_cbor_canonical("doc")).alias("cbor"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"key\":' || c_custkey || '}' AS json FROM customer")
def cbor_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))).alias("doc"))
    return docs.select("c_custkey", convert.cbor_to_json(convert.yaml_to_cbor("doc")).alias("json"))


@query("SELECT n_regionkey AS region, doc_index::INTEGER AS doc_index, n_nationkey::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS doc_index FROM nation)")
def cbor_sequence(spark, sf_dir):
    """Items of a CBOR sequence, exploded."""
    c = F.col
    docs = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("l"))
    docs = docs.select("region", F.array_join(F.transform("l", lambda k: F.concat(F.lit("--- {k: "), k.cast("string"), F.lit("}\n"))), "").alias("doc"))
    n = tables.nodes(docs.select("region", convert.yaml_to_cbor_sequence("doc").alias("raw")), "raw", form="cbor")
    return n.where("path = '/k' and role = 'value'").select("region", "doc_index", F.col("i").alias("k"))


@query("SELECT s_suppkey, '[' || s_suppkey || ',\"' || s_name || '\",null,1.5]' AS json FROM supplier")
def marshal_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", text("[", F.col("s_suppkey"), ", '", F.col("s_name"), "', ~, 1.5]").alias("doc"))
    return docs.select("s_suppkey", convert.marshal_to_json(convert.yaml_to_marshal("doc")).alias("json"))


@query("SELECT shape::INTEGER AS shape, count(*) AS n, CASE WHEN shape IN (0, 4) THEN count(*) ELSE 0 END AS strict FROM events, range(5) r(shape) GROUP BY shape")
def strict_json_gate(spark, sf_dir):
    """Texts that Spark's readers would take although they are no JSON."""
    p = F.col("props")
    shapes = F.array(p, text(p, " x"), text(p, p), text("[", p, ",]"), text('{"s":"a\\u0041\\ud83d\\ude00"}'))
    t = table(spark, sf_dir, "events").select(F.posexplode(shapes).alias("shape", "t"))
    return t.groupBy("shape").agg(count(), F.count_if(plan.strict_json(F.col("t"))).alias("strict"))


@query("SELECT o_orderkey, '{\"key\":' || (o_orderkey + 0) || ',\"cust\":7,\"status\":\"' || o_orderstatus || '\",\"tags\":[\"x\",\"' || o_orderstatus || '\",\"new\"],\"extra\":{\"a\":[1,true]}}' AS json FROM orders")
def mutate_documents(spark, sf_dir):
    change = mutate.changed([("map_set", "", "cust", 7), ("map_del", "", "prio"), ("seq_add", "/tags", "new"), ("map_add", "", "extra", {"a": [1, True]})])
    return order_yaml(spark, sf_dir).select("o_orderkey", change("doc").alias("json"))


@query("SELECT n_name AS name, n_name AS text FROM nation UNION ALL SELECT n_name, n_name FROM nation")
def decode_encodings(spark, sf_dir):
    """Text in UTF-16 with a mark and in UTF-8 with a mark."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    raw = F.array(F.concat(F.unhex(F.lit("FEFF")), F.encode("name", "UTF-16BE")), F.concat(F.unhex(F.lit("EFBBBF")), F.encode("name", "UTF-8")))
    return n.select("name", F.explode(raw).alias("raw")).select("name", convert.bytes_to_text("raw").alias("text"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def conversations_as_documents(spark, sf_dir):
    """Turns of a conversation as one JSON document, and back through the nodes table."""
    turn = F.struct("turn", "role", "text")
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(turn))).alias("doc"))
    rows = plan.extract(docs, "doc", {"kind": "seq", "children": [leaf("turn", "int"), leaf("role", "str"), leaf("text", "str")]})
    return rows.groupBy("conv_id").agg(F.count("turn").alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query(
    "SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS breaks, "
    "(length(text) - length(replace(text, chr(9), '')))::BIGINT AS tabs, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces, "
    "length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS digits, length(regexp_replace(text, '[^\"'']+', '', 'g'))::BIGINT AS quotes, "
    "(length(text) - length(replace(text, chr(92), '')))::BIGINT AS escapes, length(regexp_replace(text, '[^{}\\[\\],:]+', '', 'g'))::BIGINT AS marks FROM documents"
)
def text_class_counts(spark, sf_dir):
    s = nav.text_statistics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*")


# streaming


@query("SELECT n_regionkey::VARCHAR AS source, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS doc_index, '---' || chr(10) || 'name: ' || n_name || chr(10) AS text FROM nation")
def chunked_feed(spark, sf_dir):
    """Streams cut into chunks of 7 characters, fed through Structured Streaming with state for each stream."""
    import uuid

    from docengine.streaming.feed import feed_stream

    c = F.col
    body = F.struct("n_nationkey", text("---\nname: ", c("n_name"), "\n").alias("t"))
    streams = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").cast("string").alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(body)), lambda s: s["t"]), "").alias("t"))
    cut = F.regexp_extract_all("t", F.lit("(?s).{1,7}"), F.lit(0))
    chunks = streams.select("source", F.size(cut).alias("of"), F.posexplode(cut).alias("chunk_no", "chunk")).select("source", "chunk_no", "chunk", (c("chunk_no") == c("of") - 1).alias("final"))
    folder = f"{work_folder(spark)}/docengine/feed-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(chunks.schema).parquet(f"{folder}/in")
    run = feed_stream(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(f"{folder}/out").select("source", "doc_index", "text")


# relational work on extracted rows


@query(
    "SELECT event_type, user_id, k, rk FROM (SELECT event_type, user_id, json_extract_string(props, '$.k')::BIGINT AS k, "
    "row_number() OVER (PARTITION BY event_type ORDER BY json_extract_string(props, '$.k')::BIGINT DESC, event_id)::INTEGER AS rk FROM events) WHERE rk <= 3"
)
def top_extracted(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", text("[", F.col("props"), "]").alias("doc"))
    rows = plan.extract(ev, "doc", {"kind": "seq", "children": [leaf("k", "int")]})
    order = Window.partitionBy("event_type").orderBy(F.col("k").desc(), "event_id")
    return rows.withColumn("rk", F.row_number().over(order)).where("rk <= 3").select("event_type", "user_id", "k", "rk")


@query("SELECT o_orderstatus AS status, n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (o_orderstatus, n_name)")
def cube_of_extracted(spark, sf_dir):
    """Extracted keys joined to tables, then a cube."""
    spec = {"kind": "seq", "children": [leaf("cust", "int"), leaf("status", "str")]}
    docs = table(spark, sf_dir, "orders").select(F.to_json(F.array(F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")))).alias("doc"))
    rows = plan.extract(docs, "doc", spec, form="json")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # both sides grow with the input, so neither is broadcast, whatever Spark's estimates
    return rows.join(c.hint("merge"), rows["cust"] == c["c_custkey"]).cube("status", F.col("n_name").alias("nation")).agg(count())
