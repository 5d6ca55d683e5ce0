"""Navigation, typed access and set-based rules on the nodes table.

``doc`` names the columns that identify a document; every operator is a projection,
filter, equi-join or window on them, so Spark partitions by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import resolve as R
from docengine.shared import materialize

DOC = ["doc_index"]


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("role = 'root'")


def document_count(nodes: DataFrame, by: list[str]) -> DataFrame:
    return roots(nodes).groupBy(*by).agg(F.count(F.lit(1)).alias("documents"))


def children(nodes: DataFrame, parent_path: str) -> DataFrame:
    """Direct children of the node at a path, in order."""
    return nodes.where(is_child(parent_path))


def subtree(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(is_in(path))


def pointer(nodes: DataFrame, text: str) -> DataFrame:
    """The node at an RFC 6901 pointer, also in its percent-encoded form; of repeated keys the first."""
    from urllib.parse import unquote

    return nodes.where(is_at(unquote(text.removeprefix("#"))))


def map_get(nodes: DataFrame, key: str, doc: list[str] = DOC) -> DataFrame:
    """For each mapping the first value under ``key``."""
    first = Window.partitionBy(*doc, "parent_id").orderBy("ord")
    return nodes.where(is_value_of(key)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def map_at(nodes: DataFrame, i: int) -> DataFrame:
    """Key and value rows of pair ``i`` of each mapping."""
    return nodes.where(is_pair(i))


def seq_at(nodes: DataFrame, i: int) -> DataFrame:
    return nodes.where(is_item(i))


def counts(nodes: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """Number of items or pairs of each container that has any."""
    kids = nodes.where("parent_id is not null and role <> 'key'").groupBy(*doc, F.col("parent_id").alias("node_id"))
    return kids.agg(F.count(F.lit(1)).alias("n"))


def as_int(n: str = "tag_id", text: str = "text") -> Column:
    return F.when(F.col(n) == R.INT, R.to_int_column(F.col(text)))


def as_float(n: str = "tag_id", text: str = "text") -> Column:
    return F.when(F.col(n).isin(R.INT, R.FLOAT), R.to_float_column(F.col(text)))


def as_bool(n: str = "tag_id", text: str = "text") -> Column:
    return F.when(F.col(n) == R.BOOL, R.to_bool_column(F.col(text), True))


def resolve_aliases(nodes: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """Alias rows with what they stand for: the last node of that anchor before them in the document."""
    seen = Window.partitionBy(*doc, "__name").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    named = nodes.withColumn("__name", F.when(F.col("kind") == "alias", F.col("text")).otherwise(F.col("anchor"))).where("__name is not null")
    target = F.last(F.when(F.col("kind") != "alias", F.col("node_id")), ignorenulls=True).over(seen)
    aliases = named.withColumn("target_id", target).where("kind = 'alias'").select(*doc, "node_id", "path", F.col("text").alias("name"), "target_id")
    real = nodes.select(*doc, F.col("node_id").alias("target_id"), F.col("kind").alias("target_kind"), F.col("path").alias("target_path"), F.col("text").alias("target_text"))
    return aliases.join(real, [*doc, "target_id"], "left")


def callbacks(nodes: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """(doc, e) for each callback of a visitor, with its place: e (at, rank, event, text) sorts in the visitor's order.

    Scalars by type, key, seq+, seq-, map+, map-. A container ends after its last descendant, the innermost first.
    A key that is a collection is visited like a value.
    """
    word = F.create_map(*(F.lit(x) for pair in ((R.NULL, "null"), (R.BOOL, "bool"), (R.INT, "int"), (R.FLOAT, "float")) for x in pair))
    scalar = F.when(F.col("role") == "key", "key").otherwise(F.coalesce(F.try_element_at(word, "tag_id"), F.lit("str")))
    kind = F.col("kind")
    box = kind.isin("map", "seq")
    opening = F.struct(F.col("node_id").alias("at"), F.lit(0).alias("rank"), F.when(box, F.concat(kind, F.lit("+"))).when(kind == "alias", "alias").otherwise(scalar).alias("event"), "text")
    closing = F.struct(F.col("last_id").alias("at"), (F.lit(1 << 20) - F.col("depth")).alias("rank"), F.concat(kind, F.lit("-")).alias("event"), F.lit(None).cast("string").alias("text"))
    return nodes.select(*doc, F.explode(F.array_compact(F.array(opening, F.when(box, closing)))).alias("e"))


def callback() -> Column:
    """Place and name of a row of ``callbacks``: what groupings of a document collect and sort, without a window."""
    return F.struct("e.at", "e.rank", "e.event")


def visit(nodes: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """(doc, seq, event, text): the ``callbacks`` of each document, numbered in order."""
    rows = callbacks(nodes, doc)
    order = Window.partitionBy(*doc).orderBy("e.at", "e.rank")
    return rows.select(*doc, (F.row_number().over(order) - 1).alias("seq"), "e.event", "e.text")


def equal_text() -> Column:
    """A text that is equal for equal scalars of the nodes table: numbers by value (1 and 1.0), as 64-bit integers where they are such; all else by tag and text.

    Values are those that the reader typed (``i``, ``d``); only integers beyond 64 bits are converted here.
    """
    text = F.coalesce("text", F.lit(""))
    clean = F.regexp_replace(text, "[_,]", "")
    place = lambda i: F.coalesce(F.get(F.split(clean, ":"), F.lit(i)).try_cast("double"), F.lit(0.0))
    large = F.when(clean.rlike(r"\A[-+]?[0-9]+\z"), clean.try_cast("double")).when(clean.contains(":"), place(0) * 3600 + place(1) * 60 + place(2))
    as_double = F.coalesce("d", F.when((F.col("tag_id") == R.INT) & F.col("i").isNull(), large))
    # a double that is an integer of 64 bits has its spelling
    real = F.transform(F.array(as_double), lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 2.0**63), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")))[0]
    number = F.coalesce(F.col("i").cast("string"), real, text)
    return F.when(F.col("tag_id").isin(R.INT, R.FLOAT), F.concat(F.lit("n"), number)).otherwise(F.concat(F.lit("s"), F.col("tag_id").cast("string"), F.lit(":"), text))


def node_hashes(nodes: DataFrame, doc: list[str] = DOC, of: DataFrame | None = None) -> DataFrame:
    """(doc, node_id, hash): equal for equal subtrees, whatever the order of mappings' pairs.

    ``of`` (doc, node_id) names the nodes that are wanted, all by default. Each node goes to its
    ancestors by its path, so a subtree of n nodes at depth d moves n rows for each wanted ancestor,
    in one grouping; a hash is over the sorted places, kinds and scalars below it. Aliases count by name.
    """
    tops = nodes if of is None else nodes.join(of, [*doc, "node_id"], "left_semi")
    tops = tops.select(*doc, F.col("node_id").alias("top"), F.col("path").alias("top_path"), F.col("role").alias("top_role"))
    steps = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    below = nodes.select(*doc, "path", "role", "kind", "tag_id", "text", "i", "d", F.explode(above).alias("top_path"))
    # a key has the path of its value, and does not belong to it, nor what is in a key that is a collection
    found = below.join(tops, [*doc, "top_path"]).where((F.col("path") != F.col("top_path")) | (F.col("role") == F.col("top_role")))
    place = F.substr("path", F.length("top_path") + 1)
    inner = F.when(F.col("path") == F.col("top_path"), "").otherwise(F.col("role"))
    entry = F.concat_ws("\x01", place, inner, "kind", F.when(F.col("kind") == "scalar", equal_text()).otherwise(F.coalesce("text", F.lit(""))))
    return found.groupBy(*doc, F.col("top").alias("node_id")).agg(F.xxhash64(F.array_join(F.sort_array(F.collect_list(entry)), "\x02")).alias("hash"))


def duplicate_keys(nodes: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """A row for each key that an equal key of its mapping precedes: scalars by ``equal_text``, collections by ``node_hashes``.

    Nodes are read several times, so they are written once; without keys that are collections only scalars are compared.
    """
    nodes = materialize(nodes, "nodes")
    order = Window.partitionBy(*doc, "parent_id", "__same").orderBy("ord")
    keys = nodes.where("role = 'key'")
    scalars = keys.where("kind <> 'seq' and kind <> 'map'").withColumn("__same", equal_text())
    complex_ = keys.where("kind = 'seq' or kind = 'map'")
    numbered = lambda d: d.withColumn("__n", F.row_number().over(order)).where("__n > 1").drop("__n", "__same")
    if complex_.isEmpty():
        return numbered(scalars)
    # what stands in a key has its path; the row of the key itself is told from the value's by its role
    named = node_hashes(nodes, doc, complex_.select(*doc, "node_id")).withColumn("__same", F.concat(F.lit("c"), F.col("hash").cast("string"))).drop("hash")
    both = scalars.unionByName(complex_.join(named, [*doc, "node_id"]).select(*scalars.columns))
    return numbered(both)


def picked(nodes: DataFrame, by: list[str], **found: Column) -> DataFrame:
    """One row for each group of ``by``, with a column for each of ``found``: its value on the first node where it is not null.

    Several questions about a document are one pass over its nodes and one grouping.
    """
    return nodes.groupBy(*by).agg(*(F.min_by(v, F.when(v.isNotNull(), F.col("node_id"))).alias(k) for k, v in found.items()))


def is_value_of(key: str) -> Column:
    """The condition of ``map_get``, without its choice of the first."""
    return (F.col("role") == "value") & (F.col("key") == key)


def is_at(pointer: str) -> Column:
    return (F.col("path") == pointer) & (F.col("role") != "key")


def is_in(path: str) -> Column:
    """The condition of ``subtree``."""
    return (F.col("path") == path) | F.col("path").startswith(path + "/")


def is_child(parent_path: str) -> Column:
    depth = parent_path.count("/") + 1
    return (F.col("depth") == depth) & F.col("path").startswith(parent_path + "/") & (F.col("role") != "key")


def is_pair(i: int) -> Column:
    return F.col("role").isin("key", "value") & F.col("ord").isin(2 * i, 2 * i + 1)


def is_item(i: int) -> Column:
    return (F.col("role") == "item") & (F.col("ord") == i)


def is_tag_mismatch(family: str = "core") -> Column:
    found = R.resolve_column(F.col("text"), family)
    fits = (found == F.col("tag_id")) | ((F.col("tag_id") == R.FLOAT) & (found == R.INT))
    return (F.col("kind") == "scalar") & F.col("tag").isNotNull() & F.col("tag_id").between(R.INT, R.NULL) & ~fits


def tag_mismatches(nodes: DataFrame, family: str = "core") -> DataFrame:
    """Scalars whose explicit tag contradicts what their text is in the family."""
    return nodes.where(is_tag_mismatch(family))


def json_code() -> Column:
    """2 for a key that is no string, 3 for a tag or plain text without a JSON type, else null."""
    odd_key = (F.col("role") == "key") & ((F.col("kind") != "scalar") | (F.col("tag_id") != R.STR))
    odd_tag = F.col("tag_id").isin(R.TIMESTAMP, R.BINARY, R.MERGE, R.VALUE, R.CUSTOM)
    bare = (F.col("style") == 1) & F.col("tag").isNull() & (F.col("tag_id") == R.STR)
    return F.when(odd_key, 2).when((F.col("role") != "key") & (F.col("kind") == "scalar") & (odd_tag | bare), 3)


def not_json(nodes: DataFrame) -> DataFrame:
    """Nodes that JSON has not, with their ``json_code``."""
    return nodes.withColumn("code", json_code()).where("code is not null")


def text_statistics(text: Column) -> Column:
    """Counts of character classes of a text, as struct."""
    n = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    return F.struct(
        F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"), n("\\n").alias("breaks"), n("\\t").alias("tabs"),
        n(" ").alias("spaces"), n("0-9").alias("digits"), n("\"'").alias("quotes"), n("\\\\").alias("escapes"), n("{}\\[\\],:").alias("marks"),
    )
