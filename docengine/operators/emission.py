"""Documents as text again, and changed, from the nodes table: tokens put in order by document.

Every node gives a token where it opens, and a container one where it closes, after its last
descendant (``last_id``). Tokens are sorted and joined within their document, which is the only
thing that meets in a task. Changes are joined to nodes by path: a node that goes takes its
subtree along, what is new is a token at the end of its container, and separators follow from
what is left. Aliases are written as null. An empty nodes table gives no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import resolve as R

DOC = ["doc_index"]


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def scalar_json() -> Column:
    """A scalar of the nodes table as JSON: numbers and words by the value that the reader typed, else a string; numbers that JSON has not are strings."""
    t, n, real = F.col("text"), F.col("tag_id"), F.col("d")
    integer = F.coalesce(F.col("i").cast("string"), F.when(t.rlike(r"\A-?[1-9][0-9]*\z"), t), quoted(t))
    word = F.when(F.isnan(real), '".nan"').when(real == float("inf"), '".inf"').when(real == -float("inf"), '"-.inf"')
    plain = F.regexp_replace(F.lower(F.to_json(F.array(real))), r"\A\[(.*)\]\z", "$1")
    # an exponent has a sign and two digits
    plain = F.regexp_replace(F.regexp_replace(plain, r"e([0-9])", "e+$1"), r"e([-+])([0-9])\z", "e$10$2")
    return (
        F.when(n == R.NULL, "null")
        .when((n == R.BOOL) & F.col("b").isNotNull(), F.col("b").cast("string"))
        .when(n == R.INT, integer)
        .when((n == R.FLOAT) & real.isNotNull(), F.coalesce(word, plain))
        .otherwise(quoted(t))
    )


def changed(nodes: DataFrame, edits: DataFrame, doc: list[str] = DOC) -> DataFrame:
    """``nodes`` after ``edits`` (any of ``doc``, then path, op, name, json): of each path one edit.

    op set: the node at path becomes the value ``json``; del: it goes, with its key; add: a pair
    ``name`` (of a mapping) or an item (of a sequence, name null) comes at the end. Edits with columns
    of ``doc`` hold for their document, others for all. The result has a column ``made``: a value
    as JSON text, in place of a node's own.
    """
    by = [c for c in doc if c in edits.columns]
    key = [*by, "path"]
    whole = nodes.withColumn("made", F.lit(None).cast("string"))
    few = edits.limit(FEW + 1).collect() if not by else []
    if few and len(few) <= FEW:
        return _changed_by_few(whole, few, doc)
    gone = edits.where("op in ('set', 'del')").select(*by, F.col("path").alias("__top"), "op", "json")
    steps = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    tops = whole.select("*", F.explode(above).alias("__top")).join(gone, [*by, "__top"])
    # what is set stays as one token; its key stays as well
    hit = tops.groupBy(*doc, "node_id").agg(F.min_by(F.struct("__top", "op", "json"), F.length("__top")).alias("__hit"))
    rows = whole.join(hit, [*doc, "node_id"], "left")
    itself = F.col("path") == F.col("__hit.__top")
    is_set = (F.col("__hit.op") == "set") & itself
    stays = F.col("__hit").isNull() | (is_set & F.col("role").isin("key", "value", "item", "root"))
    rows = rows.where(stays).withColumn("made", F.when(is_set & (F.col("role") != "key"), F.col("__hit.json"))).drop("__hit")
    rows = rows.withColumns({"kind": F.when(F.col("made").isNotNull(), "scalar").otherwise(F.col("kind")), "last_id": F.when(F.col("made").isNotNull(), F.col("node_id")).otherwise(F.col("last_id"))})
    added = edits.where("op = 'add'").select(*key, F.col("name").alias("__name"), F.col("json").alias("__json"))
    boxes = nodes.where("kind in ('map', 'seq') and role <> 'key'").join(added, key)
    last = F.lit(1 << 30)
    fresh = boxes.select(
        *doc, F.col("last_id").alias("node_id"), F.col("node_id").alias("parent_id"), last.alias("ord"), F.when(F.col("kind") == "map", "value").otherwise("item").alias("role"), F.col("__name").alias("key"),
        F.concat("path", F.lit("/"), F.coalesce("__name", F.lit("-"))).alias("path"), (F.col("depth") + 1).alias("depth"), F.lit("scalar").alias("kind"), F.col("last_id"), F.col("__json").alias("made"),
    )
    return rows.unionByName(fresh, allowMissingColumns=True)


#: Edits for all documents that are one expression, without joins.
FEW = 32


def _changed_by_few(whole: DataFrame, edits: list, doc: list[str]) -> DataFrame:
    """``changed`` for a short list of edits that hold for all documents: conditions on the path, in one pass over the nodes."""
    path, role = F.col("path"), F.col("role")
    found = F.lit(None).cast("struct<path:string,op:string,json:string>")
    for e in sorted((e for e in edits if e["op"] in ("set", "del")), key=lambda e: -len(e["path"])):
        value = F.struct(F.lit(e["path"]).alias("path"), F.lit(e["op"]).alias("op"), F.lit(e["json"]).cast("string").alias("json"))
        # the shortest path is asked first
        found = F.when((path == e["path"]) | path.startswith(e["path"] + "/"), value).otherwise(found)
    rows = whole.withColumn("__hit", found)
    is_set = (F.col("__hit.op") == "set") & (path == F.col("__hit.path"))
    rows = rows.where(F.col("__hit").isNull() | is_set).withColumn("made", F.when(is_set & (role != "key"), F.col("__hit.json"))).drop("__hit")
    set_ = F.col("made").isNotNull()
    adds = [e for e in edits if e["op"] == "add"]
    # a box comes once for itself (-1) and once for each addition, by its number
    box = F.col("kind").isin("map", "seq") & (role != "key") & ~set_
    hits = [F.when(box & (path == e["path"]), F.lit(i)) for i, e in enumerate(adds)]
    rows = rows.withColumn("__add", F.explode(F.array_compact(F.array(F.lit(-1), *hits))))
    own = {"kind": F.when(set_, "scalar").otherwise(F.col("kind")), "last_id": F.when(set_, F.col("node_id")).otherwise(F.col("last_id"))}
    name = F.get(F.array(*(F.lit(e["name"]).cast("string") for e in adds), F.lit(None).cast("string")), F.col("__add"))
    json = F.get(F.array(*(F.lit(e["json"]).cast("string") for e in adds), F.lit(None).cast("string")), F.col("__add"))
    new = {
        "node_id": F.col("last_id"), "parent_id": F.col("node_id"), "last_id": F.col("last_id"), "ord": F.lit(1 << 30), "role": F.when(F.col("kind") == "map", "value").otherwise("item"), "key": name,
        "path": F.concat(path, F.lit("/"), F.coalesce(name, F.lit("-"))), "depth": F.col("depth") + 1, "kind": F.lit("scalar"), "made": json,
    }
    column = lambda c, t: F.when(F.col("__add") < 0, own.get(c, F.col(c))).otherwise(new.get(c, F.lit(None)).cast(t)).alias(c)
    return rows.select(*doc, *(column(f.name, f.dataType) for f in whole.schema if f.name not in doc))


def text_of(nodes: DataFrame, doc: list[str] = DOC, colon: str = ":", comma: str = ",", indent: int | None = None, head: str = "", tail: str = "") -> DataFrame:
    """(doc, text): each document of ``nodes`` as JSON text; with ``indent`` over several lines.

    ``head`` and ``tail`` go around it: ``---`` and a line feed with spaced separators is canonical YAML.
    """
    rows = nodes if "made" in nodes.columns else nodes.withColumn("made", F.lit(None).cast("string"))
    added = F.col("ord") == 1 << 30
    # a pair is known by its key; one that was added has no row of its own for the key
    rows = rows.where("role <> 'key'")
    line = lambda depth: F.lit("") if indent is None else F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), depth))
    between = comma.rstrip() if indent is not None else comma
    # every child has a separator behind a mark that no JSON text holds; those after an opening bracket go at the end
    separator = F.when(F.col("parent_id").isNull(), "").otherwise(F.concat(F.lit("\x01" + between), line(F.col("depth"))))
    named = F.when(F.col("role") == "value", F.concat(quoted(F.col("key")), F.lit(colon))).otherwise("")
    value = F.when(F.col("made").isNotNull(), F.col("made")).when(F.col("kind") == "map", "{").when(F.col("kind") == "seq", "[").when(F.col("kind") == "alias", "null").otherwise(scalar_json())
    close = F.when(F.col("kind") == "map", "}").when(F.col("kind") == "seq", "]")
    filled = rows.where("parent_id is not null").select(*doc, F.col("parent_id").alias("node_id")).distinct().withColumn("__filled", F.lit(True))
    rows = rows.join(filled, [*doc, "node_id"], "left") if indent is not None else rows.withColumn("__filled", F.lit(True))
    end = F.concat(F.when(F.coalesce("__filled", F.lit(False)), line(F.col("depth"))).otherwise(""), close)
    # after a node come its descendants, what was added to it, and its end; of ends the innermost first
    opening = F.struct(F.col("node_id").alias("at"), F.when(added, 1).otherwise(0).alias("phase"), F.when(added, -F.col("depth") * 4 + 2).otherwise(0).alias("rank"), F.concat(separator, named, value).alias("token"))
    closing = F.struct(F.col("last_id").alias("at"), F.lit(1).alias("phase"), (-F.col("depth") * 4 - 1).alias("rank"), end.alias("token"))
    tokens = rows.select(*doc, F.explode(F.array_compact(F.array(opening, F.when(close.isNotNull() & F.col("made").isNull(), closing)))).alias("t"))
    joined = tokens.groupBy(*doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]), "").alias("text"))
    text = F.col("text")
    for bracket in "{[":
        text = F.replace(text, F.lit(f"{bracket}\x01{between}"), F.lit(bracket))
    return joined.select(*doc, F.concat(F.lit(head), F.replace(text, F.lit("\x01"), F.lit("")), F.lit(tail)).alias("text"))
