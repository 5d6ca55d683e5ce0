"""Document fingerprints: a Merkle tree over the leaves, paragraphs and sections of a text.

A paragraph is a line. Its leaves are cut where the content says (``LEAF``): after a word
that ends in one of a few letters, or after a full stop, and after ``PIECE`` code points
where there is no such place. So cuts fall into step again after an edit. A paragraph's
hash is over the hashes of its leaves. A section ends at a paragraph whose hash ends in
one of ``ENDS``, a quarter of all; its hash is over those of its paragraphs, and the root is
over those of the sections.

The fingerprint is the tree as text: ``root:section/section/...``, a section being
``hash=paragraph,paragraph,...`` and a paragraph its hash (16 hex digits) and those of its
leaves (8 each). Equal roots mean equal texts. ``likeness`` and ``edits`` descend from the
root: branches with equal hashes are skipped, and only what differs is opened.

Null texts count as empty; an empty text is one paragraph without leaves. Equal texts and
repeated rows have equal fingerprints. An empty table gives an empty result. Columns named
like those that a function adds are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 96
LEAF = r"[^\n]{0,%d}?(?:[a-d][ \t]|[.!?;\u3002\uff01\uff1f])|[^\n]{1,%d}" % (PIECE - 2, PIECE)
#: Last hex digits of the paragraph hashes that end a section.
ENDS = "[048c]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def leaves(text: Column) -> Column:
    """The 64-bit hashes of the leaves of each paragraph: array of arrays of longs."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x)))


def fingerprint(hashes: Column) -> Column:
    """The tree over ``leaves``, as text."""

    def paragraph(hs: Column) -> Column:
        long = F.transform(hs, _hex16)
        return F.concat(_hex16(F.xxhash64(F.array_join(long, ""))), F.array_join(F.transform(long, lambda h: F.right(h, F.lit(8))), ""))

    ended = F.transform(hashes, lambda hs: _let(paragraph(hs), lambda p: F.concat(p, F.when(F.substring(p, 16, 1).rlike(ENDS), "/").otherwise(","))))
    branches = F.filter(F.split(F.array_join(ended, ""), "/", -1), lambda x: x != "")
    named = F.transform(
        F.transform(branches, lambda x: F.rtrim(x, F.lit(","))),
        lambda x: F.concat(_hex16(F.xxhash64(F.array_join(F.transform(F.split(x, ",", -1), lambda p: F.left(p, F.lit(16))), ""))), F.lit("="), x),
    )
    root = lambda s: F.left(F.sha2(F.array_join(F.transform(s, lambda x: F.left(x, F.lit(16))), ""), 256), F.lit(32))
    return _let(named, lambda s: F.concat(root(s), F.lit(":"), F.array_join(s, "/")))


def sections_of(mark: Column) -> Column:
    """The sections of a fingerprint; each begins with its hash."""
    return F.split(F.substring_index(mark, ":", -1), "/", -1)


def paragraphs_of(sections: Column) -> Column:
    """The paragraphs of sections; each begins with its hash."""
    return F.flatten(F.transform(sections, lambda s: F.split(F.substr(s, F.lit(18)), ",", -1)))


def _n_leaves(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + F.floor((F.length(p) - 16) / 8).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1: the part of their leaves that they share, by descent.

    Sections that both have count with all their leaves; of the other sections, paragraphs
    that both have; of the other paragraphs, leaves that both have. What a level repeats
    counts once there. Texts without leaves are alike.
    """

    def descend(x: Column) -> Column:
        sa, sb = x["a"], x["b"]
        common = F.array_intersect(sa, sb)
        rest = lambda m, n: F.array_distinct(paragraphs_of(F.array_except(m, n)))
        return _let(F.struct(_n_leaves(paragraphs_of(common)).alias("n"), rest(sa, sb).alias("a"), rest(sb, sa).alias("b")), paragraphs)

    def paragraphs(x: Column) -> Column:
        rest = lambda m, n: F.array_distinct(
            F.flatten(F.transform(F.array_except(m, n), lambda p: F.regexp_extract_all(F.substr(p, F.lit(17)), F.lit(".{8}"), F.lit(0))))
        )
        n = x["n"] + _n_leaves(F.array_intersect(x["a"], x["b"]))
        return _let(F.struct(n.alias("n"), rest(x["a"], x["b"]).alias("a"), rest(x["b"], x["a"]).alias("b")), dice)

    def dice(x: Column) -> Column:
        every = 2 * x["n"] + F.size(x["a"]) + F.size(x["b"])
        return F.when(every == 0, 1.0).otherwise(2 * (x["n"] + F.size(F.array_intersect(x["a"], x["b"]))) / every)

    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), 1.0).otherwise(
        _let(F.struct(sections_of(a).alias("a"), sections_of(b).alias("b")), descend)
    )


def edits(old: Column, new: Column) -> Column:
    """Where two fingerprints differ, as struct: paragraphs that they share at the head and at the tail, and removed and added ones between.

    Equal sections at both ends are skipped whole, then equal paragraphs of what is left.
    """
    none = F.array().cast("array<string>")

    def shared(x: Column, y: Column) -> Column:
        differ = F.filter(F.transform(x, lambda v, i: F.when(F.coalesce(F.get(y, i) == v, F.lit(False)), None).otherwise(i)), lambda i: i.isNotNull())
        return F.coalesce(F.array_min(differ), F.size(x))

    def ends(x: Column) -> Column:
        """Of a struct (a, b): head, and what is left of both after it and after the tail."""
        head = shared(x["a"], x["b"])
        tail = F.least(shared(F.reverse(x["a"]), F.reverse(x["b"])), F.least(F.size(x["a"]), F.size(x["b"])) - head)
        cut = lambda v, h, t: F.when(F.size(v) > h + t, F.slice(v, h + 1, F.size(v) - h - t)).otherwise(none)
        size = lambda v, h: F.when(h > 0, F.slice(v, F.lit(1), h)).otherwise(none)
        return _let(
            F.struct(head.alias("h"), tail.alias("t")),
            lambda n: F.struct(
                size(x["a"], n["h"]).alias("head"), size(F.reverse(x["a"]), n["t"]).alias("tail"), cut(x["a"], n["h"], n["t"]).alias("a"), cut(x["b"], n["h"], n["t"]).alias("b")
            ),
        )

    def opened(x: Column) -> Column:
        inner = ends(F.struct(paragraphs_of(x["a"]).alias("a"), paragraphs_of(x["b"]).alias("b")))
        return _let(
            inner,
            lambda y: F.struct(
                (F.size(paragraphs_of(x["head"])) + F.size(y["head"])).alias("head"),
                F.size(y["a"]).alias("removed"),
                F.size(y["b"]).alias("added"),
                (F.size(paragraphs_of(x["tail"])) + F.size(y["tail"])).alias("tail"),
            ),
        )

    return _let(ends(F.struct(sections_of(old).alias("a"), sections_of(new).alias("b"))), opened)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``leaves`` and ``fingerprint``."""
    df = docs.withColumn("leaves", leaves(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("fingerprint", fingerprint(F.col("leaves")))


def successors(keys: DataFrame, low: int, high: int, bits: int = 8) -> DataFrame:
    """``keys`` (k, each once, from ``low`` to ``high``) with ``after``: the next larger k, after the last the first.

    Keys are ordered in groups of at most ``2 ** bits``; the groups' own successors link the
    groups, and so on up. No task ever holds more than one group of keys.
    """
    if high - low < 2**bits:
        whole = Window.partitionBy().orderBy("k")
        return keys.withColumn("after", F.coalesce(F.lead("k").over(whole), F.min("k").over(Window.partitionBy())))
    group = F.shiftright("k", bits)
    grouped = keys.withColumn("g", group).withColumn("after", F.lead("k").over(Window.partitionBy("g").orderBy("k")))
    firsts = keys.groupBy(group.alias("g")).agg(F.min("k").alias("first"))
    linked = successors(firsts.select(F.col("g").alias("k")), low >> bits, high >> bits, bits)
    first = linked.join(firsts, linked["after"] == firsts["g"]).select(F.col("k").alias("of"), "first")
    return grouped.join(first, grouped["g"] == first["of"]).select("k", F.coalesce("after", "first").alias("after"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 8) -> DataFrame:
    """``docs`` with ``next_text``: that of the next document by id, after the last the first.

    Texts move once: to the group of ``2 ** bits`` neighbouring ids, where a window finds the
    next. Only the first text of each group moves once more, to the group before. Null ids come
    first; equal ids follow their texts, and a null text is a next text like any other. All rows
    of one id stand in one group, which a window sorts on disk where it must: ids are meant to be
    those of one document each.
    """
    at = F.col(f"`{doc_id}`")
    ends = docs.agg(F.min(at), F.max(at)).first()
    low, high = ((ends[0] or 0) >> bits) - 1, (ends[1] or 0) >> bits
    rows = docs.select(
        F.struct("*").alias("row"), at.alias("id"), F.struct(F.col(f"`{text}`").alias("text")).alias("own"), F.coalesce(F.shiftright(at.cast("long"), bits), F.lit(low)).alias("bucket")
    )
    order = Window.partitionBy("bucket").orderBy(F.col("id").asc_nulls_first(), "own.text")
    heads = rows.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("bucket").alias("at"), F.col("own").alias("head"))
    links = successors(rows.select(F.col("bucket").alias("k")).distinct(), low, high, bits)
    heads = links.join(heads, links["after"] == heads["at"]).select("k", "head")
    rows = rows.withColumn("after", F.lead("own").over(order))
    rows = rows.join(heads, (rows["bucket"] == heads["k"]) & rows["after"].isNull(), "left")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "next_text"), F.coalesce("after", "head")["text"].alias("next_text"))


def op3_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    mark = lambda c: fingerprint(leaves(F.col(c)))
    # nested, so that each tree is built once
    df = df.withColumn("edited", edited).withColumn("m", F.array(F.struct(mark("text").alias("a"), mark("edited").alias("b"), mark("next_text").alias("c"))))
    made = F.transform("m", lambda m: F.struct(m["a"].alias("fingerprint"), m["b"].alias("edited_fingerprint"), likeness(m["a"], m["b"]).alias("near_edited"), likeness(m["a"], m["c"]).alias("near_next")))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.element_at(made, 1).alias("made"))
    return df.select("doc_id", "n_chars", "edited_sha256", "made.*")
