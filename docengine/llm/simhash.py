"""Near-duplicates by SimHash, linked by bit-sliced comparison.

Fingerprints: a text is lower-cased (A-Z), cut into words, and its 3-word shingles,
repeats included, are hashed (XXH64, seed 42). A bit of the fingerprint is set if it is
set in over half the hashes. Texts of fewer words are one shingle; a text without words
(also null or empty) has fingerprint zero, which links like any other.

Links: two fingerprints link at ``RADIUS`` or fewer differing bits. Equal fingerprints
are one vertex, so copies cost nothing. Fingerprints are cut into ``RADIUS + k`` blocks;
two that link agree on k blocks whole, so they meet in the bucket of those. k grows with
the number of fingerprints, which keeps buckets small: 4 buckets each of 16 bits for k = 1,
10 of 25 bits for k = 2, 20 of 32 bits for k = 3. In a bucket, fingerprints stand in groups of 64 as 64 bit planes of one machine word each.
A fingerprint is compared with a group at once: its bits, spread over a word, are
combined with the planes by XOR, and the differing bits are added by carry-save
counters, one lane a fingerprint. After each eighth plane, pairs of fingerprint and
group of which all lanes exceed the radius are abandoned.

A bucket never becomes one task's burden: buckets over ``SPLIT`` fingerprints are cut
into parts, and each pair of parts is a task of its own. A task reduces the links it
finds to a forest, so a bucket of n fingerprints yields under n links a task, not n
squared, and no link between different components is lost.

Components: least reachable ids spread along the links, with pointer jumping, in rounds
of joins and aggregations over written tables, until nothing changes.

This is the contract of op1. ``near_duplicates``, of the pipeline, links all pairs of texts with a
Jaccard similarity of their sets of 5-word shingles of 0.8. These differ in about 10 of 64 bits, where
blocks of a fingerprint are too short to be keys. Its buckets are therefore the sets that share a hash of
their prefixes (see ``marked``), where all such pairs meet. In a bucket SimHashes of 128 bits are
compared, bit-sliced as above, at a radius of 40: a pair of similarity 0.8 differs in 19.4 bits
on average, and is over the radius with a chance of about 2 in a million. Pairs within it are checked by
their sets. First each set meets only two others of its bucket. What buckets still connect by close SimHashes
is then a group: all pairs of its different components are compared in tasks that hold the sets, first
by SimHash, then by an exact bound, then by the sets, and only a forest of links leaves a task.

Repeated rows and ties: equal texts are one vertex and come back row by row. An empty table gives an
empty result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.batches import bounded
from docengine.shared import broadcast_if, holding, materialize, release

#: Words of a shingle and differing bits of a link of the fingerprints of op1.
SHINGLE = 3
SEED = 42
RADIUS = 3
#: Words of a shingle and least Jaccard similarity of near duplicates.
WORDS = 5
SIMILARITY = 0.8
#: Bits of 128 in which the SimHashes of two sets of that similarity differ at most.
WIDE_RADIUS = 40
#: Bytes of one batch that goes back to Spark.
BATCH = 4 << 20
#: Sets of shingles that are counted, and shingles kept, to know the frequent ones.
COUNTED = 2_000
FREQUENT = 10_000
#: Rows of a table that is broadcast.
BROADCAST = 1_000_000
#: Fingerprints of a bucket that one task compares with themselves or with those of another part.
SPLIT = 2048
#: Pairs of fingerprint and group held at once.
CHUNK = 1 << 15


def shingles(text: str | None, words: int = SHINGLE):
    """The hashes of a text's shingles, repeats included; empty for a text without words."""
    import re

    import numpy as np
    from xxhash import xxh64_intdigest

    upper = bytes(range(65, 91))
    raw = (text or "").encode("utf-8").translate(bytes.maketrans(upper, upper.lower()))
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if len(found) < words:
        parts = [b" ".join(found)] if found else []
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.array([xxh64_intdigest(s, SEED) for s in parts], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text."""
    import numpy as np

    hashes = shingles(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long, column ``out``."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return pa.array([signed(fingerprint(x.as_py())) for x in texts], pa.int64())

    return docs.withColumn(out, of(F.col(text)))


def _words(values):
    """Fingerprints as an array of shape (n, words of 64 bits)."""
    return values.reshape(len(values), -1)


def _planes(values, groups: int):
    """Bit planes of ``values`` (groups * 64 fingerprints): planes[b][g] has bit b of the fingerprints of group g, one lane each."""
    import numpy as np

    n = values.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(groups, 64, 8 * n), axis=2, bitorder="little")
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64 * n, groups, 8).copy().view("<u8")[:, :, 0]


def sliced_links(first, second, same: bool, radius: int = RADIUS):
    """Pairs (i, j) of positions in two arrays of fingerprints that differ in ``radius`` bits or fewer, in chunks.

    Fingerprints are uint64, or rows of several. With ``same``, both are one array and pairs have i < j.
    """
    import numpy as np

    first, second = _words(first), _words(second)
    n, m = len(first), len(second)
    groups = -(-m // 64)
    padded = np.zeros((groups * 64, second.shape[1]), dtype=np.uint64)
    padded[:m] = second
    planes = _planes(padded, groups)
    lanes = np.full(groups, ~np.uint64(0))
    if m % 64:
        lanes[-1] = np.uint64((1 << (m % 64)) - 1)
    per = max(1, CHUNK // max(1, groups))
    for start in range(0, n, per):
        stop = min(n, start + per)
        low = start // 64 if same else 0
        rows = np.repeat(np.arange(start, stop), groups - low)
        at = np.tile(np.arange(low, groups), stop - start)
        if same:
            keep = at >= rows // 64
            rows, at = rows[keep], at[keep]
        yield from _compare(first, planes, lanes, rows, at, radius, same)


def _compare(first, planes, lanes, rows, at, radius, same):
    """Of fingerprints ``rows`` and groups ``at``, side by side: the pairs of fingerprint and lane within the radius."""
    import numpy as np

    zero, one = np.uint64(0), np.uint64(1)
    values, total = first[rows], planes.shape[0]
    over = ~lanes[at]
    # carry-save counters: a lane's count is the sum of 2**k of its bits, until it is over for good
    counts = [np.zeros_like(over) for _ in range(radius.bit_length())]
    for bit in range(total):
        wave = planes[bit][at] ^ (zero - ((values[:, bit // 64] >> np.uint64(bit % 64)) & one))
        for count in counts:
            carry = count & wave
            count ^= wave
            wave = carry
        over |= wave
        if bit + 1 == total or bit % 8 == 7 and bit > 2 * radius:
            live = ~(over | _exceeds(counts, radius)) != 0
            if not live.any():
                return
            if live.mean() < 0.7:
                rows, at, values, over, *counts = (x[live] for x in (rows, at, values, over, *counts))
    near = (~(over | _exceeds(counts, radius))).astype("<u8")
    hit = np.nonzero(near)[0]
    for k in range(0, len(hit), 4096):
        part = hit[k : k + 4096]
        lit = np.unpackbits(near[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(lit)
        i, j = rows[part[i]], at[part[i]] * 64 + lane
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _exceeds(counts, radius):
    """Lanes whose count is over the radius, by comparing bits from the highest down."""
    import numpy as np

    greater, equal = np.zeros_like(counts[0]) if counts else np.uint64(0), ~np.uint64(0)
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            greater = greater | (equal & counts[k])
            equal = equal & ~counts[k]
    return greater


class Forest:
    """Components of positions 0..n-1, kept as roots; the least position is the root."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def add(self, a, b) -> None:
        import numpy as np

        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            root[np.maximum(x, y)] = np.minimum(x, y)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def bucket_links(keys, values, radius: int = RADIUS):
    """Pairs (i, j), i < j, of positions with equal ``keys`` (which stand together) within the radius, in chunks.

    Buckets of up to 64 share one pass over all their rows: each has one word of planes.
    """
    import numpy as np

    values = _words(values)
    cut = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
    sizes = np.diff(cut)
    # single rows have no partner
    for k in np.nonzero(sizes > 64)[0]:
        part = values[cut[k] : cut[k + 1]]
        for i, j in sliced_links(part, part, True, radius):
            yield cut[k] + i, cut[k] + j
    few = np.nonzero((sizes > 1) & (sizes <= 64))[0]
    for part in np.array_split(few, max(1, -(-int(sizes[few].sum()) // CHUNK))) if len(few) else []:
        size = sizes[part]
        which = np.repeat(np.arange(len(part)), size)
        lane = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        rows = np.repeat(cut[part], size) + lane
        padded = np.zeros((len(part), 64, values.shape[1]), dtype=np.uint64)
        padded[which, lane] = values[rows]
        planes = _planes(padded.reshape(-1, values.shape[1]), len(part))
        lanes = np.where(size == 64, ~np.uint64(0), (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
        first = np.cumsum(size) - size
        for i, j in _compare(values[rows], planes, lanes, np.arange(len(rows)), which, radius, False):
            # lane numbers become positions; a pair is seen from both sides, and each row from itself
            j = first[which[i]] + j % 64
            yield rows[i[i < j]], rows[j[i < j]]


def whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """The columns ``names`` of sorted ``batches`` as arrays, in chunks that end where a bucket (the first column) ends."""
    import numpy as np

    held: list = []
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in names])
        if sum(len(x[0]) for x in held) >= 1 << 16:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = columns[0]
            whole = int(np.nonzero(key != key[-1])[0][-1]) + 1 if key[0] != key[-1] else 0  # the last bucket may go on
            if whole:
                yield [x[:whole] for x in columns]
            held = [[x[whole:] for x in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _forest_batch(values, pairs) -> pa.RecordBatch:
    """Links (a, b) of a forest over positions of ``values``."""
    import numpy as np

    forest = Forest(len(values))
    for i, j in pairs:
        forest.add(i, j)
    child = np.nonzero(forest.root != np.arange(len(values)))[0]
    a, b = values[child], values[forest.root[child]]
    return pa.record_batch([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])


def small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), a bucket's rows together: links within each bucket."""
    import numpy as np

    for keys, fps in whole_buckets(batches, ["key", "fp"]):
        values = fps.view(np.uint64)
        yield _forest_batch(values, bucket_links(keys, values))


def _parts(part, values, radius: int):
    """Pairs of positions within the radius: of one part with itself, or of two with one another."""
    import numpy as np

    parts = np.unique(part)
    if len(parts) < 2:
        yield from sliced_links(values, values, True, radius)
        return
    left, right = np.nonzero(part == parts[0])[0], np.nonzero(part == parts[1])[0]
    for i, j in sliced_links(values[left], values[right], False, radius):
        yield left[i], right[j]


def part_pair(table: pa.Table) -> pa.Table:
    """One pair of parts of a large bucket: its links."""
    import numpy as np

    part, values = table.column("part").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    return pa.Table.from_batches([_forest_batch(values, _parts(part, values, RADIUS))])


def masks(agree: int, radius: int = RADIUS) -> list[int]:
    """Bits of each choice of ``agree`` of ``radius + agree`` blocks of a fingerprint, as signed longs."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    whole = [sum(block[i] for i in chosen) for chosen in combinations(range(n), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def links(fps: DataFrame, split: int = SPLIT, agree: int | None = None) -> DataFrame:
    """Links (a, b) that connect the different fingerprints ``fps`` (fp) as all pairs within the radius would."""
    if agree is None:
        n = fps.count()
        agree = 1 if n <= 1 << 24 else 2 if n <= 1 << 33 else 3
    # keys that collide only merge buckets
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(agree))]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    few, many = parted(rows, "fp", split)
    return few.mapInArrow(small_buckets, schema).unionByName(many.groupBy("key", "x", "y").applyInArrow(part_pair, schema))


def parted(rows: DataFrame, value: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, ...) of buckets of ``split`` or fewer, each together and sorted, and those of larger ones.

    The latter are dealt into parts by a hash of ``value``; a part meets itself and each
    other part in a group (key, x, y) of its own.
    """
    large = rows.groupBy("key").count().where(F.col("count") > split).select("key", F.ceil(F.col("count") / split).cast("int").alias("parts"))
    large = broadcast_if(materialize(large, "large-buckets"), 100_000)
    few = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    many = rows.join(large, "key").withColumn("part", F.pmod(F.xxhash64(value), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    many = many.withColumn("pair", F.explode(pairs)).select(*rows.columns, "part", "pair.x", "pair.y")
    return few, many


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(v, root) for each vertex of ``edges``: root is the least vertex that it reaches.

    Each round gives a vertex the least root among its own and its neighbours', hangs roots
    under lesser roots that way, and jumps to the root's root.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w"))).where("v <> w")
    both = materialize(both.distinct(), "links")
    state = materialize(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("root")), "roots")
    for _ in range(max_rounds):
        # the least root next to each vertex
        near = both.join(state.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        seen = state.join(near, "v").select("v", "root", F.least("root", "near").alias("best"))
        # it also counts for the vertex's root
        hung = seen.groupBy(F.col("root").alias("v")).agg(F.min("best").alias("hung"))
        low = seen.join(hung, "v", "left").select("v", "root", F.least("best", F.coalesce("hung", "best")).alias("low"))
        low = materialize(low, "roots")
        jump = low.select(F.col("v").alias("low"), F.col("low").alias("up"))
        fresh = low.join(jump, "low", "left").select("v", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("old"))
        fresh = materialize(fresh, "roots")
        release(low, state)
        if not fresh.where("root <> old").limit(1).count():
            release(both)
            return fresh.select("v", "root")
        state = fresh
    raise RuntimeError("components did not settle")


def near_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``, linked by fingerprints; component_id is the least id of the component.

    Rows with equal ids count as one document; a null id is no component's name unless no other is there.
    """
    marked = materialize(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    # a document whose id stands on several rows connects their fingerprints
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    twice = marked.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    shared = marked.join(twice.select("doc_id", F.col("a").alias("a")), "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    found = links(firsts.select("fp")).unionByName(shared)
    roots = components(found).withColumnRenamed("v", "fp")
    of = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialize(of.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def marks_of(text: str | None, words: int):
    """Of a text's set of shingles: (hash of the set, two words of its SimHash, the sorted hashes)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    hashes = np.unique(shingles(text, words))
    if not len(hashes):
        return 0, 0, 0, hashes
    # the second word takes its bits from the hashes mixed once more
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    both = np.stack([hashes, mixed ^ (mixed >> np.uint64(29))], axis=1)
    ones = np.zeros(128, dtype=np.int64)
    for i in range(0, len(both), 1 << 14):
        ones += np.unpackbits(both[i : i + (1 << 14)].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    first, second = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").tolist()
    whole = xxh64_intdigest(hashes.tobytes(), SEED)
    return (whole - (1 << 64) if whole >> 63 else whole) or 1, first, second, hashes


def _sliced(batches: Iterator[pa.RecordBatch], kept: int, make, fields: list[tuple]) -> Iterator[pa.RecordBatch]:
    """``batches`` with the last column, texts, replaced by what ``make`` gives for each, in batches of about ``BATCH`` bytes."""
    for batch in batches:
        start, held, made, texts = 0, 0, [], batch.column(kept)
        for at in range(batch.num_rows):
            row, size = make(texts[at].as_py())
            made.append(row)
            held += size
            if held >= BATCH or at + 1 == batch.num_rows:
                old = batch.slice(start, at + 1 - start)
                new = [pa.array(x, kind) for x, (_, kind) in zip(zip(*made, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(old.column(i) for i in range(kept)), *new], names=[*batch.schema.names[:kept], *(c for c, _ in fields)])
                start, held, made = at + 1, 0, []


def frequent_shingles(docs: DataFrame, words: int) -> list[tuple[int, int]]:
    """(hash, count), by hash, of shingles that recur in a sample of texts. They only settle an order, so results do not depend on the sample."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, COUNTED / max(n, 1))))).select("text").dropDuplicates(["text"])

    def hashes(batches):
        make = lambda text: ((marks_of(text, words)[3].view("<i8"),), 8 * len(text or ""))
        return _sliced(batches, 0, make, [("hashes", pa.list_(pa.int64()))])

    rows = sample.mapInArrow(hashes, "hashes array<long>").select(F.explode("hashes").alias("h"))
    often = rows.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return sorted((r["h"], r["count"]) for r in often)


def marked(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, fp, s1, s2, prefix) for each row of ``docs`` (doc_id, text).

    Two sets of the similarity share one of the first ``n - ceil(similarity * n) + 1`` of n hashes in any
    order that is common to all sets: prefix. Frequent shingles come last, which keeps passages of many
    texts out of it.
    """
    often = frequent_shingles(docs, words)

    def run(batches):
        import math

        import numpy as np

        known, count = np.array([h for h, _ in often], np.int64), np.array([c for _, c in often], np.int64)

        def make(text):
            fp, s1, s2, hashes = marks_of(text, words)
            x = hashes.view("<i8")
            rank = np.zeros(len(x), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                rank = np.where(known[at] == x, count[at], 0)
            prefix = x[np.lexsort((x, rank))][: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] if len(x) else x
            return (fp, s1, s2, prefix), 64 + 8 * len(prefix)

        return _sliced(batches, 1, make, [("fp", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, s1 long, s2 long, prefix array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, hashes): the sets themselves, as sorted 32-bit halves of their hashes.

    Of sets of n shingles, about n * n / 2**32 shingles seem common that are not.
    """

    def run(batches):
        import numpy as np

        def make(text):
            fp, _, _, hashes = marks_of(text, words)
            low = np.unique(hashes.astype(np.uint32)).view("<i4")
            return (fp, low), 16 + 4 * len(low)

        return _sliced(batches, 1, make, [("fp", pa.int64()), ("hashes", pa.list_(pa.int32()))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, hashes array<int>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of ``sets`` (fp, hashes) whose Jaccard similarity is ``similarity`` at least."""

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for x, y in zip(left, right, strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                out.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    first, second = (sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").where(alike("of_a", "of_b")).select("a", "b")


def close(pairs: DataFrame, sims: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose SimHashes (``sims``: fp, s1, s2) differ in ``WIDE_RADIUS`` bits or fewer."""
    first, second = (sims.select(F.col("fp").alias(c), F.col("s1").alias(f"{c}1"), F.col("s2").alias(f"{c}2")) for c in "ab")
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return pairs.join(first, "a").join(second, "b").where(apart <= WIDE_RADIUS).select("a", "b")


def _words_of(s1, s2):
    import numpy as np

    return np.stack([s1, s2], axis=1).view(np.uint64)


def close_forest(rows: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect, in each bucket of ``rows`` (key, fp, s1, s2), all whose SimHashes differ in ``WIDE_RADIUS`` bits or fewer; a forest for each task."""

    def small(batches):
        import numpy as np

        for key, fp, s1, s2 in whole_buckets(batches, ["key", "fp", "s1", "s2"]):
            yield _forest_batch(fp.view(np.uint64), bucket_links(key, _words_of(s1, s2), WIDE_RADIUS))

    def two_parts(table: pa.Table) -> pa.Table:
        import numpy as np

        part, fp, s1, s2 = (table.column(c).to_numpy() for c in ("part", "fp", "s1", "s2"))
        return pa.Table.from_batches([_forest_batch(fp.view(np.uint64), _parts(part, _words_of(s1, s2), WIDE_RADIUS))])

    few, many = parted(rows, "fp", split)
    return few.mapInArrow(small, "a long, b long").unionByName(many.groupBy("key", "x", "y").applyInArrow(two_parts, "a long, b long")).distinct()


def _bitmaps(sets):
    """For each set, which of 4096 classes its hashes fall in, as 64 words. Two bitmaps differ in no more bits than their sets in members."""
    import numpy as np

    out = np.zeros((len(sets), 512), dtype=np.uint8)
    for k, x in enumerate(sets):
        lit = np.zeros(4096, dtype=bool)
        lit[x & 4095] = True
        out[k] = np.packbits(lit)
    return out.view(np.uint64)


def _verified(fp, root, sets, found, similarity: float) -> pa.RecordBatch:
    """Of the pairs ``found`` of positions, links (a, b) of a forest over roots: pairs whose ``sets`` have the similarity."""
    import numpy as np

    _, place = np.unique(root, return_inverse=True)
    up = list(range(len(place)))
    sizes, maps = np.array([len(x) for x in sets]), _bitmaps(sets)

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b = [], []
    for i, j in found:
        keep = place[i] != place[j]
        i, j = i[keep], j[keep]
        x, y = sizes[i], sizes[j]
        keep = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 4096):
            p, q = i[k : k + 4096], j[k : k + 4096]
            apart = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64)
            # members of one set only are (1 - s) / (1 + s) of both sizes at most
            near = np.nonzero(apart <= (1 - similarity) / (1 + similarity) * (sizes[p] + sizes[q]) + 1e-6)[0]
            for m in near[np.argsort(apart[near], kind="stable")].tolist():
                u, v = top(place[p[m]]), top(place[q[m]])
                if u != v:
                    both = len(np.intersect1d(sets[p[m]], sets[q[m]], assume_unique=True))
                    if both >= similarity * (sizes[p[m]] + sizes[q[m]] - both) - 1e-9:
                        up[max(u, v)] = min(u, v)
                        a.append(fp[p[m]])
                        b.append(fp[q[m]])
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _lists(column: pa.ChunkedArray) -> list:
    return [x.values.to_numpy() for x in column]


def set_links(rows: DataFrame, similarity: float, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect the different roots in each group of ``rows`` (key, fp, root, s1, s2, hashes) as all pairs would
    that have the similarity: pairs of close SimHashes, then of close bitmaps, then of similar sets; a forest for each task."""

    def links_of(table: pa.Table, found) -> pa.RecordBatch:
        fp, root, s1, s2 = (table.column(c).to_numpy() for c in ("fp", "root", "s1", "s2"))
        return _verified(fp, root, _lists(table.column("hashes")), found(_words_of(s1, s2)), similarity)

    def small(batches):
        import numpy as np

        held: list = []

        def flush(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            # the last group may go on
            whole = len(keys) if last else int(np.nonzero(keys != keys[-1])[0][-1]) + 1 if keys[0] != keys[-1] else 0
            held = table.slice(whole).combine_chunks().to_batches() if whole < len(keys) else []
            if whole:
                yield links_of(table.slice(0, whole), lambda sims: bucket_links(keys[:whole], sims, WIDE_RADIUS))

        for batch in batches:
            for at in range(0, batch.num_rows, SPLIT):
                held.append(batch.slice(at, SPLIT))
                if sum(x.nbytes for x in held) > 4 * BATCH or sum(x.num_rows for x in held) > 1 << 16:
                    yield from flush(False)
        if held:
            yield from flush(True)

    def two_parts(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        return pa.Table.from_batches([links_of(table, lambda sims: _parts(part, sims, WIDE_RADIUS))])

    few, many = parted(rows, "fp", split)
    return few.mapInArrow(small, "a long, b long").unionByName(many.groupBy("key", "x", "y").applyInArrow(two_parts, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of ``docs``, linked at a Jaccard similarity of their shingles
    of ``words`` words; fp is a hash of the set of shingles, component_id the least id of the component, root its least fp.

    Rows with equal ids count as one document; a null id is no component's name unless no other is there.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = materialize(marked(docs, words, similarity), "marks")
    firsts = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.count(F.lit(1)).alias("rows")), "firsts")
    # a bucket: the sets that share a hash of their prefixes; most have one set and go at once
    again = broadcast_if(firsts.where("rows > 1").select("fp"), BROADCAST)
    prefixes = marks.select("fp", "prefix")
    # a set that stands on one row needs no shuffle where the others are few
    prefixes = prefixes.join(again, "fp", "left_anti").unionByName(prefixes.join(again, "fp", "left_semi").dropDuplicates(["fp"]))
    rows = prefixes.select("fp", F.explode("prefix").alias("key"))
    order = Window.partitionBy("key").orderBy("fp")
    rows = rows.withColumns({"before": F.lag("fp").over(order), "after": F.lead("fp").over(order), "low": F.first("fp").over(order)})
    buckets = materialize(rows.where("before is not null or after is not null").select("key", "fp", "before", "low"), "buckets")

    def sets_for(wanted: DataFrame) -> DataFrame:
        """(fp, hashes), written, for ``wanted`` (fp)."""
        need = materialize(wanted.distinct().join(firsts.select("fp", "first"), "fp"), "compared")
        few = broadcast_if(need, BROADCAST)
        # only the texts that are needed are cut into shingles again
        if few is need:
            some = holding(docs, F.col("doc_id"), need.select("first"), BROADCAST).unionByName(docs.where("doc_id is null"))
        else:
            some = docs.join(few, docs["doc_id"].eqNullSafe(few["first"]), "left_semi")
        sets = sets_of(some, words).withColumnRenamed("fp", "of").join(few, (F.col("of") == F.col("fp")) & F.col("doc_id").eqNullSafe(F.col("first")))
        out = materialize(sets.select("fp", "hashes").dropDuplicates(["fp"]), "sets")
        release(need)
        return out

    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # each set with the one before it and with the first: a group of near copies becomes one component
    star = buckets.where("before is not null").select(F.explode(F.array(pair("fp", "before"), pair("fp", "low"))).alias("p")).select("p.*").distinct()
    # the SimHashes of what stands in a bucket
    sims = materialize(firsts.join(buckets.select("fp").distinct(), "fp", "left_semi").select("fp", "s1", "s2"), "sims")
    sims = broadcast_if(sims, BROADCAST)
    star = materialize(close(star, sims), "star")
    sets = sets_for(star.select(F.explode(F.array("a", "b")).alias("fp")))
    found = materialize(similar(star, sets, similarity), "similar")
    release(star, sets)
    # sets that could be linked at all: those that SimHashes and shared hashes connect, through buckets of several components
    roots = broadcast_if(components(found).withColumnRenamed("v", "fp"), BROADCAST)
    placed = buckets.select("key", "fp").join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    whole = Window.partitionBy("key")
    mixed = placed.withColumns({"x": F.min("root").over(whole), "y": F.max("root").over(whole)}).where("x <> y").select("key", "fp")
    mixed = materialize(mixed, "mixed")
    release(buckets)
    forest = materialize(close_forest(mixed.join(sims, "fp").select("key", "fp", "s1", "s2"), split), "forest")
    groups = materialize(components(forest).select(F.col("v").alias("fp"), F.col("root").alias("key")), "candidates")
    release(mixed, forest)
    now = groups.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rows = materialize(now.join(open_, "key", "left_semi").join(sims, "fp"), "open")
    sets = sets_for(rows.select("fp"))
    more = materialize(set_links(rows.join(sets, "fp").select("key", "fp", "root", "s1", "s2", "hashes"), similarity, split), "linked")
    release(rows, sets, groups)
    # a document whose id stands on several rows connects their sets
    twice = marks.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    shared = marks.select("doc_id", "fp").join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    roots = components(found.unionByName(more).unionByName(shared)).withColumnRenamed("v", "fp")
    of = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    names = materialize(of.join(least, "root").select("fp", "component_id", "root"), "components")
    release(found, more)
    return marks.select("doc_id", "fp").join(names, "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each group of ``near_duplicates`` one row of ``docs``: that of the least id; of rows with that id, that of the least hash.

    Rows without an id count by their text: they go where their group has an id, and one stays where it has none.
    """
    groups = materialize(near_duplicates(docs, doc_id, text, **options), "groups")
    firsts = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__first")).agg(F.count(F.lit(1)).alias("__n"))
    firsts = materialize(firsts, "kept")
    at = F.col(f"`{doc_id}`")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in docs.columns))).alias("row")
    # texts stay where they are: ids go to them
    one = holding(docs, at, firsts.where("__n = 1").select("__first"), BROADCAST)
    several = docs.join(broadcast_if(firsts.where("__n > 1").select("__first"), BROADCAST), at == F.col("__first"), "left_semi").select(at.alias("id"), whole.alias("row")).groupBy("id").agg(least)
    nameless = groups.where("component_id is null").select("fp", "root").distinct()
    void = docs.where(at.isNull()).select(whole.alias("row"), at.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # the sets' hashes again, beside the rows
    words = options.get("words", WORDS)

    @F.arrow_udf("long")
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array([marks_of(x.as_py(), words)[0] for x in texts], pa.int64())

    void = void.select("row", mark("text").alias("fp")).join(nameless, "fp").groupBy("root").agg(least)
    return one.unionByName(several.select("row.*")).unionByName(void.select("row.*"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mark = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_fingerprints(docs).select("doc_id", mark, "component_id")
