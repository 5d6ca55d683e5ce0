"""Language-model scores with stupid backoff, computed by groups of documents and ranges of n-grams.

The corpus is its own reference: a document is scored by the n-grams of all other
documents. With c the counts less the document's own, a word w after context v gets
c(v w) / c(v) if c(v w) > 0; else the context is cut by its first word and the score is
multiplied by ``ALPHA``. At the end stands c(w) / N, or ALPHA / N for a word that no other
document has. A document's score is the sum of the logarithms over its words.

An n-gram is known by a 64-bit hash of its words. A row for each would be shuffled at some
50 bytes a word, so rows hold many: documents are packed to groups of ``GROUP_BYTES`` of
text, and a group sends the different n-grams of all its documents, with their counts, as
one sorted list to each range of hashes. A range adds up the lists of all groups and sends
each group the counts that the others have, in the order of its list. With these a group
scores its documents. Nothing is pruned; a frequent n-gram is one entry of each group, and
ranges of hashes are even, so no key gathers rows. Groups go through one shuffle, from which
both their n-grams and their scores are made.

A task holds one group, or one range, about ``RANGE`` n-grams. Null and empty texts have no
words and score 0. Copies count as other documents. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.batches import bounded
from docengine.shared import materialize

ORDER = 3
ALPHA = 0.4
#: Text of one group of documents; a longer document is a group by itself.
GROUP_BYTES = 10 << 20
#: N-grams of one range of hashes, about.
RANGE = 4 << 20
#: Bytes that are hashed at once.
CHUNK = 1 << 18
CODEC = "zstd"
PACKED = "group long, rows array<long>, sizes array<int>, n_bytes long, texts binary"
COUNTS = "group long, part int, n int, grams binary, counts binary"
OTHERS = "group long, part int, n int, others binary"
SCORES = "row long, n_words long, best double, ends long"

_U = np.uint64


def mix(x):
    """A bijection of 64-bit integers that scatters them (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: White space between words, by byte.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Two hashes of a word: sums over its bytes of a random number of the byte, times a power by place.
TABLES = [np.where(BLANK, _U(0), mix(np.arange(256, dtype=_U) + _U(256 * s + 1))) for s in (0, 1)]
BASES = [0x9E3779B97F4A7C13, 0xD1B54A32D192ED03]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin, and their hashes."""
    blank = BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate((np.ones(1, bool), blank[:-1])))
    made, at = np.empty(len(first), _U), 0
    powers = [np.ones(1, _U)] * 2
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(first, first[at] + CHUNK)))
        end = first[stop] if stop < len(first) else len(data)
        part, starts = data[first[at] : end], first[at:stop] - first[at]
        place = np.arange(len(part)) - np.repeat(starts, np.diff(starts, append=len(part)))
        place[blank[first[at] : end]] = 0
        if place.max() >= len(powers[0]):
            powers = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(place.max(), b, _U)))) for b in BASES]
        a, b = (np.add.reduceat(t[part] * p[place], starts) for t, p in zip(TABLES, powers, strict=True))
        made[at:stop] = mix(a + mix(b))
        at = stop
    return first, made


def grams(data: np.ndarray, begins: np.ndarray, order: int):
    """The document of each word, the word's number in it, and for k = 1..order the hash of the k-gram that ends at each word (where it has one)."""
    first, words = word_hashes(data)
    doc = (np.searchsorted(begins, first, "right") - 1).astype(np.int32)
    nth = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32)
    made = [mix(words + _U(1))]
    for k in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = mix(made[-1][:-1] * _U(BASES[0]) + mix(words[1:] + _U(k)))
        made.append(longer)
    return doc, nth, made


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, in order, and how often each is there; sorts the array that it is given."""
    s = hashes
    s.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    return s[at], np.diff(at, append=len(s)).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, the lowest bytes of all first."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()
    return pa.Codec(CODEC).compress(raw, asbytes=True)


def unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.Codec(CODEC).decompress(data, decompressed_size=n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).reshape(-1)


def gaps(s: np.ndarray) -> np.ndarray:
    return np.concatenate((s[:1], s[1:] - s[:-1]))


def group_of(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Row ids, text and where each document begins in it."""
    row = table.slice(0, 1).to_pydict()
    sizes, n = np.array(row["sizes"][0], np.int64), row["n_bytes"][0]
    data = np.frombuffer(pa.Codec(CODEC).decompress(row["texts"][0], decompressed_size=n, asbytes=True) if n else b"", np.uint8)
    return row["rows"][0], data, np.cumsum(sizes) - sizes


def packed(rows: DataFrame, group_bytes: int) -> DataFrame:
    """(row, text) as groups of documents; each text ends with a line feed."""

    def run(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def made():
            data = b"".join(texts)
            columns = [[group], [ids], [[len(t) for t in texts]], [len(data)], [pa.Codec(CODEC).compress(data, asbytes=True) if data else b""]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["group", "rows", "sizes", "n_bytes", "texts"])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or b"") + b"\n"
                if ids and held + len(text) > group_bytes:
                    yield made()
                    group, ids, texts, held = group + 1, [], [], 0
                ids.append(row)
                texts.append(text)
                held += len(text)
        if ids:
            yield made()

    return rows.mapInArrow(run, PACKED)


def score(docs: DataFrame, row: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(row, n_words, log_prob, mean_log_prob, perplexity) for each row of ``docs``; ``row`` is a long."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("binary").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # ranges are a power of two; a word has some six bytes
    bits = max(0, math.ceil(math.log2(max(1, n_bytes * order / 6 / RANGE))))
    groups = packed(rows, group_bytes).repartition("group")

    def sent(table: pa.Table) -> pa.Table:
        _, data, begins = group_of(table)
        _, nth, made = grams(data, begins, order)
        known, counts = counted(np.concatenate([g[nth >= k] for k, g in enumerate(made)]))
        cuts = np.searchsorted(known, np.arange(1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.zeros(1, np.int64)
        found = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(known)], strict=True)) if b > a]
        columns = [[table["group"][0].as_py()] * len(found), [p for p, _, _ in found], [int(b - a) for _, a, b in found]]
        columns += [[planes(gaps(known[a:b])) for _, a, b in found], [planes(counts[a:b]) for _, a, b in found]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["group", "part", "n", "grams", "counts"])

    def added(table: pa.Table) -> pa.Table:
        n, coded = table["n"].to_pylist(), table["grams"]
        # one list is unpacked at a time; what is held is the sorted union and a place in it for each n-gram sent
        every, at = np.empty(sum(n), _U), 0
        for g, m in zip(coded, n, strict=True):
            np.cumsum(unplanes(g.as_py(), m, _U), out=every[at : at + m])
            at += m
        every.sort()
        new = np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1]))
        known = every[new]
        del every, new
        totals, places, others = np.zeros(len(known), np.uint32), [], []
        for g, c, m in zip(coded, table["counts"], n, strict=True):
            places.append(np.searchsorted(known, np.cumsum(unplanes(g.as_py(), m, _U))).astype(np.uint32))
            totals[places[-1]] += unplanes(c.as_py(), m, np.uint32)
        del known
        for k, (c, m) in enumerate(zip(table["counts"], n, strict=True)):
            others.append(planes(totals[places[k]] - unplanes(c.as_py(), m, np.uint32)))
            places[k] = None
        return pa.table([table["group"], table["part"], table["n"], pa.array(others, pa.binary())], names=["group", "part", "n", "others"])

    def scored(group: pa.Table, parts: pa.Table) -> pa.Table:
        ids, data, begins = group_of(group)
        doc, nth, made = grams(data, begins, order)
        parts = parts.sort_by("part")
        others = [unplanes(o.as_py(), m, np.uint32) for o, m in zip(parts["others"], parts["n"].to_pylist(), strict=True)]
        others = np.concatenate(others) if others else np.zeros(0, np.uint32)
        known, total = counted(np.concatenate([g[nth >= k] for k, g in enumerate(made)]))
        total = total.astype(np.int64)
        total += others
        del others, data
        best, ends, context = None, np.ones(len(doc), np.int64), None
        for k, g in enumerate(made):
            at = np.flatnonzero(nth >= k)
            # words in the order of their k-grams, those of one document next to each other
            by = at[np.argsort(g[at], kind="stable")].astype(np.uint32)
            new = np.concatenate((np.ones(min(1, len(by)), bool), (g[by][1:] != g[by][:-1]) | (doc[by][1:] != doc[by][:-1])))
            runs = np.flatnonzero(new)
            n = np.zeros(len(doc), np.int64)
            n[by] = np.repeat(total[np.searchsorted(known, g[by[runs]])] - np.diff(runs, append=len(by)), np.diff(runs, append=len(by)))
            made[k] = None
            if k == 0:
                best = np.log(np.where(n > 0, n, alpha))
            else:
                seen, there = n > 0, nth >= k
                before = np.maximum(np.concatenate((np.ones(1, np.int64), context))[: len(n)], 1)
                best = np.where(seen, np.log(np.maximum(n, 1) / before), np.where(there, best + math.log(alpha), best))
                ends[seen] = 0
            context = n
        count = lambda w: np.bincount(doc, w, len(ids))
        columns = [ids, count(None), count(best), count(ends).astype(np.int64)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["row", "n_words", "best", "ends"])

    counts = groups.groupBy("group").applyInArrow(sent, COUNTS)
    others = counts.groupBy("part").applyInArrow(added, OTHERS)
    sums = materialize(groups.groupBy("group").cogroup(others.groupBy("group")).applyInArrow(scored, SCORES), "scores")
    n_words = sums.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(n_words) - F.col("n_words"), F.lit(1))
    out = sums.select("row", "n_words", F.when(F.col("n_words") > 0, F.col("best") - F.col("ends") * F.log(rest)).otherwise(0.0).alias("log_prob"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).otherwise(0.0)
    return out.withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rounded = (F.round(c, 6).alias(c) for c in ("log_prob", "mean_log_prob"))
    return out.select(F.col("row").alias("doc_id"), "n_words", *rounded, F.round("perplexity", 2).alias("perplexity"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT uid, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM d
), q AS (
  SELECT *, lag(w1) OVER o || ' ' || w1 AS w2, lag(w1, 2) OVER o || ' ' || lag(w1) OVER o || ' ' || w1 AS w3 FROM p WINDOW o AS (PARTITION BY uid ORDER BY pos)
), c AS (
  -- counts less the document's own
  SELECT uid, pos, w2, w3,
         count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY uid, w1) AS n1,
         count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY uid, w2) AS n2,
         count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY uid, w3) AS n3
  FROM q
), x AS (
  SELECT *, lag(n1) OVER o AS c2, lag(n2) OVER o AS c3 FROM c WINDOW o AS (PARTITION BY uid ORDER BY pos)
), t AS (
  SELECT sum(len(w)) AS words FROM d
), s AS (
  SELECT uid,
         sum(CASE WHEN w3 IS NOT NULL AND n3 > 0 THEN ln(n3 / c3)
                  ELSE (CASE WHEN w3 IS NOT NULL THEN ln(0.4) ELSE 0 END)
                     + CASE WHEN w2 IS NOT NULL AND n2 > 0 THEN ln(n2 / c2)
                            ELSE (CASE WHEN w2 IS NOT NULL THEN ln(0.4) ELSE 0 END) + ln(CASE WHEN n1 > 0 THEN n1 ELSE 0.4 END) END END) AS best,
         sum(CASE WHEN w3 IS NOT NULL AND n3 > 0 OR w2 IS NOT NULL AND n2 > 0 THEN 0 ELSE 1 END) AS ends
  FROM x GROUP BY uid
), r AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(best - ends * ln(greatest((SELECT words FROM t) - len(w), 1)), 0.0) AS log_prob
  FROM d LEFT JOIN s USING (uid)
)
SELECT doc_id, n_words, round(log_prob, 6) AS log_prob, round(CASE WHEN n_words > 0 THEN log_prob / n_words ELSE 0.0 END, 6) AS mean_log_prob,
       round(exp(-CASE WHEN n_words > 0 THEN log_prob / n_words ELSE 0.0 END), 2) AS perplexity
FROM r
"""
