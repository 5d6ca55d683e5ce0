"""Byte-level BPE as a reduction over a monoid of token sequences.

A text is a tree: its pattern matches at the top, halves of matches below, down to
spans of at most ``LEAF`` bytes, which a plain merge loop encodes. Two neighbours are
joined by looking at the tokens about their boundary: if those are compatible (their
bytes encode to just that pair) both sides stay as they are; else a window of tokens
about the boundary is encoded again, and grows until the tokens at its edges are
compatible with those outside. A sequence whose neighbouring pairs are all compatible is
the encoding of its bytes, so what lies outside the window is then stable. Matches are
encoded separately, so above them a join is a concatenation. Decoding concatenates up
the tree.

Work of a join depends on the window, not on the length of a match, so a match of
megabytes costs O(n log n). Subtrees repeat: each worker keeps those of up to
``SUBTREE`` bytes, the ids of matches and those of words with the marks after them, in
caches that are bounded by bytes (``CACHE`` in all). Ids are kept as little-endian
unsigned 32-bit integers in one binary value.

Null texts count as empty; an empty text has no ids. Equal texts have equal ids, and
repeated rows stay. An empty table gives an empty result. Columns of the names that are
added are replaced; others are kept, whatever their names.
"""

import base64
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.batches import bounded

#: Bytes of a leaf of the tree.
LEAF = 8
#: Bytes of the largest subtree that is kept.
SUBTREE = 16
#: Bytes of all caches of a worker, and what an entry takes beside its key and value.
CACHE, ENTRY = 112 << 20, 160
#: Marks that may follow a word.
MARKS = ".,;:!?#$%&*|)"
#: The pattern for which ``encode`` knows where matches begin without matching; others are matched.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Known(dict):
    """Results of ``make`` by its argument, in two generations of ``size / 2`` bytes at most; what is asked for again is kept."""

    def __init__(self, make, size: int, longest: int, unit: int = 1):
        self.make, self.half, self.longest, self.unit, self.held, self.older = make, size // 2, longest, unit, 0, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        # a word with marks is put together again from the word; keeping it would push out other words
        if len(key) <= self.longest and not (key[-1] in MARKS and key[0].isalpha() if self.unit == 1 else False):
            if self.held > self.half:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[key] = got
            self.held += ENTRY + len(key) + self.unit * len(got)
        return got


class Coder:
    """Encodes and decodes by ``ranks`` (token bytes to id; a lower id merges first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, cache: int = CACHE):
        import regex

        self.ranks, self.leaf, self.joins = ranks, leaf, 0
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.by_words = pattern == WORDS_PATTERN
        # \s of the pattern is Unicode's White_Space, which leaves out the separators U+001C to U+001F
        self.matches = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pairs: dict[int, bool] = {}
        self.most_pairs = cache // 8 // ENTRY
        self.merged = Known(self.leaf_ids, cache // 8, SUBTREE, 8)
        self.subtrees = Known(self._span, cache // 8, SUBTREE, 8)
        self.known = Known(lambda piece: self.packed(piece.encode("utf-8")), cache // 16, 48)
        self.chunks = Known(self.chunk, cache * 9 // 16, 48)

    def chunk(self, part: str) -> bytes:
        """Ids of a space and ``part``, or of a part that begins with a line feed."""
        if part.isalpha():
            return self.packed(b" " + part.encode("utf-8"))
        core = part.rstrip(MARKS)
        if core.isalpha():
            # letters are one match, the marks after them another
            return self.chunks[core] + self.known[part[len(core) :]]
        return self.flat(part if part[:1] == "\n" else " " + part)

    def packed(self, piece: bytes) -> bytes:
        """Ids of a match; one that is a token itself is that token."""
        i = self.ranks.get(piece)
        if i is not None:
            return i.to_bytes(4, "little")
        return b"".join([x.to_bytes(4, "little") for x in self.span(piece)])

    def leaf_ids(self, span: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until no pair merges."""
        ranks, n = self.ranks, len(span)
        if n > 96:
            return self.heap_ids(span)
        never = len(self.tokens)
        parts = [span[i : i + 1] for i in range(n)]
        pairs = [ranks.get(span[i : i + 2], never) for i in range(n - 1)]
        while pairs and (best := min(pairs)) < never:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], never)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        return [ranks[p] for p in parts]

    def heap_ids(self, span: bytes) -> list[int]:
        """As ``leaf_ids``, for wide windows."""
        ranks, n = self.ranks, len(span)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(span[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or not alive[j] or end[i] != j or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(span[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, after[i], end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(span[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        return [ranks[span[i : end[i]]] for i in range(n) if alive[i]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to just these."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            # bytes that are one token by rank never stay two
            got = self.tokens[a] + self.tokens[b] not in self.ranks and self.leaf_ids(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def span(self, piece: bytes) -> list[int]:
        """Ids of a subtree."""
        return self.subtrees[piece] if len(piece) <= SUBTREE else self._span(piece)

    def _span(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merged[piece]
        # a power of two near the middle keeps long runs of one token in step on both sides
        half = 1 << ((len(piece) - 1).bit_length() - 1)
        return self.join(self.span(piece[:half]), self.span(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both; the monoid's operation."""
        self.joins += 1
        if not left or not right:
            return left or right
        if self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(width, len(right))
            middle = self.merged[self.decoded(left[a:]) + self.decoded(right[:b])]
            if (not a or self.fits(left[a - 1], middle[0])) and (b == len(right) or self.fits(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def decoded(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])

    def flat(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.matches(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text. By ``WORDS_PATTERN``, a single space or line feed between two other characters always begins a match."""
        if not self.by_words or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[-1:] in "\n " or not text.replace("\n", "").isprintable():
            return self.flat(text)
        first, *parts = text.replace("\n", " \n").split(" ")
        return self.flat(first) + b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return self.decoded(np.frombuffer(ids, "<u4").tolist())


_coders: dict = {}


def coder_of(shared, pattern: str) -> Coder:
    """The worker's coder for a broadcast of ranks."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shared.value, pattern)
    return _coders[key]


def codec(spark, path: str, pattern: str):
    """Column functions ``encode(text) -> ids`` and ``decode(ids) -> bytes``, both binary.

    The vocabulary is read once, on the driver, and broadcast; its size is that of the file.
    """
    from pyspark.sql.functions import arrow_udf

    shared = spark.sparkContext.broadcast(read_ranks(path))

    @arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        coder = coder_of(shared, pattern)
        return pa.array([coder.encode(x.as_py() or "") for x in texts], pa.binary())

    @arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        coder = coder_of(shared, pattern)
        return pa.array([coder.decode(x.as_py() or b"") for x in ids], pa.binary())

    return encode, decode


ADDED = ("n_tokens", "ids_sha256", "decoded_sha256")
#: Bytes of ids in one batch that goes back to Spark.
BATCH = 4 << 20


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, text: str = "text", keep_ids: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256, decoded_sha256 and on wish ``ids``.

    A worker holds one batch of texts and, of what it makes, one text's ids and bytes and ``BATCH`` bytes of results.
    """
    bounded(docs.sparkSession)
    own_path, own_pattern = default_vocabulary() if path is None else (path, pattern)
    shared, pattern = docs.sparkSession.sparkContext.broadcast(read_ranks(own_path)), pattern or own_pattern
    kept = [c for c in docs.columns if c not in (text, "ids", *ADDED)]
    added = (["ids"] if keep_ids else []) + list(ADDED)
    kinds = {"ids": T.BinaryType(), "n_tokens": T.LongType()}
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, kinds.get(c, T.StringType())) for c in added])

    def run(batches):
        coder = coder_of(shared, pattern)
        for batch in batches:
            start, held, made = 0, 0, []
            texts = batch.column(len(kept))
            for at in range(batch.num_rows):
                ids = coder.encode(texts[at].as_py() or "")
                made.append((ids if keep_ids else None, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
                held += len(ids) * keep_ids + 256
                if held >= BATCH or at + 1 == batch.num_rows:
                    columns = dict(zip(("ids", *ADDED), zip(*made, strict=True), strict=True))
                    new = [pa.array(columns[c], {"ids": pa.binary(), "n_tokens": pa.int64()}.get(c, pa.string())) for c in added]
                    old = batch.slice(start, at + 1 - start)
                    yield pa.RecordBatch.from_arrays([*(old.column(i) for i in range(len(kept))), *new], names=[*kept, *added])
                    start, held, made = at + 1, 0, []

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
