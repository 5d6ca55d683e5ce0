"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in blocks of ``BLOCK``, forwards and backwards, and labels
every position; the mean of the label probabilities over all positions of the whole text
is the document's. It is trained here, in numpy, by backpropagation through time on a
bounded sample: ``stretches`` pieces of ``BLOCK_TRAIN`` bytes, spread over the whole text, of each of
the ``max_labelled`` labelled documents with the smallest hash. Labels and ids are used for nothing else.

Texts without a letter, null and empty ones are ``und`` with score 0, and so is every
text if nothing is labelled. Equal texts get equal results. An empty table gives an
empty result. Prediction is a projection: it moves no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.batches import bounded
from docengine.llm.sampling import smallest

HIDDEN = 8
BLOCK = 256
BLOCK_TRAIN = 64
#: Blocks that are read side by side.
LANES = 2048


@dataclass
class Direction:
    """A gated recurrent layer: gates update, reset and candidate, in rows of H."""

    x: np.ndarray  # (3H, 256): what each byte adds
    u: np.ndarray  # (3H, H)

    def step(self, byte, h):
        n = self.u.shape[1]
        g, a = np.take(self.x, byte, axis=1), self.u @ h
        zr = np.tanh(0.5 * (g[: 2 * n] + a[: 2 * n])) * 0.5 + 0.5
        c = np.tanh(g[2 * n :] + zr[n:] * a[2 * n :])
        return c + zr[:n] * (h - c), (zr, c, a[2 * n :])

    def back(self, byte, h, kept, dh, dx, du):
        """Gradients of one step; returns that of the state before."""
        n = self.u.shape[1]
        zr, c, ac = kept
        z, r = zr[:n], zr[n:]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * ac * r * (1 - r)
        d = np.concatenate([dz, dr, dc])
        da = np.concatenate([dz, dr, dc * r])
        du += da @ h.T
        np.add.at(dx.T, byte, d.T)
        return dh * z + self.u.T @ da


@dataclass
class Network:
    labels: list
    ahead: Direction
    back: Direction
    v: np.ndarray  # (K, 2H)
    c: np.ndarray  # (K, 1)

    def parameters(self):
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.v, self.c]


def untrained(labels: list, hidden: int = HIDDEN, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * (0.5 if s[1] == 256 else 1 / np.sqrt(s[1]))).astype("f4")
    one = lambda: Direction(draw(3 * hidden, 256), draw(3 * hidden, hidden))
    return Network(labels, one(), one(), draw(len(labels), 2 * hidden), np.zeros((len(labels), 1), "f4"))


def train(stretches: list[bytes], langs: list[str], steps: int = 260, lanes: int = 192, rate: float = 0.02, seed: int = 0) -> Network:
    """Adam on the cross-entropy of every position, by backpropagation through time."""
    labels = sorted(set(langs))
    net, rng = untrained(labels, seed=seed), np.random.default_rng(seed)
    length = np.array([min(len(s), BLOCK_TRAIN) for s in stretches])
    data = np.zeros((len(stretches), BLOCK_TRAIN), dtype=np.intp)
    for i, s in enumerate(stretches):
        data[i, : length[i]] = np.frombuffer(s[:BLOCK_TRAIN], np.uint8)
    target = np.searchsorted(labels, langs)
    weights = net.parameters()
    m, s = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    h = net.ahead.u.shape[1]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(data), lanes)
        x, n, y = data[pick], length[pick], target[pick]
        live = (np.arange(BLOCK_TRAIN)[:, None] < n).astype("f4")
        runs = []
        for net_dir, order in ((net.ahead, range(BLOCK_TRAIN)), (net.back, range(BLOCK_TRAIN - 1, -1, -1))):
            state, kept, states = np.zeros((h, lanes), "f4"), {}, {}
            for t in order:
                fresh, kept[t] = net_dir.step(x[:, t], state)
                before, state = state, np.where(live[t] > 0, fresh, state)
                states[t] = (before, state)
            runs.append((net_dir, order, kept, states))
        both = np.stack([np.concatenate([runs[0][3][t][1], runs[1][3][t][1]]) for t in range(BLOCK_TRAIN)])
        logits = net.v @ both + net.c
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(lanes)] -= 1
        p *= live[:, None, :] / live.sum()
        grads = [np.zeros_like(w) for w in weights]
        grads[4] += np.einsum("tkb,thb->kh", p, both, optimize=True)
        grads[5] += p.sum(axis=(0, 2))[:, None]
        below = np.einsum("kh,tkb->thb", net.v, p, optimize=True)
        for d, (net_dir, order, kept, states) in enumerate(runs):
            dh = np.zeros((h, lanes), "f4")
            for t in reversed(order):
                dh = dh + below[t, d * h : (d + 1) * h]
                # a lane that has ended passes its gradient through
                inner = net_dir.back(x[:, t], states[t][0], kept[t], dh * live[t], grads[2 * d], grads[2 * d + 1])
                dh = inner + dh * (1 - live[t])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, mm, ss in zip(weights, grads, m, s, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mm += 0.1 * (g - mm)
            ss += 0.01 * (g * g - ss)
            pace = rate * (1 - step / (steps + 1))
            w -= (pace * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def _states(way: Direction, bytes_, live, out) -> None:
    """Runs one direction over blocks in columns, the longest first; ``live[t]`` of them reach step t."""
    n = way.u.shape[1]
    # the gates' factor 0.5 goes into the weights
    half = np.concatenate([np.full(2 * n, 0.5, "f4"), np.ones(n, "f4")])[:, None]
    x, u = way.x * half, way.u * half
    h = np.zeros((n, bytes_.shape[1]), "f4")
    for t in range(bytes_.shape[0]):
        k = live[t]
        now = h[:, :k]
        a = u @ now
        g = np.take(x, bytes_[t, :k], axis=1)
        zr = g[: 2 * n] + a[: 2 * n]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = a[2 * n :]
        c *= zr[n:]
        c += g[2 * n :]
        np.tanh(c, out=c)
        now -= c
        now *= zr[:n]
        now += c
        out[t, :, :k] = now


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all positions of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = np.zeros((len(texts), len(net.labels)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    start, length = first[owner] + inside, np.minimum(BLOCK, sizes[owner] - inside)
    order = np.argsort(-length, kind="stable")
    h = net.ahead.u.shape[1]
    for k in range(0, len(order), LANES):
        part = order[k : k + LANES]
        n, at = length[part], start[part]
        deep = int(n[0])
        live = np.searchsorted(-n, -np.arange(1, deep + 1), side="right")
        steps = np.arange(deep)[:, None]
        ahead = data[np.minimum(at + steps, len(data) - 1)]
        back = data[np.maximum(at + n - 1 - steps, 0)]
        forth, rear = np.zeros((deep, h, len(part)), "f4"), np.zeros((deep, h, len(part)), "f4")
        _states(net.ahead, ahead, live, forth)
        _states(net.back, back, live, rear)
        sums = np.zeros((len(net.labels), len(part)), "f4")
        lane = np.arange(len(part))
        for t in range(deep):
            j = live[t]
            # the backward state of position t was made at step n - 1 - t
            q = net.v[:, :h] @ forth[t, :, :j] + net.v[:, h:] @ rear[n[:j] - 1 - t, :, lane[:j]].T + net.c
            np.exp(q, out=q)
            q /= q.sum(axis=0)
            sums[:, :j] += q
        np.add.at(total, owner[part], sums.T.astype(float))
    return total / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_labelled: int = 4000, stretches: int = 4, **options) -> Network | None:
    """A network for the labels of ``docs``; None without labels. Rows without an id teach nothing.

    ``max_labelled`` different documents are learnt from, by ``stretches`` pieces of each, which
    lie evenly over the whole text, from a start that the hash gives.
    """
    h = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    chosen = smallest(known.select(h.alias("h"), F.col(f"`{lang}`").alias("lang")), "h", max_labelled, "lang")
    # max_labelled rows at most
    texts = known.select(h.alias("h"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), ["h", "lang"])
    room = F.greatest(F.length("text") - BLOCK_TRAIN, F.lit(0)) + 1
    phase = F.pmod("h", F.lit(997)) / 997.0
    at = lambda j: F.floor((F.lit(float(j)) + phase) / stretches * room).cast("int") + 1
    parts = texts.select("h", "lang", F.explode(F.array(*(F.substr("text", at(j), F.lit(BLOCK_TRAIN)) for j in range(stretches)))).alias("part")).distinct()
    got = sorted((r["h"], r["lang"], r["part"]) for r in parts.collect())
    return train([part.encode() for _, _, part in got], [x for _, x, _ in got], **options) if got else None


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: lang (``und`` if there is no letter) and score."""
    if net is None:
        return docs.withColumn("language", F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))

    bounded(docs.sparkSession)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        rows = texts.cast(pa.binary())
        for i in range(0, len(rows), 512):
            p = probabilities(net, [x or b"" for x in rows[i : i + 512].to_pylist()])
            best = p.argmax(axis=1)
            langs += [net.labels[k] for k in best]
            scores += p[np.arange(len(p)), best].tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    whole = F.coalesce(F.col(text), F.lit(""))
    lettered: Column = whole.rlike(r"\p{L}")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "language"]
    df = docs.select(*rest, predict(whole).alias("__p"), lettered.alias("__l"))
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    made = F.when(F.col("__l"), F.struct(F.col("__p.lang").alias("lang"), F.least(F.greatest("__p.score", F.lit(0.0)), F.lit(1.0)).alias("score"))).otherwise(none)
    return df.select(*rest, made.alias("language"))


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")
