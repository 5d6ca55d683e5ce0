"""Each stage against a plain version, on all that the stage before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docengine.llm import langid, quality
from docengine.shared import materialize


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), "t"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_keeps_what_the_rules_keep(spark, sf, stages):
    rules = quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.judge(stages[0], rules).collect() if r["kept"]}
    assert {r["doc_id"] for r in stages[1].collect()} == kept
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(quality.statistics(stages[0]).where("not stats.base_failed"), "doc_id", "left_semi")
    assert good.join(stages[1], "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_language_keeps_texts_in_a_language(stages):
    lost = stages[1].join(stages[2], "doc_id", "left_anti")
    assert lost.count() <= 0.05 * stages[1].count()
    net = langid.fit(stages[1].where(~langid.held_out()))
    clear = langid.identify(stages[1], net).where(F.col("language.score") > 0.9)
    assert clear.join(stages[2], "doc_id", "left_anti").count() == 0


def test_one_of_each_group_stays(stages):
    from docengine.llm.simhash import near_duplicates

    groups = {}
    for r in near_duplicates(stages[2]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(min(g) for g in groups.values())


def test_mix_repeats_rows(stages):
    from docengine.llm.mixing import mix

    times = {r["doc_id"]: r["mix"]["times"] for r in mix(stages[3]).collect()}
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: t for i, t in times.items() if t}


def test_ids_decode_to_the_texts(stages):
    import hashlib

    import numpy as np
    import public_tokenizers
    import tiktoken

    from docengine.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = known.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_agrees_with_the_stages(spark, sf, stages):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_near_dedup_reaches_every_pair_of_similarity(spark, sf, stages):
    """Components are those of all pairs with 5-word Jaccard 0.8, also where they differ in many bits."""
    import random
    import re

    rng = random.Random(7)
    texts = {r["doc_id"]: r["text"] or "" for r in stages[2].collect()}
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for k in range(40):
        words = list(base)
        for _ in range(1 + k % 5):
            words[rng.randrange(200)] = f"x{k}"
        texts[10_000_000 + k] = " ".join(words)
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    ids, up = sorted(sets), {}
    top = lambda i: i if up.get(i, i) == i else top(up[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from docengine.llm.simhash import near_duplicates

    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()} == {i: top(i) for i in ids}
    kept = corpus_pipeline.near_dedup(spark, frame, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({top(i) for i in ids})
