"""Each operator against a plain version of what it computes."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.llm import bpe, html, langid, licenses, merkle, mixing, ngrams, quality, simhash, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_simhash(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_op1(spark, sf, texts):
    marks = {i: plain_simhash(t) for i, t in texts.items()}
    sets, ids = Sets(texts), sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                sets.join(i, j)
    out = simhash.op1_simhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {i: (f"{marks[i]:016x}", sets.find(i)) for i in ids}


@pytest.mark.parametrize(("split", "agree"), [(4096, 1), (40, 1), (500, 2), (500, 3)])
def test_links_of_dense_groups(spark, split, agree):
    rng = random.Random(1)
    marks = set()
    for _ in range(12):
        base = near = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 90)):
            near ^= 1 << rng.randrange(64)
            marks |= {near, base ^ (1 << rng.randrange(64))}
    marks = sorted(marks)
    sets = Sets(marks)
    for k, a in enumerate(marks):
        for b in marks[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                sets.join(a, b)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.links(frame, split, agree)).collect()}
    found, want = defaultdict(set), defaultdict(set)
    for m in marks:
        found[roots.get(signed(m), signed(m))].add(m)
        want[sets.find(m)].add(m)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_bit_slices_of_any_radius():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    for radius in (1, 2, 3, 5):
        got = {(int(i), int(j)) for a, b in simhash.sliced_links(values, values, True, radius) for i, j in zip(a, b, strict=True)}
        assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= radius}


def test_op2(spark, sf):
    rows = {r["page_id"]: r for r in urls.op2_url_filter(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        rest = page["url"].split("://", 1)[1] if page["url"] and "://" in page["url"] else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fits = [(v, r) for v, r in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        row = rows[page["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, best[1])
        assert row["verdict"] == best[0] or best[0] is None and row["verdict"] in ("allow", "block")


def test_url_model_against_plain_counts(spark):
    """The relational model gives what the recursion over counts gives, and tells the two classes apart."""
    good = [f"a://x{i}.fine.org/en/{i}" for i in range(60)]
    bad = [f"a://y{i}.spam.com/de/{i}" for i in range(60)]
    shape = lambda u: "^" * 3 + re.sub("[^a-z0./_-]", "~", re.sub("[1-9]", "0", u.split("://", 1)[1].lower())) + "$"
    counts = {side: [Counter(s[i - k : i + 1] for s in map(shape, part) for i in range(3, len(s))) for k in range(4)] for side, part in (("g", good), ("b", bad))}

    def p(side, gram, support=4):
        out = 1 / len(urls.SYMBOLS)
        for k in range(4):
            tail, table = gram[3 - k :], counts[side][k]
            below = {t: n for t, n in table.items() if t[:-1] == tail[:-1]}
            total = sum(below.values())
            if total >= support:
                out = (table[tail] + len(below) * out) / (total + len(below))
        return out

    rows = [(g, counts["g"][3][g], counts["b"][3][g]) for g in set(counts["g"][3]) | set(counts["b"][3])]
    got = {r["gram"]: r["gain"] for r in urls.model(spark.createDataFrame(rows, "gram string, good long, bad long")).collect()}
    assert all(abs(got[g] - math.log(p("g", g) / p("b", g))) < 1e-9 for g, _, _ in rows)
    assert urls.threshold([(-3, 0, 5), (-1, 1, 2), (2, 6, 1)]) == pytest.approx(-0.01) or urls.threshold([(-3, 0, 5), (-1, 1, 2), (2, 6, 1)]) == pytest.approx(0.02)


def test_op3(spark, sf, texts):
    ids = sorted(texts)
    out = {r["doc_id"]: r for r in merkle.op3_merkle_fingerprints(spark, sf).collect()}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(text)
    by_text = defaultdict(set)
    for i in ids:
        by_text[texts[i]].add(out[i]["fingerprint"])
        assert 0 <= out[i]["near_next"] <= 1 and 0 <= out[i]["near_edited"] <= 1
    assert all(len(m) == 1 for m in by_text.values()) and len({m for s in by_text.values() for m in s}) == len(by_text)


def test_successors_of_sparse_keys(spark):
    keys = sorted({random.Random(3).randrange(-(1 << 40), 1 << 40) for _ in range(300)} | {0, 1, 2, 255, 256})
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["after"] for r in merkle.successors(frame, keys[0], keys[-1]).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


def test_edits_are_located(spark):
    a = "one line\nsecond line\nthird line\n" + "\n".join(f"row {i}" for i in range(40))
    b = a.replace("third line", "changed")
    marks = merkle.fingerprints(spark.createDataFrame([(a, b)], "text string, other string"))
    marks = marks.withColumn("new", merkle.fingerprint(merkle.leaves(marks["other"])))
    got = marks.select(merkle.edits(marks["fingerprint"], marks["new"]).alias("e")).first()["e"]
    assert (got["head"], got["removed"], got["added"]) == (2, 1, 1)


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><div class=top>Site name</div><nav><ul><li>Home</ul></nav>
<article><h1>Title {i}</h1><p>First &amp; <b>bold</b>
 words {i}<p>Quote that pages share<div class="share">Share this</div><ul class="x"><li>follow us</ul></article>
<aside>side</aside><div id="comments"><p>me too</div><footer>&copy; 2020</footer><script>var a = "<p>no</p>"</script></body></html>"""


def test_op4_templates(spark):
    pages = [(i, "http://h.org/a", PAGE.replace("{i}", f"n{i}")) for i in range(12)]
    plain = [(100 + i, "http://k.org/a", f"<body><div>Same menu</div><div>Body {chr(97 + i)}<br>line</div><table><tr><td>Same box</table></body>") for i in range(12)]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages + plain, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title n3\nFirst & bold words n3\nQuote that pages share"
    assert out[103] == "Body d\nline"


def test_op4_articles_whole(spark, sf):
    import html as references

    out = {r["page_id"]: r for r in html.op4_html_main_text(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search("(?s)<article>(.*?)</article>", page["html"])[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert out[page["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert out[page["page_id"]]["n_chars"] == len(out[page["page_id"]]["text"])


def test_op5_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op5_language_id(spark, sf).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_gradient():
    """Backpropagation through time agrees with differences."""
    rng = np.random.default_rng(1)
    way = langid.Direction(rng.standard_normal((6, 256)), rng.standard_normal((6, 2)))
    steps, push = rng.integers(0, 256, (5, 3)), rng.standard_normal((2, 3))

    def loss():
        h = np.zeros((2, 3))
        for b in steps:
            h, _ = way.step(b, h)
        return float((h * push).sum())

    h, kept = np.zeros((2, 3)), []
    for b in steps:
        fresh, k = way.step(b, h)
        kept.append((b, h, k))
        h = fresh
    dx, du, dh = np.zeros_like(way.x), np.zeros_like(way.u), push
    for b, before, k in reversed(kept):
        dh = way.back(b, before, k, dh, dx, du)
    for array, grad in ((way.x, dx), (way.u, du)):
        for at in list(zip(*np.nonzero(grad), strict=True))[:12]:
            old = array[at]
            array[at] = old + 1e-6
            high = loss()
            array[at] = old - 1e-6
            low = loss()
            array[at] = old
            assert abs((high - low) / 2e-6 - grad[at]) < 1e-5


def test_op6(spark, sf, texts):
    for r in quality.op6_quality_rules(spark, sf).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and r["kept"])


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 3] > 0.5) | (x[:, 6] > 0.95)
    rules = quality.learn([tuple(r) for r in x], list(bad))
    hit = np.zeros(len(x), dtype=bool)
    for rule in rules:
        at = np.ones(len(x), dtype=bool)
        for t in rule:
            at &= (x[:, quality.FEATURES.index(t.feature)] > t.bound) == t.above
        hit |= at
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.05 * (~bad).sum()


def test_op7(spark, sf, texts):
    out = mixing.op7_mix_sources(spark, sf).collect()
    source = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    sizes = {i: len(WORD.findall(t)) for i, t in texts.items()}
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(total.values())
    while True:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    taken = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(sizes[i] for i in sizes if source[i] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Coder(ranks, public_tokenizers.PATTERN, cache=2000), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", " ", "\n", "  ", "the", "'s", "é", "中", "\U0001f600", "12", "!", "###", "\x1c", "\x85", "Ω", "aaaaaaaa", "\t"]), max_size=40).map("".join))
def test_op8_any_text(coders, text):
    own, known = coders
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_op8_joins(coders):
    own, known = coders
    rng = random.Random(5)
    for alphabet in ("a", "ab", "the ", "xyz0", "éa"):
        piece = "".join(rng.choice(alphabet.strip()) for _ in range(3000))
        assert own.span(piece.encode()) == known._core_bpe.encode_single_piece(piece.encode())


def test_op9(spark):
    files = [
        ("a/LICENSE", "The MIT License (MIT)\n\nCopyright x"), ("a/b/x.c", "int"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"),
        ("a/b/c/y", "q"), ("z", "no"), ("a/k", "// SPDX-License-Identifier: GPL-3.0-only"), (None, "Released under the MIT License."), ("a/n", None),
        ("q", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"), ("w", "Licensed under CC BY-NC 4.0."), ("ab/x", "x"),
    ]
    out = {r["path"]: (r["license"], r["origin"], r["license_path"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert out["a/LICENSE"] == ("MIT", "file", "a/LICENSE") and out["a/b/x.c"] == ("Apache-2.0", "inherited", "a/b/LICENSE.txt")
    assert out["a/b/c/y"][0] == "Apache-2.0" and out["a/n"] == ("MIT", "inherited", "a/LICENSE") and out["ab/x"][1] == out["z"][1] == "none"
    assert out["a/k"][:2] == ("GPL-3.0", "header") and out["q"][:2] == ("GPL-3.0", "header") and out["w"][0] == "CC-BY-NC-4.0"


def test_op9_cosine(spark):
    """Scores against a plain computation."""
    made, idf, other = licenses.template_terms(spark)
    vectors, weights = defaultdict(dict), {r["term"]: r["idf"] for r in idf.collect()}
    for r in made.collect():
        vectors[r["license"], r["template"]][r["term"]] = r["share"]
    lines = ["Licensed under the MIT license", "Copyright 2020 all rights reserved by us", "released under the license, the MIT License"]
    got = {r["text"]: (r["license"], r["score"]) for r in licenses.matches(spark.createDataFrame([(x,) for x in lines], "text string"), least=0.1).collect()}
    for line in lines:
        bag = Counter(t for t in (x.strip(".") for x in re.split("[^a-z0-9.]+", line.lower())) if t)
        w = {t: (1 + math.log(n)) * weights.get(t, other) for t, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        best = max(sum(w.get(t, 0) * s for t, s in v.items()) / norm for v in vectors.values())
        assert got[line][1] == pytest.approx(min(best, 1.0))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op10(spark, texts, order):
    words = {i: WORD.findall(t) for i, t in list(texts.items())[:60]}
    every, own = Counter(), {}
    for i, w in words.items():
        own[i] = Counter(tuple(w[j - k + 1 : j + 1]) for k in range(1, order + 1) for j in range(k - 1, len(w)))
        every += own[i]
    total = sum(map(len, words.values()))
    frame = spark.createDataFrame([(i, texts[i]) for i in words], "doc_id long, text string")
    out = {r["row"]: r for r in ngrams.score(frame, order=order, group_bytes=9000).collect()}
    for i, w in words.items():
        c, want = (lambda g, i=i: every[g] - own[i][g]), 0.0
        for j in range(len(w)):
            factor = 1.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1:
                    want += math.log(factor * (c(g) or 0.4) / max(total - len(w), 1))
                elif c(g):
                    want += math.log(factor * c(g) / c(g[:-1]))
                    break
                else:
                    factor *= 0.4
            # contexts cut at the start of a text carry no factor
        assert out[i]["log_prob"] == pytest.approx(want, rel=1e-9) and out[i]["n_words"] == len(w)


def test_op10_counts_contexts_of_two_words(spark):
    """With usual bigrams, a trigram that others have scores higher than one that none has."""
    texts = ["a b c", "a b c", "x b d", "x b d", "a b d"]
    out = {r["row"]: r["log_prob"] for r in ngrams.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # a: 2 of 12; b after a: 2 of 2; d after a b: never, after b: 2 of 4
    assert out[4] == pytest.approx(math.log(2 / 12) + math.log(2 / 2) + math.log(0.4 * 2 / 4))
    # c after a b: 1 of 2
    assert out[0] == pytest.approx(math.log(2 / 12) + math.log(2 / 2) + math.log(1 / 2))


def test_op10_groups_and_ranges(spark, texts, monkeypatch):
    """Many groups of documents and ranges of n-grams score like one, rows of n-grams do not outnumber groups times ranges, and hashes tell words apart."""
    import numpy as np

    frame = spark.createDataFrame([(i, t) for i, t in list(texts.items())[:40]] + [(None, None), (-1, " \t")], "doc_id long, text string").coalesce(2)
    key = lambda d: sorted(((r["row"] is None, r["row"] or 0, r["n_words"], r["log_prob"]) for r in d.collect()))
    one = key(ngrams.score(frame))
    monkeypatch.setattr(ngrams, "RANGE", 64)
    many = key(ngrams.score(frame, group_bytes=500))
    assert [r[:3] for r in one] == [r[:3] for r in many] and [r[3] for r in one] == pytest.approx([r[3] for r in many], rel=1e-9)
    assert ngrams.packed(frame.selectExpr("doc_id row", "cast(text as binary) text"), 1 << 20).count() <= 2
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abcdéx1", repeat=n)] + ["a" * k for k in range(4, 3000, 7)]
    first, made = ngrams.word_hashes(np.frombuffer(" \n".join(words).encode(), np.uint8))
    assert len(first) == len(words) == len(set(made.tolist()))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><article><p>One <a class="share-link">tweet</a> two<p>Three</article>', "One two\nThree"),
        ('<article><p>One <span class="ad">x<span>y</span>z</span> two</p><p>Three</p></article>', "One two\nThree"),
        ('<article><p>One <span class="ad">x<p>Two</article>', "One\nTwo"),
        ('<article><p><a id="comment-3"></a>One</p></article>', "One"),
        ('<body class="has-sidebar"><p>One</p></body>', "One"),
        ('<body class="menu"><article class="post comments-open share"><p>One</p></article>', "One"),
        ('<div class="share-box">x</div><div class="shared-history">One</div>', "One"),
    ],
)
def test_op4_drops_only_what_is_marked(page, want):
    assert html.main_text(page, []) == want


def test_op4_copies_of_a_page_stay_whole(spark):
    """Copies, of pages with an article and without one, are no template; what different pages share is."""
    article = "<body><div>Menu</div><article><div><p>Some text</p><ul><li>point</ul></div></article></body>"
    near = [f"<body><div>Menu</div><p>{i}</p><article><div><section><p>Own text</p></section></div></article></body>" for i in range(5)]
    bare = "<body><div>Menu</div><p>Some words</p></body>"
    pages = [(i, "http://h.org/a", article) for i in range(5)] + [(10 + i, "http://k.org/a", x) for i, x in enumerate(near)]
    pages += [(20 + i, "http://m.org/a", bare) for i in range(5)] + [(30 + i, "http://m.org/b", f"<body><div>Menu</div><p>Text {i}</p></body>") for i in range(5)]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(5)} == {"Some text\npoint"} and {out[10 + i] for i in range(5)} == {"Own text"}
    assert {out[20 + i] for i in range(5)} == {"Some words"} and [out[30 + i] for i in range(5)] == [f"Text {i}" for i in range(5)]


def test_op8_ordinary_texts_go_through_joins(coders, texts):
    own, known = coders
    before = own.joins
    for text in list(texts.values())[:40]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == known.encode_ordinary(text)
    assert own.joins > before + 500


def test_op8_any_pattern():
    """What is known of one pattern is not used for another."""
    import public_tokenizers
    import tiktoken

    ranks, pattern = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), r"\p{L}{1,3}|[^\p{L}]"
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert public_tokenizers.PATTERN == bpe.WORDS_PATTERN
    for text in ("over the hills and far", "a b\nc  d!", ""):
        assert np.frombuffer(bpe.Coder(ranks, pattern).encode(text), "<u4").tolist() == known.encode_ordinary(text)


LEAF = re.compile(r"[^\n]{0,94}?(?:[a-d][ \t]|[.!?;\u3002\uff01\uff1f])|[^\n]{1,96}")


def plain_tree(text):
    """Sections as tuples (hash, paragraphs), paragraphs as tuples (hash, leaves)."""
    import xxhash

    h = lambda s: f"{xxhash.xxh64_intdigest(s.encode(), seed=42):016x}"
    sections, open_ = [], []
    for line in text.split("\n"):
        long = [h(x) for x in LEAF.findall(line)]
        open_.append((h("".join(long)), tuple(x[8:] for x in long)))
        if open_[-1][0][15] in "048c":
            sections, open_ = [*sections, tuple(open_)], []
    return [(h("".join(p[0] for p in s)), s) for s in (*sections, *([tuple(open_)] if open_ else []))]


def plain_mark(tree):
    root = hashlib.sha256("".join(s[0] for s in tree).encode()).hexdigest()[:32]
    return root + ":" + "/".join(s[0] + "=" + ",".join(p[0] + "".join(p[1]) for p in s[1]) for s in tree)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    distinct = lambda rows: list(dict.fromkeys(rows))
    n = sum(len(p[1]) for s in set(a) & set(b) for p in s[1])
    pa, pb = (distinct(p for s in x if s not in set(y) for p in s[1]) for x, y in ((a, b), (b, a)))
    n += sum(len(p[1]) for p in set(pa) & set(pb))
    la, lb = ({v for p in x if p not in set(y) for v in p[1]} for x, y in ((pa, pb), (pb, pa)))
    every = 2 * n + len(la) + len(lb)
    return 2 * (n + len(la & lb)) / every if every else 1.0


def test_op3_against_a_plain_tree(spark, sf, texts):
    ids = sorted(texts)
    out = {r["doc_id"]: r for r in merkle.op3_merkle_fingerprints(spark, sf).collect()}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        own, edited, following = map(plain_tree, (text, text[: len(text) - half] + after[:half], after))
        assert (out[i]["fingerprint"], out[i]["edited_fingerprint"]) == (plain_mark(own), plain_mark(edited))
        assert out[i]["near_edited"] == pytest.approx(plain_likeness(own, edited)) and out[i]["near_next"] == pytest.approx(plain_likeness(own, following))


def test_op3_one_insertion_in_one_long_paragraph(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice("the cold sea was not old and far from a red hill".split()) for _ in range(3000))
    rows = [(text, "new words here " + text), (text, text[:4000] + "x" + text[4000:])]
    marks = spark.createDataFrame(rows, "a string, b string").select(*(merkle.fingerprint(merkle.leaves(F.col(c))).alias(c) for c in "ab"))
    assert all(r[0] > 0.9 for r in marks.select(merkle.likeness(F.col("a"), F.col("b"))).collect())


def test_op3_next_text_keeps_nulls_and_columns(spark):
    rows = [(1, "a", 1, "q"), (2, None, 2, "q"), (3, "z", 3, "q"), (700, "y", 4, None)]
    out = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string, bucket int, k string"))
    assert out.columns == ["doc_id", "text", "bucket", "k", "next_text"]
    assert {r["doc_id"]: (r["bucket"], r["next_text"]) for r in out.collect()} == {1: (1, None), 2: (2, "z"), 3: (3, "y"), 700: (4, "a")}


def test_samples_are_not_starved_by_repeats(spark):
    """One id on most rows, and labels that repeat, leave the sample whole."""
    many = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("one text of many copies").alias("text"), F.lit("xx").alias("lang"))
    few = [(k, f"{word} text number {k} has some words of its own {k * k}", word) for k in range(20) for word in ("the", "der", "les")]
    net = langid.fit(many.unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string")), max_labelled=50, steps=2)
    assert set(net.labels) >= {"the", "der", "les"}
    from docengine.llm.sampling import smallest

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    got = smallest(rows.unionByName(rows).unionByName(rows.where("id < 10").withColumn("h", F.lit(-(1 << 63)).cast("long"))), "h", 3000, "id").collect()
    want = sorted({(r["h"], r["id"]) for r in rows.collect()} | {(-(1 << 63), k) for k in range(10)})[:3000]
    assert sorted((r["h"], r["id"]) for r in got) == want


def test_op5_fast_pass_equals_the_steps(spark):
    """Probabilities of whole texts, in blocks and lanes, against one step after another."""
    rng, net = np.random.default_rng(3), langid.untrained(["a", "b", "c"], seed=3)
    texts = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (1, 5, 255, 256, 257, 700)] + [b""]
    got = langid.probabilities(net, texts)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for k in range(0, len(text), langid.BLOCK):
            block, ways = text[k : k + langid.BLOCK], []
            for way, order in ((net.ahead, range(len(block))), (net.back, range(len(block) - 1, -1, -1))):
                h, states = np.zeros((way.u.shape[1], 1), "f4"), {}
                for t in order:
                    h, _ = way.step(np.array([block[t]]), h)
                    states[t] = h
                ways.append(states)
            for t in range(len(block)):
                q = np.exp(net.v @ np.concatenate([ways[0][t], ways[1][t]]) + net.c)[:, 0]
                total += q / q.sum()
        assert row == pytest.approx(total / max(len(text), 1), abs=1e-4)


def site(n, seed=5):
    """Pages of one host whose menus, adverts and footers are drawn from a few, without any telling names; and their articles."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    menus = ["<div><ul>" + "".join(f"<li><a href=x>{words(1)}</a>" for _ in range(5)) + "</ul></div>" for _ in range(4)]
    boxes, ends = [f"<section>{words(6)}</section>" for _ in range(4)], [f"<div>&copy; {words(5)}</div>" for _ in range(4)]
    pages, articles = [], []
    for _ in range(n):
        blocks = [words(12) for _ in range(4)]
        articles.append("\n".join(blocks))
        pages.append(f"<body>{rng.choice(menus)}{rng.choice(boxes)}<div>{''.join(f'<p>{b}</p>' for b in blocks)}</div>{rng.choice(ends)}</body>")
    return pages, articles


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_op4_counts_alone_find_the_article(spark, most):
    pages, articles = site(60)
    frame = spark.createDataFrame([(i, "http://h.org/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(frame, declared=False, max_broadcast=most).collect()}
    assert out == dict(enumerate(articles))


def test_op4_templates_are_on_the_pages(spark):
    """On the given pages, with what they declare put aside, counts remove the menu of nearly every page of a large host."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", html.host_of(F.col("url")))
    large = pages.groupBy("host").count().orderBy(F.desc("count")).limit(1).select("host")
    out = html.extract(pages.join(large, "host"), declared=False).select("html", "text").collect()
    held = 0
    for r in out:
        menu = [re.sub("<[^>]*>", "", x) for x in re.findall("<li>.*?</li>", r["html"].split("<article>")[0])]
        held += all(x not in r["text"].split("\n") for x in menu)
    assert held > 0.9 * len(out)


def test_op9_names_whole_licence_texts(spark):
    """Texts as they stand in files, wrapped in lines and with holders' names; titles by version; a notice spread over comment lines."""
    import textwrap

    wrap = lambda name, k: "\n".join(textwrap.wrap(licenses.TEMPLATES[name][k], 70))
    full = {name: "Copyright 2021 Some Holder and others. All rights reserved.\n\n" + wrap(name, -1) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause")}
    full["ISC"] = "Copyright 2021 Some Holder\n\n" + wrap("ISC", 2)
    files = [(f"{name}/LICENSE", text) for name, text in full.items()] + [(f"{name}/src/a.c", "int") for name in full]
    gpl = {2: "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) someone", 3: "  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) someone"}
    files += [(f"gpl{v}/COPYING", text) for v, text in gpl.items()]
    notice = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES["GPL-3.0"][4], 60))
    files += [("n/a.py", "#!/usr/bin/python\n#\n" + notice + "\n#\nimport os\n"), ("r/a.txt", "Copyright 2020. All rights reserved. Proprietary and confidential.")]
    out = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for name in full:
        assert out[f"{name}/LICENSE"] == (name, "file") and out[f"{name}/src/a.c"] == (name, "inherited")
    assert [out[f"gpl{v}/COPYING"][0] for v in (2, 3)] == ["GPL-2.0", "GPL-3.0"] and out["n/a.py"] == ("GPL-3.0", "header") and out["r/a.txt"][0] == "Proprietary"


def test_op9_gate_loses_no_unit(spark):
    """Random mixtures of templates' terms: what reaches the bar matches the pattern."""
    rows, idf, other = licenses.weights()
    vectors = defaultdict(dict)
    for _, key, term, share in rows:
        vectors[key][term] = share
    pattern, rng = re.compile(licenses.keys()), random.Random(2)
    for _ in range(3000):
        own = sorted(rng.choice(list(vectors.values())))
        unit = rng.sample(own, rng.randrange(1, len(own) + 1)) + [f"w{k}" for k in range(rng.randrange(3))]
        w = {t: idf.get(t, other) for t in unit}
        best = max(sum(w.get(t, 0) * s for t, s in v.items()) for v in vectors.values()) / math.sqrt(sum(v * v for v in w.values()))
        assert best < licenses.LEAST or pattern.search(" ".join(unit))


def test_op9_query_and_null_columns(spark, sf, tmp_path):
    import duckdb

    out = licenses.op9_license_scan(spark, sf).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
        cursor = db.execute(licenses.OP9_SQL)
        names = [c[0] for c in cursor.description]
        want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    key = lambda r: (r["doc_id"], r["path"], r["license"], round(r["score"], 5), r["origin"], r["license_path"])
    assert sorted(map(str, map(key, out))) == sorted(map(str, map(key, want)))
    rows = [(None, "a", "Released under the MIT License"), (None, None, None), (3, None, "Licensed under the ISC License")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    assert got == {(None, "MIT"), (None, None), (3, "ISC")}
    alone = licenses.scan(spark.createDataFrame([(None, "Released under the MIT License"), (None, "x")], "path string, text string")).collect()
    assert {r["license"] for r in alone} == {"MIT", None}


def test_op9_bound_loses_no_unit(spark):
    """Mixtures of templates' terms and others, some repeated: what reaches the bar passes, and prose does not."""
    rows, idf, other = licenses.weights()
    vectors = defaultdict(dict)
    for _, key, term, share in rows:
        vectors[key][term] = share
    rng, made = random.Random(5), []
    for _ in range(1500):
        own = sorted(rng.choice(list(vectors.values())))
        unit = rng.sample(own, rng.randrange(1, len(own) + 1)) * rng.choice([1, 1, 2]) + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))]
        w = {t: (1 + math.log(n)) * idf.get(t, other) for t, n in Counter(unit).items()}
        best = max(sum(w.get(t, 0) * s for t, s in v.items()) for v in vectors.values()) / math.sqrt(sum(v * v for v in w.values()))
        made.append((" ".join(unit), best))
    prose = " ".join(f"{rng.choice(['the', 'of', 'in', 'and', 'to', 'it', 'for', 'with'])} w{k}" for k in range(100))
    frame = spark.createDataFrame([*made, (prose, 0.0)], "text string, best double")
    out = frame.select("best", licenses.can_reach(F.col("text")).alias("ok")).collect()
    assert all(r["ok"] for r in out if r["best"] >= licenses.LEAST) and not out[-1]["ok"] and sum(r["best"] >= licenses.LEAST for r in out) > 100
