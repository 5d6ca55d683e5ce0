"""Quality rules: a learned decision list over text statistics, as Spark expressions.

Sequential covering learns the list from labelled statistics. A rule is a conjunction
of thresholds, grown on two thirds of the sample by information gain and pruned on the
rest; rows that a rule covers leave the sample and the next rule is sought, until no
rule is precise enough. The list becomes one ordered ``CASE`` expression, so applying
it is a projection: no join, no shuffle, no Python.

Only the labelled sample reaches the driver, as statistics, and it has ``max_labelled``
rows at most (those with the smallest hash of their id). Null and empty texts have no
words and fail the base rule. Repeated rows get equal results. Without labels the list
is empty and the base rule decides alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.sampling import smallest
from docengine.llm.words import n_pieces, pieces, words_of

#: Words in a window that must not repeat.
WINDOW = 8
#: Statistics that rules may test; each is a ratio or a length and so independent of the size of a text.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "dup_line_ratio", "repeat_ratio", "stutter_ratio", "line_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more.

    Windows are compared by their 64-bit hashes. Only a text with a repeated hash is sorted.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(rows: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(rows, j)["h"] == e["h"], F.lit(False))
            at = F.transform(rows, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            fresh = F.transform(at, lambda i, j: F.coalesce(F.least(F.get(at, j + 1) - i, F.lit(window)), F.lit(window)))
            return F.aggregate(fresh, F.lit(0), lambda a, b: a + b)

        return let(let(rows, again), total)

    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n > window, found).otherwise(0).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``stats`` of counts and ratios of the whole text; a column of that name is replaced."""
    whole = F.coalesce(F.col("__text"), F.lit(""))
    count = lambda keep: F.length(F.regexp_replace(whole, f"[^{keep}]+", "")).cast("long")
    lines = F.col("__lines")
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("__text"))
    df = df.withColumn("cut", pieces(F.col("__text"))).withColumn("__lines", F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n_words = n_pieces(F.col("cut"))
    df = df.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("cut", "")).cast("long"),
            "n_symbols": count("#*$%&|<>"),
            "n_upper": count(r"\p{Lu}"),
            "n_digits": count("0-9"),
            "n_marks": count("!?"),
            # words equal to the word before them
            "n_stutters": let(words_of(F.col("cut")), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": let(words_of(F.col("cut")), lambda w: repeated_words(w)),
        }
    )
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = {
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"),
        "mark_ratio": per("n_marks", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "stutter_ratio": per("n_stutters", "n_words"),
        "line_words": per("n_words", "n_lines"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "stats"]
    return df.select(*rest, F.struct(*counts, *(v.alias(k) for k, v in ratios.items()), failed.alias("base_failed")).alias("stats"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}").cast("double")
        return value > F.lit(self.bound) if self.above else value <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


def learn(rows: list[tuple], bad: list[bool], min_precision: float = 0.9, max_rules: int = 12, max_tests: int = 4, cuts: int = 128) -> list[tuple[Test, ...]]:
    """Ordered rules that find ``bad`` rows; ``rows`` hold the values of FEATURES."""
    import numpy as np

    if not rows:
        return []
    x, y = np.asarray(rows, dtype=float), np.asarray(bad, dtype=bool)
    held = np.arange(len(y)) % 3 == 2
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts))) for f in range(x.shape[1])]
    bounds = [(b[:-1] + b[1:]) / 2 for b in bounds]
    left, rules = np.ones(len(y), dtype=bool), []

    def covers(rule, at):
        out = at.copy()
        for f, above, b in rule:
            out &= (x[:, f] > b) == above
        return out

    def grown(at):
        rule: list = []
        while len(rule) < max_tests:
            p, n = int((at & y).sum()), int((at & ~y).sum())
            if not p or not n:
                break
            base, best = np.log2(p / (p + n)), (0.0, None)
            for f, cut in enumerate(bounds):
                if not len(cut):
                    continue
                side = np.searchsorted(cut, x[at, f], side="left")  # number of bounds below the value
                pos = np.bincount(side[y[at]], minlength=len(cut) + 1)
                neg = np.bincount(side[~y[at]], minlength=len(cut) + 1)
                low_p, low_n = np.cumsum(pos)[:-1], np.cumsum(neg)[:-1]
                for above, pp, nn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                    gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                    if gain[k := int(gain.argmax())] > best[0] + 1e-9:
                        best = (float(gain[k]), (f, above, float(cut[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            at = covers(rule[-1:], at)
        return rule

    def worth(rule):
        at = covers(rule, left & held)
        p, n = int((at & y).sum()), int((at & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < max_rules and (left & y).sum() >= 3:
        rule = grown(left & ~held)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        at = covers(rule, left)
        p, n = int((at & y).sum()), int((at & ~y).sum())
        if not rule or p < 3 or p < min_precision * (p + n) or worth(rule) < 2 * min_precision - 1:
            break
        rules.append(tuple(Test(FEATURES[f], above, b) for f, above, b in rule))
        left &= ~at
    return rules


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_labelled: int = 20_000, **options) -> list[tuple[Test, ...]]:
    """The decision list for ``labels`` (1 good, 0 bad; the worst of repeated labels counts)."""
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).alias("good"))
    sample = smallest(known.withColumn("h", F.xxhash64("id")), "h", max_labelled, "id").drop("h")
    sample = F.broadcast(sample)  # max_labelled rows at most
    seen = statistics(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sample, "id"))
    values = [F.col(f"stats.{x}").cast("double") for x in FEATURES]
    # texts that the base rule rejects teach the list nothing; a filter here would compute the statistics twice
    got = seen.select("id", "good", F.array(*values).alias("x"), F.col("stats.base_failed").alias("failed")).collect()
    got = sorted({(r["id"], r["good"], tuple(r["x"])) for r in got if not r["failed"]})
    return learn([x for _, _, x in got], [good == 0 for _, good, _ in got], **options)


def verdict(rules: list[tuple[Test, ...]], stats: str = "stats") -> Column:
    """True for rows that no rule rejects: one ordered conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        hit = F.lit(True)
        for test in rule:
            hit = hit & test.column(stats)
        out = F.when(hit, F.lit(False)).otherwise(out)
    return out & ~F.col(f"{stats}.base_failed")


def judge(docs: DataFrame, rules: list[tuple[Test, ...]], text: str = "text") -> DataFrame:
    """``docs`` with the struct ``stats`` and the boolean ``kept``."""
    return statistics(docs, text).withColumn("kept", verdict(rules))


def keep(docs: DataFrame, rules: list[tuple[Test, ...]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects.

    The row number keeps Spark from moving the filter below the statistics, where it would compute them again.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    judged = judge(rows, rules).withColumn("__at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__at") >= 0)).select("doc.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judge(docs, rules).select("doc_id", *(f"stats.{x}" for x in counts), "kept")
