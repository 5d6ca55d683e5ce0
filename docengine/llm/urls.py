"""URL filter: host and path rules first, then a ratio of two character language models.

Rules name a host and a path prefix; the longest that fits decides. URLs without a
rule are judged by two smoothed variable-order Markov models over characters, one of
URLs that rules accept and one of those they reject. A context is used only where its
class saw it ``support`` times or more, else the next shorter one; orders are
interpolated by the number of distinct continuations. The log-likelihood difference
is divided by the length, and a URL is allowed from a threshold on that is calibrated
on three sixteenths of the ruled URLs, by their hash, held out of training.

All of it is relational. Characters are mapped to ``len(SYMBOLS)`` symbols, so there
are at most ``len(SYMBOLS) ** (ORDER + 1)`` (1.3 million) different grams: the model is
a table of that proven size, whatever the number of URLs, and may be broadcast. URLs
are counted and scored once per different text, so repeated URLs cost nothing.

A null URL, or one without ``://``, has an empty host and path, no rule and score 0.
An empty table gives an empty result; without ruled URLs all scores are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.shared import materialize

#: (verdict, rule); a rule is a host and a path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``^`` starts and ``$`` ends a URL, ``0`` is any digit, ``~`` any other character.
SYMBOLS = LOWER + "0./_-~^$"
#: Characters of the longest context.
ORDER = 3
#: Scores are cut to this range and counted in steps of 0.01 for the calibration.
RANGE, STEP = 5.0, 0.01


def host_path(url: Column) -> tuple[Column, Column]:
    cut = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(cut(1), UPPER, LOWER), cut(2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule); null if none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The URL after ``://`` in SYMBOLS, between markers."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)", 1)
    plain = F.regexp_replace(F.translate(rest, UPPER + "123456789", LOWER + "0" * 9), "[^a-z0./_-]", "~")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def grams(shape: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(shape) - ORDER), lambda i: F.substr(shape, i, F.lit(ORDER + 1)))


def model(counts: DataFrame, support: int = 4) -> DataFrame:
    """``counts`` (gram, good, bad) with ``gain``: log P(last symbol | context) of good less that of bad."""
    df = counts
    for side in ("good", "bad"):
        df = df.withColumn(f"p_{side}", F.lit(1.0 / len(SYMBOLS)))
    for k in range(ORDER + 1):
        tail = F.right("gram", F.lit(k + 1))
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
        context = F.substr("tail", F.lit(1), F.lit(k))
        sums = seen.groupBy(context.alias("context")).agg(
            *(F.sum(f"n_{s}").alias(f"all_{s}") for s in ("good", "bad")),
            *(F.count_if(F.col(f"n_{s}") > 0).alias(f"kinds_{s}") for s in ("good", "bad")),
        )
        known = seen.withColumn("context", context).join(sums, "context").drop("context")
        df = df.withColumn("tail", tail).join(known, "tail")
        for s in ("good", "bad"):
            mixed = (F.col(f"n_{s}") + F.col(f"kinds_{s}") * F.col(f"p_{s}")) / (F.col(f"all_{s}") + F.col(f"kinds_{s}"))
            df = df.withColumn(f"p_{s}", F.when(F.col(f"all_{s}") >= support, mixed).otherwise(F.col(f"p_{s}")))
        df = df.select("gram", "good", "bad", "p_good", "p_bad")
    return df.select("gram", (F.log("p_good") - F.log("p_bad")).alias("gain"))


def scored(shapes: DataFrame, gains: DataFrame) -> DataFrame:
    """One row per different ``shape`` with its ``score``: the mean gain of its symbols."""
    each = shapes.select("shape").distinct().select("shape", F.explode(grams(F.col("shape"))).alias("gram"))
    return each.join(F.broadcast(gains), "gram").groupBy("shape").agg(F.avg("gain").alias("score"))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """``bins`` (step, good, bad): the lowest score with the best sum of both classes' hit rates."""
    good, bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not good or not bad:
        return 0.0
    best, at, below_good, below_bad = -1.0, 0, 0, 0
    for step, g, b in sorted(bins):
        if (value := (good - below_good) * bad + below_bad * good) > best:  # hit rates, times good and bad
            best, at = value, step
        below_good, below_bad = below_good + g, below_bad + b
    return at * STEP


def judge(pages: DataFrame, url: str = "url", rules=RULES, support: int = 4) -> DataFrame:
    """``pages`` with a struct ``verdict``: host, path, rule, score, verdict."""
    host, path = host_path(F.col("row")[url])
    rows = pages.select(F.struct("*").alias("row")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", symbols(F.col("row")[url]))
    known = rows.where(F.col("row")[url].contains("://")).groupBy("shape", (F.col("best.verdict") == "allow").alias("allowed")).agg(F.count(F.lit(1)).alias("n"))
    known = materialize(known.withColumn("held", F.substring(F.md5("shape"), 1, 1) < "3"), "urls")
    side = lambda good: F.sum(F.when(~F.col("held") & (F.col("allowed") == good), F.col("n")).otherwise(0))
    counts = known.select("*", F.explode(grams(F.col("shape"))).alias("gram")).groupBy("gram").agg(side(True).alias("good"), side(False).alias("bad"))
    # at most len(SYMBOLS) ** (ORDER + 1) rows
    gains = materialize(model(materialize(counts, "url-grams"), support), "url-model")
    scores = materialize(scored(known, gains), "url-scores")
    step = F.floor(F.least(F.greatest("score", F.lit(-RANGE)), F.lit(RANGE)) / STEP)
    bins = known.where("held and allowed is not null").join(scores, "shape").groupBy(step.alias("step"))
    # at most 2 * RANGE / STEP + 1 rows
    bins = bins.agg(F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("allowed"), F.col("n")).otherwise(0))).collect()
    least = threshold([tuple(map(int, x)) for x in bins])
    out = rows.join(scores, "shape", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("best.verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    rest = [F.col("row")[c].alias(c) for c in pages.columns if c != "verdict"]
    return out.select(*rest, F.struct("host", "path", F.col("best.rule").alias("rule"), "score", verdict.alias("verdict")).alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "verdict.host", "verdict.path", "verdict.rule", "verdict.verdict")


def _sql() -> str:
    """The query for DuckDB: the same counts, recursion over orders and threshold."""
    rules = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{'verdict': '{v}', 'rule': '{r}'}}"
        for v, r in sorted(RULES, key=lambda r: -len(r[1]))
    )
    orders, before = [], f"SELECT gram, 1.0::DOUBLE / {len(SYMBOLS)} AS p_good, 1.0::DOUBLE / {len(SYMBOLS)} AS p_bad FROM counts"
    for k in range(ORDER + 1):
        mixed = ", ".join(
            f"CASE WHEN all_{s} >= 4 THEN (n_{s} + kinds_{s} * p_{s}) / (all_{s} + kinds_{s})::DOUBLE ELSE p_{s} END AS p_{s}" for s in ("good", "bad")
        )
        orders.append(f"""
seen{k} AS (SELECT right(gram, {k + 1}) AS tail, sum(good)::BIGINT AS n_good, sum(bad)::BIGINT AS n_bad FROM counts GROUP BY 1),
sums{k} AS (SELECT left(tail, {k}) AS context, sum(n_good)::BIGINT AS all_good, sum(n_bad)::BIGINT AS all_bad,
  count(*) FILTER (n_good > 0) AS kinds_good, count(*) FILTER (n_bad > 0) AS kinds_bad FROM seen{k} GROUP BY 1),
p{k} AS (SELECT gram, {mixed} FROM ({before}) b JOIN seen{k} ON right(gram, {k + 1}) = tail JOIN sums{k} ON left(tail, {k}) = context)""")
        before = f"SELECT * FROM p{k}"
    return rf"""
WITH cut AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         '{"^" * ORDER}' || regexp_replace(translate(regexp_extract(url, '(?s)\A.*?://(.*)', 1), '{UPPER}123456789', '{LOWER}{"0" * 9}'), '[^a-z0./_-]', '~', 'g') || '$' AS shape
  FROM pages
), ruled AS (SELECT *, CASE {rules} END AS best FROM cut),
known AS (SELECT shape, best.verdict = 'allow' AS allowed, count(*) AS n, left(md5(shape), 1) < '3' AS held FROM ruled WHERE contains(url, '://') GROUP BY ALL),
positions AS (SELECT shape, substr(shape, i, {ORDER + 1}) AS gram
  FROM (SELECT shape, unnest(range(1, length(shape) - {ORDER} + 1)) AS i FROM (SELECT DISTINCT shape FROM known))),
counts AS (SELECT gram, sum(CASE WHEN NOT held AND allowed THEN n ELSE 0 END)::BIGINT AS good, sum(CASE WHEN NOT held AND NOT allowed THEN n ELSE 0 END)::BIGINT AS bad
  FROM known JOIN positions USING (shape) GROUP BY gram),{",".join(orders)},
scores AS (SELECT shape, avg(ln(p_good) - ln(p_bad)) AS score FROM positions JOIN p{ORDER} USING (gram) GROUP BY shape),
bins AS (SELECT floor(least(greatest(score, -{RANGE}::DOUBLE), {RANGE}::DOUBLE) / {STEP}::DOUBLE)::BIGINT AS step,
  sum(CASE WHEN allowed THEN n ELSE 0 END)::BIGINT AS good, sum(CASE WHEN NOT allowed THEN n ELSE 0 END)::BIGINT AS bad
  FROM known JOIN scores USING (shape) WHERE held AND allowed IS NOT NULL GROUP BY 1),
ranked AS (SELECT step, ((SELECT sum(good) FROM bins) - coalesce(sum(good) OVER w, 0)) * (SELECT sum(bad) FROM bins)
  + coalesce(sum(bad) OVER w, 0) * (SELECT sum(good) FROM bins) AS value,
  (SELECT sum(good) FROM bins) > 0 AND (SELECT sum(bad) FROM bins) > 0 AS usable
  FROM bins WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bar AS (SELECT coalesce((SELECT CASE WHEN usable THEN step * {STEP}::DOUBLE ELSE 0 END FROM ranked ORDER BY value DESC, step LIMIT 1), 0)::DOUBLE AS least)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN coalesce(score, 0) >= (SELECT least FROM bar) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN scores USING (shape)
"""


OP2_SQL = _sql()
