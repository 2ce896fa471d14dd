"""Judge URLs by host and path rules, and where none fits by the ratio of two character language models.

A rule names a host, whose subdomains it includes, and the start of a path; the longest fitting rule wins. The URLs that
rules allow or block are the accepted and rejected examples. A variable-order Markov model of each class counts characters
after the two, one and no characters before them, each order smoothed with the next shorter one. A URL's score is the mean
difference of its log-likelihoods in thousandths; the threshold is the score that best parts a set of examples kept from the
counts. Probabilities are rounded to whole millionths of a log unit, so scores do not depend on the order of sums.

The alphabet has 32 symbols, so a model has at most 32768 cells whatever the input; it reaches the rows as a scalar subquery,
and judging needs no shuffle. Null URLs and those without ``://`` have an empty host and path, no rule and the score 0. With
no examples of a class to count or calibrate, the scores or the threshold are 0, and a score equal to the threshold allows.
Repeated rows are judged and counted as often as they stand. DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common

#: Host and path, and the verdict of each rule.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Letters, a digit, four signs of their own, one for the signs of queries and fragments, and one for all else.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_~"
SIZE = len(ALPHABET)
#: Weight of the shorter context against counts.
SMOOTH = 4.0
#: First digits of the checksum of example URLs that calibrate instead of being counted: 3 of 16.
CALIBRATE = "012"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELLS = SIZE**3


def with_host_path(pages: DataFrame) -> DataFrame:
    """Add ``url_rest`` (after ``://``), host and path."""
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    host = F.regexp_extract("url_rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("url_rest"), F.length(host) + 1, F.length("url_rest")), "^[^?#]*", 0)
    return pages.withColumn("url_rest", rest).withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_of(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits; null: none. The list is part of the plan, so it has to be short."""
    out: Column = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def verdict_of(rules: Sequence[tuple[str, str]]) -> Column:
    out: Column = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(out)
    return out


def grams() -> Column:
    """Each character of a URL with the two before it, as one number; ``~~`` stands before the first."""
    lower = F.translate("url_rest", UPPER + "123456789?#=&", LOWER + "000000000____")
    plain = F.regexp_replace(lower, "[^a-z0./_-]", "~")
    codes = F.transform(F.split(F.concat(F.lit("~~"), plain), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    three = lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - 2),
        lambda i: F.element_at(c, i) * SIZE**2 + F.element_at(c, i + 1) * SIZE + F.element_at(c, i + 2),
    )
    return F.when(F.length(plain) > 0, F.element_at(F.transform(F.array(codes), three), 1)).otherwise(F.array().cast("array<int>"))


def model(examples: DataFrame) -> DataFrame:
    """One row with the score of every cell, from ``gram`` rows with the ``verdict`` of their URLs."""
    accept, reject = F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")
    seen = examples.groupBy("gram").agg(accept.alias("a"), reject.alias("b"))
    cells = examples.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    cells = cells.join(seen, F.col("cell") == F.col("gram"), "left").na.fill(0, ["a", "b"])
    wide = F.pmod(F.col("cell"), F.lit(SIZE))
    pair = F.pmod(F.col("cell"), F.lit(SIZE**2))
    scores = {}
    for side in ("a", "b"):
        total = lambda *by: F.sum(side).over(Window.partitionBy(*by))  # noqa: B023, E731
        p0 = (total(wide) + SMOOTH * (1.0 / SIZE)) / (total(F.lit(0)) + SMOOTH)
        p1 = (total(pair) + SMOOTH * p0) / (total(F.floor(pair / SIZE)) + SMOOTH)
        p2 = (F.col(side) + SMOOTH * p1) / (total(F.floor(F.col("cell") / SIZE)) + SMOOTH)
        scores[side] = F.ln(p2)
    both = F.sum("a").over(Window.partitionBy(F.lit(0))) * F.sum("b").over(Window.partitionBy(F.lit(0))) > 0
    value = F.when(both, F.round(1e6 * (scores["a"] - scores["b"])).cast("int")).otherwise(0)
    rows = cells.select("cell", value.alias("value"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "value"))), lambda s: s["value"]).alias("model"))


def score(cells: Column, found: Column) -> Column:
    """Mean score of a URL's characters in thousandths, rounded down."""
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, g: s + F.element_at(cells, g + 1))
    return F.when(F.size(found) > 0, F.floor(total / (1000.0 * F.size(found)))).otherwise(0).cast("long")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the least score ``t`` for which "allow from ``t`` on" is right most often, both classes weighing the same."""
    # Scores are whole thousandths of a bounded ratio: some ten thousand values at most.
    by_score = scored.groupBy("score").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    n_a, n_b = F.sum("a").over(every), F.sum("b").over(every)
    right = (n_a - F.coalesce(F.sum("a").over(below), F.lit(0))).cast("double") * n_b + F.coalesce(F.sum("b").over(below), F.lit(0)).cast("double") * n_a
    best = by_score.select("score", right.alias("right"), (n_a * n_b > 0).alias("both"))
    found = F.max_by(F.when(F.col("both"), F.col("score")), F.struct("right", -F.col("score")))
    return best.agg(F.coalesce(found, F.lit(0).cast("long")).alias("t"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Add host, path, rule, url_score and verdict to rows with a ``url``; columns of these names are replaced."""
    parsed = with_host_path(pages.drop("host", "path", "rule", "verdict", "url_score", "url_rest")).withColumn("rule", rule_of(rules))
    ruled = parsed.withColumn("verdict", verdict_of(rules))
    kept = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*CALIBRATE)
    examples = ruled.filter("verdict is not null").select("verdict", grams().alias("grams"), kept.alias("kept"))
    cells = model(examples.filter("not kept").select("verdict", F.explode("grams").alias("gram"))).scalar()
    known = examples.filter("kept").withColumn("url_cells", cells)
    limit = threshold(known.select("verdict", score(F.col("url_cells"), F.col("grams")).alias("score"))).scalar()
    scored = ruled.withColumn("url_cells", cells).withColumn("url_score", score(F.col("url_cells"), grams()))
    by_model = F.when(F.col("url_score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", F.coalesce("verdict", by_model)).drop("url_rest", "url_cells")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> tuple[str, str]:
    fits, verdicts = [], []
    for text, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{text}'")
        verdicts.append(f"WHEN '{text}' THEN '{verdict}'")
    return f"CASE {' '.join(fits)} END", f"CASE rule {' '.join(verdicts)} END"


def _sql_log(side: str) -> str:
    def total(by: str) -> str:
        return f"sum({side}) OVER (PARTITION BY {by})"

    p0 = f"(({total(f'cell % {SIZE}')}::DOUBLE + {SMOOTH}::DOUBLE * {1.0 / SIZE}::DOUBLE) / (sum({side}) OVER ()::DOUBLE + {SMOOTH}::DOUBLE))"
    p1 = f"(({total(f'cell % {SIZE**2}')}::DOUBLE + {SMOOTH}::DOUBLE * {p0}) / ({total(f'(cell % {SIZE**2}) // {SIZE}')}::DOUBLE + {SMOOTH}::DOUBLE))"
    return f"ln(({side}::DOUBLE + {SMOOTH}::DOUBLE * {p1}) / ({total(f'cell // {SIZE}')}::DOUBLE + {SMOOTH}::DOUBLE))"


_RULE, _VERDICT = _sql_rules()
_KEPT = f"left(md5(url), 1) IN ({', '.join(repr(c) for c in CALIBRATE)})"
ORACLE = rf"""
WITH rests AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rests),
parsed AS (
  SELECT *, translate(raw_host, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, len(raw_host) + 1), '^[^?#]*') AS path,
         regexp_replace(translate(rest, '{UPPER}123456789?#=&', '{LOWER}000000000____'), '[^a-z0./_-]', '~', 'g') AS plain FROM hosts),
ruled AS (SELECT *, {_RULE} AS rule FROM parsed),
judged AS (SELECT *, {_VERDICT} AS verdict FROM ruled),
chars AS (SELECT rid, url, verdict, '~~' || plain AS s, unnest(range(1, len(plain) + 1)) AS i FROM judged),
grams AS (
  SELECT rid, url, verdict, (instr('{ALPHABET}', substr(s, i, 1)) - 1) * {SIZE**2} + (instr('{ALPHABET}', substr(s, i + 1, 1)) - 1) * {SIZE}
         + instr('{ALPHABET}', substr(s, i + 2, 1)) - 1 AS gram FROM chars),
seen AS (
  SELECT gram, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b
  FROM grams WHERE verdict IS NOT NULL AND NOT {_KEPT} GROUP BY gram),
cells AS (SELECT r.range AS cell, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM range({CELLS}) r LEFT JOIN seen ON r.range = gram),
model AS (
  SELECT cell, CASE WHEN sum(a) OVER () * sum(b) OVER () > 0 THEN CAST(round(1e6::DOUBLE * ({_sql_log("a")} - {_sql_log("b")})) AS BIGINT) ELSE 0 END AS value
  FROM cells),
sums AS (SELECT rid, CAST(floor(sum(value)::DOUBLE / (1000.0::DOUBLE * count(*))) AS BIGINT) AS score FROM grams JOIN model ON gram = cell GROUP BY rid),
scored AS (SELECT j.*, coalesce(s.score, 0) AS score FROM judged j LEFT JOIN sums s USING (rid)),
by_score AS (
  SELECT score, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b
  FROM scored WHERE verdict IS NOT NULL AND {_KEPT} GROUP BY score),
rated AS (
  SELECT score, sum(a) OVER () * sum(b) OVER () > 0 AS usable,
         (sum(a) OVER () - coalesce(sum(a) OVER below, 0))::DOUBLE * sum(b) OVER () + coalesce(sum(b) OVER below, 0)::DOUBLE * sum(a) OVER () AS good
  FROM by_score WINDOW below AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce((SELECT score FROM rated WHERE usable ORDER BY good DESC, score LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict FROM scored, best
"""
