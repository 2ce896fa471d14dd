"""Document fingerprints: bottom-k sketches of five-word shingle hashes, in DataFrame functions only.

A fingerprint is the ``k`` smallest distinct hashes of a text's shingles. Two fingerprints merge into that of both texts
together, and compare to an estimate of resemblance and containment; one alone gives the number of distinct shingles. With
fewer than ``k`` shingles all of these are exact. A text of one to four words is one shingle; a null text or one without
words has the empty fingerprint, which resembles only another empty one, with 1.

The query pairs each document with the next one in descending id, after the last the first. Ties in the id stand in text
order, null ids last. Ranges of ids, cut at approximate quantiles, are sorted by themselves, and the first row of the next
range is added to each, so neither the order nor the pairing needs one task or a second shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common

K = 128
#: Hexadecimal digits of a hash: 64 bits.
DIGITS = 16
#: Rows of one range of ids, until the number of ranges reaches the most that the driver holds as bounds.
RANGE_ROWS, MOST_RANGES = 2_000, 10_000
#: Bounds looked at together.
STEP = 64


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprint(text: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, as an array of hexadecimal texts in order."""

    def of(w: Column) -> Column:
        last = F.size(w) - common.SHINGLE
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        shingles = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i + 1, common.SHINGLE), " ").cast("binary")), 1, DIGITS))
        return F.when(F.size(w) > 0, F.slice(F.array_sort(F.array_distinct(shingles)), 1, k)).otherwise(F.array().cast("array<string>"))

    # One-element transform: the words are computed once and named.
    return F.element_at(F.transform(F.array(words(F.coalesce(text, F.lit("")))), of), 1)


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def from_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f".{{{DIGITS}}}"), 0)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of both texts' shingles together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of the merged sketch: an estimate of intersection over union."""

    def of(x: Column) -> Column:
        union, both = x["union"], x["both"]
        size = F.least(F.size(union), F.lit(k))
        shared = F.size(F.filter(both, lambda h: h <= F.element_at(union, size)))
        return F.when(F.size(union) > 0, shared.cast("double") / size).otherwise(1.0)

    # One-element transform: the merged and the common hashes are computed once and named.
    merged = F.struct(F.array_sort(F.array_union(a, b)).alias("union"), F.array_intersect(a, b).alias("both"))
    return F.element_at(F.transform(F.array(merged), of), 1)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the ``k``-th smallest hash."""
    last = F.conv(F.substring(F.element_at(sketch, -1), 1, 12), 16, 10).cast("double") / float(16**12)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def _ranges(docs: DataFrame) -> Column:
    """Number of the range of ids that a row is in; higher ids, higher numbers; 0 for null."""
    rows = docs.agg(F.count("*")).first()[0]
    count = int(min(MOST_RANGES, max(1, rows // RANGE_ROWS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts)) if count > 1 else []
    if not bounds:
        return F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    block = below(F.lit(bounds[::STEP]))
    start = F.greatest(block - 1, F.lit(0)) * STEP
    return F.when(F.col("doc_id").isNull(), 0).otherwise(1 + start + below(F.slice(F.lit(bounds), start + 1, F.lit(STEP))))


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``next_text`` and ``next_sketch``, those of the next document; needs doc_id and text."""
    base = docs.select("doc_id", common.text_or_empty().alias("text"), _ranges(docs).alias("part"))
    # The first row of each range: one id per range, at most MOST_RANGES + 1 of them.
    heads = base.groupBy(F.col("part").alias("head_part")).agg(F.max("doc_id").alias("head_id"))
    texts = base.join(F.broadcast(heads), (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    firsts = texts.groupBy("part").agg(F.min("text").alias("text"))
    down = Window.orderBy(F.col("head_part").desc())
    before = heads.select(
        "head_part",
        F.coalesce(F.lead("head_part").over(down), F.max("head_part").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"),
    )
    tails = firsts.join(F.broadcast(before), "part").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("head_part").alias("part"), F.lit(1).alias("tail"))
    rows = base.withColumn("tail", F.lit(0)).unionByName(tails)
    rows = rows.withColumn("sketch", F.unhex(as_text(fingerprint(F.col("text")))))
    order = Window.partitionBy("part").orderBy("tail", F.col("doc_id").desc_nulls_last(), "text")
    led = rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return led.filter("tail = 0").drop("tail", "part")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = with_next(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    text = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        F.lower(F.hex("sketch")).alias("fingerprint"),
        F.lower(F.hex("next_sketch")).alias("next_fingerprint"),
    )
    # Behind a generator the sketches are computed once, however often they are used.
    sketches = F.struct(
        from_text(F.col("fingerprint")).alias("own"),
        from_text(F.col("next_fingerprint")).alias("following"),
        fingerprint(F.col("edited")).alias("changed"),
    )
    sketched = text.select("*", F.inline(F.array(sketches)))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("following")).alias("near_next"),
    )


_SHINGLES = rf"""list_sort(list_distinct(list_transform(
    CASE WHEN len({{w}}) = 0 THEN [] ELSE range(1, greatest(len({{w}}) - 4, 1) + 1) END,
    lambda i: left(md5(array_to_string({{w}}[i : i + 4], ' ')), {DIGITS}))))[1 : {K}]"""


def _near(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1 : {K}]"
    return f"""CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE
      len(list_intersect({union}, list_intersect({a}, {b})))::DOUBLE / greatest(len({union}), 1)::DOUBLE END"""


ORACLE = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
led AS (
  SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM base
  WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edited AS (
  SELECT *, substr(text, 1, len(text) - len(text) // 2) || substr(next_text, 1, len(text) // 2) AS edited FROM led),
worded AS (
  SELECT *, regexp_extract_all(text, '{common.WORD}') AS w, regexp_extract_all(edited, '{common.WORD}') AS we,
         regexp_extract_all(next_text, '{common.WORD}') AS wn FROM edited),
sketched AS (
  SELECT *, {_SHINGLES.format(w="w")} AS f, {_SHINGLES.format(w="we")} AS fe, {_SHINGLES.format(w="wn")} AS fn FROM worded)
SELECT doc_id, CAST(len(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f, '') AS fingerprint,
       array_to_string(fe, '') AS edited_fingerprint, {_near("f", "fe")} AS near_edited, {_near("f", "fn")} AS near_next
FROM sketched
"""
