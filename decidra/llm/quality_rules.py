"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch is a histogram with integer bucket bounds, 64 of them for each power of two, so a quantile's relative error is
1/32 at most.  Sketches are rows (language, source, measure, bucket, count): they merge by adding, and a source with too few
texts for its tails takes the merged sketch of its language, a language with too few that of the corpus.  A text is kept if
it fails no base rule and each measure lies within the fences of its group: a tail quantile of the group, moved away from
the median by a multiple of their distance.  The distance counts as ``least`` where nearly all of a group's texts are equal; this
is about what a sketch can't tell apart, or a few signs in a thousand.

Only DataFrame functions are used; no text is shuffled.

Defined results: a null or empty text has no words and fails the base rules.  Null languages and sources are groups
of their own.  Repeated rows count and are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: Texts that a sketch needs to set fences: two beyond the farthest tail.
LEAST_TEXTS = 200


@dataclass(frozen=True)
class Fence:
    """A measure in whole numbers, the tail quantile in percent, the multiple of its distance from the median, and the least distance."""

    name: str
    low: bool
    high: bool
    tail: int
    times: int
    least: int


#: Thousandths, but for the mean length of words in hundredths.
FENCES = (Fence("word_length", True, True, 90, 3, 16), Fence("symbols", False, True, 90, 3, 6), Fence("dup_lines", False, True, 99, 1, 30), Fence("capitals", False, True, 99, 1, 4))
PERCENTS = (1, 10, 50, 90, 99)


def statistics(documents: DataFrame) -> DataFrame:
    """One row of base counts and measures for each row; has (doc_id, lang, source) and no text."""
    rows = documents.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    rows = rows.withColumn("words", F.split(F.trim("text", F.lit(SPACES)), SPACE_CLASS)).withColumn("words", F.when(F.col("words")[0] != "", F.col("words")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    rows = rows.withColumn("lines", lines)
    window = lambda make: F.transform(F.slice("words", 1, F.greatest(F.size("words") - 4, F.lit(0))), lambda w, i: make(w, *(F.get("words", i + k) for k in range(1, 5))))
    rows = rows.withColumn("hashes", window(F.xxhash64))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    joined = window(lambda *w: F.concat_ws(" ", *w))
    ordered = F.when(some, F.array_sort(F.transform(joined, lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    rows = rows.select("doc_id", "lang", "source", "text", "lines", F.size("words").cast("long").alias("n_words"), ordered.alias("ordered"))
    rows = rows.withColumn("hits", F.array_sort(F.filter(F.transform("ordered", lambda e, j: F.when((F.get("ordered", j - 1)["s"] == e["s"]) | (F.get("ordered", j + 1)["s"] == e["s"]), e["i"])), lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("hits", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("hits", j + 1) - p, F.lit(5)))), F.lit(0), lambda s, x: s + x)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    removed = lambda chars: (F.char_length("text") - F.char_length(F.translate("text", chars, ""))).cast("long")
    counts = rows.select(
        "doc_id", "lang", "source", "n_words", F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"), removed(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), removed(letters).alias("n_capitals"), F.size("lines").cast("long").alias("n_lines"),
    )
    share = lambda a, times, b: F.when(F.col(b) > 0, F.expr(f"{times} * {a} div {b}")).otherwise(F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select("*", failed.alias("base_failed"), share("word_chars", 100, "n_words").alias("word_length"), share("n_symbols", 1000, "word_chars").alias("symbols"), share("n_dup_lines", 1000, "n_lines").alias("dup_lines"), share("n_capitals", 1000, "word_chars").alias("capitals"))


def bucket(value: str) -> Column:
    """The bucket of a whole number from 0."""
    return F.expr(f"CASE WHEN {value} < 64 THEN {value} ELSE (length(bin({value})) - 6) * 64 + shiftright({value}, length(bin({value})) - 6) END")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): a sketch of each measure by language and source."""
    measures = F.array(*(F.struct(F.lit(f.name).alias("measure"), bucket(f.name).cast("long").alias("bucket")) for f in FENCES))
    return stats.select("lang", "source", F.explode(measures).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, measure, n, q1, q10, ...): the lower bounds of the buckets with the quantiles ``PERCENTS``."""
    group = Window.partitionBy(*by, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    value = F.expr("CASE WHEN bucket < 64 THEN bucket ELSE shiftleft(bucket % 64, int(bucket div 64)) END")
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), value)).alias(f"q{p}")
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("n"), *map(at, PERCENTS))


def fences(parts: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(lang, source, one map of fences) for each language and source."""
    own = quantiles(parts, "lang", "source").alias("s")
    by_lang = quantiles(merged(parts, "lang"), "lang").alias("l")
    whole = quantiles(merged(parts)).alias("w")
    joined = own.join(by_lang, F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.measure") == F.col("l.measure"))).join(whole, F.col("s.measure") == F.col("w.measure"))
    pick = lambda c: F.when(F.col("s.n") >= least_texts, F.col(f"s.{c}")).when(F.col("l.n") >= least_texts, F.col(f"l.{c}")).otherwise(F.col(f"w.{c}")).alias(c)
    rows = joined.select(F.col("s.lang").alias("lang"), F.col("s.source").alias("source"), F.col("s.measure").alias("measure"), *(pick(f"q{p}") for p in PERCENTS))
    bounds = []
    for f in FENCES:
        mine, low, high = F.col("measure") == f.name, F.col(f"q{100 - f.tail}"), F.col(f"q{f.tail}")
        away = lambda d: f.times * F.greatest(d, F.lit(f.least))  # noqa: B023, E731
        bounds += [F.max(F.when(mine, low - away(F.col("q50") - low))).alias(f"{f.name}_low"), F.max(F.when(mine, high + away(high - F.col("q50")))).alias(f"{f.name}_high")]
    return rows.groupBy("lang", "source").agg(*bounds)


def judged(documents: DataFrame) -> DataFrame:
    """All counts, measures, fences and verdicts of each row."""
    stats = written(statistics(documents), "stats")
    limits = fences(sketches(stats)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for f in FENCES:
        inside = inside & (F.col(f.name) >= F.col(f"{f.name}_low") if f.low else F.lit(True)) & (F.col(f.name) <= F.col(f"{f.name}_high") if f.high else F.lit(True))
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
