"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Metric: (numerator, denominator); its value is their quotient in thousandths.
METRICS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Sketched beside the metrics, as it tells what a single event weighs in a group's usual text.
SIZE = "n_words"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeats = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            hit = np.zeros(n + 3, np.bool_)
            first = np.fromiter((often[x] > 1 for x in windows), np.bool_, n - 2)
            for i in range(3):
                hit[i : i + n - 2] |= first
            repeats = int(hit.sum())
    return n, len(text) - (len(raw) - len(raw.translate(None, SPACE))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every row."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")}

    def rows(batches):
        for batch in batches:
            found = np.array([text_counts(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), *(pa.array(x) for x in found.T.copy())], [*kinds, *COUNTS])

    return docs.select(*kinds, F.col("text").cast("string").alias("text")).mapInArrow(rows, ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"{c} long" for c in COUNTS]))


def bucket(value: Column) -> Column:
    """The lower end of a value's sketch bucket: exact below 64, else the six leading bits, so within 1/32."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def value(metric: str) -> Column:
    """A metric of METRICS in thousandths, 0 where its denominator is 0."""
    a, b = METRICS[metric]
    return F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(F.lit(0).cast("long"))


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: per group and metric (SIZE too) the documents in each bucket that pass the base rules.

    Sketches merge by adding; those of a language or of all documents are sums of their groups' sketches.
    """
    each = [F.struct(F.lit(k).alias("metric"), value(k).alias("value")) for k in METRICS]
    each.append(F.struct(F.lit(SIZE).alias("metric"), F.col(SIZE).alias("value")))
    rows = counts.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*each)).alias("v"))
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket(F.col("v.value")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, metric, docs and the lower ends of the buckets that hold the quartiles."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "metric")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket"))).alias(f"q{k}")
    return run.groupBy(*by, "metric", "docs").agg(at(1), at(2), at(3))


QUANTILES = ("q1", "q2", "q3")


def fences(counts: DataFrame, prior_docs: int = 50, reach: int = 15) -> DataFrame:
    """Per (lang, source) and metric: docs, q1, q2, q3, low and high.

    Every group's quantiles come from its own sketch, drawn toward those of its language, and these toward those of all
    documents, as if ``prior_docs`` documents more had the parent's quantile: (docs * own + prior_docs * parent) div
    (docs + prior_docs). So no group's size switches anything. high lies ``reach`` spreads above the upper quartile, so that
    junk of up to a quarter of a group doesn't move it, low as many below the lower; a spread is the distance to the median, but at least what one event makes in a text of the
    group's median size and the sketch's resolution (a metric that is 0 in nearly all texts has no other spread).
    """
    sketch = stored(sketches(counts), "quality-sketches")
    own = quantiles(sketch, "lang", "source").alias("o")
    lang, everything = quantiles(sketch, "lang").alias("l"), quantiles(sketch).alias("a")
    both = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric")))
    both = both.join(F.broadcast(everything), F.col("o.metric") == F.col("a.metric"))  # a row for each of METRICS and SIZE

    def drawn(docs: str, mine: str, parent: str) -> Column:
        return F.expr(f"({docs} * {mine} + {prior_docs} * ({parent})) div ({docs} + {prior_docs})")

    parent = {q: f"(l.docs * l.{q} + {prior_docs} * a.{q}) div (l.docs + {prior_docs})" for q in QUANTILES}
    each = both.select("o.lang", "o.source", "o.metric", "o.docs", *[drawn("o.docs", f"o.{q}", parent[q]).alias(q) for q in QUANTILES])
    group = W.partitionBy("lang", "source")  # a row for each of METRICS and SIZE
    size = F.max(F.when(F.col("metric") == SIZE, F.col("q2"))).over(group)
    lined = each.withColumn("size", F.greatest(size, F.lit(1))).filter(F.col("metric").isin(*METRICS)).withColumn("one", F.expr("1000 div size"))
    low = F.col("q1") - reach * F.greatest(F.col("q2") - F.col("q1"), F.col("one"), F.expr("q2 div 32"))
    high = F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q2"), F.col("one"), F.expr("q3 div 32"))
    return lined.select("lang", "source", "metric", "docs", *QUANTILES, low.alias("low"), high.alias("high"))


def judged(docs: DataFrame, least_words: int = 50, most_repeats: int = 50, prior_docs: int = 50, reach: int = 15) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, kept, and reasons (the metrics outside their fences) of every row.

    base_failed: under ``least_words`` words, or over ``most_repeats`` percent of words in repeated 3-word windows.
    kept: not base_failed and every metric inside the fences of the row's language and source (``fences``).

    Nulls: a null text is empty and fails; null languages and sources are groups of their own. Repeated rows count and
    are judged each. An empty table gives no rows. Other columns of ``docs`` are not read. Only counts by bucket are
    gathered, so one source may hold any share of the rows.
    """
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeats)
    counts = stored(counted(docs).withColumn("base_failed", failed), "quality-counts")
    rule = F.struct("metric", F.struct("low", "high"))
    found = fences(counts, prior_docs, reach).groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.map_from_entries(F.collect_list(rule)).alias("_f"))
    found = stored(found, "quality-rules")
    if found.count() <= 100_000:  # one row per language and source
        found = F.broadcast(found)
    rows = counts.join(found, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    outside = [F.when((value(k) > F.col("_f")[k]["high"]) | (value(k) < F.col("_f")[k]["low"]), F.lit(k)) for k in METRICS]
    out = rows.withColumn("reasons", F.filter(F.array(*outside), lambda x: x.isNotNull()))
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
ln AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
lines AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM ln GROUP BY doc_id),
win AS (SELECT doc_id, i, words[i:i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM often) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
v AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length', 'n_words']) AS metric,
         unnest([CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_dup_lines * 1000 // n_words ELSE 0 END,
                 CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END, n_words]) AS value FROM j),
s AS (SELECT lang, source, metric, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket FROM v WHERE NOT base_failed),
m AS (SELECT 0 AS level, lang, source, metric, bucket FROM s UNION ALL SELECT 1, lang, NULL, metric, bucket FROM s UNION ALL SELECT 2, NULL, NULL, metric, bucket FROM s),
q AS (
  SELECT level, lang, source, metric, count(*) AS docs, min(bucket) FILTER (WHERE rank * 4 >= n) AS q1, min(bucket) FILTER (WHERE rank * 4 >= n * 2) AS q2, min(bucket) FILTER (WHERE rank * 4 >= n * 3) AS q3
  FROM (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS rank, count(*) OVER (PARTITION BY level, lang, source, metric) AS n FROM m)
  GROUP BY level, lang, source, metric),
l AS (
  SELECT l.lang, l.metric, (l.docs * l.q1 + 50 * a.q1) // (l.docs + 50) AS q1, (l.docs * l.q2 + 50 * a.q2) // (l.docs + 50) AS q2, (l.docs * l.q3 + 50 * a.q3) // (l.docs + 50) AS q3
  FROM q l JOIN q a ON l.metric = a.metric WHERE l.level = 1 AND a.level = 2),
o AS (
  SELECT o.lang, o.source, o.metric, (o.docs * o.q1 + 50 * l.q1) // (o.docs + 50) AS q1, (o.docs * o.q2 + 50 * l.q2) // (o.docs + 50) AS q2, (o.docs * o.q3 + 50 * l.q3) // (o.docs + 50) AS q3
  FROM q o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric WHERE o.level = 0),
e AS (
  SELECT o.*, 1000 // greatest(1, d.q2) AS one FROM o JOIN o d ON o.lang IS NOT DISTINCT FROM d.lang AND o.source IS NOT DISTINCT FROM d.source
    AND d.metric = 'n_words' WHERE o.metric <> 'n_words'),
rule AS (SELECT lang, source, metric, q1 - 15 * greatest(q2 - q1, one, q2 // 32) AS low, q3 + 15 * greatest(q3 - q2, one, q3 // 32) AS high FROM e),
bad AS (
  SELECT DISTINCT doc_id FROM v JOIN rule ON v.lang IS NOT DISTINCT FROM rule.lang AND v.source IS NOT DISTINCT FROM rule.source AND v.metric = rule.metric
  WHERE value > high OR value < low)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM j LEFT JOIN bad USING (doc_id)
"""

QUERIES = {"op2_quality": op2_quality}
ORACLES = {"op2_quality": SQL}
