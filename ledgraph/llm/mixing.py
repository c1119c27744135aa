"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import OTHERS, n_words, packed, stored, table

#: Bits of the hash in all, and those that a histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source_size, weight, target.

    Sources in code-point order, null last, get the weights in turn. Their targets share ``share`` times all words by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight. The level
    ``target = level * weight`` of the uncapped sources follows in closed form: with sources sorted by
    ``cap / weight``, those before the level's place are capped. Works on one row per source only.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = s.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    capped = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source, by ratio, whose cap is above the level that those before it leave sets the level for all after it.
    leveled = capped.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(everything)
    return leveled.withColumn("final", final).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final.level")), F.col("cap")).otherwise(F.col("final.level") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken (words the mix takes of it, repeats counted).

    A source whose target is r times its size takes each document floor(r) times, and once more if the document's hash
    lies below the source's threshold. Thresholds come from histograms: words by (source, leading hash bits); the
    bucket in which the budget runs out is the only one refined, by its next bits, until it holds one hash. That last
    document (or group with equal hash, as repeated rows have) is taken if this comes nearer to the budget. No sort of
    documents; hash and so the result depend on doc_id and text alone.

    Nulls: a null text has size 0; null sources are one source, last; a null doc_id hashes as empty text. Words are
    runs other than ASCII white space. Empty input gives an empty result. Columns size, source_size, target and taken
    of the input are replaced, others come through, whatever their names.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    docs = packed(docs.select(*[f"`{c}`" for c in keep]), "doc_id", "source", "text")
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))), 1, HASH_BITS // 4), 16, 10).cast("long")
    sizes = stored(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), hashed.alias("hash")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")
    small = targets.count() <= 100_000
    beside = F.broadcast if small else (lambda x: x)  # one row per source

    # The open interval of each source: hashes below lo are in, and have used up `used` of the budget.
    spans = targets.select("source", "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("used"))
    inside, width = sizes.filter("size > 0"), HASH_BITS
    while width > 0:
        width = max(0, width - level_bits)
        step = 1 << width
        buckets = (
            inside.join(beside(spans.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
            .filter((F.col("hash") >= F.col("lo")) & (F.col("hash") < F.col("lo") + F.lit(step << level_bits)))
            .groupBy("source", "budget", "used", (F.floor(F.col("hash") / step) if step > (1 << 52) else F.expr(f"hash div {step}")).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        )
        order = W.partitionBy("source").orderBy("bucket")
        run = buckets.withColumn("before", F.col("used") + F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        # Where the budget runs out: the first bucket whose words end above it; if there is none, the last.
        edge = (
            run.withColumn("over", F.col("before") + F.col("words") > F.col("budget"))
            .groupBy("source", "budget")
            .agg(
                F.min(F.when(F.col("over"), F.struct("bucket", "before", "words", "first", "last"))).alias("edge"),
                F.max("bucket").alias("end"),
                F.max(F.struct("bucket", F.expr("before + words").alias("all"))).alias("tail"),
            )
        )
        spans = stored(
            edge.select(
                "source",
                "budget",
                F.coalesce(F.expr(f"edge.bucket * {step}"), F.expr(f"(end + 1) * {step}")).alias("lo"),
                F.coalesce(F.col("edge.before"), F.col("tail.all")).alias("used"),
                F.expr("edge.words").alias("edge_words"),
                F.expr("edge.first").alias("first"),
                F.coalesce(F.expr("edge.first = edge.last"), F.lit(True)).alias("single"),
            ),
            "mix-level",
        )
        done = spans.filter("single")
        found = done.select("source", F.when(F.col("edge_words").isNotNull() & (F.col("used") + F.col("edge_words") / 2 <= F.col("budget")), F.col("first") + 1).otherwise(F.coalesce("first", "lo")).alias("threshold"))
        thresholds = found if width == HASH_BITS - level_bits else thresholds.unionByName(found)
        spans = spans.filter(~F.col("single")).select("source", "budget", "lo", "used")
        if spans.isEmpty():
            break

    per_source = stored(targets.join(thresholds.select(F.col("source").alias("s"), "threshold"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "base", F.coalesce("threshold", F.lit(0)).alias("threshold")), "mix-thresholds")
    return (
        docs.withColumn("_size", n_words(F.col("text")))
        .withColumn("_hash", hashed)
        .join(beside(per_source), F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(*[F.col(c) if c in ("doc_id", "source", "text") else F.col(f"{OTHERS}.`{c}`").alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("base") + (F.col("_hash") < F.col("threshold")).cast("long"))).cast("long").alias("taken"))
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``mix`` over all documents."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT *, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][CAST(rank % 3 AS INT) + 1]::DOUBLE AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM d GROUP BY source)),
r AS (SELECT *, cap / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
f AS (SELECT (SELECT level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1) AS level),
t AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL OR ratio <= f.level THEN cap ELSE f.level * weight END AS target FROM r, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
g AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS used FROM d GROUP BY source, h),
c AS (SELECT g.source, h FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source WHERE used + words / 2 <= target - base * source_size)
SELECT d.doc_id, d.size, b.source_size, CAST(b.target AS DOUBLE) AS target,
       CAST(d.size * (b.base + (c.h IS NOT NULL)::INT) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": SQL}
