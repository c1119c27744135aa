"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lowered, packed, stored, table, unpacked

#: Words are runs of ASCII letters, digits and non-ASCII characters; this is what lies between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text before its A-Z are in lower case.
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def window_hash(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """item_id, hash, window (its words, space-joined), width: one row per item and distinct window."""
    words = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(n))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.slice("words", i, width))
    each = words.select("item_id", width.alias("width"), F.explode(windows).alias("w"))
    return each.select("item_id", window_hash(F.col("w")).alias("hash"), F.array_join("w", " ").alias("window"), "width").distinct()


def beside(df: DataFrame, row_bytes: int, most: int, listed: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted, take ``most`` bytes at most; ``listed`` is an array column with 32 bytes an entry."""
    n, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(listed)), F.lit(0)) if listed else F.lit(0)).first()
    return F.broadcast(df) if n * row_bytes + entries * 32 <= most else df


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = 64_000_000, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (None: all) and n_words, spans (word position and width of each window found), items, n_hit.

    First the hashes of each text's windows are exploded, a row being the text's key, a place and a hash, and joined
    with the set of the benchmark's window hashes, which is broadcast up to ``broadcast_bytes`` (counted first) and
    shuffled beyond. Then only the texts with a hit are read again and the hit windows' words compared. What is found,
    a row per text, is joined to the documents, again broadcast only up to that size; texts aren't shuffled below it.

    Nulls: a null text has no words; an item with null or empty text has no window; a null item_id marks hits but is
    no item. Rows that repeat an id and its text get the same result each. Empty benchmark: no hits. Input columns
    named n_words, spans, items, n_hit are replaced. A window within a document may repeat: each place counts.
    """
    known = stored(benchmark_windows(benchmark, n), "benchmark-windows")
    hashes = stored(known.select("hash", "width").distinct(), "benchmark-hashes")
    widths = [r[0] for r in hashes.select("width").distinct().orderBy("width").collect()]  # n values at most
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "spans", "items", "n_hit")]
    others = [F.col(f"`{c}`").alias(c) for c in kept]
    own = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    rows = docs.select(F.struct(*others).alias("_doc"), own.alias("_own"), F.col("text").alias("_text"))

    # Places of the windows among those of all widths, one width after the other.
    places = lambda k: F.greatest(F.col("_n") - (k - 1), F.lit(0))
    d = rows.select("_own", F.transform(normal_words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h")).select("_own", "_h", F.size("_h").alias("_n"))
    each = [F.when(F.col("_n") >= k, F.transform(F.sequence(F.lit(1), places(k)), lambda i: F.xxhash64(F.slice("_h", i, k)))).otherwise(F.array().cast("array<bigint>")) for k in widths]  # noqa: B023
    none = F.array().cast("array<bigint>")
    exploded = d.select("_own", "_n", F.posexplode(F.concat(none, *each)).alias("_pos", "hash"))
    start, before = F.lit(0), F.lit(0)
    for k in widths:
        start = F.when((F.col("width") == k) & (F.col("_pos") - before < places(k)), F.col("_pos") - before + 1).otherwise(start)
        before = before + places(k)
    met = exploded.join(beside(hashes, 16, broadcast_bytes), "hash").select("_own", start.alias("start"), "width").filter("start > 0")
    met = stored(met.groupBy("_own").agg(F.collect_set(F.struct("start", "width")).alias("places")), "benchmark-hits")

    # The words of what was hit.
    texts = rows.select("_own", "_text").join(beside(met, 100, broadcast_bytes, "places"), "_own").select("_own", "places", normal_words(F.col("_text")).alias("_words"))
    cut = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["width"].alias("width"), F.array_join(F.slice("_words", p["start"], p["width"]), " ").alias("window")))
    cut = texts.filter(F.size("_words") > 0).select("_own", F.explode(cut).alias("c")).select("_own", "c.*").distinct()
    true = stored(cut.join(beside(known, 200, broadcast_bytes), ["window", "width"]).select("_own", "start", "width", "item_id"), "benchmark-true")
    spans = true.groupBy("_own").agg(F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"), F.collect_set("item_id").alias("items"))
    spans = stored(spans, "benchmark-spans").withColumnRenamed("_own", "_of")

    full = rows.join(beside(spans, 100, broadcast_bytes, "spans"), F.col("_own") == F.col("_of"), "left")
    no_items = F.array().cast(benchmark.select(F.array("item_id").alias("x")).schema["x"].dataType)
    no_spans = F.array().cast("array<struct<start:int,width:int>>")
    found = full.select("_doc", "_text", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))
    # Spans sorted by start: words covered are summed from one end to the next.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["width"] - 1).alias("end"), (a["hit"] + F.greatest(F.lit(0), s["start"] + s["width"] - 1 - F.greatest(a["end"], s["start"] - 1))).alias("hit")),
        lambda a: a["hit"],
    )
    n_words = F.coalesce(F.regexp_count("_text", F.lit(NORMAL_WORD)), F.lit(0))
    return found.select(*[F.col("_doc")[c].alias(c) for c in kept], n_words.cast("long").alias("n_words"), "spans", "items", covered.cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, document_share: float = 0.8) -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut out of the text; a document of which ``document_share`` of the words or more are hit goes.

    Untouched documents come back as they were, nulls and empty texts too. In a cut document the words that stay keep
    their own spelling and the marks between them. Columns, and what others hold, as in ``docs``, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0)
    # The sorted spans as disjoint runs of word positions: what lies between them is joined, a slice for each gap.
    end = lambda r: r["start"] + r["width"]
    none = F.array().cast("array<struct<start:int,width:int>>")
    gaps = F.aggregate(
        "spans",
        F.struct(none.alias("done"), F.lit(1).alias("next")),
        lambda a, s: F.struct(
            F.when(s["start"] > a["next"], F.concat(a["done"], F.array(F.struct(a["next"].alias("start"), (s["start"] - a["next"]).alias("width"))))).otherwise(a["done"]).alias("done"),
            F.greatest(a["next"], end(s)).alias("next"),
        ),
        lambda a: F.concat(a["done"], F.array(F.struct(a["next"].alias("start"), F.lit(2**30).alias("width")))),
    )
    cut = F.concat("_head", F.array_join(F.transform("_gaps", lambda g: F.array_join(F.slice("_pieces", g["start"], g["width"]), "")), ""))
    hit = F.col("n_hit") > 0
    found = contamination(packed(docs, "doc_id", "text"), benchmark, n).filter(F.col("n_hit") < F.greatest(F.lit(1.0), F.col("n_words") * F.lit(document_share)))
    found = found.withColumns({"_gaps": F.when(hit, gaps), "_head": F.when(hit, head), "_pieces": F.when(hit, pieces)})
    return unpacked(found.withColumn("text", F.when(hit & (F.size("_pieces") > 0), cut).otherwise(F.col("text"))), docs, "doc_id", "text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``contamination`` over all documents; nulls, ties and repeated rows as there."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, words, least(len(words), 10) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0),
bw AS (SELECT item_id, width, array_to_string(words[i:i + width - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT width FROM b),
dw AS (
  SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS win
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM w, sizes WHERE len(words) >= width)),
hit AS (SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": SQL}
