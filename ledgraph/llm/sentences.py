"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER_BYTES, OTHERS, packed, stored, table

#: A sentence with the marks and white space that close it; the last may have none. All pieces together are the text.
PIECE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t\n\v\f\r]*|[^.!?\n]+\Z")
#: Consecutive sentences of a span.
SENTENCES = 2


def pieces(text: str | None) -> tuple[list[str], list[bytes]]:
    """The pieces of a text, and of each its words (A-Z in lower case, one space between); empty for a piece without a word."""
    found = PIECE.findall(text or "")
    return found, [b" ".join(p.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()) for p in found]


def spans(sentences: list[bytes], number: int = SENTENCES) -> list[bytes]:
    """The content of every run of ``number`` consecutive sentences, by its first sentence."""
    return [b"\n".join(sentences[i : i + number]) for i in range(len(sentences) - number + 1)]


def _span_rows(number: int):
    def rows(batches):
        for batch in batches:
            row, first, digest = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = spans([s for s in pieces(text)[1] if s], number)
                row += [i] * len(found)
                first += range(len(found))
                digest += map(xxhash.xxh3_128_digest, found)
            h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column("doc_id").take(at), batch.column("own").take(at), pa.array(first, pa.int64())], ["h1", "h2", "doc_id", "own", "place"])

    return rows


def repeated_spans(docs: DataFrame, number: int = SENTENCES) -> DataFrame:
    """doc_id, own, places (of the first sentence) of all spans that an earlier place, by doc_id and position, holds too.

    The first place of each span is a minimum, joined back; a very common span is a skewed join key against one row,
    which adaptive execution splits, and is never collected.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "own", "text").mapInArrow(_span_rows(number), f"h1 long, h2 long, doc_id {kind}, own long, place long")
    where = F.struct("doc_id", "own", "place")
    ends = found.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last").select("h1", "h2", "first")
    ends = stored(ends, "sentence-firsts")  # so that the join may split a very common span
    later = found.join(ends, ["h1", "h2"]).filter(~where.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "own").agg(F.collect_set("place").alias("places"))


def remove_repeated(docs: DataFrame, number: int = SENTENCES) -> DataFrame:
    """All columns of ``docs`` and n_sentences, n_removed, kept (the text left).

    Every run of ``number`` consecutive sentences, whatever their lengths, is hashed (128 bits of its words, A-Z in lower
    case); longer runs are the union of theirs. A sentence covered by any run that also begins at an earlier place goes.
    Earlier: smaller doc_id, then earlier in the text; a null doc_id is smallest. Texts of fewer sentences have no run
    and stay. Pieces without a word are no sentences and stay. Null texts are empty and stay null in ``kept``. Rows that
    repeat a doc_id and its text are one document and get the same result. An empty table gives none. Input columns
    named n_sentences, n_removed or kept are replaced; others come through, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "kept", "doc_id", "text")]
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = packed(docs.select("doc_id", "text", *[f"`{c}`" for c in others]), "doc_id", "text").withColumn("own", own)
    hits = repeated_spans(rows, number).select(F.col("doc_id").alias("d"), F.col("own").alias("o"), "places")
    joined = rows.join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o")), "left").select("doc_id", "text", OTHERS, "places")
    schema = T.StructType([*(joined.schema[c] for c in ("doc_id", "text", OTHERS)), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                found, words = pieces(text)
                index = [i for i, w in enumerate(words) if w]
                gone = {index[i] for p in places or () for i in range(p, p + number)}
                total.append(len(index))
                removed.append(len(gone))
                kept.append("".join(p for i, p in enumerate(found) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", OTHERS)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    found = joined.mapInArrow(cut, schema)
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "kept")]
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"{OTHERS}.`{c}`").alias(c) for c in names], "n_sentences", "n_removed", "kept")


def op3_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_bytes and kept_sha256 of ``remove_repeated`` over all documents."""
    found = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", F.octet_length(F.coalesce("kept", F.lit(""))).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH p AS (
  SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS piece
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \t\n\x0B\f\r]*|[^.!?\n]+') AS ps FROM documents)),
w AS (SELECT doc_id, k, piece, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM p),
s AS (
  SELECT doc_id, k, array_to_string(words, ' ') AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM w WHERE len(words) > 0),
r AS (SELECT doc_id, i, sentence || chr(10) || lead(sentence, 1) OVER w AS content FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS rank FROM r WHERE content IS NOT NULL) WHERE rank > 1),
gone AS (SELECT DISTINCT s.doc_id, s.k FROM later JOIN s ON s.doc_id = later.doc_id AND s.i BETWEEN later.i AND later.i + 1),
kept AS (SELECT p.doc_id, string_agg(piece, '' ORDER BY p.k) FILTER (gone.k IS NULL) AS text, count(gone.k) AS n_removed FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.k = gone.k GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(strlen(coalesce(kept.text, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c USING (doc_id)
"""

QUERIES = {"op3_sentence_dedup": op3_sentence_dedup}
ORACLES = {"op3_sentence_dedup": SQL}
