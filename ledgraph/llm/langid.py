"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, packed, table, unpacked

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the fit: languages, sampled documents of each, and characters of each of these.
LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS = 256, 64, 250
#: Bytes that are compressed at once, so that the dictionary, not the text before, is what they are held against.
PIECE = 1500


def letters(text: str | None) -> bytes:
    """The letters of a text in lower case, runs of anything else as one space."""
    return " ".join(LETTERS.findall((text or "").lower())).encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Per lang value the content of its dictionary, most frequent language first; the ``languages`` most frequent values are learned.

    A dictionary is all of a bounded sample: the ``sample_docs`` documents of a language with the least hashes of doc_id
    and text, and of each ``sample_chars`` characters from a place that depends on the hash. Rows with null lang or text
    don't count; repeated rows are one.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not found:
        return {}
    # Enough rows by hash that every language has its sample among them; the least of these are taken.
    n = 1_000_003
    h = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(n))
    share = F.map_from_arrays(F.array(*[F.lit(r[0]) for r in found]), F.array(*[F.lit(min(n, int(n * 4 * sample_docs / r[1]) + 1)) for r in found]))
    start = F.pmod(h, F.greatest(F.length("text") - sample_chars, F.lit(1))) + 1
    sample = known.filter(h < share[F.col("lang")]).select("lang", h.alias("h"), F.substring(F.col("text"), start.cast("int"), F.lit(sample_chars)).alias("text")).distinct().collect()
    content: dict[str, list[bytes]] = {r[0]: [] for r in found}
    for r in sorted(sample, key=lambda r: (r.h, r.text)):
        if len(content[r.lang]) < sample_docs:
            content[r.lang].append(letters(r.text))
    return {k: b" ".join(v) for k, v in content.items() if v}


class Classifier:
    """Sizes of a text under each language's raw-content dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = 6):
        self.names = list(content)
        self.compressors = [self._compressor(v, level) for v in content.values()]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
        own.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=how)

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes per language, summed over pieces of equal length of the whole text."""
        n = max(1, -(-len(text) // PIECE))
        step = -(-len(text) // n)
        pieces = [text[i : i + step] for i in range(0, len(text), step)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is by how much the second smallest size is larger than the smallest, as a share of it.

        score is the smallest size's share among likelihoods 2^(-8 size), tempered by length. No letter: ("und", 0, 0).
        Equal sizes: the language with more labelled documents.
        """
        if not self.names or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0, 0.0
        raw = letters(text)
        s = np.array(self.sizes(raw), float)
        best = int(s.argmin())
        rest = np.delete(s, best)
        margin = float((rest.min() - s[best]) / s[best]) if len(rest) else 1.0
        likely = np.exp2(-8 * (s - s[best]) / max(4.0, len(raw) ** 0.5))
        return self.names[best], float(1 / likely.sum()), margin


def identify(docs: DataFrame, content: dict[str, bytes], least_margin: float = 0.01) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (0 to 1), margin, rejected.

    Each whole text is compressed with every language's dictionary; the smallest total names the language. rejected:
    no letter, or a margin under ``least_margin``. Null and empty texts: und. Repeated rows are judged alike; an empty
    table gives none; input columns with these names are replaced. ``content`` is bounded as ``fit`` says.
    """
    new = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    held = packed(docs, "text")
    names, schema = held.columns, held.select("*").schema  # a copy of the schema, as it grows
    for c, k in new.items():
        schema = schema.add(c, k)

    def rows(batches):
        judge = Classifier(content)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < least_margin or k == UNKNOWN for k, m in zip(lang, margin, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, *new])

    return unpacked(held.mapInArrow(rows, schema), docs, "text", new=tuple(new))


def trained(docs: DataFrame, folds: int = 4, held: int = 2) -> dict[str, bytes]:
    """``fit`` on the rows whose crc32(doc_id) modulo ``folds`` is not ``held``."""
    return fit(docs.select("doc_id", "lang", "text").filter(crc_mod(F.col("doc_id"), folds) != held))


def without_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects (null and empty texts too); learned from ``docs`` itself. Columns as in ``docs``, whatever their names."""
    return unpacked(identify(packed(docs, "text"), trained(docs)).filter("NOT rejected"), docs, "text")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``identify`` over all documents, and margin and rejected."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op7_language": op7_language}
ORACLES: dict = {}
