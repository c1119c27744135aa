"""The pipeline's stages on a small corpus, and the registered names."""

import pytest

import __spark_entry__
import corpus_pipeline

from .conftest import prose
from .test_corpus import SYLLABLES, speech


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, speech(k, i, 120), k, f"s{i % 5}") for i in range(160) for k in [list(SYLLABLES)[i % 4]]]
    copy = speech("en", 1000, 150)
    passage = speech("en", 2000, 60)
    rows += [(200, copy, "en", "s1"), (201, copy, "en", "s1"), (202, copy + " th", "en", "s2")]
    rows += [(i, speech("en", 3000 + i, 60) + " " + passage + " " + speech("en", 4000 + i, 60), "en", "s3") for i in range(210, 213)]
    rows += [(220, speech("en", 5000, 60) + " " + prose(77, 30) + " " + speech("en", 5001, 60), "en", "s4"), (230, None, None, None), (231, "!!! 42", "en", None)]
    full = [r + (len(r[1] or ""),) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), {r[0]: r[1] for r in rows}, passage


def test_stages(spark, corpus):
    path, texts, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) - set(seen["language"]) == {230, 231}
    assert set(seen["language"]) - set(seen["near_duplicates"]) == {201, 202}
    cut = seen["repeated_passages"]
    assert set(cut) == set(seen["near_duplicates"])
    assert all(passage[20:-20] not in cut[i] and len(cut[i]) > 200 for i in (210, 211, 212))
    assert all(cut[i] == texts[i] for i in range(160))
    clean = seen["benchmark_passages"]
    assert prose(77, 30).split()[15] not in clean[220] and all(clean[i] == texts[i] for i in range(160))
    assert set(seen["mixture"]) <= set(clean)
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(seen["mixture"])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_on_odd_rows_and_none(spark, odd_docs, no_docs, k, tmp_path):
    """Nulls, repeated rows, very long texts and clashing names: rows that stay hold what they held, but for the text and what the mixture adds."""
    spark.createDataFrame([(1, prose(77, 30)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    kept = stage(spark, odd_docs, str(tmp_path))
    old = [c for c in odd_docs.columns if c != "size"]
    if name != "mixture":
        assert kept.schema.simpleString() == odd_docs.schema.simpleString()
    if name == "repeated_passages":
        old.remove("text")
    assert set(map(str, kept.select(*old).collect())) <= set(map(str, odd_docs.select(*old).collect()))
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    # Rejected languages; one of the repeated rows; its 17 bytes are no passage; no benchmark words; empty texts have no words to take.
    assert ids == {"near_duplicates": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], "repeated_passages": [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9] if 9 in ids else ids, "benchmark_passages": [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]}.get(name, ids)
    assert name != "language" or not {2, 3, 7} & set(ids)
    assert name != "mixture" or not {2, 3, 7} & set(ids)
    assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
