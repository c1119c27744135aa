"""What several operators need: shared storage, tables, whole key groups from sorted batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one if all runs on this machine, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: With it Spark removes a query's shuffle files when the query ends, instead of when the driver happens to collect garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, and is computed once.

    What was shuffled for it isn't needed once it is written, and goes then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Holds a row's other columns while an operator works on some of them, so that no name clashes.
OTHERS = "_other_columns"


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` of ``docs``, and all others in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias(OTHERS))


def unpacked(found: DataFrame, docs: DataFrame, *used: str, new: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs``, in its order: ``used`` as ``found`` has them, the others as they were; then those of ``new``."""
    return found.select(*[F.col(c) if c in used else F.col(f"{OTHERS}.`{c}`").alias(c) for c in docs.columns], *new)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Cut batches sorted by ``key`` so that no key is spread over two tables, of ``at_least`` rows where there are as many."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(keys == keys[-1]))
        if cut == 0 and (len(held) == 1 or held[-2].column(key)[-1].as_py() == keys[-1]):
            if len(held) == 1 or held[0].column(key)[0].as_py() == keys[-1]:
                continue
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.argmax(keys == keys[-1]))
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
        rows = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held)
