"""The append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The log's columns, in order.
RUN_LOG = T.StructType(
    [
        T.StructField("timestamp_utc", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("config_hash", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField("git_dirty", T.BooleanType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("data_snapshot_id", T.StringType()),
        T.StructField("metrics_json", T.StringType()),
        T.StructField("wall_clock_s", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)
REQUIRED = ("run_id", "config_hash", "seed", "metrics_json")


def conform(rows: DataFrame) -> DataFrame:
    """``rows`` with the log's columns in order; missing ones null. A column that the log doesn't have raises KeyError."""
    extra = set(rows.columns) - set(RUN_LOG.names)
    if extra:
        raise KeyError(f"not in the run log: {sorted(extra)}")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RUN_LOG])


def append_runs(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Adds rows to the log at ``path``; what is there is never rewritten. As CSV, part files with header and doubled quotes."""
    out = conform(rows).write.mode("append").format(format)
    if format == "csv":
        out = out.options(header=True, quote='"', escape='"')
    out.save(path)


def read_runs(spark: SparkSession, path: str, run_ids: DataFrame | list[str] | None = None, format: str = "parquet") -> DataFrame:
    """The log, or the runs of ``run_ids`` (a list, or a frame with column run_id)."""
    reader = spark.read.schema(RUN_LOG).format(format)
    if format == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    log = reader.load(path)
    if run_ids is None:
        return log
    if isinstance(run_ids, list):
        return log.filter(F.col("run_id").isin(run_ids))
    return log.join(run_ids.select("run_id"), "run_id", "left_semi").select(*RUN_LOG.names)


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an earlier log that a later one doesn't have as often."""
    return before.exceptAll(after.select(*before.columns))


def assert_append_only(before: DataFrame, after: DataFrame) -> None:
    if not lost_rows(before, after).isEmpty():
        raise AssertionError("the log has lost or changed rows")


def _parts(spark: SparkSession, *paths: str) -> DataFrame:
    """file, length, modified, content of part files; content is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths))
    return files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def part_digests(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """file, length, modified, digest (SHA-256) of every part file of the log at ``path``; those of ``known`` are taken over, only other files are read."""
    names = _parts(spark, path).select("file")
    if known is not None:
        names = names.join(known.select("file"), "file", "left_anti")
    new = [r.file for r in names.collect()]  # a log's part files, which the driver lists anyway
    empty = names.sparkSession.createDataFrame([], "file string, length long, modified timestamp, digest string")
    found = _parts(spark, *new).select("file", "length", "modified", F.sha2("content", 256).alias("digest")) if new else empty
    return found if known is None else known.unionByName(found)


def broken_parts(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """file, fault of the files in ``known`` (``part_digests`` of an earlier time) that are ``lost`` or ``rewritten``.

    Names, lengths and times are compared; a file is read only if its length is the same and its time another. Rows
    of the log are never compared, so the work grows with the number of files.
    """
    now = _parts(spark, path).select("file", F.col("length").alias("length_"), F.col("modified").alias("modified_"))
    both = known.join(now, "file", "left")
    fault = F.when(F.col("length_").isNull(), "lost").when(F.col("length_") != F.col("length"), "rewritten")
    found = both.select("file", fault.alias("fault")).filter("fault IS NOT NULL")
    touched = [r.file for r in both.filter("length_ = length AND modified_ <> modified").select("file").collect()]
    if not touched:
        return found
    again = _parts(spark, *touched).join(known.select("file", "digest"), "file").filter(F.sha2("content", 256) != F.col("digest"))
    return found.unionByName(again.select("file", F.lit("rewritten").alias("fault")))


def assert_parts_kept(spark: SparkSession, path: str, known: DataFrame) -> None:
    """AssertionError if a part file of an earlier log was lost or rewritten."""
    bad = broken_parts(spark, path, known).take(3)
    if bad:
        raise AssertionError("; ".join(f"{r.file} is {r.fault}" for r in bad))


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows in which a required cell is null or empty."""
    bad = F.lit(False)
    for c in REQUIRED:
        bad |= F.col(c).isNull() | (F.col(c).cast("string") == "")
    return rows.filter(bad)


def assert_run_log(before: DataFrame, after: DataFrame, new_rows: int) -> None:
    """AssertionError unless ``after`` has the log's columns in order, ``new_rows`` more rows than ``before``, and no invalid row."""
    if after.columns != RUN_LOG.names:
        raise AssertionError(f"columns are {after.columns}")
    n = after.count() - before.count()
    if n != new_rows:
        raise AssertionError(f"{n} new rows, not {new_rows}")
    if not invalid_rows(after).isEmpty():
        raise AssertionError("required cells are empty")


def reproducibility_check(log: DataFrame) -> DataFrame:
    """config_hash, runs, n_metrics (distinct results), reproducible (not over one)."""
    each = log.groupBy("config_hash").agg(F.count("*").alias("runs"), F.countDistinct("metrics_json").alias("n_metrics"))
    return each.withColumn("reproducible", F.col("n_metrics") <= 1)
