"""Scalar helpers of the run log and its report."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

METRICS = "baseline STRING, illicit_auc DOUBLE, illicit_f1 DOUBLE, illicit_precision DOUBLE, illicit_recall DOUBLE, n_test BIGINT, n_test_illicit BIGINT, n_train BIGINT, test_window STRING"


def parse_metrics(text: Column) -> Column:
    """The metrics of a run as a struct; null for text that is no JSON object."""
    return F.from_json(text, METRICS)


def metrics_to_json(**fields: Column) -> Column:
    """A JSON object with keys in order, no spaces, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_json(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration's JSON with sorted keys; the order of keys doesn't matter."""
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def config_hash_struct(config: Column) -> Column:
    """The same for a column of structs whose fields are in order at all levels (plain ASCII, no exponent floats)."""
    return F.sha2(F.to_json(config, {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(StringType())
def config_hash_json(text: pd.Series) -> pd.Series:
    """The same for any JSON text."""
    return text.map(lambda t: None if t is None else config_hash(json.loads(t)))


def format_mean_std(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def test_window(first: Column, last: Column) -> Column:
    """'first-last'; an open end is 'end'."""
    return F.concat_ws("-", first.cast("string"), F.coalesce(last.cast("string"), F.lit("end")))


def run_id(model: Column, at: Column, nonce: Column) -> Column:
    """model, UTC stamp and eight hex digits."""
    return F.concat(model, F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.md5(nonce.cast("string")), 1, 8))


def serialise(value: Column) -> Column:
    """Text of a log cell: true/false, numbers as they are, null empty."""
    return F.coalesce(value.cast("string"), F.lit(""))
