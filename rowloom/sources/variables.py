"""The one-row source of date variables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.functions.dates import variable_columns


def set_variables(
    spark: SparkSession, fields: str, fmt: str = "yyyy/MM/dd", as_of: datetime | None = None
) -> DataFrame:
    """One row of text columns from ``name=expression`` lines."""
    at = F.current_timestamp() if as_of is None else F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return spark.range(1).select(*variable_columns(fields, at, fmt))
