"""Delimited output files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.dates import resolve_path_tokens
from rowloom.functions.values import as_text, field
from rowloom.sources.files import DELIMITERS, charset


def write_delimited(
    df: DataFrame,
    path: str,
    format: str = "CSV",
    header: bool = True,
    delimiter: str = "",
    encoding: str = "UTF-8",
    at: datetime | None = None,
) -> DataFrame:
    """Write a directory of text files and hand the input on.

    ``{yyyyMMdd}``-like tokens in the path are filled.  NULL becomes an empty
    field.  A field is quoted only when it has to be; with a tab delimiter never.
    """
    sep = delimiter or DELIMITERS.get(format, ",")
    target = resolve_path_tokens(path, at or datetime.now())
    texts = df.select(*[as_text(field(df, c)).alias(c) for c in df.columns])
    options = {"sep": sep, "header": str(header).lower(), "encoding": charset(df.sparkSession, encoding)}
    # emptyValue: Spark would otherwise write "" for empty text.
    if sep == "\t":
        options |= {"quote": "", "emptyValue": "", "escape": ""}
    else:
        options |= {"quote": '"', "escape": '"', "emptyValue": ""}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    texts.write.mode("overwrite").options(**options).csv(target)
    return df


def write_dated(df: DataFrame, path: str, moment: str, fmt: str = "yyyyMMdd", format: str = "parquet") -> DataFrame:
    """One folder per date found in the data."""
    day = F.date_format(field(df, moment).col, fmt)
    df.withColumn("date_token", day).write.mode("overwrite").partitionBy("date_token").format(format).save(path)
    return df
