"""Tables and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.functions.values import quoted
from rowloom.sources.jdbc import JdbcConnection


def append_table(df: DataFrame, table: str) -> DataFrame:
    """Insert rows by column name and hand the input on."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.saveAsTable(table)
        return df
    have = {c.lower(): c for c in df.columns}
    columns = [c for c in spark.table(table).columns if c.lower() in have]
    if len(columns) != len(df.columns):
        raise ValueError(f"{table} lacks some of the columns {df.columns}")
    named = ", ".join(quoted(c) for c in columns)
    values = ", ".join(quoted(have[c.lower()]) for c in columns)
    spark.sql(f"INSERT INTO {table} ({named}) SELECT {values} FROM {{rows}}", rows=df)
    return df


def jdbc_write_options(connection: JdbcConnection, table: str, commit_size: int = 100) -> dict[str, str]:
    """``commit_size`` rows go in one batch; Spark commits once per partition."""
    return {**connection.options(), "dbtable": table, "batchsize": str(commit_size)}


def append_jdbc(df: DataFrame, connection: JdbcConnection, table: str, commit_size: int = 100) -> DataFrame:
    options = jdbc_write_options(connection, table, commit_size)
    df.write.format("jdbc").options(**options).mode("append").save()
    return df


def write_state(df: DataFrame, path: str) -> DataFrame:
    """Write a new table state; the path must not exist yet, so that a state can
    never replace the one it was computed from."""
    df.write.mode("errorifexists").parquet(path)
    return df


def write_routed(tagged: DataFrame, path: str, tag: str = "branch", format: str = "parquet") -> DataFrame:
    """All ports in one pass: one folder per branch."""
    tagged.write.mode("overwrite").partitionBy(tag).format(format).save(path)
    return tagged
