"""Delimited text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

# The names of the encodings and the default delimiters.
ENCODINGS = {"UTF-8": "UTF-8", "UTF-8 BOM": "UTF-8", "Shift-JIS": "Shift_JIS"}
DELIMITERS = {"CSV": ",", "TSV": "\t", "TXT": ","}

_BAD = "__bad_line"


def charset(spark: SparkSession, encoding: str) -> str:
    """The Java charset; Shift_JIS needs Spark's wider list of charsets."""
    name = ENCODINGS.get(encoding, "UTF-8")
    if name == "Shift_JIS":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def _reader(spark: SparkSession, encoding: str, header: bool) -> DataFrameReader:
    return spark.read.option("header", header).option("encoding", charset(spark, encoding)).option(
        "mode", "PERMISSIVE"
    )


def _names(first: list[str | None], header: bool) -> list[str]:
    return [v if header and v else f"Column{i}" for i, v in enumerate(first, 1)]


def _last_of_each(columns: list[tuple[str, Column]]) -> list[Column]:
    """A repeated header keeps its first place and its last column."""
    return [c.alias(n) for n, c in dict(columns).items()]


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    format: str = "CSV",
    header: bool = True,
    delimiter: str = "",
    encoding: str = "UTF-8",
    max_rows: int = 0,
) -> DataFrame:
    """Text columns, named by the header or ``Column1``, ``Column2`` ...

    An empty field is empty text; a field the line does not have is NULL; fields
    beyond the header are dropped, and so are lines of nothing but white space.
    Quotes mean something only when the delimiter is a comma.  One small job reads the
    first line to fix the schema, so the files themselves are read once.  In a folder
    every file must have the same header, else reading fails; headers with an empty or
    a repeated name cannot be compared and are taken by place.
    """
    sep = delimiter or DELIMITERS.get(format, ",")
    out = _read_quoted if sep == "," else _read_plain
    df = out(spark, path, sep, header, encoding)
    return df.limit(max_rows) if max_rows > 0 else df


def _checked(names: list[str | None], header: bool) -> bool:
    """Whether Spark can hold every file's header against the first one's: it compares
    by name and place, so the names must be there and differ."""
    return header and all(names) and len({n.lower() for n in names}) == len(names)


def _read_quoted(spark: SparkSession, path, sep: str, header: bool, encoding: str) -> DataFrame:
    options = {"sep": sep, "quote": '"', "escape": '"'}
    first = _reader(spark, encoding, False).options(**options).csv(path).head(1)
    found = list(first[0]) if first else []
    names = _names(found, header)
    inner, checked = [f"c{i}" for i in range(len(names))], _checked(found, header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*(found if checked else inner), _BAD]])
    rows = (
        _reader(spark, encoding, header)
        .options(**options, columnNameOfCorruptRecord=_BAD, enforceSchema=not checked)
        .schema(schema)
        .csv(path)
        .toDF(*inner, _BAD)
    )
    # Spark reads an empty field and an absent one as NULL.  Lines of the wrong
    # length keep their text, from which the number of fields is counted.
    bad = F.col(_BAD)
    fields = F.size(F.split(F.regexp_replace(bad, '"[^"]*"', ""), sep, -1))
    columns = []
    for i, (c, name) in enumerate(zip(inner, names)):
        absent = bad.isNotNull() & (fields <= i)
        columns.append((name, F.when(absent, F.lit(None)).otherwise(F.coalesce(F.col(c), F.lit("")))))
    return rows.select(*_last_of_each(columns))


def _read_plain(spark: SparkSession, path, sep: str, header: bool, encoding: str) -> DataFrame:
    # The whole line is read as one column, so that Spark still skips the header of
    # every file; then it is split.  No line can hold the separator, as it has a line end.
    options = {"sep": "\n\u0001", "quote": "", "escape": "", "maxCharsPerColumn": "-1"}
    line = lambda name: T.StructType([T.StructField(name, T.StringType())])
    first = _reader(spark, encoding, False).options(**options).schema(line("line")).csv(path).head(1)
    top = first[0][0] if first else ""
    names = _names(top.split(sep) if first else [], header)
    checked = _checked([top], header)
    lines = _reader(spark, encoding, header).options(**options, enforceSchema=not checked).schema(line(top if checked else "line")).csv(path).toDF("line")
    cells = F.split(F.col("line"), _literal_pattern(sep), -1)
    columns = [(n, F.get(F.col("cells"), i)) for i, n in enumerate(names)]
    return lines.select(cells.alias("cells")).select(*_last_of_each(columns))


def _literal_pattern(sep: str) -> str:
    return r"\Q" + sep + r"\E"


