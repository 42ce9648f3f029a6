"""Raw ledger exports (A1): header row + text cells, every column a string.

The export must carry its row order in a ``_pos`` column (sheet row
number); a reader cannot recover order from a distributed file split.
No schema inference: every cell stays text until the cleaning projection.
Columns are taken by the header's names, in any order.

A row that cannot be taken apart as the header says is kept, with its text in
``_corrupt_record`` and no cells, and ends as a reject: a JSON line that is cut or
is no object, a CSV row with cells past the header or with a quote that never
closes within the row. Quotes inside quoted CSV cells are doubled, as sheets write
them. A CSV row with fewer cells is an ordinary one, as sheets leave out blank
cells at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

RAW_COLUMNS = {"income": S.INCOME_RAW_COLUMNS, "expenses": S.EXPENSE_RAW_COLUMNS}
QUOTED_CELL = r'(^|,)"(?:[^"]|"")*"(?=,|$)'  # a whole cell in quotes, those inside doubled
OPEN_QUOTE = r'(^|,)"'


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, S.CORRUPT]])


def _broken_csv(record: Column, cells: int) -> Column:
    """Of rows whose cell count is not the header's: more cells, or an open quote."""
    bare = F.regexp_replace(record, QUOTED_CELL, "$1")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 > cells) | bare.rlike(OPEN_QUOTE)


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    header = reader.option("inferSchema", False).csv(path).columns
    if not header:
        return spark.createDataFrame([], T.StructType())
    # All cells are parsed, since only then are rows of another length noticed;
    # a file whose header differs from the first one's is an error.
    df = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", S.CORRUPT)
          .option("columnPruning", False).option("enforceSchema", False).schema(_text_schema(header)).csv(path))
    broken = F.coalesce(_broken_csv(F.col(S.CORRUPT), len(header)), F.lit(False))
    return df.select([F.when(~broken, F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in header]
                     + [F.when(broken, F.col(S.CORRUPT)).alias(S.CORRUPT)])


def _read_json(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    columns = ["_pos", *RAW_COLUMNS[ledger]]
    df = (spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", S.CORRUPT)
          .schema(_text_schema(columns)).json(path))
    whole = F.col(S.CORRUPT).isNull()
    return df.select([F.when(whole, F.col(c)).alias(c) for c in columns] + [S.CORRUPT])


def read_raw_ledger(spark: SparkSession, path: str, fmt: str = "csv", ledger: str = "income",
                    multi_line: bool = False) -> DataFrame:
    """Read an export as text columns plus ``_pos`` (bigint) and, for text
    formats, ``_corrupt_record``.

    CSV: files are split between tasks; ``multi_line`` (line breaks inside
    quoted cells) makes each file one task. A blank cell is the empty text, as
    a sheet gives it; the cells that a short row lacks read as blank too, since
    CSV cannot tell them apart. JSON: one object a line, read with the ledger's
    columns as schema, so a column that is null throughout stays a column. An
    empty export gives an empty frame."""
    if fmt == "csv":
        df = _read_csv(spark, path, multi_line)
    elif fmt == "json":
        df = _read_json(spark, path, ledger)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")
    cols = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "_pos"]
    pos = F.col("_pos").try_cast("long") if "_pos" in df.columns else F.lit(None).cast("long")
    return df.select(pos.alias("_pos"), *cols)


def write_raw_ledger(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a text batch as an export (used by tests and the stream source)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_raw_lines(lines: DataFrame, path: str, header: str | None, compression: str = "none") -> None:
    """Write an export from finished text lines (column ``line``), each file
    under the header line if there is one. Every task writes the lines it has as
    a file, so the files grow in number with the export, not in size. A
    ``compression`` that readers know by its ending (gzip) makes a file one task's."""
    text = F.col("line")
    if header is not None:
        # A file of the header alone, for an export without lines.
        lines.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("line")).write.mode("overwrite").text(path)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task
        text = F.when(first, F.concat(F.lit(header + "\n"), text)).otherwise(text)
    (lines.select(text.alias("line")).write.mode("overwrite" if header is None else "append")
     .option("maxRecordsPerFile", 0).option("compression", compression).text(path))
