"""Scans of landed files, with lineage columns."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S

AUDIT = ["_ingest_ts", "_source_file", "_source_format"]
SENT_CHARS = 4_000_000  # of leading lines that are sent to every task
# Blanks around a value belong to it.
CSV_SPACES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def with_audit(df: DataFrame, source_format: str, source_file: str | Column | None = None) -> DataFrame:
    """Stamp ingest time, source file and format. The file is that of the scan unless given."""
    if source_file is None:
        source_file = F.col("_metadata.file_path")
    elif isinstance(source_file, str):
        source_file = F.lit(source_file)
    return df.select(
        "*",
        F.current_timestamp().alias("_ingest_ts"),
        source_file.alias("_source_file"),
        F.lit(source_format).alias("_source_format"),
    )


def read_parquet_audited(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return with_audit(reader.parquet(path), "parquet")


def first_lines(spark: SparkSession, path: str, n: int) -> list[tuple[str, list[str]]]:
    """The first ``n`` lines of every file at ``path``, with the file. A task has one file,
    opens it, and stops after its first batch of lines, however long the file is. The
    result is as long as the listing of files that any scan of them makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.slice(0, n)
            return

    # A session of its own, so that files are not split or packed together here only.
    planning = spark.newSession()
    for option in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        planning.conf.set(option, 1 << 50)
    planning.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", max(n, 100))
    lines = planning.read.text(path).select(
        F.col("_metadata.file_path").alias("_source_file"), F.col("value").alias("_line")
    )
    found: dict[str, list[str]] = {}
    for r in lines.mapInArrow(run, "_source_file string, _line string").collect():
        found.setdefault(r["_source_file"], []).append(r["_line"])
    return sorted(found.items())


def csv_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header lines of the files at ``path`` and the files that have each."""
    found: dict[str, list[str]] = {}
    for file, lines in first_lines(spark, path, 1):
        found.setdefault(lines[0], []).append(file)
    return found


def header_fields(header: str, schema: T.StructType) -> list[T.StructField]:
    """Fields in the order of a header line; names go by case-folded text, the first of
    several that are alike counts, and what the schema does not have is text."""
    known = {f.name.lower(): f for f in schema.fields}
    fields: list[T.StructField] = []
    for k, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        field = known.get(name.strip().lower())
        new = field is not None and field.name not in {f.name for f in fields}
        fields.append(T.StructField(field.name, field.dataType) if new else T.StructField(f"_unused_{k}", T.StringType()))
    return fields


def _of_schema(columns: Iterable[str], schema: T.StructType) -> list[Column]:
    """Columns of the schema; those that are not there are null."""
    have = set(columns)
    return [
        (F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields
    ]


def read_csv_audited(
    spark: SparkSession, path: str, schema: T.StructType = S.READING_DATA
) -> DataFrame:
    """CSV with a header line; columns go by name, whatever their case and order, which
    may differ between files. Columns that the schema does not have are left out, those
    a file does not have are null. One read for each header that occurs."""
    parts = []
    for header, paths in sorted(csv_headers(spark, path).items()):
        fields = T.StructType(header_fields(header, schema))
        rows = spark.read.schema(fields).options(header=True, **CSV_SPACES).csv(paths)
        parts.append(with_audit(rows, "csv").select(*_of_schema(rows.columns, schema), *AUDIT))
    if not parts:
        return with_audit(spark.createDataFrame([], schema), "csv", "")
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def empty_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.READING)


def read_csv_preamble(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.READING_DATA,
    skip: int = 4,
    header: bool = True,
) -> DataFrame:
    """CSV files whose first ``skip`` lines are prose, followed by a header line.

    Columns go by the header's names, as in ``read_csv_audited``; without a header, by
    position. The leading lines of each file are known before the scan and taken out of
    its first split by their text, so files stay splittable and the scan stays in the
    JVM; a line of that split that repeats one of them word for word goes as well. Blank
    lines are left out, quoted line breaks are not supported."""
    n = skip + int(header)
    groups: dict[str | None, list[tuple[str, list[str]]]] = {}
    for file, lines in first_lines(spark, path, n):
        if len(lines) >= n:  # else there is no more than a preamble
            groups.setdefault(lines[skip] if header else None, []).append((file, lines))
    parts = []
    for line, members in groups.items():
        fields = schema.fields if line is None else header_fields(line, schema)
        known = [(file, text, 0) for file, lines in members for text in set(lines)]
        leading = spark.createDataFrame(known, "_source_file string, _line string, _block_start long")
        if sum(len(file) + len(text) for file, text, _ in known) < SENT_CHARS:
            leading = F.broadcast(leading)  # with more files than that, Spark decides
        rows = spark.read.text([file for file, _ in members]).select(
            F.col("value").alias("_line"),
            F.col("_metadata.file_path").alias("_source_file"),
            F.col("_metadata.file_block_start").alias("_block_start"),
        )
        body = rows.filter(F.trim("_line") != "").join(leading, leading.columns, "left_anti")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        parsed = body.select(F.from_csv("_line", ddl, CSV_SPACES).alias("_row"), "_source_file").select("_row.*", "_source_file")
        parts.append(parsed.select(*_of_schema([f.name for f in fields], schema), "_source_file"))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("_source_file", F.lit(""))
    return reduce(DataFrame.unionByName, parts)


def source_name(path: Column) -> Column:
    """Last part of a path, without ``.csv``. Plain cuts: a pattern up to the end of the path
    would be tried at every character of it, row by row."""
    last = F.substring_index(path, "/", -1)
    return F.when(last.endswith(".csv") & (F.length(last) > 4), F.left(last, F.length(last) - 4)).otherwise(last)


def csv_preamble_to_parquet(
    spark: SparkSession,
    in_glob: str,
    out: str,
    schema: T.StructType = S.READING_DATA,
    skip: int = 4,
) -> None:
    """Convert preamble CSVs to Parquet, one output folder per input file."""
    rows = read_csv_preamble(spark, in_glob, schema, skip)
    (
        rows.withColumn("source_name", source_name(F.col("_source_file")))
        .drop("_source_file")
        .write.mode("overwrite")
        .partitionBy("source_name")
        .parquet(out)
    )
