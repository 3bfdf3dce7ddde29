"""CSV ingest, stored tables, period skeletons and result files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.dates import period
from ..functions.text import NUMBER_PATTERN


QUOTED = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_csv_strict(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                    multiline: bool = False, source: str | None = None) -> DataFrame:
    """Quoted CSV in which a quoted field may hold delimiters and quotes.

    Without a schema every column is text; typing is a separate step. A cell that its type
    cannot hold, a row of too few or too many cells and a header unlike the schema make the read fail.
    `multiline` allows newlines in quoted fields too (`read_csv_records`). `source` adds a column
    with the path of each row's file.
    """
    if multiline:
        return read_csv_records(spark, path, schema, source)
    reader = spark.read.option("header", True).options(**QUOTED).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias(source)) if source else rows


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file on any file system that Spark reads."""
    jvm, place = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """`path`, `record` (number in its file, from 0), `text` of the records of CSV files whose
    quoted fields may hold newlines; blank records are left out.

    Lines are read from all byte ranges of a file at once. A newline ends a record if the quotes before
    it are even in number. Quotes are counted per range, so a running sum over the ranges of a
    file (a row each) tells each range whether it begins inside quotes, and another how many
    records begin before it; within its range each line is then numbered by itself. Records of one
    line are done there; only the lines of longer ones are put together, also across ranges.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), "value", F.regexp_count("value", F.lit('"')).alias("quotes"))
    before = W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("path", "range").orderBy("at").rowsBetween(W.unboundedPreceding, -1)

    def ahead(per_range: DataFrame, total: str) -> DataFrame:
        return per_range.select(F.col("path").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum(total).over(before), F.lit(0)).alias("ahead"))

    def with_ahead(rows: DataFrame, per_range: DataFrame, total: str) -> DataFrame:
        return rows.join(ahead(per_range, total), (F.col("path") == F.col("p")) & (F.col("range") == F.col("r"))).drop("p", "r")

    quotes = lines.groupBy("path", "range").agg(F.sum("quotes").alias("quotes"))
    rows = with_ahead(lines, quotes, "quotes")
    even = (F.col("ahead") + F.coalesce(F.sum("quotes").over(upto), F.lit(0))) % 2 == 0
    rows = rows.withColumn("begins", even.cast("int")).drop("ahead")
    begun = rows.groupBy("path", "range").agg(F.sum("begins").alias("begins"))
    rows = with_ahead(rows, begun, "begins").withColumn("record", F.col("ahead") + F.coalesce(F.sum("begins").over(upto), F.lit(0)) + F.col("begins") - 1)
    whole = (F.col("begins") == 1) & (F.col("quotes") % 2 == 0)
    single = rows.filter(whole).select("path", "record", F.col("value").alias("text"))
    parts = rows.filter(~whole).groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    text = F.rtrim(F.col("text"), F.lit("\r"))
    return (single.unionByName(parts.select("path", "record", F.array_join("parts.value", "\n").alias("text")))
            .select("path", "record", text.alias("text")).filter(F.trim("text") != ""))


def read_csv_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                     source: str | None = None) -> DataFrame:
    """`read_csv_strict` for files whose quoted fields may hold newlines, read in many tasks."""
    records = csv_records(spark, path)
    names = schema.names if schema else spark.read.option("header", True).options(**QUOTED).csv(path).columns
    schema = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    heading = F.from_csv("text", _ddl(text), QUOTED)
    agrees = F.lit(True)
    for i, name in enumerate(names):
        agrees = agrees & heading[f"c{i}"].eqNullSafe(F.lit(name))
    unlike = F.raise_error(F.concat(F.lit("MALFORMED header, unlike the schema: "), F.col("text"))).cast("boolean")
    rows = records.filter(F.when(F.col("record") > 0, True).when(agrees, False).otherwise(unlike))
    return rows.select(F.from_csv("text", _ddl(schema), QUOTED).alias("r"), "path").select("r.*", *([F.col("path").alias(source)] if source else []))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# Candidate types in order, with the shape a text must have to be read as one.
CANDIDATE_TYPES = (
    (T.LongType(), r"^[+-]?\d+$"),
    (T.DoubleType(), NUMBER_PATTERN),
    (T.DateType(), r"^\d{4}-\d{1,2}-\d{1,2}$"),
    (T.TimestampNTZType(), r"^\d{4}-\d{1,2}-\d{1,2}[ T]"),
)


def infer_schema(spark: SparkSession, path: str, multiline: bool = False) -> T.StructType:
    """Column types from all rows, in one aggregate: the first candidate type that every
    non-blank value of the column can be read as, else text."""
    head = read_csv_strict(spark, path, multiline=multiline)
    tests = []
    for i, name in enumerate(head.columns):
        text = F.nullif(F.trim(F.col(name)), F.lit(""))
        for j, (kind, shape) in enumerate(CANDIDATE_TYPES):
            readable = text.rlike(shape) & text.try_cast(kind).isNotNull()
            tests.append(F.min(F.when(text.isNotNull(), readable)).alias(f"t{i}_{j}"))
    verdict = head.agg(*tests).first()
    fields = []
    for i, name in enumerate(head.columns):
        kinds = (kind for j, (kind, _) in enumerate(CANDIDATE_TYPES) if verdict[f"t{i}_{j}"])
        fields.append(T.StructField(name, next(kinds, T.StringType())))
    return T.StructType(fields)


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files directly in a folder, on any file system Spark reads."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .load(folder).select("path"))
    return sorted(r["path"] for r in files.collect())


def _stem(path: str) -> str:
    return os.path.basename(path).removesuffix(".csv")


def ingest_csv_files(spark: SparkSession, paths: Iterable[str], dst: str,
                     schemas: Mapping[str, T.StructType] | None = None, multiline: bool = False) -> list[str]:
    """Store each CSV file as a Parquet table of the same name; returns the names.

    Files of one header and schema are read and written together by one job, whose tasks write
    the rows of each file below its name; the finished folders then take the place of the old tables.
    """
    paths = list(paths)
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        schema = (schemas or {}).get(_stem(path))
        groups.setdefault((first_line(spark, path).rstrip("\r"), schema and schema.json()), []).append(path)
    for some in groups.values():
        staged = f"{dst}/_ingest-{uuid.uuid4().hex}"
        df = read_csv_strict(spark, some, (schemas or {}).get(_stem(some[0])), multiline, source="__path")
        df.withColumn("__table", F.regexp_extract("__path", r"([^/]*)\.csv$", 1)).drop("__path").write.partitionBy("__table").parquet(staged)
        place = spark._jvm.org.apache.hadoop.fs.Path
        files = place(dst).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in map(_stem, some):
            own = place(f"{staged}/__table={name}")
            if not files.exists(own):  # a file without rows
                read_csv_strict(spark, next(p for p in some if _stem(p) == name), (schemas or {}).get(name)).write.mode("overwrite").parquet(f"{dst}/{name}")
                continue
            files.delete(place(f"{dst}/{name}"), True)
            files.rename(own, place(f"{dst}/{name}"))
        files.delete(place(staged), True)
    return [_stem(p) for p in paths]


def ingest_csv_dir(spark: SparkSession, src: str, dst: str,
                   schemas: Mapping[str, T.StructType] | None = None, multiline: bool = False) -> list[str]:
    return ingest_csv_files(spark, list_csv(spark, src), dst, schemas, multiline)


def ingest_csv_list(spark: SparkSession, src: str, names: Sequence[str], dst: str,
                    schemas: Mapping[str, T.StructType] | None = None, multiline: bool = False) -> list[str]:
    return ingest_csv_files(spark, [f"{src}/{n}.csv" for n in names], dst, schemas, multiline)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, or only some of its columns (pruned in the scan)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_periods(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Put `df` in the place of the partitions that it has rows of; all others keep their files.
    Rows are shuffled by partition first, large ones to several tasks, so files are few."""
    df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def add_extract(spark: SparkSession, extract: DataFrame, name: str, events: str, counts: str, period: str,
                count: Callable[[DataFrame], DataFrame]) -> None:
    """Add a later extract to a stored table of events and bring a table of counts per period up to date.

    Events lie in partitions of period and extract, counts (`count` of the events, which keeps `period`) in
    partitions of period. Only the periods of the extract are read and counted again, so the work is that of
    the extract and not of the history. An extract that is added again under its name replaces itself
    in the periods it has. Rows without a period are in no period and are left out.
    """
    rows = extract.filter(F.col(period).isNotNull()).withColumn("extract", F.lit(name))
    periods = [r[0] for r in rows.select(period).distinct().collect()]  # a few months
    write_periods(rows, events, [period, "extract"])
    if periods:
        touched = spark.read.parquet(events).filter(F.col(period).isin(periods)).drop("extract")
        write_periods(count(touched), counts, [period])


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, period: str | None = None) -> None:
    """A table of the catalog whose rows lie by period and, within, in buckets of the key in its order:
    windows skip partitions, and joins by the key to a table of as many buckets need no exchange."""
    writer = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(period) if period else writer).saveAsTable(table)


def drop_leading_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Drop the n rows that come first by `order`, which must identify a row.

    The n rows are found by a per-partition top-n, so nothing is sorted as a whole.
    """
    head = df.select(*order).orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)
    head = head.select(*[F.col(c).alias(f"__{c}") for c in order])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order]
    return df.join(head, on, "left_anti")


def period_skeleton(spark: SparkSession, start: int | str, end: int | str,
                    column: str = "q") -> DataFrame:
    """Every period number from start to end; bounds as numbers or `2022q1` texts."""
    lo = period(start) if isinstance(start, str) else start
    hi = period(end) if isinstance(end, str) else end
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(column))


def write_results(results: DataFrame, path: str,
                  partition_by: Sequence[str] = ("outcome", "spec")) -> None:
    """Estimates as one table, one folder per outcome and specification."""
    write_table(results, path, partition_by)
