"""Partitioned Parquet tables: reading by time range, statistics, layout and retention."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash


def with_date_parts(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumn("year", F.year(time)).withColumn("month", F.month(time)).withColumn("day", F.dayofmonth(time))


def write_bronze(df: DataFrame, path: str, time: str = "ts") -> None:
    with_date_parts(df, time).repartition("year", "month", "day").write.partitionBy("year", "month", "day").parquet(path)


def scan_range(spark: SparkSession, path: str, start: str, end: str, time: str = "ts") -> DataFrame:
    """Rows in [start, end]: a predicate on the date parts prunes partitions, one on the time does the rest."""
    number = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    low, high = (int(x[:10].replace("-", "")) for x in (start, end))
    return spark.read.parquet(path).where(number.between(low, high) & F.col(time).between(start, end))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The files of a partitioned store with the values of their partitions and their ``length``, from the listing alone: without
    its content, no file is opened."""
    return spark.read.format("binaryFile").load(path).drop("content", "modificationTime")


def latest_partition(spark: SparkSession, path: str) -> DataFrame:
    """The newest date, from the names of the partitions alone."""
    return listing(spark, path).agg(F.max(F.struct("year", "month", "day")).alias("p")).select("p.*")


def latest_timestamp(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """The newest time; only the newest partition's times are read."""
    newest = latest_partition(spark, path).first()
    rows = spark.read.parquet(path).where(f"year = {newest['year']} AND month = {newest['month']} AND day = {newest['day']}")
    return rows.agg(F.max(time).alias(time))


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows, files and bytes of each date: sizes from the listing, row counts from the files' footers (no column is read)."""
    dates = ["year", "month", "day"]
    sizes = listing(spark, path).groupBy(*dates).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.read.parquet(path).groupBy(*dates).agg(F.count("*").alias("rows"))
    return rows.join(sizes, dates).select(*dates, "rows", "files", "bytes")


def sample_newest(spark: SparkSession, path: str, n: int = 10, time: str = "ts", tie: str = "event_id", most: int = 100) -> DataFrame:
    """The last rows of the newest partition, newest first; other partitions aren't read."""
    newest = latest_partition(spark, path).first()
    rows = spark.read.parquet(path).where(f"year = {newest['year']} AND month = {newest['month']} AND day = {newest['day']}")
    return rows.orderBy(F.desc(time), tie).limit(min(n, most))


def retained(df: DataFrame, as_of: str, days: int, time: str = "ts") -> DataFrame:
    return df.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def drop_expired(spark: SparkSession, path: str, as_of: str, days: int) -> list[str]:
    """Delete the date partitions that end before ``as_of`` less so many days; their names. No file is opened."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    parts = listing(spark, path).select("year", "month", "day").distinct()
    past = parts.where(F.make_date("year", "month", "day") < F.to_date(oldest)).collect()  # a row per expired day
    jvm = spark.sparkContext._jvm
    dropped = []
    for r in sorted(past):
        name = f"year={r['year']}/month={r['month']}/day={r['day']}"
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        dropped.append(name)
    return dropped


def sort_layout(df: DataFrame, entity: str, time: str = "ts") -> DataFrame:
    """Rows of an entity together, newest first."""
    return df.repartition(entity).sortWithinPartitions(entity, F.desc(time))


def rewrite_date(spark: SparkSession, path: str, date: tuple[int, int, int], entity: str, time: str = "ts") -> None:
    """Lay out one date of a store anew, rows of an entity together and newest first; other dates aren't touched. The rows
    are written elsewhere before they take the place of the old ones."""
    y, m, d = date
    rows = stash(spark.read.parquet(path).where(f"year = {y} AND month = {m} AND day = {d}"), "layout")
    # the writer sorts by the partitions unless the rows are in that order already, and would lose the order within
    laid = sort_layout(rows, entity, time).sortWithinPartitions("year", "month", "day", entity, F.desc(time))
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(path)


def extract_keys(df: DataFrame, path: str, key: str, keys: list[str], order: str) -> None:
    """One folder per key, its rows sorted."""
    own = df.where(F.col(key).isin(*keys))
    own.repartition(key).sortWithinPartitions(key, order).write.partitionBy(key).parquet(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> dict[str, int]:
    """Replace a whole table: the new rows are written beside it and swapped in by renames, so a failed load leaves the
    old table, also when a rename fails. Returns how many rows went and came."""
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = {name: jvm.org.apache.hadoop.fs.Path(name) for name in (path, fresh, old)}
    files = where[path].getFileSystem(conf)
    counts = {"deleted": spark.read.parquet(path).count() if files.exists(where[path]) else 0, "loaded": spark.read.parquet(fresh).count()}
    there = files.exists(where[path])
    if there:
        files.delete(where[old], True)  # of a load that broke off
        if not files.rename(where[path], where[old]):
            raise OSError(f"{path} could not be moved")
    if not files.rename(where[fresh], where[path]):
        if there:
            files.rename(where[old], where[path])
        raise OSError(f"{fresh} could not take the place of {path}")
    files.delete(where[old], True)
    return counts


CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, on_error: str = "skip", schema: str | None = None, limit: int | None = None
) -> DataFrame:
    """All columns as text unless a schema is given; columns without header are col_0, col_1, and so on.

    Whole rows are parsed whatever columns a query reads: rows that don't fit the schema end the read (``fail``), are left out (``skip``), or are kept with their text in
    ``_corrupt_record`` (``log``), for ``quarantined``.
    """
    mode = {"fail": "FAILFAST", "skip": "PERMISSIVE", "log": "PERMISSIVE"}[on_error]
    reader = spark.read.option("sep", sep).option("header", header).option("mode", mode)
    if schema:
        logged = schema if on_error == "fail" else f"{schema}, {CORRUPT} STRING"
        found = reader.schema(logged).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
        # what counts as bad changes with the columns that a query reads, so whole rows are parsed into a table first
        found = found if on_error == "fail" else stash(found, "csv")
        found = found.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if on_error == "skip" else found
    else:
        found = reader.csv(path)
        found = found if header else found.toDF(*[f"col_{i}" for i in range(len(found.columns))])
    return found if limit is None else found.limit(limit)


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of the bad ones."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_dimension(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", width: str = "fail") -> DataFrame:
    """Declared columns by name, as their types. A declared column that the file lacks is an error, other columns are
    ignored, and rows with a value that its type can't hold are left out. A row with more or fewer fields than the header is an
    error, or left out with ``width="skip"``. ``boolean`` takes true, 1, yes, t, y."""
    reader = spark.read.option("sep", sep).option("header", True)
    names = reader.csv(path).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in {path}")
    shape = ", ".join(f"`{c}` string" for c in [*names, CORRUPT])
    # fields are counted only where no column is pruned
    text = reader.schema(shape).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    wrong = F.col(CORRUPT).isNotNull()
    if width == "skip":
        text = text.where(~wrong)
    else:
        told = F.concat(F.lit("a row has another number of fields than the header: "), F.col(CORRUPT))
        text = text.where(F.when(wrong, F.raise_error(told).cast("boolean")).otherwise(True))

    def typed(c: str, kind: str) -> Column:
        if kind == "boolean":
            v = F.lower(F.trim(c))
            return F.when(v.isin("true", "1", "yes", "t", "y"), True).when(v.isin("false", "0", "no", "f", "n"), False)
        return F.col(c).try_cast(kind)

    checked = text.select(*[F.col(c).alias(f"__{c}") for c in columns], *[typed(c, kind).alias(c) for c, kind in columns.items()])
    for c in columns:
        checked = checked.where(F.col(f"__{c}").isNull() | F.col(c).isNotNull())
    return checked.select(*columns)


#: What counts as a whole number and as a number in a CSV value: nothing around it, no type suffix, no hexadecimal digits.
INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"


def _by_type(v: Column, null: str, whole: Column | str, number: Column | str, truth: Column | str, text: Column | str) -> Column:
    """One of five by the type of a CSV value, each type tested once."""
    return (
        F.when(v.isNull() | (v == ""), null).when(v.rlike(INTEGER) & v.try_cast("long").isNotNull(), whole).when(v.rlike(NUMBER), number)
        .when(F.lower(v).isin("true", "false"), truth).otherwise(text)
    )


def inferred(c: str) -> Column:
    """The type of a CSV value: int (64 bits), else float, else bool, else null (empty), else string."""
    return _by_type(F.col(c), "null", "int", "float", "bool", "string")


def inferred_json(c: str) -> Column:
    """A CSV value as JSON of its inferred type; numbers that JSON lacks (infinite, NaN) are 0."""
    v = F.col(c)
    number = v.try_cast("double")
    odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    quoted = F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]\z", "")
    return _by_type(v, "null", v.try_cast("long").cast("string"), F.when(odd, "0").otherwise(number.cast("string")), F.lower(v), quoted)


#: ISO 8601: a time with zone, or one without zone (UTC) with the letter T.
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})|T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?)\z"


def csv_timestamp(c: str, kind: str, pattern: str | None = None) -> Column:
    """A CSV value as time, null if it isn't one: ``epoch_seconds``, ``epoch_millis``, ``custom`` by a pattern, else ISO 8601 (a date
    alone is none)."""
    v = F.col(c)
    if kind == "epoch_seconds":
        return F.when(v.rlike(INTEGER), F.timestamp_seconds(v.try_cast("long")))
    if kind == "epoch_millis":
        return F.when(v.rlike(INTEGER), F.timestamp_millis(v.try_cast("long")))
    return F.try_to_timestamp(v, F.lit(pattern)) if pattern else F.when(v.rlike(ISO), F.upper(v).try_cast("timestamp"))


def csv_points(
    spark: SparkSession, path: str, time_field: str, time_format: str = "iso8601", sep: str = ",", header: bool = True, on_error: str = "skip",
    limit: int | None = None, pattern: str | None = None, fields: int | None = None,
) -> DataFrame:
    """Raw points of a CSV file: ``timestamp``, and ``payload``, the row as a JSON object of inferred types.

    Columns without header are col_0, col_1, and so on, as many as ``fields`` says, or as the first row has; a time field that the
    file lacks is an error. A row is bad if it has
    another number of fields, or no time in the format: it ends the read (``fail``), is left out (``skip``), or
    is kept with what is wrong in ``error`` (``log``). A limit counts bad rows too.
    """
    reader = spark.read.option("sep", sep).option("header", header)
    if header:
        names = reader.csv(path).columns
    else:
        names = [f"col_{i}" for i in range(fields or len(reader.csv(path).columns))]
    if time_field not in names:
        raise ValueError(f"there is no column {time_field!r} in {path}")
    shape = ", ".join(f"`{c}` string" for c in [*names, CORRUPT])
    rows = reader.schema(shape).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    rows = rows if limit is None else rows.limit(limit)
    time = csv_timestamp(time_field, time_format, pattern)
    error = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("another number of fields: "), F.col(CORRUPT))).when(time.isNull(), F.concat(F.lit("no time: "), F.coalesce(time_field, F.lit(""))))
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{json.dumps(c)}:"), inferred_json(c)) for c in names]), F.lit("}"))
    told = rows.select(time.alias("timestamp"), body.alias("payload"), error.alias("error"))
    if on_error == "log":
        return told
    if on_error == "skip":
        return told.where("error IS NULL").drop("error")
    return told.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)).drop("error")
