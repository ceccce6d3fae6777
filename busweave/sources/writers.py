"""CSV and partitioned writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE_FILE_BYTES = 1 << 30


def write_csv(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sep: str = ",", spread: int = 8, rows_per_file: int = 10_000_000
) -> None:
    """Header in every part file. With ``partition_by``, rows are dealt by partition and a hash of the row: a partition
    has at most ``spread`` writing tasks, whatever the input's number of tasks, and large files are cut."""
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    writer = df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_by_month(df: DataFrame, path: str, ts: str) -> None:
    write_csv(df.withColumn("month", F.date_format(ts, "yyyy-MM")), path, ["month"])


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    write_csv(df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")), path, ["day"])


def write_weather_by_day(df: DataFrame, path: str, ts: str, lat: str = "lat", lon: str = "lon") -> None:
    """Weather files with swapped coordinates put right."""
    write_by_day(df.withColumns({lat: F.col(lon), lon: F.col(lat)}), path, ts)


def write_by_shape(df: DataFrame, path: str, keys: Sequence[str] = ("route_id", "shape_id")) -> None:
    write_csv(df, path, list(keys))


def merge_parts(spark: SparkSession, source: str, target: str, file_bytes: int = ONE_FILE_BYTES, schema=None) -> int:
    """Merge part files into one file with a header, or into as few as ``file_bytes`` allows.

    Small outputs, the usual case, give one file; a task never handles more than the stated size.
    Returns the number of files asked for.
    """
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True)
    total = sizes.load(source).agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    frame = spark.read.option("header", True)
    frame = (frame.schema(schema) if schema else frame).csv(source)
    write_csv(frame.repartition(files), target)  # the parts are read in parallel, whatever their size
    return files
