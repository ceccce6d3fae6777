"""Text, CSV and JSON readers with explicit schemas; bad fields become null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busweave.functions.text import decimal_comma, parse_line, parse_point
from busweave.functions.times import from_millis
from busweave.sources import schemas


def read_csv(spark: SparkSession, path: str | list[str], schema, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text; the header goes per file, quoted separators stay inside their field."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_named_csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """Delimited text whose columns go by the names in its header, whatever their order.

    Columns that the files lack are null, further ones are left out, a field that is not of its type is null. Files
    read together must have the same header; others raise an error instead of shifting columns.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": False}
    raw = spark.read.options(**options).csv(path)
    return raw.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in T.StructType.fromDDL(schema)
        ]
    )


def read_days(spark: SparkSession, glob: str, schema, sep: str = ",", header: bool = True, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Part files of all day folders as one frame; ``day`` comes from the folder name, blank lines drop out."""
    frame = read_csv(spark, glob, schema, sep, header)
    filled = frame.where(F.coalesce(*[F.col(c).cast("string") for c in frame.columns]).isNotNull())
    return filled.withColumn("day", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)))


def read_day_folders(spark: SparkSession, folder: str, schema: str, sep: str = ",", header: bool = True, column: str = "day") -> DataFrame:
    """Part files of the folders ``<column>=YYYY-MM-DD`` below ``folder`` as one frame; blank lines drop out.

    The day is a partition column: a filter on it chooses folders and reads no other file.
    """
    fields = T.StructType([f for f in T.StructType.fromDDL(schema).fields if f.name != column])
    frame = read_csv(spark, folder, T.StructType([*fields, T.StructField(column, T.DateType())]), sep, header)
    return frame.where(F.coalesce(*[F.col(c).cast("string") for c in fields.names]).isNotNull())


def read_vehicle_json(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle positions, one JSON document per line, with the time of day split off."""
    rows = spark.read.schema(schemas.VEHICLE).json(path)
    ts = F.coalesce(
        F.try_to_timestamp("DTHR", F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp("DTHR", F.lit("yyyy-MM-dd HH:mm:ss"))
    )
    return rows.select(
        F.col("VEIC").alias("bus_code"),
        F.replace("LAT", F.lit(","), F.lit(".")).try_cast("double").alias("latitude"),
        F.replace("LON", F.lit(","), F.lit(".")).try_cast("double").alias("longitude"),
        ts.alias("timestamp"),
        F.date_format(ts, "HH:mm:ss").alias("time_of_day"),
        F.col("COD_LINHA").alias("line_code"),
    )


def read_documents(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Documents, one per line, as a flat table of the listed fields; nested fields use dots.

    ``fields`` maps a field to its type. Only these fields are parsed.
    """
    lines = spark.read.text(path)
    return lines.select(
        *[F.get_json_object("value", f"$.{name}").try_cast(kind).alias(name.replace(".", "_")) for name, kind in fields.items()]
    )


def explode_vehicle_feed(df: DataFrame, json_col: str) -> DataFrame:
    """One row per vehicle of a nested feed ``{shape: [vehicle, ...]}``."""
    feed = F.from_json(json_col, f"map<string,array<{schemas.FEED_VEHICLE}>>")
    shapes = df.select(F.explode(feed).alias("shape", "vehicles"))
    return shapes.select("shape", F.explode("vehicles").alias("v")).select("shape", "v.*")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Rain readings: semicolons, decimal commas, fractions of seconds cut."""
    raw = read_csv(spark, path, schemas.WEATHER, sep=";")
    return raw.select(
        F.col("codEstacao").alias("station"),
        decimal_comma(F.col("latitude")).alias("lat"),
        decimal_comma(F.col("longitude")).alias("lon"),
        F.try_to_timestamp(F.substring("datahora", 1, 19)).alias("ts"),
        decimal_comma(F.col("valorMedida")).alias("precipitation"),
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Traffic alerts with their JSON position and epoch milliseconds parsed."""
    raw = read_named_csv(spark, path, schemas.ALERTS)
    at = parse_point(F.col("location"))
    return raw.withColumns({"lat": at["y"], "lon": at["x"], "ts": from_millis(F.col("pubMillis"))}).withColumnRenamed("uuid", "alert_id")


def read_jams(spark: SparkSession, path: str) -> DataFrame:
    """Traffic jams with their line as an array of points; a block type ``NONE`` counts as missing."""
    raw = read_named_csv(spark, path, schemas.JAMS)
    return raw.withColumns(
        {
            "line": parse_line(F.col("line")),
            "ts": from_millis(F.col("updateMillis")),
            "expires": from_millis(F.col("blockExpiration")),
            "blockType": F.nullif(F.col("blockType"), F.lit("NONE")),
        }
    ).withColumnRenamed("uuid", "jam_id")


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six timetable files."""
    return {name: read_named_csv(spark, f"{folder.rstrip('/')}/{name}.txt", schema) for name, schema in schemas.GTFS.items()}


def user_of_file(pattern: str) -> Column:
    """User number in the path of the row's file; null where the pattern does not match."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int")


def read_trajectory(spark: SparkSession, path: str, user_pattern: str = r"combined(\d+)\.plt") -> DataFrame:
    """Trajectory lines with exactly seven fields: latitude, longitude, …, day number, date, time. The file names the user."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(parts) == 7)
    return rows.select(
        user_of_file(user_pattern).alias("user"),
        F.get(parts, 0).try_cast("double").alias("lat"),
        F.get(parts, 1).try_cast("double").alias("lon"),
        F.get(parts, 4).try_cast("double").alias("day_number"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL AND day_number IS NOT NULL")


def read_mode_labels(spark: SparkSession, path: str, user_pattern: str = r"labels(\d+)\.txt") -> DataFrame:
    """Tab-separated intervals; rows need all three fields and valid times. The file names the user."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    moment = lambda i: F.try_to_timestamp(F.get(parts, i), F.lit("yyyy/MM/dd HH:mm:ss"))
    return rows.select(user_of_file(user_pattern).alias("user"), moment(0).alias("start"), moment(1).alias("end"), F.trim(F.get(parts, 2)).alias("mode")).where(
        "start IS NOT NULL AND end IS NOT NULL"
    )


def standard_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same columns in the same order for files that differ; absent ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(T.StringType()).alias(c) for c in columns])
