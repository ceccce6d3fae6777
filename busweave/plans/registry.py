"""Registered queries: a DataFrame builder and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's Parquet tables; zone-less timestamps become session timestamps."""

    def __init__(self, spark: SparkSession, folder: str):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.withColumns(
            {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
        )

    events = cached_property(lambda self: self.read("events"))
    orders = cached_property(lambda self: self.read("orders"))
    lineitem = cached_property(lambda self: self.read("lineitem"))
    customer = cached_property(lambda self: self.read("customer"))
    supplier = cached_property(lambda self: self.read("supplier"))
    part = cached_property(lambda self: self.read("part"))
    nation = cached_property(lambda self: self.read("nation"))
    region = cached_property(lambda self: self.read("region"))
    embeddings = cached_property(lambda self: self.read("embeddings"))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register
