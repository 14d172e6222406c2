"""Statements that change tables, over versions of a table in a folder.

Every statement writes a new version beside the old and then moves the table's name to
it, so readers see one state or the other."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators import changes
from quillmill.sources.log import write_atomic


class Tables:
    """Tables by name in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def _name(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.json")

    def names(self) -> list[str]:
        return sorted(x.removesuffix(".json") for x in os.listdir(self.folder) if x.endswith(".json"))

    def _write(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet("file://" + os.path.abspath(os.path.join(self.folder, version)))
        write_atomic(self._name(name), json.dumps({"version": version, "schema": df.schema.jsonValue()}).encode())

    def read(self, name: str) -> DataFrame:
        with open(self._name(name)) as f:
            now = json.load(f)
        return self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet("file://" + os.path.abspath(os.path.join(self.folder, now["version"])))

    def create(self, name: str, schema: str, if_not_exists: bool = False) -> None:
        if os.path.exists(self._name(name)):
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self._write(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if if_exists and not os.path.exists(self._name(name)):
            return
        os.unlink(self._name(name))

    def insert(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Adds rows; with a key, rows whose key is there or comes twice are an error."""
        old = self.read(name)
        both = old.unionByName(rows.select(*old.columns))
        if key and not both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"{name}.{key} is not unique")
        self._write(name, both)

    def replace(self, name: str, rows: DataFrame, key: str) -> None:
        """Puts rows in by key, in place of those that are there."""
        old = self.read(name)
        self._write(name, changes.upsert(old, rows.select(*old.columns), key))

    def update(self, name: str, values: dict[str, Column], where: Column) -> None:
        """Sets columns of the rows that meet a condition; unknown is no match."""
        old = self.read(name)
        match = F.coalesce(where, F.lit(False))
        self._write(name, old.select(*(F.when(match, values[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns)))

    def delete(self, name: str, where: Column) -> None:
        old = self.read(name)
        self._write(name, old.filter(~F.coalesce(where, F.lit(False))))

    def views(self) -> None:
        """Makes every table a view of its name, for SQL."""
        for name in self.names():
            self.read(name).createOrReplaceTempView(name)
