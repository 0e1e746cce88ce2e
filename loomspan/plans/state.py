"""The engine's own state as one JSON file in the warehouse, so that it outlives the process.

It holds the load version, the databases made and the definitions of their tables, indexes, saved
queries and views. The file is written aside and renamed, so a reader sees an old or a new one, never half of it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

FILE = "_loomspan/state.json"


def warehouse(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class StateFile:
    """Reads and writes the state through the file system of the warehouse, whatever it is."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"{warehouse(spark)}/{FILE}")
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> dict:
        if not self.files.exists(self.path):
            return {}
        source = self.files.open(self.path)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def write(self, state: dict) -> None:
        aside = self.path.suffix(".new")
        out = self.files.create(aside, True)
        try:
            out.write(bytearray(json.dumps(state, indent=1).encode()))
        finally:
            out.close()
        self.files.delete(self.path, False)
        self.files.rename(aside, self.path)

    def remove(self) -> None:
        self.files.delete(self.path, False)

    def remove_folder(self, path: str) -> None:
        self.files.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

    def holds(self, path: str) -> bool:
        return self.files.exists(self.jvm.org.apache.hadoop.fs.Path(path))
