"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OWN_FOLDER: dict[str, str] = {}
#: Rows of one key that a task of a join takes without more ado, and the most keys that are broadcast because they have more.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and Spark runs inside one process (tests)
    does a temporary folder take its place; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(_remove_local, _OWN_FOLDER[app])
    return _OWN_FOLDER[app]


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Tables written to the shared folder to cut lineage; each is computed once.

    A written table survives the loss of executors, unlike cached or locally
    checkpointed blocks. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomspan/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/loomspan/" in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same on pure ASCII and is much cheaper there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def let(value: Column, body) -> Column:
    """Binds ``value`` once for ``body``, which may use it many times and inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def row_count_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; looks at ``bound + 1`` rows at most."""
    return df.limit(bound + 1).count() <= bound


def join_hot(large: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``large``, of ``rows`` rows, with ``small``, whatever rows of ``large`` share a key.

    ``small`` has one row per key and in ``n`` how many rows of ``large`` have that key;
    ``n`` is not returned. Keys of ``HOT_ROWS`` rows, or a ``HOT_KEYS``-th of all, are broadcast, so their
    rows stay where they are: there are ``HOT_KEYS`` such keys at most. All others meet by a shuffle.
    """
    if rows < HOT_ROWS:  # no key can have so many
        return large.join(small.drop("n"), keys, how)
    bound = max(HOT_ROWS, -(-rows // HOT_KEYS))
    values = [c for c in small.columns if c not in keys and c != "n"]
    hot = small.where(F.col("n") >= bound).select(*keys, F.struct(*values).alias("_hot"))
    marked = large.join(F.broadcast(hot), keys, "left")
    near = marked.where("_hot is not null").select(*large.columns, *[F.col(f"_hot.{v}").alias(v) for v in values])
    rest = marked.where("_hot is null").select(*large.columns)
    return near.unionByName(rest.join(small.where(F.col("n") < bound).drop("n"), keys, how))
