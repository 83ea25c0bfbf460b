"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Largest row count of a side that is broadcast by hint (rows of at most
#: about 64 bytes, so below 32 MB). Larger sides go through a shuffle join.
BROADCAST_ROWS = 400_000


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: their
    machines need not have it installed. The archive (source files only) lies
    in the shared checkpoint folder."""
    sc, top = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _SHIPPED or not os.path.isdir(top):  # already imported from such an archive
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    target = os.path.join(checkpoint_dir(spark), "llm", f"code-{uuid.uuid4().hex}", "tally.zip")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


class Scratch:
    """Tables written once under the shared checkpoint folder.

    ``write`` cuts lineage: a lost executor re-reads files, and every later
    use sees the same rows. ``drop`` removes a table no frame needs any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.base = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.base, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.base, name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside ``extra`` columns, so that
    no input column, whatever its name, can clash with a working column."""
    return docs.select(*[c.alias(k) for k, c in extra.items()], F.struct("*").alias("row"))


def parts(df: DataFrame) -> int:
    """The session's shuffle parallelism."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
