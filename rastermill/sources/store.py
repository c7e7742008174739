"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import dealt


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a folder of our own serves a local master;
    a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: How intermediate tables are written: as large as their rows. Spark takes a file's size for that of its rows when it looks for
#: a side to broadcast, and encoded columns of an image's pixels and samples can be a fiftieth of what the driver would hold.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written below the shared folder and read again, so its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """The tables of a job, each in a folder of its own below `folder` (one below the shared folder if none is given). A table
    that a run before has written whole is read instead of computed, so a job that broke off goes on after its last stage."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_folder(spark)}/job-{uuid.uuid4().hex}").rstrip("/")
        self.names: list[str] = []

    def written(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table `name`, made by make() unless it is there. Names are numbered in the order they are asked for."""
        name = f"{len(self.names):02d}-{name}"
        self.names.append(name)
        if not self.written(name):
            make().write.mode("overwrite").options(**PLAIN).parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


class PixelVersions:
    """A pixel table that stages change: each stage writes only the pixels it changes, as the next version of them."""

    KEY, COLORS = ["image_id", "x", "y"], ["r", "g", "b", "a"]

    def __init__(self, px: DataFrame, stages: Stages):
        self.base, self.stages, self.changes = px.select(*self.KEY, *self.COLORS), stages, []

    def now(self) -> DataFrame:
        """The pixels with the latest version of each."""
        if not self.changes:
            return self.base
        every = self.changes[0]
        for c in self.changes[1:]:
            every = every.unionByName(c)
        latest = every.groupBy(*self.KEY).agg(F.max_by(F.struct(*self.COLORS), "version").alias("new"))
        return self.base.join(dealt(latest), self.KEY, "left").select(*self.KEY, *[F.coalesce(f"new.{c}", c).alias(c) for c in self.COLORS])

    def change(self, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply a stage: make(pixels) gives the changed ones, image_id, x, y, r, g, b and, unless they become opaque, a. Returns them."""

        def changed() -> DataFrame:
            d = make(self.now())
            return d.select(*self.KEY, "r", "g", "b", F.col("a") if "a" in d.columns else F.lit(65535).alias("a"))

        new = self.stages.table(name, changed)
        self.changes.append(new.withColumn("version", F.lit(len(self.changes))))
        return new

    def rewrite(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Apply a stage that changes most pixels: make(pixels) gives all of them, which become the base of later versions."""
        self.base, self.changes = self.stages.table(name, lambda: make(self.now()).select(*self.KEY, *self.COLORS)), []
