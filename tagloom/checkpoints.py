"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_DIR = "file:///tmp/tagloom-shared"  # where driver and executors are one machine and the session names none, as in tests


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own setting, which only a local session may lack."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        named = LOCAL_DIR
    return named.rstrip("/")


class Stored:
    """Tables written to the shared folder.

    ``drop`` deletes one that is no longer read; the rest go when the driver's JVM ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        self.until_exit()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tagloom_path = path  # for drop()
        return out

    def until_exit(self) -> None:
        """Has the folder, which something was written to, deleted when the driver's JVM ends."""
        fs, path = self._at(self.root)
        fs.deleteOnExit(path)

    def drop(self, df: DataFrame) -> None:
        fs, path = self._at(df._tagloom_path)
        fs.delete(path, True)

    def _at(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
