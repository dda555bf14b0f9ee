"""Tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where none is set, a local session, as in tests, gets one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomnet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df under the shared folder and read it back: cuts the lineage of loops and survives lost executors. ``compression``: other than the session's."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame, name: str) -> None:
    """Delete a table that materialize() wrote under this name and that nothing reads any more, as the last round's of a loop."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not re.fullmatch(re.escape(name) + "-[0-9a-f]{32}", folder.rpartition("/")[2]):
            raise ValueError(f"{folder} is no table of the name {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder.rpartition('/')[2]}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
