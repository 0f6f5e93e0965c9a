"""Tables written to the folder that a cluster shares, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when the application ends.

    Only a local session may lack the setting, as in tests: it gets a temporary folder. On a cluster that would put
    tables on the disks of single machines, so it is an error there.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{(root or tempfile.mkdtemp(prefix='mediaspark-')).rstrip('/')}/mediaspark-{app}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _roots[app] = path
    return _roots[app]


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: later steps survive lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
