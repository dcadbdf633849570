"""Folder for written intermediate results, shared by all executors."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where none is set, as in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="campaignflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df, spark: SparkSession | None = None):
    """Reliable checkpoint of ``df`` in the shared folder, cutting its lineage."""
    spark = spark or df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df, name: str, spark: SparkSession | None = None):
    """``df`` written to the shared folder as Parquet and read again, by ``spark`` if given: computed once, whoever reads it and however often."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)
