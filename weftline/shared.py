"""Small helpers that several jobs share: durable intermediate tables and their release."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir. Where it is unset and all executors are in this process (tests,
    benches), a temporary one; on a cluster that is an error, since each executor would write to its own disk."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftline.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-weftline-")
        spark.conf.set("spark.weftline.scratch", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the written table.

    The lineage is cut there, the rows survive lost executors, and later uses read columns instead of
    recomputing. The files stay for as long as the shared folder is kept."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        break
