"""Tables written to the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a session on one machine may lack it; it then gets a folder of its own.
    """
    name = "spark.checkpoint.dir"
    found = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spanfold-")
    spark.conf.set(name, own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _system(df.sparkSession, folder).delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def _system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def file_state(spark: SparkSession, path: str) -> str:
    """A mark of a file, or of the files of a folder, which changes when one of them is written again. No job is run for it."""
    system, marks = _system(spark, path), []
    found = system.listFiles(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    while found.hasNext():
        status = found.next()
        marks.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(marks)).encode()).hexdigest()
