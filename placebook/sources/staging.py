"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written whole and is still there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back, so that what follows sees fixed rows and a short lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file that is whole as soon as it is there; False, and nothing changes, if there is one already.

    It is written under another name and renamed without overwriting, in one step where the file system does so (HDFS,
    local disks).
    """
    jvm, fs = spark._jvm, file_system(spark, path)
    final = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(text.encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    without = spark.sparkContext._gateway.new_array(kind, 1)
    without[0] = kind.NONE
    try:
        files.rename(draft, final, without)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise
    return True


def named(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the files ``<prefix><number>`` in a folder, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def content(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).first()[0]
