"""Small files and folders in whatever store a path names, and written tables that cut a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach; one of our own only within one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quotemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quotes-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that several uses do not work it out again."""
    path = f"{scratch_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, folder: str, name) -> None:
    """Renames the data files of a folder to ``name(number)`` beside it; a call a file."""
    p, fs = _path(spark, folder)
    files = sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    for k, f in enumerate(files):
        src, _ = _path(spark, f)
        dst, _ = _path(spark, name(k))
        if not fs.rename(src, dst):
            raise OSError(f"{f} could not be renamed to {name(k)}")
