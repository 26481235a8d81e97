"""A session with the settings the engine relies on; a cluster's own session works as well."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "mnemospark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint
    folder. Where neither is set a session on one machine gets a local one; a cluster gets an error,
    as executors don't see each other's disks."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="mnemospark-")
        context.setCheckpointDir(root)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def kept_folder(source: DataFrame, name: str, last: str, write: Callable[[str], object]) -> str:
    """A folder of tables in the shared folder that are written once for the files of source: found again by
    their paths, sizes and times, by this session or a later one. last: the table that write() writes
    last; a folder without it was not finished, and is written anew."""
    spark = source.sparkSession
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files = []
    for file in sorted(source.inputFiles()):
        status = path(file).getFileSystem(conf).getFileStatus(path(file))
        files.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    folder = f"{shared_folder(spark)}/{name}-{hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:32]}"
    store = path(folder).getFileSystem(conf)
    if not store.exists(path(f"{folder}/{last}/_SUCCESS")):
        store.delete(path(folder), True)
        write(folder)
    return folder
