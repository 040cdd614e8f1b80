"""Folders that the driver and every executor can see, and small Hadoop FileSystem helpers.

Nothing here touches the local disk of one machine: all paths go through Hadoop, so the same
code works on ``file:``, ``hdfs:`` and object stores.
"""

from __future__ import annotations

import json
import os
import re
import site
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()  # scratch folders that are to go at the end
_SHIPPED: set[str] = set()  # applications whose workers have the package

def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one, in local mode alone: on a
    cluster other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the application's own folder, which goes when the driver ends."""
    folder = f"{shared_root(spark).rstrip('/')}/gridloom/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        fs, p = _fs(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWN.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that have no other way to it (once a session)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    reached = [os.path.abspath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()) if p]
    if root in reached or context.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")  # the driver hands it out itself
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "gridloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def materialize(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` to a fresh Parquet table in the shared folder and read it back.

    Cuts lineage without a local checkpoint: the written files survive lost executors.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def age(spark: SparkSession, path: str) -> float:
    """Seconds since the newest file directly below ``path``, or the folder itself, was changed."""
    fs, p = _fs(spark, path)
    times = [s.getModificationTime() for s in fs.listStatus(p)] + [fs.getFileStatus(p).getModificationTime()]
    return time.time() - max(times) / 1000


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files directly below ``path``."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(
        (s.getPath().toString(), s.getLen())
        for s in fs.listStatus(p)
        if s.isFile() and s.getPath().getName().endswith(suffix)
    )


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, overwrite)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` whole or not at all; False if somebody else has created it first.

    The content goes to a temporary name and is renamed without overwriting, which HDFS does
    atomically. Stores without an atomic rename need a put-if-absent in its place.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, temporary, text)
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (temporary, path))
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, options)
        return True
    except Exception as error:
        delete(spark, temporary)
        if "FileAlreadyExists" in str(error):
            return False
        raise


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))
