"""Small files wherever Spark's paths lead: through Hadoop's file systems, written under another name and renamed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _locate(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    _, system, where = _locate(path)
    return system.exists(where)


def read_bytes(path: str) -> bytes:
    jvm, system, where = _locate(path)
    if not system.exists(where):
        raise FileNotFoundError(path)
    stream = system.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(path: str, data: bytes) -> None:
    """Readers see the old file or the new one, never a part; folders are made as needed."""
    jvm, system, where = _locate(path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{where.toString()}._{uuid.uuid4().hex}")
    stream = system.create(temporary, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not system.rename(temporary, where):  # some systems don't rename onto a file
        system.delete(where, False)
        if not system.rename(temporary, where):
            system.delete(temporary, False)
            raise OSError(f"can't write {path}")


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())
