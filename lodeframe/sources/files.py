"""Small files and folders by Spark's own file systems, so that any store Spark writes to can hold a warehouse."""

from __future__ import annotations

import re
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import EngineError


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False when it exists already. Of writers at the same time exactly one creates it.

        Locally a hard link is made, which never replaces a file; HDFS renames without replacing; other stores create exclusively
        themselves. Except for the last, readers never see a part of the text.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        jvm, scheme = self._jvm, fs.getUri().getScheme()
        whole = scheme in ("file", "hdfs", "viewfs")
        tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID()}") if whole else p
        try:
            stream = fs.create(tmp, False)
        except Py4JJavaError as e:
            if whole or not fs.exists(p):
                raise
            del e
            return False
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not whole:
            return True
        try:
            if scheme == "file":
                at = [jvm.java.nio.file.Path.of(jvm.java.net.URI.create(x.toUri().toString())) for x in (fs.makeQualified(p), fs.makeQualified(tmp))]
                jvm.java.nio.file.Files.createLink(at[0], at[1])
                return True
            return fs.rename(tmp, p)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName() != "java.nio.file.FileAlreadyExistsException":
                raise
            return False
        finally:
            if fs.exists(tmp):
                fs.delete(tmp, False)

    def changed(self, path: str) -> int:
        """When a file or folder was last changed, in milliseconds."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the driver's machine is all there is."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^,]*\]|\[[^,]*,[^,]*\])?$", spark.sparkContext.master):
        raise EngineError("spark.checkpoint.dir names no folder, and executors on other machines don't share a local one")
    return tempfile.mkdtemp(prefix="lodeframe-")
