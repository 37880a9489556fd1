"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    """Small files and folders through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> bytes:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        p, fs = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        # one step that replaces what is there: a reader sees the old file or the new one, also after a crash
        overwrite = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        how = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = overwrite
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)

    def create(self, path: str, data: bytes) -> bool:
        """Write a file unless there is one of that name; False then. Of several writers one succeeds, and readers see
        all of it or nothing: a link on a local disk, a rename that doesn't replace elsewhere (one step on HDFS)."""
        p, fs = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        whole, part = fs.makeQualified(p), fs.makeQualified(tmp)
        try:
            if fs.getScheme() == "file":
                try:
                    os.link(part.toUri().getPath(), whole.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            if fs.exists(p):
                return False
            how = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.conf).rename(part, whole, how)
            except Exception:
                if fs.exists(p):
                    return False
                raise
            return True
        finally:
            fs.delete(tmp, False)

    def join(self, parts: list[str], path: str, head: bytes = b"", tail: bytes = b"", cut: int = 0) -> None:
        """One file of head, the parts' bytes in order, and tail, streamed within the JVM; without the last cut bytes
        of all parts together (a separator)."""
        p, fs = self._at(path)
        raw = fs.getRaw() if fs.getScheme() == "file" else fs  # no checksum file beside a local one
        sizes = []
        for part in parts:
            q, of = self._at(part)
            sizes.append(of.getFileStatus(q).getLen())
        left = sum(sizes) - cut
        out = raw.create(p, True)
        try:
            out.write(bytearray(head))
            for part, size in zip(parts, sizes, strict=True):
                n = min(size, left)
                if n > 0:
                    q, of = self._at(part)
                    stream = of.open(q)
                    try:
                        self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, n)
                    finally:
                        stream.close()
                    left -= n
            out.write(bytearray(tail))
        finally:
            out.close()

    def names(self, path: str) -> list[str]:
        """Names of the files in a folder."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        p, fs = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def folders(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
