"""Small driver-side files of logs, folds and artifacts: atomic, exclusive, on local disks or a Hadoop file system.

Data are never read or written here; Spark's readers and writers do that.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        at = _local(path)
        if at is not None:
            return os.path.exists(at)
        fs, p = self._fs(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Entries of a folder, sorted; none if it doesn't exist."""
        at = _local(path)
        if at is not None:
            return sorted(os.listdir(at)) if os.path.isdir(at) else []
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        at = _local(path)
        if at is not None:
            with open(at, "rb") as f:
                return f.read()
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Write a file that must not exist yet, whole or not at all. False if it exists."""
        at = _local(path)
        if at is not None:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            aside = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}"
            self._write_synced(aside, data)
            try:
                os.link(aside, at)  # fails if another writer was first
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
        fs, p = self._fs(path)
        aside = self._spill(fs, p, data)
        done = not fs.exists(p) and fs.rename(aside, p)
        if not done:
            fs.delete(aside, False)
        return bool(done)

    def replace(self, path: str, data: bytes) -> None:
        """Put a file in place of whatever is there."""
        at = _local(path)
        if at is not None:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            aside = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}"
            self._write_synced(aside, data)
            os.replace(aside, at)
            return
        fs, p = self._fs(path)
        aside = self._spill(fs, p, data)
        fs.delete(p, False)
        if not fs.rename(aside, p):
            raise OSError(f"cannot replace {path}")

    @contextlib.contextmanager
    def writing(self, path: str):
        """A function that appends bytes to a file, which is put in place when the block ends well; no more than a piece is held."""
        at = _local(path)
        if at is not None:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            aside = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}"
            try:
                with open(aside, "wb") as f:
                    yield f.write
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(aside, at)
            finally:
                if os.path.exists(aside):
                    os.unlink(aside)
            return
        fs, p = self._fs(path)
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            yield lambda data: out.write(bytearray(data))
            out.close()
            fs.delete(p, False)
            if not fs.rename(aside, p):
                raise OSError(f"cannot replace {path}")
        finally:
            fs.delete(aside, False)

    def _spill(self, fs, p, data: bytes):
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(data))
        out.close()
        return aside

    @staticmethod
    def _write_synced(at: str, data: bytes) -> None:
        with open(at, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def remove(self, path: str) -> None:
        at = _local(path)
        if at is not None:
            if os.path.isdir(at):
                shutil.rmtree(at)
            elif os.path.exists(at):
                os.unlink(at)
            return
        fs, p = self._fs(path)
        fs.delete(p, True)

    def rename(self, path: str, to: str) -> None:
        at, target = _local(path), _local(to)
        if at is not None and target is not None:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if os.path.isdir(target) and not os.listdir(target):
                os.rmdir(target)
            os.rename(at, target)
            return
        fs, p = self._fs(path)
        q = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(q.getParent())
        if fs.exists(q) and not fs.listStatus(q):
            fs.delete(q, False)  # an empty folder; a rename would go below it
        if fs.exists(q) or not fs.rename(p, q):
            raise OSError(f"cannot rename {path} to {to}")

    def size(self, path: str) -> int:
        """Bytes below a path, without check sums and markers."""
        at = _local(path)
        if at is not None:
            if os.path.isfile(at):
                return os.path.getsize(at)
            return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(at) for n in names if n[0] not in "._")
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def walk(self, path: str) -> list[str]:
        """Files below a folder, relative to it, sorted; hidden ones too."""
        at = _local(path)
        if at is not None:
            return sorted(os.path.relpath(os.path.join(d, n), at) for d, _, names in os.walk(at) for n in names)
        fs, p = self._fs(path)
        out, found = [], fs.listFiles(p, True) if fs.exists(p) else None
        top = fs.makeQualified(p).toString().rstrip("/") + "/"
        while found is not None and found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(top))
        return sorted(out)

    def odd(self, path: str) -> str | None:
        """Something below a folder that is no plain file or folder (a link, say). Only local disks have such."""
        at = _local(path)
        for d, dirs, names in os.walk(at) if at is not None else ():
            for n in [*dirs, *names]:
                if os.path.islink(f"{d}/{n}") or not (os.path.isfile(f"{d}/{n}") or os.path.isdir(f"{d}/{n}")):
                    return n
        return None

    def free(self, path: str) -> bool:
        """Is nothing at a path, or only an empty folder?"""
        at = _local(path)
        if at is not None:
            return not os.path.lexists(at) or (not os.path.islink(at) and os.path.isdir(at) and not os.listdir(at))
        fs, p = self._fs(path)
        return not fs.exists(p) or (fs.getFileStatus(p).isDirectory() and not fs.listStatus(p))

    def modified(self, path: str) -> float:
        at = _local(path)
        if at is not None:
            return os.path.getmtime(at)
        fs, p = self._fs(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def copy(self, path: str, to: str) -> None:
        """Copy a folder, file by file, through this process; large payloads are moved or read by Spark instead."""
        at, target = _local(path), _local(to)
        if at is not None and target is not None:
            shutil.copytree(at, target)
            return
        (fs, p), (other, q) = self._fs(path), self._fs(to)
        if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, self.spark._jsc.hadoopConfiguration()):
            raise OSError(f"cannot copy {path} to {to}")

    def is_local(self, path: str) -> bool:
        return _local(path) is not None
