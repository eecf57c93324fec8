"""The few file operations that the driver needs, and versions of a table kept as one small file each.

A version lists the data folders that belong to a table.  Data folders are
written once and never changed; a writer adds its folders first and then puts
the next version's list in place with one rename that fails if that version is
already there.  So a reader sees a whole version or the one before it, a writer
that dies leaves folders that no list names, and of two writers one starts over
on the other's result.

The rename must be atomic (HDFS, local, ABFS).  On a store without that, let one
job write.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_VERSION = re.compile(r"\d{12}\.json")
#: How often a writer starts over because another one was faster.
ATTEMPTS = 20


class Files:
    """The few file operations that the driver needs, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """What the folder holds, nothing if it is not there."""
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, folder: str) -> int:
        """Bytes that the folder holds, 0 if it is not there."""
        at = self._path(folder)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write the file whole; False if there is one already."""
        folder, _, last = name.rpartition("/")
        aside = self._path(f"{folder}/.{last}-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, self._path(name), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            self._fs.delete(aside, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def versions(files: Files) -> list[int]:
    return [int(n[:12]) for n in files.names("_versions") if _VERSION.fullmatch(n)]


def load(files: Files, version: int) -> dict[str, Any]:
    return json.loads(files.text(f"_versions/{version:012d}.json"))


def latest(files: Files) -> dict[str, Any]:
    """The newest version; empty if nothing has been published."""
    known = versions(files)
    return load(files, max(known)) if known else {}


def commit(files: Files, version: int, made: dict[str, Any]) -> bool:
    """Put a version in place; False if another writer was faster."""
    return files.put_new(f"_versions/{version:012d}.json", json.dumps(made, sort_keys=True))


def folder_of(version: int) -> str:
    """A new name for the data that a writer adds for this version."""
    return f"v{version:012d}-{uuid.uuid4().hex[:8]}"


def vacuum(files: Files, keep: int, tables: tuple[str, ...], used: Callable[[dict[str, Any]], set[str]]) -> int:
    """Drop all but the newest ``keep`` versions and the folders ``table/v=..`` that none of these uses.

    Folders of a version still to come belong to a running writer and stay.
    Returns the number of folders removed.  Readers of older versions fail.
    """
    known = versions(files)
    kept, old = known[-keep:], known[:-keep]
    if not kept:
        return 0
    live = set().union(*[used(load(files, v)) for v in kept])
    gone = 0
    for table in tables:
        for name in files.names(table):
            folder = name.removeprefix("v=")
            if folder != name and folder not in live and int(folder[1:13]) <= kept[-1]:
                files.remove(f"{table}/{name}".lstrip("/"))
                gone += 1
    for v in old:
        files.remove(f"_versions/{v:012d}.json")
    return gone
