"""Versions of a folder: one small JSON file each, published by a rename that fails if the version is there already.

Data files never change once written; a version names those that belong to it.  A
reader keeps the version it began with, a writer that crashes leaves files that no
version names.  The file system's rename must be atomic, as HDFS's is."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer changed what this one would."""


class Files:
    """The few calls to the cluster's file system that Spark's readers and writers do not make."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def of(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when they changed (ms); none if it is not there."""
        fs, at = self.of(folder), self.path(folder)
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def size(self, folder: str) -> int:
        fs, at = self.of(folder), self.path(folder)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def text(self, path: str) -> str:
        stream = self.of(path).open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.of(path).create(self.path(path), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes the file whole unless there is one; False if there was."""
        fs = self.of(path)
        if fs.exists(self.path(path)):
            return False
        folder, name = path.rsplit("/", 1)
        temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.write(temporary, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = SparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(self.path(temporary), self.path(path), options)
        except Exception as e:  # only its message tells what it was
            self.remove(temporary)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.of(path).delete(self.path(path), True)


class Versions:
    """The versions of a folder, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark), f"{folder}/versions"

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n, _ in self.files.listed(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> int:
        """0 if there is none."""
        return max(self.numbers(), default=0)

    def _file(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def read(self, version: int) -> dict[str, Any]:
        return json.loads(self.files.text(self._file(version)))

    def publish(self, version: int, manifest: dict[str, Any]) -> bool:
        return self.files.publish(self._file(version), json.dumps(manifest))

    def forget(self, version: int) -> None:
        self.files.remove(self._file(version))
