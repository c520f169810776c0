"""Numbered manifests in a folder: versions of a table, of which the greatest number counts.

A manifest is written under a name of its own and then renamed to its number, which fails if that number is taken. So of two
writers that start from one version the second is told, and a reader sees a version whole or not at all. Renaming is
atomic in HDFS and the like; a store where it is not needs one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """Another writer has published that number."""


class Manifests:
    """Those in a folder, a URI of any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _of(self, number: int) -> Any:
        return self._path(f"{self.folder}/manifest-{number:012d}.json")

    def read(self, number: int) -> dict[str, Any] | None:
        if not self._fs.exists(self._of(number)):
            return None
        stream = self._fs.open(self._of(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The greatest number and what it holds; 0 and nothing before the first."""
        found = self._fs.globStatus(self._path(f"{self.folder}/manifest-*.json")) or []
        number = max((int(f.getPath().getName()[9:-5]) for f in found), default=0)
        return number, (self.read(number) if number else None) or {}

    def publish(self, number: int, content: dict[str, Any]) -> None:
        """Makes ``content`` version ``number``, or raises Taken."""
        new = self._path(f"{self.folder}/new-{uuid.uuid4().hex}")
        stream = self._fs.create(new)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.folder)).toUri(), self._conf)
        try:
            context.rename(new, self._of(number), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if self._fs.exists(self._of(number)) and self._fs.exists(new):
                self._fs.delete(new, False)
                raise Taken(f"{self.folder}: version {number}") from e
            raise

    def remove(self, name: str) -> None:
        """A part of an old version."""
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)
