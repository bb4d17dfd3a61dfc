"""Numbered commits of a folder: a small file names what belongs to a commit, and only one writer can create the file of a number."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """``<root>/_commits/<n>.json`` for n from 1. Data is written into folders of its own first; it counts once a commit names it.

    The file is written under a name of its own and then given the number's name by an operation that fails if that is taken: a hard link on local
    disks, else a rename that doesn't overwrite, which file systems of clusters do in one step. Unlike the rename of a folder, neither can put one
    writer's data into another's.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._at = self._path(f"{self.root}/_commits")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def last(self) -> int:
        """The greatest number; files of any other name are ignored."""
        if not self._fs.exists(self._at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{n}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self) -> str:
        """A name for new data."""
        return f"data/{uuid.uuid4().hex}"

    def claim(self, n: int, content: dict) -> None:
        """Make commit n, or raise if another writer has made it."""
        self._fs.mkdirs(self._at)
        own, target = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{n}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                where = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(where(target), where(own))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, options)
        except Exception as e:
            if self._fs.exists(target):
                raise RuntimeError(f"commit {n} was taken by another writer") from e
            raise
        finally:
            self._fs.delete(own, False)
