"""A versioned store of keyed rows under a folder that Spark's file systems reach.

``versions/<n>.json`` are the pointers: each names the commits that a version has.
A commit is a folder of rows and a folder of its keys, written before its pointer;
the pointer is renamed to its number, which fails if another writer has taken it, so
writers never lose each other's commits and readers see a version or the next one.
What a crash leaves behind has no pointer and is never read.

Reads of a key go to the index of keys, then to the commits that have it, and there
to its own folder if the store is partitioned by it.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ContractError

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=+-]*")


class Conflict(Exception):
    """Another writer has taken the version."""


class SnapshotStore:
    """``keys`` tell rows apart (or units of rows); ``partition_by`` lays rows out in
    folders of these columns; another ``schema_version`` than the store's is refused."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema_version: int = 1, partition_by: list[str] | None = None):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema_version, self.partition_by = schema_version, partition_by or []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _below(self, *parts: str) -> str:
        """A path below the root; a part that could leave it is refused."""
        for p in parts:
            if not _SAFE.fullmatch(p) or ".." in p:
                raise ContractError(f"not a name inside the store: {p!r}")
        return "/".join([self.root, *parts])

    def pointer(self, version: int | None = None) -> dict:
        """The newest version, or one of the past; version 0 is the empty store."""
        numbers = self.versions()
        number = version if version is not None else max(numbers, default=0)
        if number == 0:
            return {"version": 0, "schema_version": self.schema_version, "commits": [], "tags": []}
        if number not in numbers:
            raise ContractError(f"no version {number}")
        stream = self._fs.open(self._path(self._below("versions", f"{number:012d}.json")))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        if held.get("schema_version") != self.schema_version:
            raise ContractError(f"schema version {held.get('schema_version')}, not {self.schema_version}")
        return held

    def versions(self) -> list[int]:
        folder = self._path(self._below("versions"))
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def _swap(self, number: int, held: dict) -> None:
        """Publish a pointer under a number that is free, or raise Conflict."""
        jvm = self.spark.sparkContext._jvm
        temporary = self._path(self._below("versions", f"new-{uuid.uuid4().hex}"))
        target = self._path(self._below("versions", f"{number:012d}.json"))
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(target), options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(number) from None
            raise

    def index(self, version: int | None = None, *, at: dict | None = None) -> DataFrame | None:
        """(keys, _commit) of a version, without its rows; None if it is empty."""
        commits = (at or self.pointer(version))["commits"]
        if not commits:
            return None
        read = self.spark.read.parquet(*[self._below("index", c) for c in commits])
        return read.select(*self.keys, "_commit")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        commits = self.pointer(version)["commits"]
        if not commits:
            raise ContractError("the store is empty")
        return self._rows(commits)

    def _rows(self, commits: list[str]) -> DataFrame:
        out = self.spark.read.parquet(self._below("data", commits[0]))
        for c in commits[1:]:
            out = out.unionByName(self.spark.read.parquet(self._below("data", c)))
        return out

    def read_key(self, version: int | None = None, **key: object) -> DataFrame:
        """The rows of one key: only commits that have it are read."""
        if set(key) != set(self.keys):
            raise ContractError(f"the keys are {', '.join(self.keys)}")
        index = self.index(version)
        same = [F.col(k) == F.lit(v) for k, v in key.items()]
        having = []
        if index is not None:
            for s in same:
                index = index.filter(s)
            having = [r["_commit"] for r in index.select("_commit").distinct().collect()]
        if not having:
            raise ContractError(f"unknown key {key}")
        rows = self._rows(sorted(having))
        for s in same:
            rows = rows.filter(s)
        return rows

    def commit(self, rows: DataFrame, tag: str | None = None, known: str = "refuse", most_tries: int = 20) -> bool:
        """Add rows as one commit.  Keys that the store has are an error, or left out
        if ``known`` is "skip" (of repeated keys among the rows one row stays then).  A
        tag that the store has makes a rerun do nothing and return False."""
        for _ in range(most_tries):
            base = self.pointer()
            if tag is not None and tag in base["tags"]:
                return False
            index, new = self.index(at=base), rows
            if known == "skip":
                new = rows.dropDuplicates(self.keys)
                new = new if index is None else new.join(index.select(*self.keys), self.keys, "left_anti")
            elif index is not None:
                twice = rows.select(*self.keys).distinct().join(index.select(*self.keys), self.keys, "left_semi").limit(3).collect()
                if twice:
                    raise ContractError(f"already stored: {', '.join(str(tuple(r)) for r in twice)}")
            name = uuid.uuid4().hex
            new.write.partitionBy(*self.partition_by).parquet(self._below("data", name))
            written = self.spark.read.schema(new.schema).parquet(self._below("data", name))
            written.select(*self.keys).distinct().withColumn("_commit", F.lit(name)).write.parquet(self._below("index", name))
            held = {"version": base["version"] + 1, "schema_version": self.schema_version, "commits": [*base["commits"], name], "tags": [*base["tags"], *([tag] if tag else [])]}
            try:
                self._swap(held["version"], held)
                return True
            except Conflict:  # check again against what the other has stored
                for part in ("data", "index"):
                    self._fs.delete(self._path(self._below(part, name)), True)
        raise Conflict(f"no version was free in {most_tries} tries")


def unit_store(spark: SparkSession, root: str) -> SnapshotStore:
    """Parsed units: rows by unit_id, each unit in folders of its own."""
    return SnapshotStore(spark, root, ["unit_id"], partition_by=["unit_id"])
