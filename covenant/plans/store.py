"""Stored views in versions, which any session can read.

A version is a folder of data and a manifest, a small file of its number. A commit
writes the data first and then creates the next manifest only if nobody else has:
whoever comes second fails and leaves the view as it was. A reader takes the last
manifest, or one it names, and keeps its data whatever is committed meanwhile.
Manifests hold the hash of the view's definition, so a changed definition is noticed
and the view built anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from covenant.plans import incremental


class CommitConflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    schema: str
    definition: str


class Manifests:
    """Numbered JSON objects under ``path``, each created once. The file system must
    refuse to create a file that exists, as HDFS and local ones do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def file(self, path: str):
        """A path and its file system, as Spark itself opens it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        where, fs = self.file(f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def held(self, schema: str) -> list[dict]:
        """What the manifests hold, in their order. One that its writer has not
        finished is empty and does not count."""
        if not self.numbers():
            return []
        rows = self.spark.read.schema(f"number int, {schema}").json(f"{self.path}/manifests").where("number IS NOT NULL").collect()
        return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r["number"])

    def put(self, number: int, told: dict) -> None:
        where, fs = self.file(f"{self.path}/manifests/v{number:010d}.json")
        try:
            out = fs.create(where, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise CommitConflict(f"version {number} of {self.path} is there already") from error
        out.write((json.dumps({"number": number} | told) + "\n").encode())
        out.close()


class VersionedStore(Manifests):
    """Tables under ``path``, which all sessions share."""

    def versions(self) -> list[Version]:
        """Committed ones, oldest first."""
        return [Version(**r) for r in self.held("data string, schema string, definition string")]

    def last(self) -> Version | None:
        return next(iter(self.versions()[::-1]), None)

    def read(self, number: int | None = None) -> DataFrame:
        found = next((v for v in self.versions()[::-1] if number in (None, v.number)), None)
        if found is None:
            raise ValueError(f"{self.path} has no version {number or ''}".rstrip())
        return self.spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(found.data)

    def commit(self, df: DataFrame, definition: str, after: int | None = None) -> Version:
        """Make ``df`` the version after ``after`` (the last one that is there now)."""
        after = max(self.numbers(), default=0) if after is None else after
        made = Version(after + 1, f"{self.path}/data-{uuid.uuid4().hex}", df.schema.json(), definition)
        df.write.parquet(made.data)
        self.put(made.number, {"data": made.data, "schema": made.schema, "definition": made.definition})
        return made

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions, and data that no manifest
        names; no writer may be at work."""
        versions = self.versions()
        stays = {v.data.rpartition("/")[2] for v in versions[-keep:]}
        where, fs = self.file(self.path)
        for v in versions[:-keep]:
            at, _ = self.file(f"{self.path}/manifests/v{v.number:010d}.json")
            fs.delete(at, False)
        gone = [s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in stays]
        for name in gone:
            fs.delete(self.file(f"{self.path}/{name}")[0], True)
        return gone


class StoredView:
    """A view (`incremental.View`) in a versioned store."""

    def __init__(self, spark: SparkSession, path: str, view: incremental.View):
        self.store, self.view = VersionedStore(spark, path), view
        self.definition = incremental.definition_hash(view)

    def read(self, number: int | None = None) -> DataFrame:
        return incremental.shown(self.view, self.store.read(number))

    def refresh(self, tables: Mapping[str, DataFrame], deltas: Mapping[str, DataFrame] | None = None) -> Version:
        """Commit the view of ``tables`` as they are now: by ``deltas``, what they
        changed since the last version, or anew without them, at first, and after
        the definition changed."""
        last = self.store.last()
        if last is None or deltas is None or last.definition != self.definition:
            return self.store.commit(incremental.state(self.view, tables), self.definition)
        held = incremental.follow(self.view, self.store.read(last.number), tables, deltas)
        return self.store.commit(held, self.definition, after=last.number)
