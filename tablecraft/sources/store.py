"""Versioned tables: every commit writes new files and publishes one manifest.

A manifest lists the folder of each table. It is created under the next number
and never overwritten, so of two writers who read the same version one fails;
several tables change together or not at all, and readers see one version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConcurrencyError, UnknownNameError


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifests"))

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/_manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.root}/_manifests/{version:012d}.json"

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, table: str, version: int | None = None) -> DataFrame:
        path = self.manifest(version).get(table.lower())
        if path is None:
            raise UnknownNameError(f"no table {table}")
        return self.spark.read.parquet(path)

    def commit(self, changes: dict[str, DataFrame], base: int | None = None) -> int:
        """Publishes new contents of tables on top of version ``base``; fails if another commit came first."""
        base = self.version() if base is None else base
        manifest = self.manifest(base)
        for table, df in changes.items():
            path = f"{self.root}/{table.lower()}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            manifest[table.lower()] = path
        # Written aside and renamed, so a reader never meets half of it.
        aside = self._path(f"{self.root}/_manifests/.{base + 1}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        files = gateway.jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        none = gateway.new_array(getattr(files, "Options$Rename"), 0)
        try:
            context.rename(aside, self._path(self._name(base + 1)), none)
        except Exception as e:
            self._fs.delete(aside, False)
            raise ConcurrencyError(f"version {base + 1} is there already") from e
        return base + 1


__all__ = ["VersionedStore"]
