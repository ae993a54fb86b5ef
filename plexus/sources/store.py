"""Versioned Parquet store with a JSON manifest.

A version is the set of table folders that its manifest names, one or several a
table. Writing a version writes the rows that it appends, or a changed table as a
whole, to new folders and then publishes the next numbered
manifest, which must not exist yet: the version check and the publication are one
rename, so two writers can't both win. Everything goes through Hadoop file
systems, so a store can be on any that Spark knows.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES, GraphData, Source

PROPERTY_TABLES = ("nodes", "edges")
#: A table with more folders than this is written anew as one.
COMPACT_AFTER = 12


class StaleGraph(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils
        self.root = self.fs.makeQualified(self.Path(self.path)).toString()

    def _manifests(self) -> list[int]:
        folder = self.Path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        return max(self._manifests(), default=0)

    def _read(self, version: int) -> dict[str, Any]:
        stream = self.fs.open(self.Path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def load(self, version: int | None = None) -> GraphData:
        version = self.version() if version is None else version
        empty = GraphData(self.spark)
        if not version:
            return empty.with_(nodes=(Source(empty.table("nodes")),), edges=(Source(empty.table("edges")),))
        m = self._read(version)
        tables = {k: self.spark.read.schema(TABLES[k]).parquet(*[f"{self.root}/{f}" for f in folders]) for k, folders in m["tables"].items()}
        get = lambda k: tables[k] if k in tables else empty.table(k)
        rest = {k: v for k, v in tables.items() if k not in PROPERTY_TABLES}
        return GraphData(self.spark, (Source(get("nodes")),), (Source(get("edges")),), rest, m["fulltext"], m["vector"], m["counters"], version)

    def operations(self) -> list[tuple[int, str]]:
        """(version, operation) of every mutation so far."""
        return [(v, self._read(v)["operation"]) for v in self._manifests()]

    def save(self, data: GraphData, changed: set[str], operation: str, appended: dict[str, DataFrame] | None = None) -> GraphData:
        """Publish ``data`` as the version after its own, or raise if another writer was first.

        ``changed`` names the tables that are written as a whole; of a table in
        ``appended`` only the rows given there are, beside its folders so far.
        """
        current = self.version()
        if current != data.version:
            raise StaleGraph("graph changed in its store; call refresh() before writing")
        before = self._read(current)["tables"] if current else {}
        frames = {"nodes": data.node_table, "edges": data.edge_table} | {k: (lambda k=k: data.table(k)) for k in data.tables}
        folders = {k: list(v) for k, v in before.items() if k in frames}
        for k in frames:
            delta = (appended or {}).get(k)
            whole = k not in folders or k in changed or len(folders[k]) >= COMPACT_AFTER
            if whole or delta is not None:
                folder = f"tables/{k}-{current + 1:012d}-{uuid.uuid4().hex[:8]}"
                columns = [c.split()[0] for c in TABLES[k].replace("struct<t:string,b:boolean,i:bigint,f:double,s:string>", "pv").split(", ")]
                (frames[k]() if whole else delta).select(*columns).write.parquet(f"{self.root}/{folder}")
                folders[k] = [folder] if whole else [*folders[k], folder]
        manifest = {"operation": operation, "tables": folders, "fulltext": data.fulltext, "vector": data.vector, "counters": data.counters}
        draft = self.Path(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self.Path(f"{self.path}/manifests/{current + 1:012d}.json")
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise StaleGraph("graph changed in its store; call refresh() before writing")
        return self.load(current + 1)

    def backup(self, target: str, version: int | None = None) -> None:
        """Copy a version into another store folder."""
        data = self.load(version)
        other = Store(self.spark, target)
        if other.version():
            raise ValueError("backup target is not empty")
        other.save(data.with_(version=0), set(TABLES), "backup")

    def restore(self, source: str, version: int | None = None, overwrite: bool = False) -> GraphData:
        """Make a backup's state this store's next version; what it held before stays among its versions."""
        backup = Store(self.spark, source)
        if not backup.version():
            raise KeyError(f"backup {source!r} not found")
        current = self.version()
        if current and not overwrite:
            raise ValueError("graph already exists; restore with overwrite to replace its state")
        return self.save(backup.load(version).with_(version=current), set(TABLES), "restore")
