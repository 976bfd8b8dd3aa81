"""Versioned tables in segments: a commit writes new segments beside the old ones, then one small file names them all.

A table is a list of segments. A commit appends to some tables and replaces others; what it replaces
of an appended table is named by keys in a `gone` list of its own, and readers leave those rows of
older segments out. So a small change writes little, and readers never see half a version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

EMPTY = {"version": 0, "tables": {}, "gone": {}, "numbers": {}}


def scratch(spark: SparkSession) -> str:
    """A new folder for a store that lives as long as its application: in the folder that the session shares. A local session that names none uses its warehouse; a cluster has to name one."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/corvine-store/{context.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and no lost executor takes it along."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotStore:
    """<root>/<table>/v=<n> in any file system that Spark reaches, and <root>/CURRENT, the manifest in JSON."""

    def __init__(self, spark: SparkSession, root: str, key: str = "path"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version; tables: the versions of each table's segments; gone: for each group of tables, the versions of its lists; numbers that go with the version."""
        path = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(path):
            return json.loads(json.dumps(EMPTY))
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The current version, 0 if nothing was committed."""
        return self.manifest()["version"]

    def segment(self, table: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/v={version}")

    def read(self, table: str, group: str | None = None, manifest: dict | None = None) -> DataFrame:
        """The table's rows; of a table that belongs to a group of `gone` lists, without what later versions replaced."""
        known = manifest or self.manifest()
        out = None
        for v in known["tables"][table]:
            part = self.segment(table, v)
            for later in known["gone"].get(group, []):
                if later > v:
                    part = part.join(self.segment(group, later), self.key, "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def stage(self, table: str, version: int, df: DataFrame, sort: str | None = None, find: tuple[str, ...] = ()) -> DataFrame:
        """Writes a segment that no manifest names yet, and reads it back. Sorted by `sort`, with Bloom filters for columns that are looked up."""
        if sort:
            df = df.repartition(sort).sortWithinPartitions(sort)
        writer = df.write.mode("overwrite")
        for c in find:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{table}/v={version}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}/v={version}")

    def publish(self, manifest: dict) -> int:
        """Moves CURRENT to a manifest whose segments are staged; a failed or repeated attempt before leaves the old version in place."""
        version = manifest["version"]
        draft, current = self._path(f"{self.root}/.CURRENT-{version}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, current, options)
        return version

    def drop_unused(self) -> None:
        """Deletes segments that the current manifest doesn't name, those of failed attempts among them."""
        known = self.manifest()
        named = {(t, v) for part in ("tables", "gone") for t, versions in known[part].items() for v in versions}
        root = self._path(self.root)
        for folder in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if folder.isDirectory():
                table = folder.getPath().getName()
                for status in self._fs.listStatus(folder.getPath()):
                    name = status.getPath().getName()
                    if name.startswith("v=") and (table, int(name[2:])) not in named:
                        self._fs.delete(status.getPath(), True)
