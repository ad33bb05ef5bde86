"""Shards under size-tiered compaction, in DataFrame functions alone.

An arrival becomes a run: a few small Parquet files that never change. Runs of a tier are of like size (a tier is FAN times
the one below); FAN runs of a tier are read together and written as one run of files near the target size, without a shuffle:
readers pack small files into partitions of that size, and each partition becomes a file. Merging never drops rows.

The manifest names the files of the current version. A version is written beside and renamed to its number, once its files are
complete; readers of a version keep it until `vacuum`. A commit that finds its number taken loads the newer version and
is tried again on it. A writer that dies leaves files that no manifest names, and `vacuum` removes them.

The manifest keeps the schema of each run, and arrivals may differ in theirs. Rows are read with the columns of all runs, in order of first
arrival, null where a run lacks one. Where runs differ in a column's type, numbers take the widest of them and anything else becomes a string.
A merge writes the columns of all its runs, and is refused if a row or a column is missing from what it wrote.

The commit needs a rename that fails where its target is: HDFS and local file systems have it. On an object store, give the
root a file system that does (or commit from one writer).

Rows may hold nulls and any columns; repeated rows stay. An arrival without rows makes no run, and a null arrival number is one arrival.
An empty store reads as no rows.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

TARGET, FAN = 64 << 20, 4
#: Runs smaller than this are of the lowest tier.
SMALL = 1 << 20
_WIDER = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType()]


def common_type(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    if a in _WIDER and b in _WIDER:
        wide = max(a, b, key=_WIDER.index)
        return DoubleType() if wide == FloatType() and LongType() in (a, b) else wide
    return StringType()


def common_schema(schemas: list[StructType]) -> StructType:
    """The columns of all, in order of first appearance; names are compared as Spark does, whatever their case."""
    found: dict[str, StructField] = {}
    for schema in schemas:
        for f in schema:
            have = found.get(f.name.lower())
            found[f.name.lower()] = StructField(f.name, f.dataType) if have is None else StructField(have.name, common_type(have.dataType, f.dataType))
    return StructType(list(found.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan: int = FAN) -> None:
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target, fan
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, writer, runs: [{run, files, bytes, rows, tier, schema}]}; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "writer": "", "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/v{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, change) -> dict:
        """change(runs) -> runs of the next version. Retried on the newer version if another writer was first."""
        while True:
            now = self.manifest()
            writer = uuid.uuid4().hex
            after = {"version": now["version"] + 1, "writer": writer, "runs": change(now["runs"])}
            beside = self._path(f"{self.root}/_manifests/.{writer}")
            stream = self._fs.create(beside, False)
            stream.write(bytearray(json.dumps(after).encode()))
            stream.close()
            number = self._path(f"{self.root}/_manifests/v{after['version']:09d}.json")
            if not self._fs.exists(number) and self._fs.rename(beside, number) and self.manifest(after["version"])["writer"] == writer:
                return after
            self._fs.delete(beside, False)

    # runs

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALL, self.fan)) + 1) if size >= SMALL else 0

    def _run(self, name: str, folder: str, rows: int, schema: StructType) -> dict | None:
        files = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        size = sum(n for _, n in files)
        return {"run": name, "files": [f for f, _ in files], "bytes": size, "rows": rows, "tier": self.tier(size), "schema": schema.jsonValue()} if files and rows else None

    def append(self, rows: DataFrame) -> dict:
        """One arrival as one run."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}")
        run = self._run(name, f"{self.root}/{name}", self.spark.read.parquet(f"{self.root}/{name}").count(), rows.schema)
        return self.commit(lambda runs: [*runs, *([run] if run else [])])

    def append_each(self, rows: DataFrame, arrival: str) -> list[dict]:
        """A run and a commit for each value of `arrival` (a column of whole numbers), from one write of all."""
        name = uuid.uuid4().hex
        column = f"_arrival_{name}"
        rows.withColumn(column, F.coalesce(F.expr(arrival).cast("int"), F.lit(-1))).write.partitionBy(column).parquet(f"{self.root}/{name}")
        folders = sorted((s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.isDirectory() and "=" in s.getPath().getName()), key=lambda p: int(p.getName().partition("=")[2]))
        counts = {r[column]: r["count"] for r in self.spark.read.parquet(f"{self.root}/{name}").groupBy(column).count().collect()} if folders else {}
        done = []
        for folder in folders:
            number = int(folder.getName().partition("=")[2])
            run = self._run(f"{name}-{number}", folder.toString(), counts.get(number, 0), rows.schema)
            done.append(self.commit(lambda runs, run=run: [*runs, *([run] if run else [])]))
        return done

    def due(self) -> list[dict] | None:
        """FAN runs of the lowest tier that has so many."""
        tiers: dict[int, list[dict]] = {}
        for run in self.manifest()["runs"]:
            tiers.setdefault(run["tier"], []).append(run)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= self.fan:
                return sorted(tiers[tier], key=lambda r: r["bytes"])[: self.fan]
        return None

    def merge(self, merged: list[dict]) -> dict:
        name, size = uuid.uuid4().hex, sum(r["bytes"] for r in merged)
        key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
        before = {k: self.spark.conf.get(k) for k in (key, cost)}
        try:
            self.spark.conf.set(key, str(self.target))
            self.spark.conf.set(cost, "0")
            rows = self._rows(merged)
            rows.coalesce(max(1, math.ceil(size / self.target))).write.parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        written = self.spark.read.parquet(f"{self.root}/{name}")
        if [(f.name, f.dataType) for f in written.schema] != [(f.name, f.dataType) for f in rows.schema]:
            raise RuntimeError(f"a merge of {rows.schema.simpleString()} gave {written.schema.simpleString()}")
        count = written.count()
        if count != sum(r["rows"] for r in merged):
            raise RuntimeError(f"a merge of {sum(r['rows'] for r in merged)} rows gave {count}")
        run, gone = self._run(name, f"{self.root}/{name}", count, rows.schema), {r["run"] for r in merged}
        run["tier"] = max(run["tier"], max(r["tier"] for r in merged) + 1)

        def change(runs):
            if not gone <= {r["run"] for r in runs}:
                raise RuntimeError("another writer merged these runs")
            return [*[r for r in runs if r["run"] not in gone], run]

        return self.commit(change)

    def compact(self) -> dict:
        """Merges until no tier has FAN runs."""
        while (due := self.due()) is not None:
            self.merge(due)
        return self.manifest()

    def vacuum(self, keep: int = 1) -> None:
        """Removes versions before the last `keep`, and files that those kept don't name."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for r in self.manifest(v)["runs"] for f in r["files"]}
        folders = {f.rpartition("/")[0] for f in named}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/v{v:09d}.json"), False)
        for status in self._fs.listStatus(self._path(self.root)):
            path = status.getPath()
            if path.getName() == "_manifests":
                continue
            inner = [s.getPath() for s in self._fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
            for folder in [*inner, path]:
                if not any(f == folder.toString() or f.startswith(f"{folder.toString()}/") for f in folders):
                    self._fs.delete(folder, True)

    def _rows(self, runs: list[dict], shard: str | None = None) -> DataFrame:
        """One scan for each schema among the runs, their columns brought to the common ones."""
        schemas = [StructType.fromJson(r["schema"]) for r in runs]
        every = common_schema(schemas)
        scans: dict[str, tuple[StructType, list[str]]] = {}
        for r, schema in zip(runs, schemas, strict=True):
            scans.setdefault(schema.json(), (schema, []))[1].extend(r["files"])
        found = None
        for schema, files in scans.values():
            own = {f.name.lower(): f.name for f in schema}
            columns = [(F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in every]
            file = [F.col("_metadata.file_path").alias(shard)] if shard else []
            rows = self.spark.read.schema(schema).parquet(*files).select(*columns, *file)
            found = rows if found is None else found.union(rows)
        return found

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame | None:
        """The rows of a version, and under the name `shard` the file of each, if asked for; None where the version has no run."""
        runs = self.manifest(version)["runs"]
        return self._rows(runs, shard) if runs else None
