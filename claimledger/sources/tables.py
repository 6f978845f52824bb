"""State tables that change together: bucketed Parquet, one manifest for each epoch.

A table is dealt into buckets by a hash of its key.  A change reads the buckets that its keys fall into and writes those
buckets anew (or adds files to them, for a log); all others stay the files that they are.  A manifest names the files of
every bucket of every table.  It is written last and moved into place in one step, so all tables of an epoch are
there or none is, whatever was lost on the way.  An epoch that has its manifest is not written again.

There is one writer at a time; readers hold a manifest and see the tables of that epoch until ``vacuum`` removes its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A table: DDL of its columns, the column that deals it into buckets, and whether rows are only added."""

    schema: str
    key: str
    append: bool = False


class Tables:
    """The tables ``kinds`` under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, Kind], buckets: int = 256, most_files: int = 16):
        self.spark, self.root, self.kinds, self.n_buckets, self.most_files = spark, root.rstrip("/"), kinds, buckets, most_files

    # ---- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    # ---- manifests

    def epochs(self) -> list[int]:
        """Epochs that are complete."""
        return [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, before: int | None = None) -> dict:
        """The manifest of the last epoch, or of the last one before ``before``."""
        done = [e for e in self.epochs() if before is None or e < before]
        if not done:
            return {"epoch": -1, "tables": {name: {} for name in self.kinds}, "summary": {}}
        stream = self._fs().open(self._path(f"commits/{max(done):012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fs = self._fs()
        draft, final = self._path(f"commits/_{uuid.uuid4().hex}"), self._path(f"commits/{manifest['epoch']:012d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"epoch {manifest['epoch']} was written by someone else")

    # ---- reads

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.n_buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """Buckets that the keys fall into, ``buckets`` numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(column))).distinct().collect())

    def read(self, name: str, buckets: Sequence[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table's rows, of some buckets or of all; only the files of these are opened."""
        files = (manifest or self.manifest())["tables"].get(name, {})
        paths = [f"{self.root}/{p}" for b, ps in files.items() if buckets is None or int(b) in set(buckets) for p in ps]
        schema = self.kinds[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- changes

    def commit(self, epoch: int, changes: dict[str, tuple[DataFrame, Sequence[int] | None]], summary: dict | None = None) -> dict:
        """Writes the new rows of the buckets named (None: all) and then the epoch's manifest.

        Rows of an append table are added to their buckets.  A bucket of more than ``most_files`` parts is written as one.
        """
        if epoch in self.epochs():
            return self.manifest(epoch + 1)
        old = self.manifest(epoch)
        tables = {name: dict(old["tables"].get(name, {})) for name in self.kinds}
        for name, (rows, buckets) in changes.items():
            kind, files = self.kinds[name], tables[name]
            if kind.append:
                full = [int(b) for b, ps in files.items() if len(ps) >= self.most_files and (buckets is None or int(b) in set(buckets))]
                if full:
                    rows = rows.unionByName(self.read(name, full, old))
            else:
                full = [int(b) for b in files] if buckets is None else list(buckets)
            for b in full:
                files.pop(str(b), None)
            for b, path in self._write(name, epoch, rows).items():
                files.setdefault(b, []).append(path)
        manifest = {"epoch": epoch, "tables": tables, "summary": summary or {}}
        self._publish(manifest)
        return manifest

    def _write(self, name: str, epoch: int, rows: DataFrame) -> dict[str, str]:
        """Bucket -> folder of the rows written.  A bucket of very many rows is split over tasks."""
        kind, folder = self.kinds[name], f"{name}/{epoch:012d}-{uuid.uuid4().hex[:8]}"
        columns = self.spark.createDataFrame([], kind.schema).schema
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns], self.bucket(F.col(kind.key)).alias("_bucket"))
        typed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def vacuum(self, keep: int = 2) -> int:
        """Removes what no manifest of the last ``keep`` epochs names, left by lost attempts or replaced since; gives the number of folders."""
        done, fs, n = self.epochs(), self._fs(), 0
        kept = [self.manifest(e + 1) for e in done[-keep:]]
        named = {p for m in kept for files in m["tables"].values() for ps in files.values() for p in ps}
        for name in self.kinds:
            for folder in self._names(name):
                parts = [f"{name}/{folder}/{p}" for p in self._names(f"{name}/{folder}") if p.startswith("_bucket=")]
                gone = [p for p in parts if p not in named]
                for p in [f"{name}/{folder}"] if len(gone) == len(parts) else gone:
                    fs.delete(self._path(p), True)
                    n += 1
        for e in done[:-keep]:
            fs.delete(self._path(f"commits/{e:012d}.json"), False)
        return n
