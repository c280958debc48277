"""A table of rows by key in hash buckets, of which an upsert rewrites only those it touches.

The files of a bucket are never changed.  A manifest, one small JSON file a version, names the folder that holds each
bucket now; a new version is put in place by creating its file, which fails if it is there already, so two writers
can't both win and a reader sees one version whole.  What a crash leaves behind is named by no manifest; ``vacuum``
deletes it with the folders of older versions.

Of rows with one key the one of the highest ``seq`` stays, also against the row that is stored; of equal ones the
batch's, and within a batch the greatest row, so that a replayed or reordered batch gives the same table.  An
``epoch`` is remembered: a batch whose epoch isn't above the last one changes nothing.

Defined cases: rows with a null key are kept out (they can't be addressed); a null seq is below every other; an empty
batch makes no version but remembers its epoch; new columns are added, missing ones are null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, seq: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path.rstrip("/"), key, seq, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- manifests ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self) -> dict:
        """version, epoch, schema (JSON or None) and bucket -> folder of the last version."""
        seen = self.versions()
        if not seen:
            return {"version": 0, "epoch": None, "schema": None, "buckets": {}, "of": self.buckets}
        stream = self._fs.open(self._at(f"manifest/{seen[-1]:012d}.json"))
        try:
            got = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        if got["of"] != self.buckets:
            raise ValueError(f"the table has {got['of']} buckets, not {self.buckets}")
        return got

    def _commit(self, manifest: dict) -> None:
        """Write the manifest aside and rename it; a version that is there already is a lost race."""
        target = self._at(f"manifest/{manifest['version']:012d}.json")
        aside = self._at(f"manifest/{uuid.uuid4().hex}.part")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another")

    # -- rows --------------------------------------------------------------------------------

    def bucket(self, key: str | None = None):
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first rows."""
        m = self.manifest()
        if m["schema"] is None:
            return None
        schema = StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{p}" for b, p in sorted(m["buckets"].items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row of each key that counts: highest seq, then the batch's, then the greatest."""
        cols = [c for c in rows.columns if c != "_new"]
        seq = [F.col(self.seq)] if self.seq else []
        best = F.max_by(F.struct(*cols), F.struct(*seq, "_new", F.xxhash64(*cols), F.to_json(F.struct(*cols))))
        return rows.groupBy(self.key).agg(best.alias("_r")).select("_r.*")

    def upsert(self, batch: DataFrame, epoch: int | None = None, gone: DataFrame | None = None) -> list[int]:
        """Merge a batch (and delete the keys of ``gone``); returns the buckets that were rewritten."""
        from ..operators import graph

        m = self.manifest()
        if epoch is not None and m["epoch"] is not None and epoch <= m["epoch"]:
            return []
        batch = batch.where(F.col(self.key).isNotNull())
        # the batch is looked at twice, for its buckets and for its rows
        batch = graph.cut(self._last(batch.withColumn("_new", F.lit(1))))
        touched = batch.select(self.bucket().alias("b"))
        if gone is not None:
            touched = touched.union(gone.select(self.bucket().alias("b")))
        hit = sorted(r.b for r in touched.distinct().collect() if r.b is not None)  # no more than there are buckets
        if not hit:
            if epoch is not None:
                self._commit(m | {"version": m["version"] + 1, "epoch": epoch})
            return []
        old = self.read(hit)
        rows = batch.withColumn("_new", F.lit(1))
        if old is not None:
            rows = old.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        rows = self._last(rows)
        if gone is not None:
            rows = rows.join(gone.select(self.key).distinct(), self.key, "left_anti")
        folder = f"data/v={m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        schema = rows.schema
        rows = rows.withColumn("_b", self.bucket())
        rows.repartition(len(hit), "_b").write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        written = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().startswith("_b=")}
        buckets = {b: p for b, p in m["buckets"].items() if int(b) not in hit} | {str(b): f"{folder}/_b={b}" for b in written}
        self._commit({"version": m["version"] + 1, "epoch": m["epoch"] if epoch is None else epoch, "schema": schema.jsonValue(), "buckets": buckets, "of": self.buckets})
        return hit

    def vacuum(self) -> int:
        """Delete folders that the last version doesn't name, and older manifests; returns how many folders went."""
        m, n = self.manifest(), 0
        named = set(m["buckets"].values())
        if self._fs.exists(self._at("data")):
            for version in self._fs.listStatus(self._at("data")):
                top = f"data/{version.getPath().getName()}"
                parts = [f"{top}/{f.getPath().getName()}" for f in self._fs.listStatus(version.getPath()) if f.isDirectory()]
                dead = [p for p in parts if p not in named]
                n += len(dead)
                for p in [top] if len(dead) == len(parts) else dead:
                    self._fs.delete(self._at(p), True)
        for v in self.versions()[:-1]:
            self._fs.delete(self._at(f"manifest/{v:012d}.json"), False)
        return n
