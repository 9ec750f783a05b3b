"""A keyed dataset in Parquet that is upserted by copying only what changes.

Rows are dealt by a hash of their key into buckets. A version is a manifest: which folder has each bucket. An upsert reads the
buckets that its keys fall to, writes those anew beside the old ones, and adds the next manifest, which names the old folders of all other
buckets. A manifest gets its name by a rename that fails if the name is taken: of two writers that began from one version, one gets an error and
nothing of it shows. Readers keep the version that they began with; ``vacuum`` deletes what no kept version names.

A manifest also has the last batch of each stream that was upserted, so a batch that is replayed changes nothing.

Cases: keys may be null (null is a key like others); rows of one key in one upsert must be ordered by ``order`` or be equal in all but it, else an
error is raised before anything shows; an empty upsert adds a version without new folders; an empty store reads as no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS = 64
#: Columns that the store keeps about each row.
KEPT = (StructField("first_seen", StringType()), StructField("last_synced", StringType()), StructField("sync_count", IntegerType()))


class Conflict(RuntimeError):
    """Another writer added the version first."""


@dataclass
class Manifest:
    version: int
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """Rows of ``schema`` under ``root``, one a key. ``order``: a column by which the latest row of a key is told; rows that come late then don't count."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.values = [f.name for f in schema if f.name not in keys]
        self.schema = StructType([*(schema[k] for k in keys), *(schema[v] for v in self.values), *KEPT])
        self.new_buckets = buckets

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        path = self._path("manifests")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        files, path = self._files()
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or of the newest; version 0 has no rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, self.new_buckets)
        lines = self.spark.read.text(f"{self.root}/manifests/{version:010d}.json", wholetext=True).first()
        return Manifest(**json.loads(lines.value))

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest under a name of its own, then rename it; the rename fails if the version is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, folder = self._files()
        files.mkdirs(folder)
        hidden, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest.version:010d}.json")
        out = files.create(hidden, False)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(folder).toUri(), conf)
        try:
            context.rename(hidden, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            files.delete(hidden, False)
            raise Conflict(f"version {manifest.version} is there already") from error

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _folders(self, manifest: Manifest, names: list[str]) -> DataFrame:
        paths = [f"{self.root}/{manifest.folders[b]}" for b in names if b in manifest.folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; it stays readable while others are added."""
        manifest = self.manifest(version)
        return self._folders(manifest, list(manifest.folders))

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the given keys; reads only their buckets."""
        manifest = self.manifest(version)
        keys = wanted.select(*self.keys).distinct()
        return self._folders(manifest, self._touched(keys, manifest.buckets)).join(keys, self.keys, "left_semi")

    def _touched(self, rows: DataFrame, buckets: int) -> list[str]:
        """At most as many names as there are buckets."""
        return [str(r.b) for r in rows.select(self._bucket(buckets).alias("b")).distinct().collect()]

    def upsert(self, rows: DataFrame, now: str, stream: str | None = None, batch: int | None = None) -> Manifest:
        """Add the next version: new values where a key has some, times of first sight and last change, and a count of changes.

        Stored and new rows of the touched buckets are dealt out by bucket once, and grouped by key there. A batch of a stream that isn't
        after the stream's last one changes nothing.
        """
        before = self.manifest()
        if stream is not None and batch is not None and before.streams.get(stream, -1) >= batch:
            return before
        touched = self._touched(rows, before.buckets)
        after = Manifest(before.version + 1, before.buckets, dict(before.folders), before.streams | ({stream: batch} if stream is not None and batch is not None else {}))
        if touched:
            folder = f"data/{after.version:010d}-{uuid.uuid4().hex}"
            merged = self._merged(self._folders(before, touched), rows, now, before.buckets, len(touched))
            merged.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            after.folders |= {b: f"{folder}/_bucket={b}" for b in touched}
        self._publish(after)
        return after

    def _merged(self, stored: DataFrame, rows: DataFrame, now: str, buckets: int, tasks: int) -> DataFrame:
        value, kept = F.struct(*self.values), [f.name for f in KEPT]
        bucket = self._bucket(buckets).alias("_bucket")
        old = stored.select(bucket, *self.keys, value.alias("value"), F.struct(*kept).alias("kept"), F.lit(0).alias("side"))
        new = rows.select(bucket, *self.keys, value.alias("value"), F.lit(None).cast(StructType(list(KEPT))).alias("kept"), F.lit(1).alias("side"))
        when = F.struct(F.col(f"value.{self.order}"), "side") if self.order else F.struct("side")
        of_new = F.when(F.col("side") == 1, F.to_json("value"))
        # without an order, rows of one key must be equal; with one, those that are latest
        rival = F.max(of_new) != F.min(of_new) if not self.order else F.lit(False)
        grouped = old.unionByName(new).repartition(tasks, "_bucket").groupBy("_bucket", *self.keys).agg(
            F.max_by("value", when).alias("value"), F.max_by("side", when).alias("side"), F.any_value(F.when(F.col("side") == 0, F.col("value")), True).alias("old"), F.any_value("kept", True).alias("kept"), rival.alias("rival"),
        )
        fine = grouped.where(F.when(F.coalesce("rival", F.lit(False)), F.raise_error(F.lit("different rows of one key")).cast("boolean")).otherwise(True))
        changed = F.col("kept").isNull() | ((F.col("side") == 1) & ~F.col("value").eqNullSafe(F.col("old")))
        return fine.select(
            "_bucket", *self.keys, *[F.col(f"value.{v}").alias(v) for v in self.values],
            F.coalesce("kept.first_seen", F.lit(now)).alias("first_seen"), F.when(changed, F.lit(now)).otherwise(F.col("kept.last_synced")).alias("last_synced"),
            (F.coalesce("kept.sync_count", F.lit(0)) + changed.cast("int")).alias("sync_count"),
        ).sortWithinPartitions("_bucket", *self.keys)

    def delete(self, gone: DataFrame) -> Manifest:
        """Add a version without the given keys; only their buckets are written anew."""
        before = self.manifest()
        keys = gone.select(*self.keys).distinct()
        touched = [b for b in self._touched(keys, before.buckets) if b in before.folders]
        after = Manifest(before.version + 1, before.buckets, {b: f for b, f in before.folders.items() if b not in touched}, before.streams)
        if touched:
            folder = f"data/{after.version:010d}-{uuid.uuid4().hex}"
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            stay = self._folders(before, touched).join(keys.select(*[F.col(k).alias(f"_{k}") for k in self.keys]), same, "left_anti")
            stay = stay.withColumn("_bucket", self._bucket(before.buckets)).repartition(len(touched), "_bucket").sortWithinPartitions("_bucket", *self.keys)
            stay.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            files, _ = self._files()
            after.folders |= {b: name for b in touched if files.exists(self._path(name := f"{folder}/_bucket={b}"))}
        self._publish(after)
        return after

    def backfill(self, column: str, value: Column, where: Column, now: str, page: int = 16, first: int = 0) -> Iterator[tuple[int, int]]:
        """Set ``column`` to ``value`` in the rows that meet ``where`` and whose value would change, ``page`` buckets at a time; yields (next bucket, rows changed) after each.

        Each page looks at the newest version, so a row that another writer has changed meanwhile is judged anew, and an interrupted run goes on from the
        bucket it was given last. Buckets without such a row aren't written.
        """
        buckets = self.manifest().buckets
        for start in range(first, buckets, page):
            before = self.manifest()
            rows = self._folders(before, [str(b) for b in range(start, min(start + page, buckets))]).where(where).withColumn("_new", value.cast(self.schema[column].dataType))
            rows = rows.where(~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).select(*self.keys, *self.values).persist()
            changed = rows.count()
            if changed:
                self.upsert(rows, now)
            rows.unpersist()
            yield min(start + page, buckets), changed

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the manifests of all but the newest ``keep`` versions, and the folders that no kept one names; returns the folders' names."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {f for m in kept for f in m.folders.values()}
        files, _ = self._files()
        for v in versions[:-keep]:
            files.delete(self._path(f"manifests/{v:010d}.json"), False)
        gone = []
        for version in files.listStatus(self._path("data")) if files.exists(self._path("data")) else []:
            for bucket in files.listStatus(version.getPath()):
                name = f"data/{version.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in named:
                    files.delete(bucket.getPath(), True)
                    gone.append(name)
        return sorted(gone)
