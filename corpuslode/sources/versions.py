"""Tables with versions: immutable files, named by numbered manifests, published in one step.

A manifest is a small JSON file versions/N.json. A writer puts its files beside those that are there, claims the number
after the version it started from, and renames a finished manifest to it; so a reader sees a version whole or not at all, and
what a killed writer leaves is named by no manifest. Two writers that started from one version claim the same number: the
second one fails. A table's rows lie in buckets by a hash of its keys, a folder each; a write makes new folders of the buckets
it touches and names the others' old ones again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has claimed the version."""


class Manifests:
    """The numbered manifests below a path. stale: seconds after which a claim without a version is void."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 3600.0) -> None:
        self.spark, self.path, self.stale = spark, path.rstrip("/"), stale
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._Path("/".join((self.path, *names)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def latest(self) -> int:
        """The number of the current version; 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {}
        at = self._at("versions", f"{version}.json")
        size = self.fs.getFileStatus(at).getLen()
        source = self.fs.open(at)
        try:
            return json.loads(bytes(source.readNBytes(size)).decode())
        finally:
            source.close()

    def publish(self, base: int, value: dict) -> int:
        """Makes value the version after base."""
        number, claim = base + 1, self._at("claims", str(base + 1))
        if self.latest() != base:
            raise Conflict(f"{self.path} is at version {self.latest()}, not {base}")
        self.fs.mkdirs(self._at("claims")), self.fs.mkdirs(self._at("versions"))
        if self.fs.exists(claim) and time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000 > self.stale:
            self.fs.delete(claim, False)
        try:
            free = self.fs.createNewFile(claim)
        except Exception as e:  # noqa: BLE001  some file systems raise where others say no
            raise Conflict(f"version {number} of {self.path} is claimed") from e
        if not free:
            raise Conflict(f"version {number} of {self.path} is claimed")
        part = self._at("claims", f"{number}-{uuid.uuid4().hex}.json")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.fs.rename(part, self._at("versions", f"{number}.json")):
            raise Conflict(f"version {number} of {self.path} is there already")
        return number

    def folder(self) -> str:
        """The name of a new folder below data, for files that a manifest is going to name."""
        return f"data/{uuid.uuid4().hex}"

    def clean(self, named: Callable[[dict], set[str]], keep: int = 1) -> list[str]:
        """Deletes all versions but the last `keep`, and the folders below data that none of those names; not beside a writer."""
        for old in self.versions()[:-keep]:
            self.fs.delete(self._at("versions", f"{old}.json"), False)
        used = set().union(*(named(self.read(v)) for v in self.versions()))
        gone = [n for n in self._names("data") if f"data/{n}" not in used]
        for n in gone:
            self.fs.delete(self._at("data", n), True)
        return gone


class VersionedTable:
    """Rows in `buckets` buckets by their keys. Keys may be null; rows may share keys.

    version: the one that reads and writes start from, whatever came after it; a write is the latest version then.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, version: int | None = None) -> None:
        self.spark, self.path, self.keys, self.version = spark, path.rstrip("/"), keys, version
        self.manifests = Manifests(spark, path)
        self.buckets = self.manifests.read().get("buckets", buckets)

    def _base(self) -> int:
        return self.manifests.latest() if self.version is None else self.version

    def exists(self) -> bool:
        return self.manifests.latest() > 0

    def files(self, version: int | None = None) -> dict[int, str]:
        """The folder of every bucket that has rows."""
        return {int(k): v for k, v in self.manifests.read(version).get("files", {}).items()}

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifests.read(version)["schema"])

    def _paths(self, folders: list[str]) -> list[str]:
        return [f"{self.path}/{x}" for x in folders]

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one unless another is named. The data frame stays with that version."""
        version = self._base() if version is None else version
        if not version:
            raise RuntimeError(f"no table at {self.path}")
        return self._rows(sorted(self.files(version).values()), self.schema(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _put(self, base: int, rows: DataFrame, replaced: list[int] | None) -> int:
        """Publishes rows in place of those of the replaced buckets, or of all."""
        folder, before = self.manifests.folder(), self.manifests.latest()
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = rows.withColumn("_bucket", self._bucket())
        # where there are more tasks than buckets, a bucket is dealt to several
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, tasks // self.buckets)))
        own.repartition(tasks, "_bucket", spread).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at = self.manifests._at(folder)
        made = {int(x.getPath().getName().split("=")[1]): f"{folder}/{x.getPath().getName()}" for x in self.manifests.fs.listStatus(at) if "=" in x.getPath().getName()}
        kept = {} if replaced is None else {k: v for k, v in self.files(base).items() if k not in replaced}
        self.version = None
        return self.manifests.publish(before, {"schema": json.loads(rows.schema.json()), "keys": self.keys, "buckets": self.buckets, "files": kept | made})

    def replace(self, rows: DataFrame) -> int:
        """rows as all that the table has."""
        return self._put(0, rows, None)

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        """old without the rows of those keys; null keys are equal."""
        other = keys.select(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).distinct()
        same = None
        for k in self.keys:
            one = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
            same = one if same is None else same & one
        return old.join(other, same, "left_anti")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets

    def upsert(self, rows: DataFrame, replaced: DataFrame | None = None) -> int:
        """rows in place of those with their keys, and of the keys of replaced. Columns that one side lacks are null there."""
        base = self._base()
        if not base:
            return self.replace(rows)
        keys = rows.select(*self.keys)
        keys = keys if replaced is None else keys.unionByName(replaced.select(*self.keys))
        files, touched = self.files(base), self._touched(keys)
        old = self._rows([files[b] for b in touched if b in files], self.schema(base))
        return self._put(base, self._without(old, keys).unionByName(rows, allowMissingColumns=True), touched)

    def update(self, changes: DataFrame) -> int:
        """The non-null values of changes (keys and some columns, a row a key) in the rows with their keys."""
        from corpuslode.sources.tables import updated

        base = self._base()
        files, touched = self.files(base), self._touched(changes)
        old = self._rows([files[b] for b in touched if b in files], self.schema(base))
        return self._put(base, updated(old, changes, self.keys), touched)

    def delete(self, keys: DataFrame) -> int:
        """The table without the rows of those keys (the key columns)."""
        base = self._base()
        files, touched = self.files(base), self._touched(keys)
        old = self._rows([files[b] for b in touched if b in files], self.schema(base))
        return self._put(base, self._without(old, keys), touched)

    def delete_by_hash(self, hashes: DataFrame, key: str) -> int:
        """The table without the rows whose key ends in one of the hashes (hash); only their buckets are written."""
        from corpuslode.sources.tables import delete_by_hash

        own = self.read().select(*self.keys, *([key] if key not in self.keys else []))
        gone = own.select(*self.keys).exceptAll(delete_by_hash(own, hashes, key).select(*self.keys))
        return self.delete(gone)

    def clean(self, keep: int = 1) -> list[str]:
        """Deletes older versions and what no version names; the names of the folders that went."""
        return self.manifests.clean(lambda m: {x.rsplit("/", 1)[0] for x in m.get("files", {}).values()}, keep)
