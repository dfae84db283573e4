"""A keyed table of buckets: upserts and deletions as small files, merged on read.

Rows lie in buckets by the hash of one column. A write adds files to the buckets that it touches, of rows and of
tombstones, and becomes visible in one step, when a new manifest names them; until then, and after a writer that
died, readers see the state before. A bucket with many added files is rewritten by itself, so that reading costs
the same after any number of writes. A manifest holds one entry per bucket and added file, never one per row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Added files of a bucket at which it is rewritten.
FULL = 8


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@dataclass
class Manifest:
    """``base`` and ``added`` folders of each bucket, of the version; ``writes`` names the writes that are in."""

    version: int = 0
    base: dict[str, str] = field(default_factory=dict)
    added: dict[str, list[str]] = field(default_factory=dict)
    writes: list[str] = field(default_factory=list)


class KeyedStore:
    """A table at ``path`` with one row per ``key``, in ``buckets`` by the hash of ``by`` (by default the first key column).

    ``by`` must follow from the key: rows of one key have one value of it. ``put`` replaces rows of equal keys, and
    with ``replace`` all rows of the values of ``by`` that it brings; ``drop`` removes all rows of values of ``by``.
    Of rows of one key in one write any one stays. A write that is named is taken once, so that a batch may run
    again. One writer at a time: of two that start from one version, the later one fails and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], by: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.by, self.buckets = spark, path.rstrip("/"), schema, key, by or key[0], buckets
        self.stored = f"{schema}, _version long, _gone boolean"

    # ---- manifests

    def manifest(self) -> Manifest:
        """The newest manifest that is complete."""
        fs, at = _files(self.spark, f"{self.path}/manifests")
        if not fs.exists(at):
            return Manifest()
        names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))
        if not names:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]))

    def _commit(self, found: Manifest) -> None:
        """Write the next manifest beside the others and give it its name, which must be new."""
        fs, at = _files(self.spark, f"{self.path}/manifests/{found.version:012d}.json")
        _, draft = _files(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(found.__dict__).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has made version {found.version}")
        # A few older versions stay for readers that have just listed them.
        for old in sorted((f.getPath() for f in fs.listStatus(at.getParent()) if f.getPath().getName().endswith(".json")), key=lambda p: p.getName())[:-4]:
            fs.delete(old, False)

    # ---- writing

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> dict[str, str]:
        """The folders of the buckets that ``rows`` touch, one file or more each."""
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64(*self.key), F.lit(4))).write.partitionBy("bucket").parquet(folder)
        fs, at = _files(self.spark, folder)
        found = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in found if n.startswith("bucket=")}

    def write(self, put: DataFrame | None = None, drop: DataFrame | None = None, replace: bool = False, name: str | None = None) -> DataFrame:
        """One write: rows to put and values of ``by`` (in a column of that name) to drop; (bucket, folder, kind) of what was written.

        Drops come before puts. ``name`` makes the write one that is taken once.
        """
        now = self.manifest()
        written: list[tuple[int, str, str]] = []
        if name is None or name not in now.writes:
            version = now.version + 1
            parts, columns = [], self.spark.createDataFrame([], self.schema).columns
            if put is not None:
                # Of rows of one key one stays when they are read, so they aren't shuffled for it here.
                parts.append(put.select(*columns).withColumns({"_version": F.lit(version).cast("long"), "_gone": F.lit(False)}))
            gone = [d.select(self.by) for d in (drop, put if replace else None) if d is not None]
            for values in gone:
                parts.append(values.distinct().select(*(F.col(c) if c == self.by else F.lit(None).alias(c) for c in columns), F.lit(version).cast("long").alias("_version"), F.lit(True).alias("_gone")))
            schema = self.spark.createDataFrame([], self.stored).schema
            rows = None
            for part in parts:
                part = part.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
                rows = part if rows is None else rows.unionByName(part)
            nxt = Manifest(version, dict(now.base), {b: list(a) for b, a in now.added.items()}, [*now.writes[-99:], *([name] if name else [])])
            if rows is not None:
                for bucket, folder in self._write(rows, f"v{version}").items():
                    nxt.added.setdefault(bucket, []).append(folder)
                    written.append((int(bucket), folder, "added"))
            written += self._compact(nxt)
            self._commit(nxt)
        return self.spark.createDataFrame(written, "bucket int, folder string, kind string")

    def _compact(self, nxt: Manifest) -> list[tuple[int, str, str]]:
        """Rewrite the buckets with many added files; the others stay as they are."""
        full = [b for b, a in nxt.added.items() if len(a) >= FULL]
        if not full:
            return []
        some = Manifest(nxt.version, {b: f for b, f in nxt.base.items() if b in full}, {b: nxt.added[b] for b in full})
        rows = self._merged(some).withColumns({"_version": F.lit(nxt.version).cast("long"), "_gone": F.lit(False)})
        folders = self._write(rows, f"base{nxt.version}")
        for bucket in full:
            nxt.added.pop(bucket)
            nxt.base.pop(bucket, None)
            if bucket in folders:
                nxt.base[bucket] = folders[bucket]
        return [(int(b), f, "base") for b, f in folders.items()]

    # ---- reading

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*folders) if folders else self.spark.createDataFrame([], self.stored)

    def _merged(self, found: Manifest) -> DataFrame:
        """The rows that are left of buckets with added files."""
        rows = self._load([*found.base.values(), *(f for a in found.added.values() for f in a)])
        gone = rows.where("_gone").groupBy(self.by).agg(F.max("_version").alias("_dropped"))
        # ``by`` follows from the key, so rows are shuffled by it once, for the join and for the keys.
        last = Window.partitionBy(self.by, *(c for c in self.key if c != self.by)).orderBy(F.desc("_version"))
        kept = rows.where("not _gone").join(gone, self.by, "left").where("_dropped is null or _version >= _dropped")
        kept = kept.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        return kept.select(*self.spark.createDataFrame([], self.schema).columns)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of some. Buckets without added files are read as they lie, without a shuffle."""
        found = self.manifest()
        wanted = None if buckets is None else {str(b) for b in buckets}
        chosen = lambda b: wanted is None or b in wanted
        busy = {b: a for b, a in found.added.items() if a and chosen(b)}
        still = self._load([f for b, f in found.base.items() if b not in busy and chosen(b)]).drop("_version", "_gone")
        if not busy:
            return still
        return still.unionByName(self._merged(Manifest(found.version, {b: f for b, f in found.base.items() if b in busy}, busy)))

    def touched(self, values: DataFrame) -> list[int]:
        """The buckets of the values of ``by``, a number of ints that the store bounds."""
        return [r[0] for r in values.select(self._bucket().alias("b")).distinct().collect()]

    def vacuum(self) -> int:
        """Delete the folders that the newest manifests don't name; call it when no reader is at an older one."""
        fs, at = _files(self.spark, f"{self.path}/data")
        _, manifests = _files(self.spark, f"{self.path}/manifests")
        used = set()
        for f in fs.listStatus(manifests):
            if f.getPath().getName().endswith(".json"):
                one = Manifest(**json.loads(self.spark.read.text(f.getPath().toString(), wholetext=True).first()[0]))
                used |= {x.rpartition("/")[0].rpartition("/")[2] for x in [*one.base.values(), *(y for a in one.added.values() for y in a)]}
        dead = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in used]
        for path in dead:
            fs.delete(path, True)
        return len(dead)
