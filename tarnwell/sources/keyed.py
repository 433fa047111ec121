"""A table of rows by key whose versions are committed whole, with statistics that let readers skip its files.

Rows lie in files by a hash of their key. A version is a manifest: one small file that lists the data files with the least
and largest key and a Bloom filter of each. Writers put new data files beside the old ones and then create the next
manifest, which only one writer can; readers take the newest manifest and never see part of a version. A merge reads and
rewrites the buckets that its rows fall into and lists the other files as they are.

Everything goes through Spark's readers and Hadoop's file systems, so a table may lie in any store that Spark reaches.
The driver holds a manifest: a few numbers and FILTER bits for each bucket.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of a file's filter and how many of them a key sets.
FILTER, PROBES = 1 << 15, 5
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class File:
    bucket: int
    path: str
    rows: int
    least: str
    largest: str
    bits: bytes


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: str
    files: tuple[File, ...]
    #: files of this version that the one before did not have
    written: int = 0


def _hash(key: Column, seed: int = 0) -> Column:
    return F.xxhash64(key.cast("string"), F.lit(seed))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(_hash(key), F.lit(buckets)).cast("int")


def _probes(key: Column) -> Column:
    return F.array(*(F.pmod(_hash(key, k), F.lit(FILTER)).cast("int") for k in range(1, PROBES + 1)))


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        found = self.versions()
        if not found:
            return None
        version = found[-1] if version is None else version
        if version not in found:
            raise ValueError(f"version {version} is not kept; those kept are {found}")
        stream = self._fs().open(self._path("versions", f"{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        files = tuple(File(**(f | {"bits": base64.b64decode(f["bits"])})) for f in m.pop("files"))
        return Manifest(files=files, **m)

    def _commit(self, m: Manifest, again: bool = False) -> None:
        """Gives the manifest its name, which must be free unless a version is made `again`: the step that makes a version."""
        whole = {k: getattr(m, k) for k in ("version", "key", "buckets", "schema", "written")}
        whole["files"] = [vars(f) | {"bits": base64.b64encode(f.bits).decode()} for f in m.files]
        ready = self._path("versions", f".{uuid.uuid4().hex}")
        stream = self._fs().create(ready, False)
        try:
            stream.write(bytearray(json.dumps(whole).encode()))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE if again else hadoop.Options.Rename.NONE  # the latter fails if the name is taken
        ready, name = (self._fs().makeQualified(p) for p in (ready, self._path("versions", f"{m.version:012d}.json")))
        try:
            hadoop.FileContext.getFileContext(ready.toUri(), self.spark._jsc.hadoopConfiguration()).rename(ready, name, how)
        except Exception as e:
            self._fs().delete(ready, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {m.version} of {self.path} exists") from e
            raise

    def _write(self, rows: DataFrame, key: str, buckets: int) -> tuple[File, ...]:
        """Writes rows by bucket and gives the new files with their statistics, which Spark reads back from the files."""
        commit = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, _bucket(F.col(key), buckets)).repartition(F.col(_BUCKET))
        dealt.write.partitionBy(_BUCKET).parquet(str(self._path(commit)))
        if not any(n.startswith(_BUCKET) for n in self._names(commit)):
            return ()
        stored = self.spark.read.parquet(str(self._path(commit)))
        k = F.col(key)
        probed = stored.select(_BUCKET, F.explode(_probes(k)).alias("p"))
        cells = probed.groupBy(_BUCKET, F.expr("p div 64").cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)))).alias("w"))
        lists = cells.groupBy(_BUCKET).agg(F.sort_array(F.collect_list(F.struct("cell", "w"))).alias("cells"))  # FILTER / 64 of a bucket
        told = stored.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("rows"), F.min(k.cast("string")).alias("least"), F.max(k.cast("string")).alias("largest")).join(lists, _BUCKET).collect()
        out = []
        for r in told:
            words = np.zeros(FILTER // 64, np.int64)
            for cell, w in r["cells"]:
                words[cell] = w
            out.append(File(r[_BUCKET], f"{commit}/{_BUCKET}={r[_BUCKET]}", r["rows"], r["least"], r["largest"], words.tobytes()))
        return tuple(sorted(out, key=lambda f: f.bucket))

    def _read(self, files: Iterable[File], schema: str) -> DataFrame:
        paths, parsed = [str(self._path(f.path)) for f in files], StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(parsed).parquet(*paths) if paths else self.spark.createDataFrame([], parsed)

    # readers

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; all from that version whatever is committed meanwhile."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._read(m.files, m.schema)

    def _likely(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """rows with _bucket and _maybe: whether the statistics allow for the key. Nulls never are in a table."""
        stats = [(f.bucket, f.least, f.largest, np.frombuffer(f.bits, np.int64).tolist()) for f in m.files]
        known = self.spark.createDataFrame(stats, f"{_BUCKET} int, least string, largest string, bits array<bigint>")
        k = F.col(m.key)
        text = k.cast("string")
        set_ = F.forall(_probes(k), lambda p: F.call_function("shiftrightunsigned", F.get("bits", F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64))).bitwiseAND(F.lit(1)) == 1)
        maybe = F.coalesce((text >= F.col("least")) & (text <= F.col("largest")) & set_, F.lit(False))
        joined = rows.withColumn(_BUCKET, _bucket(k, m.buckets)).join(F.broadcast(known), _BUCKET, "left")  # a manifest: a row for each bucket
        return joined.withColumn("_maybe", maybe).drop("least", "largest", "bits")

    def lookup(self, keys: DataFrame) -> tuple[DataFrame, int]:
        """The table's rows of these keys, and how many of its files are read for them."""
        m = self.manifest()
        told = self._likely(keys.select(m.key).distinct(), m)
        wanted = {r[0] for r in told.where("_maybe").select(_BUCKET).distinct().collect()}  # buckets at most
        files = [f for f in m.files if f.bucket in wanted]
        return self._read(files, m.schema).join(told.where("_maybe").select(m.key), m.key, "left_semi"), len(files)

    def unknown(self, found: DataFrame) -> tuple[DataFrame, int]:
        """The found rows whose key the table lacks (an anti-join), and how many files are read to tell.

        What the statistics rule out is new without reading; only the files that may hold one of the others are read.
        """
        m = self.manifest()
        if m is None:
            return found, 0
        told = self._likely(found, m)
        wanted = {r[0] for r in told.where("_maybe").select(_BUCKET).distinct().collect()}
        files = [f for f in m.files if f.bucket in wanted]
        if not files:
            return found, 0
        surely = told.where(~F.col("_maybe")).select(*found.columns)
        asked = told.where("_maybe").select(*found.columns).join(self._read(files, m.schema).select(m.key), m.key, "left_anti")
        return surely.unionByName(asked), len(files)

    # writers

    def create(self, rows: DataFrame, key: str, buckets: int = 64, again: bool = False) -> Manifest:
        """The first version. Keys must not be null, nor repeated."""
        m = Manifest(1, key, buckets, rows.schema.json(), self._write(rows, key, buckets))
        m = replace(m, written=len(m.files))
        self._commit(m, again)
        return m

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None, tries: int = 5) -> Manifest:
        """The next version: in the buckets of the batch's keys, combine(rows there, batch) takes the place of the rows.

        combine must keep the table's columns and give only keys that it was given. If another writer commits first, the
        merge is made again on its version. A writer that numbers its batches gives the `version`: it is made from the one
        before, and a batch that runs again after a failure replaces its own version and nothing else.
        """
        for _ in range(tries):
            found = self.versions()
            m = self.manifest(None if version is None else max((v for v in found if v < version), default=None))
            touched = {r[0] for r in batch.select(_bucket(F.col(m.key), m.buckets)).distinct().collect()}  # buckets at most
            old = [f for f in m.files if f.bucket in touched]
            new = self._write(combine(self._read(old, m.schema), batch), m.key, m.buckets) if touched else ()
            kept = tuple(f for f in m.files if f.bucket not in touched)
            number = m.version + 1 if version is None else version
            following = replace(m, version=number, files=tuple(sorted(kept + new, key=lambda f: f.bucket)), written=len(new))
            try:
                self._commit(following, version is not None)
                return following
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} versions were committed before this one")

    def dealt_anew(self, buckets: int) -> Manifest:
        """A version of the same rows in another number of buckets, for a table that has grown."""
        m = self.manifest()
        new = self._write(self.read(m.version), m.key, buckets)
        following = replace(m, version=m.version + 1, buckets=buckets, files=new, written=len(new))
        self._commit(following)
        return following

    def cleaned(self, keep: int = 2) -> int:
        """Removes versions but the last `keep`, and data files that none of those list; gives the number of folders removed.

        Not for use while a writer runs: its files are listed nowhere yet.
        """
        found = self.versions()
        for v in found[:-keep]:
            self._fs().delete(self._path("versions", f"{v:012d}.json"), False)
        used = {f.path for v in found[-keep:] for f in self.manifest(v).files}
        gone = 0
        for commit in self._names("data"):
            inside = [n for n in self._names(f"data/{commit}") if n.startswith(_BUCKET)]
            unused = [n for n in inside if f"data/{commit}/{n}" not in used]
            if len(unused) == len(inside):
                self._fs().delete(self._path("data", commit), True)
                gone += len(unused)
            else:
                for n in unused:
                    self._fs().delete(self._path("data", commit, n), True)
                    gone += 1
        return gone
