"""Processing only new or changed records.

``diff_manifests`` compares two immutable manifests (what a version holds, by key and fingerprint).  ``VersionedTable``
keeps such manifests for tables of records: immutable Parquet files, one JSON manifest for each version with the files and
the deletion vectors that hold.  The difference of two manifests (files added, files removed, deletion vectors grown) gives
the records added and removed between them without reading what both have.  ``process`` applies a function to that
difference and saves the version it has processed in the commit of its output, so after a failure at any point the next run
neither skips nor repeats a record.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(column):
    """A checksum in one spelling: lower case, without blanks and the prefix of its algorithm; empty is null."""
    plain = F.regexp_replace(F.lower(F.trim(column)), r"^sha-?256:", "")
    return F.when(plain != "", plain)


def diff_manifests(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, change (added, changed, removed) between two manifests.

    A key that a manifest lists several times counts with its greatest fingerprint; a null fingerprint equals nothing, not
    even another null; null keys are left out.  Either manifest may be empty.
    """
    side = lambda df, old: df.where(F.col(key).isNotNull()).select(key, F.lit(old).alias("_old"), F.col(fingerprint).alias("_print"))
    # One aggregation in place of a full join: partial on the map side, so a key that is listed often does no harm.
    both = side(old, True).unionByName(side(new, False)).groupBy(key).agg(F.bool_or("_old").alias("was"), F.bool_or(~F.col("_old")).alias("is"), F.max(F.when(F.col("_old"), F.col("_print"))).alias("before"), F.max(F.when(~F.col("_old"), F.col("_print"))).alias("after"))
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").when(F.col("before").isNull() | F.col("after").isNull() | (F.col("before") != F.col("after")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def listing_manifest(listing: DataFrame) -> DataFrame:
    """name, checksum of the files in the last scan; of several entries of a file the one with the greatest listed_at holds.

    listing: scan_id, name, checksum, listed_at.
    """
    last = listing.agg(F.max("scan_id").alias("scan_id"))  # a single row
    newest = F.max_by("checksum", F.struct("listed_at", "checksum"))
    return listing.join(F.broadcast(last), "scan_id").groupBy("name").agg(checksum(newest).alias("checksum"))


def completed_manifest(ledger: DataFrame) -> DataFrame:
    """name, checksum of each file's most recent completed entry by ts; of equal times the one recorded last holds.

    ledger: log_id, name, checksum, status, ts, recorded_at.
    """
    done = ledger.where(F.lower(F.trim("status")) == "completed")
    return done.groupBy("name").agg(checksum(F.max_by("checksum", F.struct("ts", "recorded_at", "log_id", "checksum"))).alias("checksum"))


def due_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """name, change (added or changed) of the files to process now."""
    return diff_manifests(completed_manifest(ledger), listing_manifest(listing), "name", "checksum").where("change <> 'removed'")


#: Every so many versions the manifest is written whole.
SNAPSHOT = 20
#: Files of deletion vectors that are kept apart.
MOST_VECTORS = 16


class VersionedTable:
    """Records in immutable files with a manifest for each version.

    path/data/*.parquet, path/deleted/*.parquet (deletion vectors: file, row) and path/versions/<number>.json, which holds
    the files and vectors that came and went.  A version exists as soon as its manifest does; creating it fails if another
    writer was first, so commits are atomic and numbers have no gaps.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        return max([int(n.removesuffix(".json")) for n in self._files("versions") if n.endswith(".json") and not n.startswith((".", "_"))], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """files, deleted (vectors) and processed of a version: the last snapshot at or before it and the differences since."""
        version = self.version() if version is None else version
        steps = []
        while version:
            step = self._step(version)
            steps.append(step)
            if step["snapshot"]:
                break
            version -= 1
        files: dict[str, None] = {}
        deleted: dict[str, None] = {}
        processed: dict[str, int] = {}
        for step in reversed(steps):
            for held, name in ((files, "files"), (deleted, "deleted")):
                for f in step["gone"][name]:
                    del held[f]
                held.update(dict.fromkeys(step[name]))
            processed |= step["processed"]
        return {"files": list(files), "deleted": list(deleted), "processed": processed}

    def _step(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict, old: dict | None = None) -> int:
        """Writes what differs from the version before, every SNAPSHOT versions all of it.

        Where a rename is one step (HDFS, local disks) the manifest is written aside and renamed, which fails on a name that
        exists; on object stores it is created under its name, which they do in one step and refuse for a name that exists.
        """
        old = self.manifest(version - 1) if old is None else old
        whole = version % SNAPSHOT == 1
        step = {"snapshot": whole, "processed": manifest["processed"], "gone": {"files": [], "deleted": []}}
        for name in ("files", "deleted"):
            if whole:
                step[name] = manifest[name]
            else:
                before, now = set(old[name]), set(manifest[name])
                step[name], step["gone"][name] = [f for f in manifest[name] if f not in before], [f for f in old[name] if f not in now]
        content = bytearray(json.dumps(step).encode())
        final = self._path(f"{self.path}/versions/{version:012d}.json")
        taken = RuntimeError(f"version {version} of {self.path} was committed by another writer")
        if self._fs.exists(final):
            raise taken
        if self._fs.getScheme() in ("file", "hdfs", "viewfs"):
            hidden = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
            self._put(hidden, content)
            if not self._fs.rename(hidden, final):
                self._fs.delete(hidden, False)
                raise taken
        else:
            try:
                self._put(final, content)
            except Exception as e:
                raise taken from e
        return version

    def _put(self, path, content: bytearray) -> None:
        out = self._fs.create(path, False)
        out.write(content)
        out.close()

    def _write(self, rows: DataFrame, folder: str) -> list[str]:
        name = f"{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return [f"{name}/{f}" for f in self._files(name) if f.endswith(".parquet")]

    def commit(self, added: DataFrame | None = None, delete: Callable[[DataFrame], DataFrame] | None = None, processed: dict[str, int] | None = None) -> int:
        """A new version: the rows that ``delete`` keeps of the table are deleted, those of ``added`` added.

        processed: versions of other tables that this one has taken in, remembered beside those known.  Deletion vectors
        that have become more than MOST_VECTORS files are written again as one.
        """
        before = self.version()
        old = self.manifest(before)
        deleted = list(old["deleted"])
        if delete is not None and old["files"]:
            deleted += self._write(delete(self._read(old, True)).select("_file", "_row"), "deleted")
        if len(deleted) > MOST_VECTORS:
            deleted = self._write(self._vectors(deleted).dropDuplicates(["_file", "_row"]).coalesce(1 + len(deleted) // MOST_VECTORS), "deleted")
        new = self._write(added, "data") if added is not None else []
        return self._commit(before + 1, {"files": old["files"] + new, "deleted": deleted, "processed": old["processed"] | (processed or {})}, old)

    def replace(self, rows: DataFrame) -> int:
        """A new version of nothing but these rows: compaction, or a full rewrite."""
        before = self.version()
        old = self.manifest(before)
        return self._commit(before + 1, {"files": self._write(rows, "data"), "deleted": [], "processed": old["processed"]}, old)

    def merge(self, rows: DataFrame, key: str, fingerprint: str) -> int:
        """A new version with the content of ``rows``, in which what is the same as before stays in its files.

        Keys that rows doesn't have any more, or with another fingerprint, go into deletion vectors; new keys and fingerprints into new files (a
        null fingerprint equals nothing).  A key with several rows counts with its greatest fingerprint.
        """
        before = self.manifest()
        if not before["files"]:
            return self.commit(added=rows)
        change = diff_manifests(self._read(before), rows, key, fingerprint)
        return self.commit(added=rows.join(change.where("change <> 'removed'"), key, "left_semi"), delete=lambda held: held.join(change.where("change <> 'added'"), key, "left_semi"))

    def _raw(self, files: list[str]) -> DataFrame:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in files]).select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in names])

    def _read(self, manifest: dict, places: bool = False, files: list[str] | None = None) -> DataFrame:
        rows = self._raw(manifest["files"] if files is None else files)
        if manifest["deleted"]:
            rows = rows.join(self._vectors(manifest["deleted"]), ["_file", "_row"], "left_anti")
        return rows if places else rows.drop("_file", "_row")

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """The table's columns and _change (added or removed) of the records that differ between two versions; None for none.

        Files that only the later version has give what it holds of them; files that only the earlier has, what that held;
        of files that both have only the rows named by new deletion vectors are read.  A record rewritten into another
        file comes out as removed and added.
        """
        a, b = self.manifest(since), self.manifest(self.version() if until is None else until)
        was, now, vectors_then = set(a["files"]), set(b["files"]), set(a["deleted"])
        new, gone = [f for f in b["files"] if f not in was], [f for f in a["files"] if f not in now]
        kept, vectors = [f for f in a["files"] if f in now], [f for f in b["deleted"] if f not in vectors_then]
        parts = []
        if new:
            parts.append(self._read(b, files=new).withColumn("_change", F.lit("added")))
        if gone:
            parts.append(self._read(a, files=gone).withColumn("_change", F.lit("removed")))
        if kept and vectors:
            hit = self._vectors(vectors).dropDuplicates(["_file", "_row"])
            if a["deleted"]:
                hit = hit.join(self._vectors(a["deleted"]), ["_file", "_row"], "left_anti")
            # Only the files that the new vectors name are opened; their names are some of the manifest's, which is here already.
            named = {r[0] for r in hit.select("_file").distinct().collect()}
            if files := [f for f in kept if f in named]:
                parts.append(self._raw(files).join(hit, ["_file", "_row"]).drop("_file", "_row").withColumn("_change", F.lit("removed")))
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def process(source: VersionedTable, sink: VersionedTable, function: Callable[[DataFrame], DataFrame]) -> int:
    """Applies the function to the records of ``source`` that ``sink`` hasn't taken in; returns their version.

    The output and the version processed are one commit of the sink: if the run fails before it, nothing has happened.
    """
    done = sink.manifest()["processed"].get(source.path, 0)
    now = source.version()
    if now > done:
        delta = source.changes(done, now)
        sink.commit(added=function(delta) if delta is not None else None, processed={source.path: now})
    return now


def take_due(listing: DataFrame, ledger: DataFrame, source: VersionedTable, sink: VersionedTable) -> DataFrame:
    """name, checksum of the files to process now, by the versions of a table of the folder's files.

    The first version of ``source`` is what the ledger shows completed, which ``sink`` has taken in with it; the next is the last scan,
    merged into it.  Their difference (new files and deletion vectors) goes to the sink in the commit that saves the
    version processed: a run that fails before it has taken nothing, and one after it finds nothing to take.
    """
    if not source.version():
        source.commit(added=completed_manifest(ledger))
    if source.path not in sink.manifest()["processed"]:
        sink.commit(added=source.read(1).select("name", "checksum", F.lit(False).alias("due")), processed={source.path: 1})
    since = sink.version()
    source.merge(listing_manifest(listing).where("name is not null"), "name", "checksum")
    process(source, sink, lambda delta: delta.where("_change = 'added'").select("name", "checksum", F.lit(True).alias("due")))
    taken = sink.changes(since)
    return (sink.read().limit(0) if taken is None else taken.where("_change = 'added'")).where("due").select("name", "checksum")
