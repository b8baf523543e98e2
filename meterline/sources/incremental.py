"""The ledger kept up to date in a folder, without reading it again.

A state folder holds three Parquet tables, each in parts ``version=N`` that
one scan writes:

* ``records``: usage records and parse errors of the files parsed in that
  scan (new files and those whose size or time changed);
* ``kept``: the result of the replay dedup (D1) for the keys that the scan
  touched, a null record where a key has none left;
* ``manifest``: the files of the scan with the version their records lie in.
  It is written last; without it a version does not count, and a scan that
  failed is overwritten by the next.

A scan reads changed files only. A key of D1 is touched if a changed, vanished
or newly dropped file had it or a changed file has it; its winner is chosen
anew among all current records of the key, so a copy takes the place of a
record that is gone. Everything stays in DataFrames: no file name, key or
record passes the driver. ``compact`` writes the current state as one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import KEY_COLS, dedup_replays
from .ledger import discovered, read_files, usage_records

SAME = ["file_path", "length", "modificationTime"]


class LedgerState:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, name: str, version: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")

    def version(self) -> int:
        """The last complete scan; 0 before the first."""
        from pyspark.errors import AnalysisException

        try:
            return self._read("manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:  # no manifest yet
            return 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a scan (of the last one): ``SAME``, path and the
        version ``at`` which each was parsed."""
        version = self.version() if version is None else version
        return self._read("manifest").where(F.col("version") == version).drop("version")

    def records(self, version: int | None = None) -> DataFrame:
        """All current records and parse errors."""
        files = self.manifest(version).select("file_path", F.col("at").alias("version"))
        return self._read("records").join(files, ["file_path", "version"], "left_semi")

    def kept(self, version: int | None = None) -> DataFrame:
        """D1 of all current records: each key's last written state."""
        version = self.version() if version is None else version
        rows = self._read("kept").where(F.col("version") <= version)
        last = rows.groupBy("key").agg(F.max_by(F.struct("rec"), "version").alias("last"))
        return last.where("last.rec is not null").select("last.rec.*")

    def scan(self, root: str) -> int:
        """Brings the state up to date with the files below ``root``; returns
        the new version."""
        before = self.version()
        now = before + 1
        files = discovered(self.spark, root)
        if before:
            old = self.manifest(before)
            as_before = files.join(old.select(*SAME, "at"), SAME, "left")
            files = as_before.withColumn("at", F.coalesce("at", F.lit(now)))
        else:
            files = files.withColumn("at", F.lit(now))
        # Written beside the manifests until all else is: one listing for all steps.
        self._write("listing", now, files.select(*SAME, "path", "is_archived", "path_parts", "at"))
        files = self.spark.read.parquet(f"{self.folder}/listing/version={now}")

        fresh = usage_records(read_files(files.where(F.col("at") == now).drop("modificationTime", "at"))).drop("length")
        self._write("records", now, fresh.withColumn("key", _key()))
        fresh = self.spark.read.parquet(f"{self.folder}/records/version={now}")
        touched = fresh.where(~F.col("is_error")).select("key")
        current = fresh
        if before:
            stays = files.where(F.col("at") < now).select("file_path", F.col("at").alias("version"))
            past = self._read("records").where(F.col("version") < now).join(self.manifest(before).select("file_path", F.col("at").alias("version")),
                                                                            ["file_path", "version"], "left_semi")
            gone = past.join(stays, ["file_path", "version"], "left_anti")
            touched = touched.unionByName(gone.where(~F.col("is_error")).select("key"))
            current = past.join(stays, ["file_path", "version"], "left_semi").drop("version").unionByName(fresh)
        touched = touched.distinct()
        winners = dedup_replays(current.join(touched, "key", "left_semi"))
        rec = F.struct(*[c for c in winners.columns if c != "key"])
        state = touched.join(winners.select("key", rec.alias("rec")), "key", "left")
        self._write("kept", now, state)
        self._write("manifest", now, files)
        return now

    def add_scan(self, version: int, row: DataFrame) -> None:
        """What a scan counted (one row), for :meth:`scans`."""
        self._write("scans", version, row)

    def scans(self) -> DataFrame:
        """One row per scan with its version."""
        return self._read("scans")

    def last_scan(self) -> int:
        """The last scan that has its row; 0 before the first."""
        from pyspark.errors import AnalysisException

        try:
            return self.scans().agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def compact(self, folder: str) -> "LedgerState":
        """The current state as version 1 of another folder."""
        out, at = LedgerState(self.spark, folder), self.version()
        out._write("records", 1, self.records(at).drop("version"))
        rows = self._read("kept").where(F.col("version") <= at)
        last = rows.groupBy("key").agg(F.max_by(F.struct("rec"), "version").alias("last")).where("last.rec is not null")
        out._write("kept", 1, last.select("key", "last.rec"))
        out._write("manifest", 1, self.manifest(at).withColumn("at", F.lit(1)))
        return out


def _key():
    """One column for the parts of D1's key; a part that is absent is no
    field of it."""
    return F.sha2(F.to_json(F.struct(*KEY_COLS)), 256)
