"""Versions of a set of files by manifests: what files hold is stored once, under its digest.

A store has ``objects`` (digest and content), ``manifests`` (what each version has under which name), ``archive`` (manifests of
files that left the live set) and one pointer, ``CURRENT``, to the live version. Objects are written
before the manifest that names them and the manifest before the pointer, so readers see a version whole or not
at all, and a write that ends early leaves objects that nothing names. A version that has its manifest is not written
again, but only pointed to; one that has none yet is begun anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.selection import moment
from lodestone.sources.session_files import Folder

OBJECTS, MANIFEST = "digest string, content binary", "name string, digest string, modified timestamp_ntz"


class VersionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame:
        there = Folder(self.path).exists(part)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if there else self.spark.createDataFrame([], schema)

    def current(self) -> str | None:
        """The live version."""
        raw = Folder(self.path).read("CURRENT")
        return raw.decode() if raw else None

    def point_to(self, version: str) -> None:
        folder = Folder(self.path)
        folder.write("CURRENT.next", version.encode())
        folder.move("CURRENT.next", "CURRENT")

    def manifest(self, version: str) -> DataFrame:
        return self._read(f"manifests/{version}", MANIFEST)

    def files(self, version: str | None = None) -> DataFrame:
        """(name, content, modified) of a version, the live one if none is named."""
        version = version or self.current()
        held = self.manifest(version) if version else self._read("manifests/none", MANIFEST)
        return held.join(self._read("objects", f"{OBJECTS}, version string").dropDuplicates(["digest"]), "digest").select("name", "content", "modified")

    def _written(self, version: str) -> bool:
        return Folder(self.path).exists(f"manifests/{version}/_SUCCESS")

    def _write_manifest(self, rows: DataFrame, version: str) -> None:
        rows.select("name", "digest", "modified").write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")

    def snapshot(self, files: DataFrame, version: str, since: str | None = None) -> None:
        """S-21. ``files`` (name, content, modified) as a new live version; null content is empty.

        With ``since`` only files modified from then on are read and stored, and the live version's others stay as they
        are there; files that are gone from ``files`` are gone from the version.
        """
        if self._written(version):
            return self.point_to(version)
        stated = files.where("name IS NOT NULL").select("name", F.coalesce("content", F.lit("").cast("binary")).alias("content"), "modified")
        before = self.manifest(self.current()) if self.current() else self._read("manifests/none", MANIFEST)
        changed = stated
        if since:
            fresh = F.coalesce(F.col("modified") >= moment(since), F.lit(True))
            changed, old = stated.where(fresh), stated.where(~fresh)
            unknown = old.select("name").join(before.select("name"), "name", "left_anti")
            if not unknown.isEmpty():  # else no content is dealt by its name
                changed = changed.unionByName(old.join(before.select("name"), "name", "left_anti"))
        read = changed.withColumn("digest", F.sha2("content", 256))
        held = self._read("objects", f"{OBJECTS}, version string").where(F.col("version") != version).select("digest")
        new = read.select("digest", "content")
        if read.select("digest").join(held, "digest", "left_anti").isEmpty():  # digests alone travel where everything is stored
            new = new.limit(0)
        new.dropDuplicates(["digest"]).join(held, "digest", "left_anti").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/objects/version={version}")
        rows = read.select("name", "digest", "modified")
        if since:
            kept = before.join(stated.select("name"), "name", "left_semi").join(rows.select("name"), "name", "left_anti")
            rows = rows.unionByName(kept.select("name", "digest", "modified"))
        self._write_manifest(rows, version)
        self.point_to(version)

    def archive(self, version: str, as_of: str, days: int = 90) -> None:
        """S-24. A new live version without the files last modified more than ``days`` before ``as_of``, which go to the archive."""
        if self._written(version):
            return self.point_to(version)
        held = self.manifest(self.current())
        cold = F.coalesce(F.col("modified") < moment(as_of) - F.make_dt_interval(F.lit(days)), F.lit(False))
        held.where(cold).write.mode("overwrite").parquet(f"{self.path}/archive/version={version}")
        self._write_manifest(held.where(~cold), version)
        self.point_to(version)

    def archived(self) -> DataFrame:
        """(name, digest, modified, version) of what was archived, by the version that did it; contents are still objects."""
        return self._read("archive", f"{MANIFEST}, version string")

    def restore(self, version: str, files: DataFrame, safety: str) -> None:
        """S-25. Stores ``files``, as they are, as the version ``safety``, and makes ``version`` the live one."""
        if not self._written(version):
            raise ValueError(f"no version {version}")
        self.snapshot(files, safety)
        self.point_to(version)
