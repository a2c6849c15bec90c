"""Tables that change together: a version is all of them, and one pointer names the live version.

A commit writes every table of a new version beside the live ones, then a note of the version that it follows, and then moves
the pointer. Readers see all of a commit or nothing. A commit of a name that is noted already writes nothing, and moves
the pointer only if that move is what is lacking, so a repeated job changes nothing, even after later commits. Tables that a
commit doesn't name stay as they are. Commits take turns: there is no lock.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.session_files import Folder


class TableSet:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _json(self, name: str) -> dict:
        return json.loads(Folder(self.path).read(name) or b"{}")

    def current(self) -> str | None:
        return self._json("CURRENT").get("version")

    def committed(self, version: str) -> bool:
        return bool(self._json(f"notes/{version}"))

    def _point_to(self, version: str) -> None:
        folder = Folder(self.path)
        folder.write("CURRENT.next", json.dumps({"version": version}).encode())
        folder.move("CURRENT.next", "CURRENT")

    def read(self, name: str, schema: str, version: str | None = None) -> DataFrame:
        """A table of a version, the live one if none is named; empty before its first commit."""
        version = version or self.current()
        held = self._json(f"notes/{version}").get("tables", {}) if version else {}
        if name not in held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/tables/{name}/version={held[name]}")

    def commit(self, version: str, **tables: DataFrame) -> bool:
        """Whether the version is new."""
        note = self._json(f"notes/{version}")
        if note:
            if note["after"] == self.current():
                self._point_to(version)
            return False
        before = self.current()
        held = self._json(f"notes/{before}").get("tables", {}) if before else {}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/version={version}")
        Folder(self.path).write(f"notes/{version}.next", json.dumps({"after": before, "tables": held | dict.fromkeys(tables, version)}).encode())
        Folder(self.path).move(f"notes/{version}.next", f"notes/{version}")
        self._point_to(version)
        return True
