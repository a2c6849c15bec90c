"""Session files as a sink: one Markdown file a session, in batches that are written whole, once.

Every task writes the files that it changes, with what they hold and what is new, to a folder of the batch beside
the live ones. The driver's commit first stores the list of these task folders, which makes the batch decided, then
moves each file to its place, and then marks the batch as done. A batch that ends before it is decided
leaves the live files as they were; one that ends between its moves is finished by the next commit of
the same name from the list, and not begun anew; one that is done changes nothing. A file belongs to one row,
so no two tasks write it. Batches of different names into one folder take turns: the sink has no lock.

Files are reached by the path's own file system (``file:``, ``hdfs:``, ``s3:``), from all executors.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: The folder of each kind of source.
FOLDERS = {"session": "sessions", "upload": "uploads", "external": "external"}
BATCHES = "_batches"


def file_name(file_id: str, source_type: str | None) -> str:
    """S-07. The place of a session's file; unknown kinds are sessions. An id is one name, whatever it holds."""
    return f"{FOLDERS.get(source_type or 'session', FOLDERS['session'])}/{quote(file_id, safe=' ')}.md"


class Folder:
    """A folder of any file system."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{posixpath.abspath(path)}")
        self.kinds = fs.FileType

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self.at(name)).type != self.kinds.NotFound

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        with self.fs.open_input_file(self.at(name)) as f:
            return f.read()

    def write(self, name: str, body: bytes) -> None:
        self.fs.create_dir(posixpath.dirname(self.at(name)), recursive=True)
        with self.fs.open_output_stream(self.at(name)) as f:
            f.write(body)

    def move(self, name: str, to: str) -> None:
        self.fs.create_dir(posixpath.dirname(self.at(to)), recursive=True)
        self.fs.move(self.at(name), self.at(to))

    def files(self, name: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.at(name), recursive=True, allow_not_found=True))
        return [posixpath.relpath(x.path, self.at(name)) for x in found if x.type == self.kinds.File]

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete_dir(self.at(name))


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task wrote."""

    folder: str


class SessionWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.base = path, f"{BATCHES}/{quote(batch, safe='')}"
        self.staging = f"{self.base}/files-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, own = Folder(self.path), f"{self.staging}/{uuid.uuid4().hex}"  # an attempt of a task has its own
        for r in iterator:
            name = file_name(r["file_id"], r["source_type"])
            held = folder.read(name)
            folder.write(f"{own}/{name}", held + r["blocks"].encode() if held else (r["head"] + r["first"]).encode())
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        folder = Folder(self.path)
        done, decided = f"{self.base}/done", f"{self.base}/decided.json"
        if not folder.exists(done):
            if not folder.exists(decided):
                folder.write(f"{self.base}/deciding.json", json.dumps([m.folder for m in messages if m]).encode())
                folder.move(f"{self.base}/deciding.json", decided)
            for own in json.loads(folder.read(decided)):
                for name in folder.files(own):  # what has been moved is not there any more
                    folder.move(f"{own}/{name}", name)
            folder.write(done, b"")
            for own in json.loads(folder.read(decided)):
                folder.delete(posixpath.dirname(own))
        folder.delete(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        Folder(self.path).delete(self.staging)


class SessionFiles(DataSource):
    """``format("session_files")``: rows of (file_id, source_type, head, first, blocks), option ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def writer(self, schema: StructType, overwrite: bool) -> SessionWriter:
        if overwrite:
            raise ValueError("session files are appended to, not overwritten")
        return SessionWriter(self.options["path"], self.options["batch"])
