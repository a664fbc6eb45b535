"""Files written whole or not at all: a Python data source for rows of (path, content).

Tasks write a temporary file beside each target and sync it; only when every task has ended are the files
renamed over their targets, keeping their permissions. An aborted job removes what it wrote.

    spark.dataSource.register(AtomicFiles)
    rows.write.format("atomic_files").option("path", folder).option("root", read_from).mode("append").save()

A file keeps its place below `root` (the folder that was read; folders are made as needed). Without a root, or
for a path outside of it, the base name is the target. Two rows with one target fail the job before any file
is replaced. The folder must be a file system path that the driver and all executors reach.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class AtomicFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "atomic_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return AtomicWriter(self.options["path"], self.options.get("root", ""))


def _plain(path: str) -> str:
    """A path without the file scheme."""
    return unquote(path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")) if path.startswith("file:") else path


def target_of(path: str, folder: str, root: str) -> str:
    """Where a file goes: its place below root, or its base name."""
    path, root = _plain(path), _plain(root).rstrip("/")
    below = os.path.relpath(path, root) if root and path.startswith(root + "/") else os.path.basename(path)
    if below.startswith("..") or not below:
        raise ValueError(f"{path} does not name a file below {root}")
    return os.path.join(folder, below)


class AtomicWriter(DataSourceWriter):
    def __init__(self, folder: str, root: str = ""):
        self.folder, self.root = _plain(folder), root

    def write(self, rows) -> Written:
        files: list[tuple[str, str]] = []
        try:
            for row in rows:
                if row["content"] is not None:
                    files.append(write_beside(target_of(row["path"], self.folder, self.root), row["content"]))
        except BaseException:
            _unlink([t for t, _ in files])
            raise
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m for f in m.files]
        targets = Counter(target for _, target in files)
        twice = sorted(t for t, n in targets.items() if n > 1)
        if twice:
            raise ValueError(f"{len(twice)} targets have several rows: {', '.join(twice[:3])}")
        for temporary, target in files:
            os.replace(temporary, target)

    def abort(self, messages) -> None:
        for message in messages:
            _unlink([t for t, _ in message.files] if message else [])


def write_beside(target: str, content: bytes) -> tuple[str, str]:
    """(temporary file, target): the synced content next to its target."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    temporary = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}")
    with open(temporary, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    if os.path.exists(target):
        os.chmod(temporary, os.stat(target).st_mode & 0o7777)
    return temporary, target


def _unlink(paths: list[str]) -> None:
    for p in paths:
        if os.path.exists(p):
            os.unlink(p)
