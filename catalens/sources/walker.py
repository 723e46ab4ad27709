"""Directory listings as a Spark source: ``spark.read.format("entries").option("path", ...)``.

Each folder of the upper ``split_levels`` levels is a partition, so folders are walked in parallel; executors must see the
file system. Options: ``path``; ``volume`` (``/``); ``access_time`` (``true``; else the time of change stands for it);
``classify`` (``true``; else category 0). Names that aren't UTF-8 are replaced, unreadable entries are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from catalens.functions.labels import EXTENSIONS
from catalens.model import Category, Kind
from catalens.schemas import ENTRY_SCHEMA

_BY_EXTENSION = {e: c for c, names in EXTENSIONS.items() for e in names.split()}


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def category_of(path: str) -> int:
    stem, dot, ext = os.path.basename(path).rpartition(".")
    return _BY_EXTENSION.get(ext.lower(), Category.OTHER) if stem and dot else Category.OTHER


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or "."
        self.volume = options.get("volume", "/")
        self.levels = int(options.get("split_levels", "2"))
        self.access = options.get("access_time", "true").lower() == "true"
        self.classify = options.get("classify", "true").lower() == "true"

    def partitions(self) -> list[Folder]:
        out, level = [], [self.root]
        for _ in range(self.levels):
            out += [Folder(p, False) for p in level]
            level = [e.path for p in level for e in _listed(p) if e.is_dir(follow_symlinks=False)]
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition.path == self.root:
            yield from self._row(self.root)
        todo = [partition.path]
        while todo:
            for e in _listed(todo.pop()):
                yield from self._row(e.path)
                if partition.deep and e.is_dir(follow_symlinks=False):
                    todo.append(e.path)

    def _row(self, path: str) -> Iterator[tuple]:
        try:
            s = os.stat(path, follow_symlinks=False)
        except OSError:
            return
        is_dir, is_link = os.path.isdir(path) and not os.path.islink(path), os.path.islink(path)
        kind = Kind.DIRECTORY if is_dir else Kind.SYMLINK if is_link else Kind.FILE
        changed = s.st_mtime_ns // 1000
        text = os.fsencode(path).decode("utf-8", "replace")
        yield (text, self.volume, int(kind), changed, s.st_atime_ns // 1000 if self.access else changed, category_of(text) if self.classify else 0, 0)


def _listed(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


class EntrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self):
        return ENTRY_SCHEMA

    def reader(self, schema) -> EntryReader:
        return EntryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntrySource)
