"""The log of what a handle holds back: single inserts and deletes that are not yet in a generation.

Every line is flushed to the file system before the call that made it returns, so a driver that dies loses nothing it has
acknowledged: on a local folder the line has left the process, on HDFS it is with the data nodes (``hflush``). On object
stores, which have no flush, lines are safe once the handle syncs.

Which lines are in a generation is told by the manifest that published it (``logged``: name of the log to number of
lines), so lines are taken in once, whoever takes them in: the handle itself, or another that finds the log when it opens.
"""

from __future__ import annotations

import json
import uuid

from catalens.sources.versioned import VersionedTable


class HeldLog:
    def __init__(self, table: VersionedTable):
        self.table, self.name, self._out = table, f"{uuid.uuid4().hex[:16]}.jsonl", None

    def append(self, row: list) -> None:
        if self._out is None:
            fs = self.table._fs
            raw = fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs
            self._out = raw.create(self.table._path(f"{self.table.root}/_log/{self.name}"), False)
        self._out.write(bytearray(json.dumps(row) + "\n", "utf-8"))
        self._out.hflush()

    def remove(self) -> None:
        """The end of a log whose lines are all in a generation; the next line begins another."""
        if self._out is not None:
            self._out.close()
            self.table._fs.delete(self.table._path(f"{self.table.root}/_log/{self.name}"), False)
        self.name, self._out = f"{uuid.uuid4().hex[:16]}.jsonl", None

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


def logs(table: VersionedTable) -> list[str]:
    """Names of the logs that are there."""
    at = table._path(f"{table.root}/_log")
    if not table._fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in table._fs.listStatus(at) if s.getPath().getName().endswith(".jsonl"))


def lines(table: VersionedTable, name: str) -> list[list]:
    """The rows of a log; a last line that was cut off was never acknowledged and doesn't count."""
    whole = table.text(f"_log/{name}").split("\n")[:-1]
    return [json.loads(x) for x in whole]
