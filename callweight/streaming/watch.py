"""File changes as a stream that sees deletions.

An offset is the number of a listing. A listing of the watched folders is written to a state folder,
under its number, before the offset that names it is used; the rows between two offsets are the
difference of their listings. So a stream that starts again from its checkpoint asks for the same
difference again, whatever has happened to the files since, and neither repeats nor loses a change.
"""

from __future__ import annotations

import fnmatch
import json
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "file_changes"
SCHEMA = "kind string, path string, change string, modified timestamp"
PARTS = 4


class FileChanges(DataSource):
    """Options: sources, a JSON object {kind: [folder, glob]}; state, a folder that the driver and all
    tasks share; parts, tasks that a difference is spread over."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return ChangeReader({k: tuple(v) for k, v in json.loads(o["sources"]).items()}, o["state"], int(o.get("parts", PARTS)))


class Share(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        self.start, self.end, self.part = start, end, part


def listed(sources: dict[str, tuple[str, str]]) -> list[tuple[str, str, int, int]]:
    """(kind, path, mtime in microseconds, size) of all files, in order. A file that goes while the
    listing is made is not in it."""
    out = []
    for kind, (folder, glob) in sources.items():
        for at, _, names in os.walk(folder):
            for n in names:
                if fnmatch.fnmatch(n, glob):
                    path = os.path.join(at, n)
                    try:
                        s = os.stat(path)
                    except OSError:
                        continue
                    out.append((kind, path, s.st_mtime_ns // 1000, s.st_size))
    return sorted(out)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, sources: dict[str, tuple[str, str]], state: str, parts: int):
        self.sources, self.state, self.parts = sources, state, parts
        os.makedirs(state, exist_ok=True)

    def _file(self, number: int) -> str:
        return f"{self.state}/{number:012d}.json"

    def _listing(self, number: int) -> Iterator[list]:
        if number >= 0:
            with open(self._file(number), encoding="utf-8") as f:
                for line in f:
                    yield json.loads(line)

    def _last(self) -> int:
        return max((int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json")), default=-1)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": -1}  # nothing: files that are there at first are created ones

    def latestOffset(self) -> dict:  # noqa: N802
        last, now = self._last(), [list(x) for x in listed(self.sources)]
        if last >= 0 and now == list(self._listing(last)):
            return {"listing": last}
        tmp = f"{self.state}/.{os.getpid()}.tmp"
        with open(tmp, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(x) + "\n" for x in now)
        os.replace(tmp, self._file(last + 1))
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(start["listing"], end["listing"], p) for p in range(self.parts)]

    def read(self, partition: Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        mine = lambda n: {(k, p): (m, s) for k, p, m, s in self._listing(n) if zlib.crc32(p.encode("utf-8", "surrogateescape")) % self.parts == partition.part}
        old, new = mine(partition.start), mine(partition.end)
        for key in sorted(old.keys() | new.keys()):
            change = "created" if key not in old else "deleted" if key not in new else "changed" if old[key] != new[key] else None
            if change:
                at = new.get(key, old.get(key))[0]
                yield (*key, change, datetime.fromtimestamp(at / 1e6, timezone.utc))

    def commit(self, end: dict) -> None:
        """Listings before a committed one are read no more."""
        for n in os.listdir(self.state):
            if n.endswith(".json") and int(n[:-5]) < end["listing"]:
                os.remove(f"{self.state}/{n}")


def watch(spark: SparkSession, sources: dict[str, tuple[str, str]], state: str, parts: int = PARTS) -> DataFrame:
    """A stream of (kind, path, change, modified): files created, changed and deleted below folders, from
    {kind: (folder, glob)}. One stream to a state folder."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format(FORMAT).option("sources", json.dumps(sources)).option("state", state).option("parts", str(parts)).load()
