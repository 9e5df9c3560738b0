"""One ordered JSON text from many tasks: a data source that only writes.

Rows carry the section they belong to and their text. Each task writes what it has of a section to a
file of its own beside the target; the commit joins these files in order, block by block, so no row
goes through the driver's memory. A task that is run again writes files of another name, and only
files that a committed task reports are joined.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "ordered_document"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (section, file name), in the order of sections."""

    partition: int
    files: list


class OrderedDocument(DataSource):
    """Options: path, and sections, a JSON list of [text before, text after]."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], json.loads(self.options["sections"]))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sections: list):
        self.path, self.sections = path, sections
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        files, f, now = [], None, None
        for section, text in iterator:
            if section != now:
                if f is not None:
                    f.close()
                name = f"{task.partitionId()}-{section}-{uuid.uuid4().hex}"
                files.append((section, name))
                f, now = open(f"{self.folder}/{name}", "w", encoding="utf-8", newline=""), section
            else:
                f.write(",")
            f.write(text)
        if f is not None:
            f.close()
        return Written(task.partitionId(), files)

    def commit(self, messages: list) -> None:
        order: dict[int, list[str]] = {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for section, name in m.files:
                order.setdefault(section, []).append(name)
        whole = f"{self.path}.{uuid.uuid4().hex}"
        with open(whole, "wb") as out:
            for k, (before, after) in enumerate(self.sections):
                out.write(before.encode())
                for i, name in enumerate(order.get(k, [])):
                    out.write(b"," if i else b"")
                    with open(f"{self.folder}/{name}", "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                out.write(after.encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def write_ordered(rows: DataFrame, sections: list[tuple[str, str]], path: str) -> None:
    """rows(section, key, text) as one text: each section's texts in the order of their keys, parted by
    commas, between what comes before and after it. Keys are spread by range over the tasks, so the text
    is the same however many there are. The folder of `path` is one that all executors share."""
    spark = rows.sparkSession
    spark.dataSource.register(OrderedDocument)
    d = rows.select("section", "key", "text").repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("section", "text")
    d.write.format(FORMAT).option("path", path).option("sections", json.dumps(sections)).mode("append").save()
