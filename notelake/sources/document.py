"""One ordered document from many tasks: each writes its part of the rows, and the commit joins the parts in the order of the partitions.

The driver copies files block by block, so its memory doesn't follow the document, and the document appears by one rename, when all parts are there. Where a
task fails for good, parts are deleted and no document appears. Parts lie beside the document, in a folder that all executors see.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_BLOCK = 1 << 20


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.csv = options["path"], options.get("kind", "lines") == "csv"
        self.head, self.between, self.tail = (options.get(k, "") for k in ("head", "between", "tail"))
        self.columns = columns
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex[:8]}"
        os.mkdir(self.parts)

    def write(self, iterator: Iterator[Row]) -> _Written:
        task = TaskContext.get()
        name = f"{task.partitionId():06}-{task.taskAttemptId()}"
        n = 0
        with open(os.path.join(self.parts, name), "w", encoding="utf-8", newline="") as f:
            rows = csv.writer(f, lineterminator="\r\n")
            for r in iterator:
                if self.csv:
                    rows.writerow(r)
                else:
                    f.write((self.between if n else "") + r[0])
                n += 1
        return _Written(task.partitionId(), name, n)

    def commit(self, messages: list[_Written]) -> None:
        whole = os.path.join(self.parts, "whole")
        with open(whole, "w", encoding="utf-8", newline="") as f:
            if self.csv:
                csv.writer(f, lineterminator="\r\n").writerow(self.columns)
            f.write(self.head)
            first = True
            for m in sorted((m for m in messages if m.rows), key=lambda m: m.partition):
                f.write("" if first or self.csv else self.between)
                first = False
                with open(os.path.join(self.parts, m.name), encoding="utf-8", newline="") as part:
                    shutil.copyfileobj(part, f, _BLOCK)
            f.write(self.tail)
            f.flush()
            os.fsync(f.fileno())
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Moves the parts away first, so that a task that is still at work finds no folder for a file of its own."""
        os.rename(self.parts, f"{self.parts}-gone")
        shutil.rmtree(f"{self.parts}-gone", ignore_errors=True)


class DocumentSink(DataSource):
    """write.format("document"): options path, kind (csv; lines: the first column, with `between` between two), head, tail."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema.fieldNames())


def write_document(rows: DataFrame, path: str, **options: str) -> int:
    """Writes rows in their order as one document, replacing a present one, and returns their number."""
    rows.sparkSession.dataSource.register(DocumentSink)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("document").options(path=os.path.abspath(path), **options).mode("append").save()
    return seen.get["rows"]
