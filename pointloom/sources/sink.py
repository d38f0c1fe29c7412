"""The format "entropy" as a sink, for batches and streams: a file for each task.

Tasks write into a staging folder of the job. Its commit moves the files of the tasks that
succeeded to their place, its abort deletes the folder; files of other attempts go with it.
Option ``path`` is a folder that driver and executors share; option ``form`` is "text" (lines of
position, comma and value), "hex" (a word of four digits, or a block, a line) or "binary" (a word's
two bytes, the higher first, or the bytes of a hex block). Rows need a column pos, and word, block
or value. A null raises, in all forms, and so does a value that is no word under hex and binary.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMS = ("text", "hex", "binary")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Files:
    def __init__(self, options: dict, schema: StructType, job: str) -> None:
        self.path, self.form = options.get("path", ""), options.get("form", "text")
        if not self.path:
            raise ValueError("the sink needs a path")
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {FORMS}")
        named = [c for c in ("word", "block", "value") if c in schema.names]
        if "pos" not in schema.names or len(named) != 1:
            raise ValueError("the sink takes rows of pos, and of word, block or value")
        self.column, self.job = named[0], job

    def _place(self) -> tuple[fs.FileSystem, str]:
        if self.path.startswith("/"):
            return fs.LocalFileSystem(), self.path
        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path)

    def _bytes(self, row: Row) -> bytes:
        value = row[self.column]
        if value is None or row["pos"] is None:
            raise ValueError("the sink takes no nulls")
        if self.form == "text":
            return f"{row['pos']},{value}\n".encode()
        if self.column == "block":
            return bytes.fromhex(value) if self.form == "binary" else f"{value}\n".encode()
        if not 0 <= value < 1 << 16:
            raise ValueError(f"{value} is no word of 16 bits")
        return int(value).to_bytes(2, "big") if self.form == "binary" else f"{value:04x}\n".encode()

    def stage(self, rows: Iterator[Row]) -> Written:
        """The rows of a task in a file of its attempt."""
        system, path = self._place()
        n, name = 0, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        system.create_dir(f"{path}/_staging-{self.job}", recursive=True)
        with system.open_output_stream(f"{path}/_staging-{self.job}/{name}") as out:
            for row in rows:
                out.write(self._bytes(row))
                n += 1
        return Written(name, n)

    def publish(self, messages: list[Written | None], prefix: str, replaced: str | None) -> None:
        """Move staged files to their place, ``prefix`` in front, in the place of files whose names begin with ``replaced``."""
        system, path = self._place()
        system.create_dir(path, recursive=True)
        if replaced is not None:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.is_file and old.base_name.startswith(replaced):
                    system.delete_file(old.path)
        for message in messages:
            if message is not None and message.rows:
                system.move(f"{path}/_staging-{self.job}/{message.name}", f"{path}/{prefix}{message.name}")
        self.clear()

    def clear(self) -> None:
        system, path = self._place()
        staging = f"{path}/_staging-{self.job}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class EntropyWriter(DataSourceWriter):
    """Appends the files of a job, or puts them in the place of what batches wrote before."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.files, self.overwrite = _Files(options, schema, uuid.uuid4().hex), overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.stage(iterator)

    def commit(self, messages: list) -> None:
        self.files.publish(messages, f"words-{self.files.job}-", "words-" if self.overwrite else None)

    def abort(self, messages: list) -> None:
        self.files.clear()


class EntropyStreamWriter(DataSourceStreamWriter):
    """Files of each batch under its number; a batch that is written again takes the place of its first files.

    A folder takes one stream.
    """

    def __init__(self, options: dict, schema: StructType) -> None:
        self.files = _Files(options, schema, "stream")  # tasks and commit have writers of their own, which a name of a job would part

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.stage(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        name = f"batch-{batchId:010d}-"
        self.files.publish(messages, name, name)

    def abort(self, messages: list, batchId: int) -> None:
        self.files.clear()
