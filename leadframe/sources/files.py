"""Files by path or URI, for drivers and tasks alike: local folders, and the object stores and clusters that Arrow knows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from leadframe.operators.durable import durable


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that ``folder`` (a path or URI) is on, and its path there."""
    if folder.startswith(("s3a://", "s3n://")):
        folder = "s3" + folder[3:]
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:"))


def exists(folder: str, name: str) -> bool:
    system, path = filesystem(folder)
    return system.get_file_info(f"{path}/{name}").type == fs.FileType.File


def size(folder: str, name: str) -> int:
    system, path = filesystem(folder)
    return system.get_file_info(f"{path}/{name}").size


def names(folder: str, suffix: str) -> list[str]:
    """Names of the files in ``folder`` that end with ``suffix``, in order, without it."""
    system, path = filesystem(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(i.base_name[: -len(suffix)] for i in found if i.type == fs.FileType.File and i.base_name.endswith(suffix))


def read_all(folder: str, files: list[str]) -> list[bytes]:
    """Contents of small files, several at a time."""
    system, path = filesystem(folder)

    def one(name: str) -> bytes:
        with system.open_input_stream(f"{path}/{name}") as f:
            return f.read()

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, files))


def make(folder: str) -> None:
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)


class Aside:
    """A file that is written under a name of this task's attempt and takes its own when it is closed, so that two attempts
    of one task never write to the same file and a reader never sees half of one."""

    def __init__(self, folder: str, name: str) -> None:
        from pyspark import TaskContext

        at = TaskContext.get()
        self._system, path = filesystem(folder)
        self._name = f"{path}/{name}"
        self._part = f"{self._name}.{at.taskAttemptId() if at else os.getpid()}.part"
        self._file = self._system.open_output_stream(self._part)

    def write(self, data: bytes) -> None:
        self._file.write(data)

    def close(self) -> None:
        self._file.close()
        self._system.move(self._part, self._name)


def put(folder: str, name: str, data: bytes) -> None:
    f = Aside(folder, name)
    f.write(data)
    f.close()


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """One file per row of (``name``, ``content``, text or binary) in ``folder``; returns (``name``, ``bytes``) once all are written."""
    make(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for name, content in zip(b["name"].to_pylist(), b["content"].to_pylist(), strict=True):
                data = content.encode() if isinstance(content, str) else content
                put(folder, name, data)
                done.append(len(data))
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(done, pa.int64())], names=["name", "bytes"])

    return durable(df.select("name", "content").mapInArrow(work, "name string, bytes bigint"))
