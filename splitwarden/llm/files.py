"""Files that tasks write to and read from the shared folder, in any store Arrow can reach."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``file:``, ``hdfs:``, ``s3:`` and other URIs, or a plain path."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def published(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes under its own name; attempts give equal bytes, so whichever
    is moved last leaves the same file.
    """
    task = TaskContext.get()
    mark = f"{task.taskAttemptId()}" if task else "0"
    system, path = locate(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{mark}-{name}"
    with system.open_output_stream(draft, compression=None) as out:
        yield out
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
    system.move(draft, path)


def task_number() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0
