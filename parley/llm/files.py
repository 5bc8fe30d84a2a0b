"""Files that tasks write and read in the shared folder, by URI (file, hdfs, s3 and whatever else Arrow opens)."""

from __future__ import annotations

from pyarrow import fs as arrow_fs
from pyspark import TaskContext


def at(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def own_name(prefix: str, suffix: str) -> str:
    """A name of this attempt alone: a repeated task writes another file, and the manifest names the one that counts."""
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


class Writer:
    """A file under its final, attempt-owned name, opened on first write so that empty tasks leave none."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.size, self.out = folder, name, 0, None

    def write(self, data: bytes) -> int:
        if self.out is None:
            system, path = at(self.folder)
            system.create_dir(path, recursive=True)
            self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        start, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Reader:
    """Reads ranges of files, keeping the last file open."""

    def __init__(self, folder: str):
        self.system, self.path = at(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
