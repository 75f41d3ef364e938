"""Files in the shared folder, written and read by executors through Arrow's filesystems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    f, path = open_fs(uri)
    f.create_dir(path, recursive=True)


class NewFile:
    """A file that appears under its name only when it is whole. Names are unique to an attempt,
    so a task that runs again never touches what another attempt wrote."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.fs, base = open_fs(folder)
        self.path = f"{base}/{self.name}"
        self._out = self.fs.open_output_stream(self.path + ".part", compression=None, buffer_size=1 << 20)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self.fs.move(self.path + ".part", self.path)
