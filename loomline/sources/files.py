"""Byte access to files of any store that executors can reach, for code that runs in Python workers."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """A file read by ranges."""

    def __init__(self, uri: str):
        where, path = store(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise EOFError(f"wanted {length} bytes at {offset}, got {len(data)}")
        return data

    def close(self) -> None:
        self.file.close()


def put(uri: str, parts: list[bytes]) -> None:
    """Write a file under another name and move it into place, so that a reader sees all of it or nothing."""
    where, path = store(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_file(path)  # of an earlier attempt; a local move replaces it
    where.move(part, path)


def local_path(uri: str) -> str | None:
    """The path of a file in a folder of this machine (or one it mounts); None for other stores."""
    where, path = store(uri)
    return path if isinstance(where, fs.LocalFileSystem) else None
