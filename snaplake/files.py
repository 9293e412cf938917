"""Files on any file system pyarrow can open, and commits that one writer wins."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


#: Schemes that Hadoop names otherwise than Arrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, of Hadoop's names too, and the path there. A name without a scheme is local."""
    scheme, mark, rest = uri.partition("://")
    if mark:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri("file://" + os.path.abspath(uri.removeprefix("file:")))


def put(uri: str, data: bytes) -> None:
    """A whole file or none: written under a name of its own, then moved."""
    with Writer(uri) as w:
        w.write(data)


class Writer:
    """Streams into a file that appears under its name when all of it is there."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        top, name = os.path.split(self.path)
        self.fs.create_dir(top, recursive=True)
        self.own = f"{top}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            try:
                self.fs.move(self.own, self.path)
            except OSError:  # stores that do not replace: a task that runs again finds the file of its first try
                if self.fs.get_file_info(self.path).type == fs.FileType.NotFound:
                    raise
                self.fs.delete_file(self.path)
                self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


def get(uri: str, at: int = 0, n: int | None = None) -> bytes:
    """A file's bytes, n of them from at on."""
    where, path = file_system(uri)
    with where.open_input_file(path) as f:
        return f.read_at(f.size() - at if n is None else n, at)


def exists(uri: str) -> bool:
    where, path = file_system(uri)
    return where.get_file_info(path).type != fs.FileType.NotFound


def delete(uri: str) -> None:
    """A file, or a folder with all below it; nothing where there is none."""
    where, path = file_system(uri)
    kind = where.get_file_info(path).type
    if kind == fs.FileType.Directory:
        where.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        where.delete_file(path)


def create_once(path: str, data: bytes) -> bool:
    """Creates a local file with all of its data if there is none; of many writers one gets True."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(own, path)  # fails where the name is taken
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(own)
