"""Small documents on any file system that Spark can reach: read, write once, digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    _, at, files = _at(path)
    return bool(files.exists(at))


def chunks(path: str, start: int = 0, size: int | None = None, step: int = 1 << 22) -> Iterator[bytes]:
    """Bytes of a file from ``start``, sought, not skipped; all or ``size`` of them."""
    jvm, at, files = _at(path)
    left = files.getFileStatus(at).getLen() - start if size is None else size
    stream = files.open(at)
    try:
        stream.seek(start)
        while left > 0:
            part = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(step, left)))
            left -= len(part)
            yield part
    finally:
        stream.close()


def length(path: str) -> int:
    _, at, files = _at(path)
    return int(files.getFileStatus(at).getLen())


def read_text(path: str) -> str:
    return b"".join(chunks(path)).decode()


def write_text(path: str, text: str, *, overwrite: bool = False) -> None:
    """The whole document appears at once, by a rename; an existing one is an error unless told otherwise."""
    jvm, at, files = _at(path)
    if files.exists(at) and not overwrite:
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if overwrite:
        files.delete(at, False)
    if not files.rename(part, at):
        files.delete(part, False)
        raise FileExistsError(path)


def make_folder(path: str) -> None:
    """A folder that must not exist yet."""
    _, at, files = _at(path)
    if files.exists(at):
        raise FileExistsError(path)
    files.mkdirs(at)


def listed(path: str) -> list[str]:
    """Paths of all files below, in order; names that begin with a dot or underscore are left out."""
    _, at, files = _at(path)
    found, todo = [], [at]
    while todo:
        for status in files.listStatus(todo.pop()):
            if status.getPath().getName()[:1] in "._":
                continue
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                found.append(status.getPath().toString())
    return sorted(found)


def sha256(path: str) -> str:
    """Digest of a file, or of the names and digests of a folder's files."""
    _, at, files = _at(path)
    if not files.getFileStatus(at).isDirectory():
        digest = hashlib.sha256()
        for part in chunks(path):
            digest.update(part)
        return digest.hexdigest()
    root = files.getFileStatus(at).getPath().toString().rstrip("/")
    return hashlib.sha256("".join(f"{p.removeprefix(root)}:{sha256(p)}\n" for p in listed(path)).encode()).hexdigest()
