"""ZIP packages: members read one by one, by ranges of the file, as a table function that SQL can join laterally."""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: members above this many bytes are not read.
MAX_BYTES = 100 * 1024 * 1024
_STEP = 1 << 20

SCHEMA = "member string, size long, is_symlink boolean, content binary, problem string"
_Row = tuple[str | None, int | None, bool | None, bytes | None, str | None]


def _content(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most_bytes: int) -> tuple[bytes | None, int, str | None]:
    """A member's bytes, how many were read, and what is wrong; what its header says of its size is not believed."""
    held = io.BytesIO()
    try:
        with archive.open(info) as member:
            while piece := member.read(_STEP):
                held.write(piece)
                if held.tell() > most_bytes:
                    return None, held.tell(), "too large"
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
        return None, held.tell(), "damaged"
    return held.getvalue(), held.tell(), None


def members_of(file: BinaryIO, most_bytes: int = MAX_BYTES) -> Iterator[_Row]:
    """(member, size, is_symlink, content, problem) of a ZIP file that can be read at any place; holds one member at a time.

    A member with a problem (unsafe path, duplicate, symlink, too large, damaged) has null content; of one that is too large or damaged size is what was
    read of it.  A file that is no ZIP has one row with a null member.
    """
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError, ValueError):
        yield None, None, None, None, "not a ZIP file"
        return
    seen: set[str] = set()
    for info in archive.infolist():
        if info.is_dir():
            continue
        name, link = info.filename, stat.S_ISLNK(info.external_attr >> 16)
        if name.startswith("/") or "\\" in name or ":" in name or any(s in ("", ".", "..") for s in name.split("/")):
            yield name, info.file_size, link, None, "unsafe path"
        elif name in seen:
            yield name, info.file_size, link, None, "duplicate"
        elif link:
            yield name, info.file_size, link, None, "symlink"
        else:
            content, size, problem = _content(archive, info, most_bytes)
            yield name, size, link, content, problem
        seen.add(name)


def package_members(packages: DataFrame, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(package, member, size, is_symlink, content, problem) of ZIP files given by path and content, for packages that fit in a cell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["package", *[c.split()[0] for c in SCHEMA.split(", ")]]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                for row in members_of(io.BytesIO(content or b""), most_bytes):
                    yield pd.DataFrame([(path, *row)], columns=columns)

    return packages.select("path", "content").mapInPandas(run, f"package string, {SCHEMA}")


def _members_udtf(most_bytes: int):
    class PackageMembers:
        def eval(self, path: str):  # noqa: A003
            if path is None:
                return
            import pyarrow.fs as pafs

            system, place = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
            try:
                file = system.open_input_file(place)
            except OSError:
                yield None, None, None, None, "not found"
                return
            with file:
                yield from members_of(file, most_bytes)

    return F.udtf(PackageMembers, returnType=SCHEMA)


def register_package_members(spark: SparkSession, name: str = "package_members", most_bytes: int = MAX_BYTES) -> None:
    """Makes package_members(path) known to SQL: ``SELECT p.path, m.* FROM packages p, LATERAL package_members(p.path) m``.

    Executors read the central directory and then single members by range, from any file system that pyarrow opens (files shared by the
    executors, HDFS, object stores); a package of any size takes the memory of its largest member, at most ``most_bytes``.
    """
    spark.udtf.register(name, _members_udtf(most_bytes))


def read_package_members(packages: DataFrame, path: str = "path", most_bytes: int = MAX_BYTES) -> DataFrame:
    """packages with a row for each member of the ZIP file at ``path``: member, size, is_symlink, content and problem."""
    return packages.lateralJoin(_members_udtf(most_bytes)(F.col(path).outer()))
