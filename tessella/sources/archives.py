"""A data source over ZIP archives' directories: members, sizes and checksums, without reading any member.

    spark.dataSource.register(ZipDirectory)
    spark.read.format("zip_directory").option("paths", "\\n".join(paths)).load()

Archives are partitions (several to one if there are many). A reader opens an archive for random access, finds the end record
in its last bytes, and reads the central directory alone, in pieces; archives of 4 GB and more (Zip64) are read alike. What can't be read
gives one row with its reason, after the members before the fault.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
#: Archives of one partition at most, and partitions aimed at.
TOGETHER, PARTITIONS = 64, 512
#: Fixed values of the file format: signatures and record layouts.
END, END64, LOCATOR64, ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_END, _END64, _ENTRY = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4s6H3L5H2L")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

SCHEMA = "archive string, position long, member string, directory boolean, size long, compressed_size long, crc32 long, method int, encrypted boolean, header_offset long, reason string"


class Unreadable(Exception):
    """Why an archive's directory can't be read."""


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def _range(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) < size:
        raise Unreadable("truncated_archive")
    return data


def _directory(f) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory."""
    total = f.size()
    if total < _END.size:
        raise Unreadable("not_a_zip_archive")
    tail = _range(f, max(0, total - _END.size - _FULL16), min(total, _END.size + _FULL16))
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)  # a comment may hold the signature
    if at < 0:
        raise Unreadable("end_record_missing")
    _, disk, first_disk, _, entries, size, offset, _ = _END.unpack_from(tail, at)
    if entries == _FULL16 or size == _FULL32 or offset == _FULL32:
        where = total - len(tail) + at - 20
        locator = _range(f, where, 20) if where >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise Unreadable("zip64_locator_missing")
        record = _range(f, struct.unpack_from("<Q", locator, 8)[0], _END64.size)
        if record[:4] != END64:
            raise Unreadable("zip64_end_record_missing")
        *_, disk, first_disk, _, entries, size, offset = _END64.unpack(record)
    elif disk or first_disk:
        raise Unreadable("multi_volume_archive")
    if offset + size > total:
        raise Unreadable("directory_outside_archive")
    return offset, size, entries


def members(f) -> Iterator[tuple]:
    """(position, member, directory, size, compressed_size, crc32, method, encrypted, header_offset) of an open archive."""
    offset, left, entries = _directory(f)
    held, n = b"", 0
    while left or held:
        while left and len(held) < _ENTRY.size + 3 * _FULL16:
            piece = _range(f, offset, min(PIECE, left))
            held, offset, left = held + piece, offset + len(piece), left - len(piece)
        if len(held) < _ENTRY.size:
            raise Unreadable("truncated_directory")
        sign, _, _, flags, method, _, _, crc, packed, size, a, b, c, _, _, _, header = _ENTRY.unpack_from(held)
        if sign != ENTRY:
            raise Unreadable("unexpected_directory_signature")
        end = _ENTRY.size + a + b + c
        if len(held) < end:
            raise Unreadable("truncated_directory")
        raw, extra = held[_ENTRY.size : _ENTRY.size + a], held[_ENTRY.size + a : _ENTRY.size + a + b]
        if _FULL32 in (packed, size, header):
            at = 0
            while at + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, at)
                if kind == 1:  # 64-bit values, of those fields alone that are full
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                    size, packed, header = (next(values, v) if v == _FULL32 else v for v in (size, packed, header))
                at += 4 + length
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield n, name, name.endswith("/"), size, packed, crc, method, bool(flags & 1), header
        held, n = held[end:], n + 1
    if n != entries:
        raise Unreadable("directory_entry_count_mismatch")


class _Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]

    def partitions(self) -> list[_Archives]:
        step = max(1, min(TOGETHER, len(self.paths) // PARTITIONS))
        return [_Archives(self.paths[i : i + step]) for i in range(0, len(self.paths), step)]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with _opened(path) as f:
                    for row in members(f):
                        yield (path, *row, "")
            except Unreadable as e:
                yield (path, *[None] * 9, str(e))
            except OSError:
                yield (path, *[None] * 9, "archive_unavailable")


class ZipDirectory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
