"""ZIP archives from bytes or ranges of files: listing, bounded reads, typed errors.

A source has a ``size`` and reads ranges; the directory is found from the file's end, and an entry costs its own range.

Duplicate names, trailing comments and over-inflating entries follow fixed rules, so the reader is our own; only raw
inflate comes from zlib."""

from __future__ import annotations

import struct
import zlib

_LIMIT = 2**53 - 1
#: Record signatures and sizes of the ZIP format.
_END, _LOCATOR, _END64, _CENTRAL, _LOCAL = 0x06054B50, 0x07064B50, 0x06064B50, 0x02014B50, 0x04034B50


class ArchiveError(Exception):
    """kind: format, missing, encrypted, unsupported, corrupt or truncated."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Bytes:
    """A source over bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


class Counted:
    """A source that remembers how many bytes were read, and the last range: what lies in it is not read again."""

    def __init__(self, source):
        self.source, self.size, self.bytes, self._at, self._held = source, source.size, 0, 0, b""

    def read(self, at: int, size: int) -> bytes:
        if not self._at <= at <= at + size <= self._at + len(self._held):
            self._at, self._held = at, self.source.read(at, size)
            self.bytes += len(self._held)
        return self._held[at - self._at : at - self._at + size]


def _span(source, at: int, size: int) -> bytes:
    if at < 0 or at + size > source.size:
        raise ArchiveError("truncated", f"{size} bytes at {at} reach beyond the end")
    data = source.read(at, size)
    if len(data) != size:
        raise ArchiveError("truncated", f"{len(data)} of {size} bytes at {at} came")
    return data


def _safe(value: int) -> int:
    if value > _LIMIT:
        raise ArchiveError("format", "a 64-bit field is out of range")
    return value


#: So much of a file's end is looked at first, and at most (an end record and its longest comment).
_PROBES = (1024, 22 + 0xFFFF)


def _end_record(tail: bytes) -> int:
    """Place of the last end record whose comment ends the file; -1 without one."""
    at, mark = len(tail) - 22, struct.pack("<I", _END)
    while at >= 0 and (at := tail.rfind(mark, 0, at + 4)) != -1:
        if at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            return at
        at -= 1
    return -1


def directory(source) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory."""
    if source.size < 22:
        raise ArchiveError("format", "too small for an archive")
    for probe in _PROBES:
        base = max(0, source.size - probe)
        tail = _span(source, base, source.size - base)
        at = _end_record(tail)
        if at != -1 or not base:
            break
    if at == -1:
        raise ArchiveError("format", "no end of central directory")
    if base + at >= 20 and struct.unpack("<I", (locator := _span(source, base + at - 20, 20))[:4])[0] == _LOCATOR:
        _, _, where, disks = struct.unpack("<IIQI", locator)
        if disks > 1:
            raise ArchiveError("format", "several disks")
        record = _span(source, _safe(where), 56)
        if struct.unpack_from("<I", record)[0] != _END64:
            raise ArchiveError("format", "the zip64 record is missing")
        entries, size, offset = map(_safe, struct.unpack_from("<QQQ", record, 32))
        return offset, size, entries
    disk, first, _, entries, size, offset = struct.unpack_from("<HHHHII", tail, at + 4)
    if disk or first:
        raise ArchiveError("format", "several disks")
    if entries == 0xFFFF or 0xFFFFFFFF in (size, offset):
        raise ArchiveError("format", "zip64 fields without a locator")
    return offset, size, entries


def entries(data) -> list[dict]:
    """Of bytes or a source: one dict per central record, in order; masked sizes come from the zip64 extra field."""
    source = Bytes(data) if isinstance(data, (bytes, bytearray)) else data
    offset, size, count = directory(source)
    table, at, out = _span(source, offset, size), 0, []
    for ord_ in range(count):
        if at + 46 > len(table) or struct.unpack_from("<I", table, at)[0] != _CENTRAL:
            raise ArchiveError("format", f"bad record {ord_}")
        flags, method = struct.unpack_from("<HH", table, at + 8)
        crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", table, at + 16)
        (local,) = struct.unpack_from("<I", table, at + 42)
        end = at + 46 + n_name + n_extra + n_comment
        if end > len(table):
            raise ArchiveError("format", f"record {ord_} is cut off")
        fields = {"full": full, "packed": packed, "local": local}
        for tag, body in _extras(table[at + 46 + n_name : at + 46 + n_name + n_extra]):
            masked = [k for k, v in fields.items() if v == 0xFFFFFFFF]
            if tag == 1 and len(body) >= 8 * len(masked):
                fields |= {k: _safe(struct.unpack_from("<Q", body, 8 * i)[0]) for i, k in enumerate(masked)}
        name = table[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        out.append({"ord": ord_, "name": name, "method": method, "encrypted": bool(flags & 1), "crc32": crc, "compressed_size": fields["packed"], "uncompressed_size": fields["full"], "offset": fields["local"]})
        at = end
    return out


def _extras(raw: bytes):
    at = 0
    while at + 4 <= len(raw):
        tag, size = struct.unpack_from("<HH", raw, at)
        if at + 4 + size > len(raw):
            return
        yield tag, raw[at + 4 : at + 4 + size]
        at += 4 + size


def read(data, entry: dict) -> bytes:
    source = Bytes(data) if isinstance(data, (bytes, bytearray)) else data
    if entry["encrypted"]:
        raise ArchiveError("encrypted", entry["name"])
    head = _span(source, entry["offset"], 30)
    if struct.unpack_from("<I", head)[0] != _LOCAL:
        raise ArchiveError("format", f"{entry['name']} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    packed = _span(source, entry["offset"] + 30 + n_name + n_extra, entry["compressed_size"])
    if entry["method"] == 0:
        out = packed
    elif entry["method"] == 8:
        try:
            out = zlib.decompressobj(-15).decompress(packed, entry["uncompressed_size"] + 1)  # one byte more shows an overrun
        except zlib.error as e:
            raise ArchiveError("corrupt", f"{entry['name']}: {e}") from e
    else:
        raise ArchiveError("unsupported", f"method {entry['method']}")
    if len(out) != entry["uncompressed_size"] or zlib.crc32(out) != entry["crc32"]:
        raise ArchiveError("corrupt", f"{entry['name']} has another length or checksum")
    return out


class Archive:
    """Entries by name; of equal names the first record wins."""

    def __init__(self, data: bytes):
        self.data, self.entries = data, entries(data)
        self.by_name: dict[str, dict] = {}
        for e in self.entries:
            self.by_name.setdefault(e["name"], e)

    def read(self, name: str) -> bytes:
        if name not in self.by_name:
            raise ArchiveError("missing", name)
        return read(self.data, self.by_name[name])
