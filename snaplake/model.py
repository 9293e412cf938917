"""Tables and errors of a snapshot lake.

A snapshot is a set of (path, object, mode) rows; a pack holds an ordered series of snapshots as a log of
added and removed rows; objects are named by the SHA-1 of their content.
"""

from __future__ import annotations

from pyspark.sql import types as T

_long, _string, _binary, _int = T.LongType(), T.StringType(), T.BinaryType(), T.IntegerType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SNAPSHOTS = _table(pack=_string, seq=_int, tag=_string)
#: A row is keyed by path (any bytes), checksum (lower hex) and mode together; op is 'A' (added) or 'R' (removed) against the snapshot before.
CHANGES = _table(pack=_string, seq=_int, op=_string, path=_binary, checksum=_string, mode=_long, size=_long)
OBJECTS = _table(pack=_string, checksum=_string, offset=_long, size=_long)
FRAMES = _table(pack=_string, frame=_int, frame_size=_long, decompressed_size=_long, path=_string, start=_long)
#: Fingerprints of snapshots, told once when they are written.
PRINTS = _table(pack=_string, seq=_int, tag=_string, fingerprint=_string)
TABLES = {"snapshots": SNAPSHOTS, "changes": CHANGES, "objects": OBJECTS, "frames": FRAMES, "prints": PRINTS}
LOOSE = _table(checksum=_string, size=_long, content=_binary)
WORKTREE = _table(path=_binary, content=_binary, size=_long, mode=_long, last_modified=T.TimestampType(), readable=T.BooleanType())

# What stored repositories rely on.
DEFAULT_MODE = 0o100664
LOOSE_PREFIX = "loose/"
ID_PATTERN = "^[A-Za-z0-9_/-]*$"
ID_BYTES = 20
NO_OBJECT = "0" * 40  # an unreadable file of no bytes
FRAME_BYTES = 512 * 1024 * 1024
COMPRESSION_LEVEL = 10
WINDOW_LOG = 28
WINDOW_LOG_MAX = 30
SKIPPABLE_MAGIC = 0x184D2A50
HTTP_DATE = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"


class LakeError(Exception):
    """Any error of the lake."""


class BadIdentifier(LakeError): ...


class SnapshotNotFound(LakeError): ...


class SnapshotAlreadyExists(LakeError): ...


class AmbiguousSnapshot(LakeError): ...


class PackNotFound(LakeError): ...


class PathNotFound(LakeError): ...


class ObjectNotFound(LakeError): ...


class CorruptPack(LakeError): ...


class CorruptHead(LakeError): ...


class CorruptLog(LakeError): ...


class InUse(LakeError): ...


class DirtyWorkDir(LakeError): ...


class ReadOnly(LakeError): ...


class BadRemoteIndex(LakeError): ...
