"""Column functions: identifiers, checksums, formats. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FRAME_BYTES, HTTP_DATE, ID_BYTES, ID_PATTERN, LOOSE_PREFIX


def id_valid(text: Column) -> Column:
    return text.rlike(ID_PATTERN)


def snapshot_id(text: Column) -> Column:
    """struct<pack, tag> of `pack:tag`, split at the last colon after trailing white space; null if a part is missing or the pack's characters are not allowed."""
    plain = F.regexp_replace(text, r"\s+$", "")
    pack, tag = (F.regexp_extract(plain, r"(?s)^(.*):([^:]*)$", i) for i in (1, 2))
    return F.when((pack != "") & (tag != "") & id_valid(pack), F.struct(pack.alias("pack"), tag.alias("tag")))


def is_loose(pack: Column) -> Column:
    return F.startswith(pack, F.lit(LOOSE_PREFIX))


def object_checksum(content: Column) -> Column:
    """Lower hex SHA-1 of the bytes."""
    return F.sha1(content)


def hexed(checksum: Column) -> Column:
    return F.lower(F.hex(checksum))


def loose_path(checksum_hex: Column) -> Column:
    """ab/cd/rest."""
    return F.concat_ws("/", F.substring(checksum_hex, 1, 2), F.substring(checksum_hex, 3, 2), F.substring(checksum_hex, 5, 2 * ID_BYTES))


def loose_checksum(path: Column) -> Column:
    """Lower hex checksum that the last three parts of a path spell; null unless they are 20 bytes of hex."""
    parts = F.split(path, "/")
    text = F.concat(F.element_at(parts, -3), F.element_at(parts, -2), F.element_at(parts, -1))
    return F.when((F.size(parts) >= 3) & text.rlike(f"^[0-9a-fA-F]{{{2 * ID_BYTES}}}$"), F.lower(text))


def octal_mode(mode: Column) -> Column:
    return F.lower(F.conv(mode.cast("string"), 10, 8))


def format_size(size: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more, to three decimals, trailing zeros dropped."""
    units = ["B", "K", "M", "G", "T"]
    out = None
    for k in reversed(range(len(units))):
        text = F.regexp_replace(F.format_string("%.3f", F.round(size.cast("double") / float(1024**k), 3)), r"\.?0+$", "")
        text = F.concat(text, F.lit(units[k]))
        out = text if out is None else F.when(size < 1024 ** (k + 1), text).otherwise(out)
    return out


def formatted(template: str, fields: list[tuple[str, Column]]) -> Column:
    """Replaces the keys one after another, so a value that spells a later key is replaced too."""
    out = F.lit(template)
    for key, value in fields:
        out = F.replace(out, F.lit(key), value.cast("string"))
    return out


def pack_file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def http_date(at: Column) -> Column:
    return F.date_format(at, HTTP_DATE)


def last_modified(created: Column, modified: Column) -> Column:
    return F.greatest(created, modified)


def frame_hint(total: Column) -> Column:
    return F.expr("1").cast("long") * F.floor((total + (FRAME_BYTES - 1)) / FRAME_BYTES).cast("long")


def function_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_+-]", "_")


def without_version(name: Column) -> Column:
    return F.regexp_replace(name, "-[0-9]+$", "")
