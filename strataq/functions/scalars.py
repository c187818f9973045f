"""Scalar functions on names, paths, bytes and numbers; built-ins except where none exists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_BYTES, PATH_BYTES = 255, 4096
MODE_MASK = 0o1777


def path_parts(path: Column) -> Column:
    """Components of an absolute path; empty ones are dropped, and a trailing slash adds a dot. Null if not absolute."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    dotted = F.when(path.endswith("/") & (F.size(parts) > 0), F.concat(parts, F.array(F.lit(".")))).otherwise(parts)
    return F.when(path.startswith("/"), dotted)


def link_parts(target: Column) -> Column:
    """Components of a link target, which may be relative."""
    return F.filter(F.split(target, "/"), lambda x: x != "")


def path_join(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat_ws("/", parent, name))


def dirname(path: Column) -> Column:
    return F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def valid_name(name: Column) -> Column:
    """Names of 1 to 255 bytes without slash or NUL, except the two dots; control characters are allowed."""
    return (F.octet_length(name) >= 1) & (F.octet_length(name) <= NAME_BYTES) & ~name.contains("/") & ~name.contains("\0") & ~name.isin(".", "..")


def valid_path(path: Column) -> Column:
    return path.startswith("/") & (F.octet_length(path) <= PATH_BYTES) & ~path.contains("\0")


def valid_label(name: Column) -> Column:
    """Names of attributes and volumes: as names, but without control characters."""
    return valid_name(name) & ~name.rlike(r"[\x00-\x1f\x7f]")


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """The bytes of lower-case hex; null for anything else or an odd number of digits."""
    return F.when(text.rlike("^([0-9a-f]{2})*$"), F.unhex(text))


def is_inode_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{32}$")


def little_endian(data: Column, bytes_: int) -> Column:
    """The unsigned number in the first bytes, the least significant first; null if there are too few."""
    h = F.hex(data)
    turned = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(bytes_))))
    return F.when(F.octet_length(data) >= bytes_, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def to_little_endian(number: Column, bytes_: int) -> Column:
    h = F.lpad(F.hex(number), 2 * bytes_, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(bytes_)))))


def json_quoted(text: Column) -> Column:
    """A JSON string literal with the short escapes for quote and backslash only, other controls as numbers."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def prefix_end(prefix: str) -> bytes | None:
    """The smallest byte string above all that start with ``prefix``; none if all bytes are 255."""
    data = prefix.encode().rstrip(b"\xff")
    return data[:-1] + bytes([data[-1] + 1]) if data else None


def chunk_key(idx: Column) -> Column:
    """Sortable text of a chunk index: four digits below 1024, then x and eight."""
    return F.when(idx < 1024, F.lpad(idx.cast("string"), 4, "0")).otherwise(F.concat(F.lit("x"), F.lpad(idx.cast("string"), 8, "0")))


def strict_int(text: Column) -> Column:
    """A whole string of digits as a number; null for anything else or too large a number."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def octal(text: Column) -> Column:
    return F.when(text.rlike("^[0-7]+$"), F.conv(text, 8, 10).cast("long"))


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def valid_mode(mode: Column) -> Column:
    return mode.bitwiseAND(~MODE_MASK) == 0


def ceil_512(size: Column) -> Column:
    return F.ceil(size / 512).cast("long") * 512


def excluded(path: Column, names: list[str]) -> Column:
    """Whether any component is one of ``names``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def checked_add(a: Column, b: Column) -> Column:
    """The sum, or null where it does not fit in 64 bits."""
    return F.try_add(a, b)


def seek_position(base: Column, offset: Column) -> Column:
    """A struct of position and error: a position below 0 is ``EINVAL``, one beyond 64 bits ``EOVERFLOW``."""
    to = F.try_add(base, offset)
    error = F.when(to.isNull(), "EOVERFLOW").when(to < 0, "EINVAL")
    return F.struct(F.when(error.isNull(), to).alias("position"), error.alias("error"))


def unit_key(key: Column) -> Column:
    """The key of the unit that a record is merged with: content, chunks and attributes go with their inode."""
    inode = F.regexp_extract(key, "^(?:content|chunk|xattr)/([0-9a-f]{32})(?:/|$)", 1)
    return F.when(inode != "", F.concat(F.lit("inode/"), inode)).otherwise(key)


def sharded_path(oid: Column) -> Column:
    """Where an object lies: two levels of folders by its first hex digits."""
    return F.concat_ws("/", F.substring(oid, 1, 2), F.substring(oid, 3, 2), oid)


def priority(key: Column) -> Column:
    """A number that follows from the key's content alone."""
    return F.sha2(F.concat(F.lit("priority:"), key), 256)


def canonical_hash(*columns: str) -> Column:
    """A hash of named values in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def estimate_bytes(entries: Column) -> Column:
    return entries * 308


def minute_text(seconds: Column) -> Column:
    """The minute in UTC; years have four digits, or as many as they need without a plus, and those before year 0 a minus and no zeros."""
    at = F.timestamp_seconds(seconds)
    year = F.when(F.year(at).between(0, 9999), F.date_format(at, "yyyy")).otherwise(F.year(at).cast("string"))
    return F.concat(year, F.date_format(at, "-MM-dd HH:mm"))


def _crc32c_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_TABLE = np.array(_crc32c_table(), np.uint32)


def _crc32c(data: pd.Series) -> pd.Series:
    """One step of the table for the n-th byte of all values that have one."""
    known = data.notna().to_numpy()
    values = [bytes(x) for x in data[known]]
    size = np.array([len(x) for x in values], np.int64)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    flat, crc = np.frombuffer(b"".join(values), np.uint8), np.full(len(values), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for i, n in enumerate(live.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ flat[start[:n] + i]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    found = np.empty(len(values), np.int64)
    found[order] = crc ^ np.uint32(0xFFFFFFFF)
    out = pd.Series([None] * len(data), dtype="Int64")
    out[known] = found
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) of bytes, by an Arrow-batched function; Spark's own crc32 has another polynomial."""
    return F.pandas_udf(_crc32c, "long")(data)
