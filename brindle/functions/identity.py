"""Identity functions: keys that join the tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name space of chunk ids (OID) as hex digits.
OID_SPACE = "6ba7b8129dad11d180b400c04fd430c8"


def file_id(project: Column, path: Column) -> Column:
    return F.md5(F.concat_ws("_", project, path).cast("binary"))


def web_file_id(project: Column, url: Column) -> Column:
    return F.md5(F.concat(project, F.lit("_web_"), url).cast("binary"))


def text_file_id(project: Column, title: Column) -> Column:
    return F.md5(F.concat(project, F.lit("_text_"), title).cast("binary"))


def uuid5(name: Column, space: str = OID_SPACE) -> Column:
    """RFC 4122 version 5: SHA-1 of name space and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(19, 2), F.lit("-"), h.substr(21, 12))


def chunk_id(file: Column, index: Column) -> Column:
    return uuid5(F.concat(file, F.lit("__chunk_"), index.cast("string")))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def community_id(project: Column, names: Column) -> Column:
    return F.concat(project, F.lit("_comm_"), F.md5(F.array_join(F.array_sort(names), ",").cast("binary")))


def cache_key(*parts: Column, files: Column) -> Column:
    return F.xxhash64(F.concat_ws(":", *parts, F.array_join(F.array_sort(files), ",")))
