"""Identifiers that are functions of their inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def spec_id(file_id: Column, section_id: Column, text: Column) -> Column:
    return F.concat(F.lit("spec-"), F.substring(F.sha1(F.concat_ws(":", file_id, section_id, text)), 1, 12))


def leaf_spec_id(file_id: Column, section_id: Column, index: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", file_id, section_id, index.cast("string"), text))


def header_section_id(upload: Column, number: Column, name: Column) -> Column:
    return F.sha1(F.concat_ws("|", upload, number, name))


def section_line_id(section_id: Column, line: Column) -> Column:
    return F.sha1(F.concat_ws("|", section_id, line))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), 1, 1)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def header_id(page: Column, line: Column, title: Column) -> Column:
    return uuid5(F.concat_ws(":", page.cast("string"), line.cast("string"), title))


def numbered(file_id: Column, kind: str, n: Column, width: int = 6) -> Column:
    """``file-kind-000001``: object and section ids."""
    return F.format_string(f"%s-{kind}-%0{width}d", file_id, n)
