"""Manifest paths and manifest lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from netsieve.schemas import SPLITS

# Fixed format of a checksum line: digest, blanks, optional mode mark, path.
CHECKSUM_LINE = r"^([0-9a-fA-F]{64})\s+[* ]?(.+)$"


def normalise_path(path: Column) -> Column:
    """Forward slashes, no leading `./` repetitions."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def path_split(path: Column, splits: tuple[str, ...] = SPLITS) -> Column:
    """Third component of a path if it names a split, else `unknown`."""
    part = F.get(F.split(path, "/"), F.lit(2))
    return F.when(part.isin(*splits), part).otherwise("unknown")


def is_data_path(path: Column, root: str, suffix: str, splits: tuple[str, ...] = SPLITS) -> Column:
    parts = F.split(path, "/")
    return (
        path.startswith(root)
        & (F.size(parts) >= 4)
        & F.get(parts, F.lit(2)).isin(*splits)
        & path.endswith(suffix)
    )


def line_digest(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, CHECKSUM_LINE, 1))


def line_path(line: Column) -> Column:
    return normalise_path(F.trim(F.regexp_extract(line, CHECKSUM_LINE, 2)))
