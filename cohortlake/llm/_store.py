"""Tables written once and read back (from the library's own store), and names for working columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..store import shared_folder, shuffles_freed, stored, stored_by

__all__ = ["shared_folder", "shuffles_freed", "stored", "stored_by", "unused"]


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores added until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
