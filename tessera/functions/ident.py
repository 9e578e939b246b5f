"""Sequential GUIDs: random, but ordered by time in their last two groups."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns ticks from year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000
#: 8-4-4-4-12 hexadecimal digits, in braces or not.
GUID_PATTERN = r"^(\{[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def sequential_guid(ticks: int | None = None) -> str:
    """A new GUID; the last group holds the high 48 bits of the ticks, the fourth the low 16."""
    ticks = time.time_ns() // 100 + EPOCH_TICKS if ticks is None else ticks
    h, t = uuid.uuid4().hex, f"{ticks & (2**64 - 1):016x}"
    return f"{h[:8]}-{h[8:12]}-c{h[13:16]}-{t[12:]}-{t[:12]}"


def sequential_guid_column(ticks: Column | None = None) -> Column:
    """The same as an expression, for a column of ticks or the query's time."""
    if ticks is None:
        ticks = F.unix_micros(F.current_timestamp()) * 10 + F.lit(EPOCH_TICKS)
    h, t = F.uuid(), F.lower(F.lpad(F.hex(ticks), 16, "0"))
    return F.concat(F.substring(h, 1, 14), F.lit("c"), F.substring(h, 16, 4), F.substring(t, 13, 4), F.lit("-"), F.substring(t, 1, 12))


def time_order(guid: Column) -> tuple[Column, Column]:
    """Sort keys that put sequential GUIDs in order of time."""
    return F.substring(guid, 25, 12), F.substring(guid, 20, 4)


def is_guid(value: Column) -> Column:
    return value.rlike(GUID_PATTERN)
