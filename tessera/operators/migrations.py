"""Migrations: functions of a unit of work, marked with a title and a date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Migration:
    title: str
    when: dt.datetime
    action: Callable


REGISTRY: list[Migration] = []


def migration(title: str, year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0):
    """Register the decorated function as a migration."""

    def mark(action: Callable) -> Callable:
        if any(m.title == title for m in REGISTRY):
            raise ValueError(f"migration {title!r} exists")
        REGISTRY.append(Migration(title, dt.datetime(year, month, day, hour, minute, second), action))
        return action

    return mark
