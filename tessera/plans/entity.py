"""Entity descriptors: what a table is called, how its rows are told apart and what they lead to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

ONE, MANY = "one", "many"


@dataclass(frozen=True)
class Navigation:
    """A way from one entity to another, by equal columns (own, target)."""

    target: str
    kind: str
    on: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if self.kind not in (ONE, MANY) or not self.on:
            raise ValueError("a navigation is 'one' or 'many' and has columns")


@dataclass(frozen=True)
class Entity:
    """A table, its key, navigations, default predicate and audit columns."""

    name: str
    key: tuple[str, ...] = ()
    navigations: dict[str, Navigation] = field(default_factory=dict)
    query_filter: Callable | None = None
    updated_by: str = "updated_by"
    updated_at: str = "updated_at"
    created_by: str = "created_by"
    created_at: str = "created_at"

    def navigation(self, name: str) -> Navigation:
        if name not in self.navigations:
            raise KeyError(f"{self.name} has no navigation {name!r}")
        return self.navigations[name]
