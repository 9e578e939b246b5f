"""Rows that can be edited: a unit of work notices the first edit, so rows that are only read cost it nothing."""

from __future__ import annotations

from pyspark.sql import Row


class Item:
    """A row of a unit of work, by attribute or key, like a ``Row``; an edit is saved by the next commit."""

    __slots__ = ("_values", "_tracker", "_version")

    def __init__(self, values: dict, tracker, version: int):
        object.__setattr__(self, "_values", values)
        object.__setattr__(self, "_tracker", tracker)
        object.__setattr__(self, "_version", version)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name):
        return list(self._values.values())[name] if isinstance(name, int) else self._values[name]

    def __setitem__(self, name: str, value) -> None:
        if name not in self._values:
            raise KeyError(name)
        self._tracker(self, name)
        self._values[name] = value

    def __setattr__(self, name: str, value) -> None:
        try:
            self[name] = value
        except KeyError:
            raise AttributeError(name) from None

    def __iter__(self):
        return iter(self._values.values())

    def __len__(self) -> int:
        return len(self._values)

    def __contains__(self, name: str) -> bool:
        return name in self._values

    def __eq__(self, other) -> bool:
        return isinstance(other, (Item, Row, dict)) and self.asDict() == as_dict(other)

    __hash__ = None

    def __repr__(self) -> str:
        return f"Item({', '.join(f'{k}={v!r}' for k, v in self._values.items())})"

    def asDict(self, recursive: bool = True) -> dict:  # noqa: N802 - as rows have it
        return {k: v.asDict(True) if recursive and isinstance(v, Row) else v for k, v in self._values.items()}


def as_dict(item) -> dict:
    return item.asDict(recursive=True) if isinstance(item, (Row, Item)) else dict(item)
