"""Options of reads, SQL calls and commits.  ``with_*`` methods change the object and return it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


def _given(values, what: str):
    if any(v is None for v in values):
        raise ValueError(f"{what} must not be None")
    return values


@dataclass(frozen=True)
class Sort:
    """One sort key: a column name, or a function of the row.  Nulls come first ascending, last descending."""

    column: str | Callable
    descending: bool = False


@dataclass
class ReadConfig:
    """What a read is to do besides its predicate."""

    properties: list[str] = field(default_factory=list)
    sorting: list[Sort] = field(default_factory=list)
    tag: str | None = None
    no_tracking: bool = False
    ignore_query_filters: bool = False
    sql: str | None = None
    before: Callable = staticmethod(lambda df: df)
    after: Callable = staticmethod(lambda df: df)

    def with_properties(self, *names: str) -> ReadConfig:
        for n in _given(names, "a property"):
            if n not in self.properties:
                self.properties.append(n)
        return self

    def with_sorting(self, *keys: Sort | str) -> ReadConfig:
        for k in _given(keys, "a sort key"):
            k = k if isinstance(k, Sort) else Sort(k)
            if k not in self.sorting:
                self.sorting.append(k)
        return self

    def with_tag(self, tag: str) -> ReadConfig:
        self.tag = _given((tag,), "the tag")[0]
        return self

    def with_no_tracking(self) -> ReadConfig:
        self.no_tracking = True
        return self

    def without_query_filters(self) -> ReadConfig:
        self.ignore_query_filters = True
        return self

    def with_before_customization(self, change: Callable) -> ReadConfig:
        self.before = _given((change,), "the customization")[0]
        return self

    def with_after_customization(self, change: Callable) -> ReadConfig:
        self.after = _given((change,), "the customization")[0]
        return self

    def from_sql_raw(self, sql: str | None) -> ReadConfig:
        self.sql = sql
        return self


@dataclass(frozen=True)
class ParamValue:
    """A parameter of SQL text; without a name it is positional."""

    name: str | None
    value: Any

    @staticmethod
    def create(*args) -> ParamValue:
        """``create(value)`` or ``create(name, value)``."""
        if len(args) not in (1, 2):
            raise TypeError("create(value) or create(name, value)")
        return ParamValue(None, args[0]) if len(args) == 1 else ParamValue(*args)


@dataclass
class SqlConfig:
    """Parameters, tag and timeout (seconds) of a SQL call."""

    positional: list[Any] = field(default_factory=list)
    named: dict[str, Any] = field(default_factory=dict)
    tag: str | None = None
    timeout: int | None = None

    def with_parameters(self, *values) -> SqlConfig:
        """Bare values replace the positional list; ``ParamValue`` objects are merged, the last of a name wins.

        Positional values keep order and repeats; a null value is a parameter like any other, but the
        whole list must not be None.
        """
        if len(values) == 1 and values[0] is None:
            raise ValueError("the parameters must not be None")
        typed = [v for v in values if isinstance(v, ParamValue)]
        bare = [v for v in values if not isinstance(v, ParamValue)]
        if bare or not typed:
            self.positional = list(bare)
        for v in typed:
            if v.name is None:
                self.positional.append(v.value)
            else:
                self.named[v.name.lstrip("@:")] = v.value
        return self

    def with_tag(self, tag: str) -> SqlConfig:
        self.tag = _given((tag,), "the tag")[0]
        return self

    def with_command_timeout(self, seconds: int) -> SqlConfig:
        self.timeout = _given((seconds,), "the timeout")[0]
        return self


@dataclass
class SaveOptions:
    """What a commit records besides the changes."""

    audit: bool = False
    user: Any = None

    def with_audit_metadata(self, user_id) -> SaveOptions:
        self.audit, self.user = True, user_id
        return self

    def is_audit_metadata(self) -> bool:
        return self.audit

    def user_id(self):
        return self.user


def configured(kind, config):
    """An options object from None, an object of that kind, or a function that fills one."""
    if config is None:
        return kind()
    if isinstance(config, kind):
        return config
    made = kind()
    config(made)
    return made
