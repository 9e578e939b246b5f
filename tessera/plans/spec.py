"""Predicates: specifications, and the row proxy through which they reach columns and navigations."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as PlainColumn

if TYPE_CHECKING:
    from .planner import Scope


class Specification:
    """A reusable predicate; subclasses give ``satisfied_by(row) -> Column``."""

    def satisfied_by(self, row) -> Column:
        raise NotImplementedError

    def __and__(self, other: Specification) -> Specification:
        return Where(lambda r: self.satisfied_by(r) & other.satisfied_by(r))

    def __or__(self, other: Specification) -> Specification:
        return Where(lambda r: self.satisfied_by(r) | other.satisfied_by(r))

    def __invert__(self) -> Specification:
        return Where(lambda r: ~self.satisfied_by(r))


class Where(Specification):
    """A specification made of a function of the row."""

    def __init__(self, predicate: Callable[[Row], Column]):
        self.predicate = predicate

    def satisfied_by(self, row) -> Column:
        return self.predicate(row)


class Row:
    """Columns of an entity as attributes; to-one navigations lead to the target's row, to-many ones to a set.

    Names that collide with attributes of this class are reached as ``row["name"]``.
    """

    def __init__(self, scope: Scope, entity, path: tuple[str, ...] = ()):
        self._scope, self._entity, self._path = scope, entity, path

    def __getitem__(self, name: str):
        nav = self._entity.navigations.get(name)
        if nav is None:
            return self._scope.column(self._path, name)
        if nav.kind == "one":
            return Row(self._scope, self._scope.catalog.entity(nav.target), (*self._path, name))
        if self._path:
            raise ValueError("a to-many navigation is reached from the entity itself only")
        return Related(self._scope, nav)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


class Test(PlainColumn):
    """A conjunction that holds tests of related rows: a column like any other, whose parts the planner can take apart.

    ``sets`` are (flag column, whether it is negated), ``others`` the remaining conjuncts.  Anything but ``&`` and the
    negation of a single test makes a plain column of it.
    """

    def __new__(cls, column, sets=(), others=()):
        return object.__new__(cls)

    def __init__(self, column, sets=(), others=()):
        super().__init__(column._jc)
        self.sets, self.others = tuple(sets), tuple(others)

    def __and__(self, other):
        sets, others = (other.sets, other.others) if isinstance(other, Test) else ((), (other,))
        return Test(PlainColumn.__and__(self, other), self.sets + sets, self.others + others)

    def __rand__(self, other):
        return Test(PlainColumn.__and__(other, self), self.sets, (other, *self.others))

    def __invert__(self):
        plain = PlainColumn.__invert__(self)
        if self.others or len(self.sets) != 1:
            return plain
        name, negated = self.sets[0]
        return Test(plain, ((name, not negated),))


class Related:
    """The rows that a to-many navigation leads to."""

    def __init__(self, scope: Scope, nav):
        self._scope, self._nav = scope, nav

    def any(self, predicate=None) -> Column:
        """True where some related row satisfies the predicate (without: where one exists)."""
        return self._scope.exists(self._nav, predicate)

    def none(self, predicate=None) -> Column:
        return ~self.any(predicate)


def as_column(predicate, row: Row) -> Column:
    """A boolean column of a specification, function of the row, column or SQL text."""
    if isinstance(predicate, Specification):
        return predicate.satisfied_by(row)
    if isinstance(predicate, Column):
        return predicate
    if isinstance(predicate, str):
        return F.expr(predicate)
    if callable(predicate):
        return predicate(row)
    raise TypeError(f"not a predicate: {predicate!r}")
