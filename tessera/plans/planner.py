"""The one place that turns entity, predicate, options and page into a lazy DataFrame.

Order: source, query filters, before-hook, predicate, after-hook, sort, page, includes.  Navigations
that a predicate or sort key uses are joined before paging; includes are joined to the page only,
and to-many includes are aggregated before they are joined, so parents never multiply.  Of a page, only the
related rows of its keys are aggregated.  Tests of related rows that are conjuncts become semi and anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import ReadConfig
from .entity import MANY, Entity, Navigation
from .spec import Row, Test, as_column

#: Number of the first page.
FIRST_PAGE = 0
#: Rows of a page whose keys are broadcast at most.
BROADCAST_PAGE = 100_000


class Scope:
    """Collects the joins that predicates and sort keys of one query need."""

    def __init__(self, catalog, entity: Entity):
        self.catalog, self.entity = catalog, entity
        self.paths: list[tuple[str, ...]] = []
        self.sets: list[tuple[str, Navigation, object]] = []

    def column(self, path: tuple[str, ...], name: str) -> Column:
        for n in range(1, len(path) + 1):
            if path[:n] not in self.paths:
                self.paths.append(path[:n])
        return F.col(f"`{self.joined_name(path)}`.`{name}`") if path else F.col(f"`{name}`")

    @staticmethod
    def joined_name(path: tuple[str, ...]) -> str:
        return "__nav_" + "_".join(path)

    def exists(self, nav: Navigation, predicate) -> Column:
        name = f"__any_{len(self.sets)}"
        self.sets.append((name, nav, predicate))
        return Test(F.coalesce(F.col(name), F.lit(False)), ((name, False),))

    def related(self, name: str, nav: Navigation, predicate) -> tuple[DataFrame, Column]:
        """Keys of the related rows that satisfy the predicate, and the condition that joins them."""
        target = self.catalog.read(nav.target)
        if predicate is not None:
            target = plan_filter(self.catalog, self.catalog.entity(nav.target), target, predicate)
        keys = [F.col(t).alias(f"{name}_{i}") for i, (_, t) in enumerate(nav.on)]
        cond = F.col(nav.on[0][0]) == F.col(f"{name}_0")
        for i in range(1, len(nav.on)):
            cond = cond & (F.col(nav.on[i][0]) == F.col(f"{name}_{i}"))
        return target.select(*keys), cond

    def filter(self, df: DataFrame, column: Column) -> DataFrame:
        """Rows for which ``column`` is true: its tests of related rows by semi and anti joins, the rest by flags."""
        columns = df.columns
        if isinstance(column, Test):
            rest = " ".join(c._jc.toString() for c in column.others if isinstance(c, Column))
            alone = {n: negated for n, negated in column.sets if n not in rest}
            if len(alone) == len(column.sets):  # none is used twice
                own = [s for s in self.sets if s[0] in alone]
                self.sets = [s for s in self.sets if s[0] not in alone]
                df = self.join(df)
                for c in column.others:
                    df = df.where(c)
                for name, nav, predicate in own:
                    target, cond = self.related(name, nav, predicate)
                    df = df.join(target, cond, "left_anti" if alone[name] else "left_semi")
                return df.select(*columns)
        if not self.paths and not self.sets:
            return df.where(column)
        return self.join(df).where(column).select(*columns)

    def join(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that the collected navigations need, one row per row."""
        for path in self.paths:
            owner = self.entity
            for step in path[:-1]:
                owner = self.catalog.entity(owner.navigation(step).target)
            nav = owner.navigation(path[-1])
            name = self.joined_name(path)
            target = self.catalog.read(nav.target)
            keys = [F.col(t).alias(f"{name}_{i}") for i, (_, t) in enumerate(nav.on)]
            target = target.select(F.struct(*target.columns).alias(name), *keys)
            own = [self.column(path[:-1], o) for o, _ in nav.on]
            cond = own[0] == F.col(f"{name}_0")
            for i in range(1, len(own)):
                cond = cond & (own[i] == F.col(f"{name}_{i}"))
            df = df.join(target, cond, "left").drop(*[f"{name}_{i}" for i in range(len(own))])
        for name, nav, predicate in self.sets:
            target, cond = self.related(name, nav, predicate)
            df = df.join(target.distinct().withColumn(name, F.lit(True)), cond, "left").drop(*target.columns)
        return df


def plan_filter(catalog, entity: Entity, df: DataFrame, predicate) -> DataFrame:
    """The rows of ``df`` for which the predicate is true; null counts as false."""
    scope = Scope(catalog, entity)
    return scope.filter(df, as_column(predicate, Row(scope, entity)))


def plan_source(catalog, entity: Entity, config: ReadConfig) -> DataFrame:
    df = catalog.sql(config.sql) if config.sql is not None else catalog.read(entity.name)
    if entity.query_filter is not None and not config.ignore_query_filters:
        df = plan_filter(catalog, entity, df, entity.query_filter)
    return config.before(df)


def plan_sorted(catalog, entity: Entity, df: DataFrame, config: ReadConfig, limit: int | None, offset: int) -> DataFrame:
    """Sorted, with the key as last sort key where rows are cut off, so results are the same each time."""
    scope = Scope(catalog, entity)
    row = Row(scope, entity)
    keys, named = [], set()
    for s in config.sorting:
        if isinstance(s.column, str):
            named.add(s.column)
            c = scope.column((), s.column)
        else:
            c = s.column(row)
        keys.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
    cut = limit is not None or offset
    if cut:
        keys += [F.col(f"`{k}`").asc_nulls_first() for k in (entity.key or df.columns) if k not in named and k in df.columns]
    columns = df.columns
    df = scope.join(df)
    if keys:
        df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns)


def include(catalog, entity: Entity, df: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    """``df`` with a struct (to-one, null if there is none) or array of structs (to-many) for each navigation.

    If ``df`` is a page of at most ``limit`` rows, its keys go to all tasks and only related rows of theirs are
    shuffled; the page is cut the same each time, as its sort keys are total.
    """
    page = df
    for name in names:
        nav = entity.navigation(name)
        target = catalog.read(nav.target)
        keys = [f"__key_{i}" for i in range(len(nav.on))]
        target = target.select(F.struct(*target.columns).alias(name), *[F.col(t).alias(k) for k, (_, t) in zip(keys, nav.on, strict=True)])
        if limit is not None and limit <= BROADCAST_PAGE:
            wanted = page.select(*[F.col(own).alias(k) for k, (own, _) in zip(keys, nav.on, strict=True)])
            target = target.join(F.broadcast(wanted), keys, "left_semi").select(name, *keys)
        if nav.kind == MANY:
            target = target.groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias(name))
        cond = None
        for k, (own, _) in zip(keys, nav.on, strict=True):
            c = df[own] == target[k]
            cond = c if cond is None else cond & c
        columns = [df[c] for c in df.columns]
        value = target[name]
        if nav.kind == MANY:
            value = F.coalesce(value, F.array().cast(target.schema[name].dataType))
        df = df.join(target, cond, "left").select(*columns, value.alias(name))
    return df


def plan(catalog, entity: Entity, config: ReadConfig, predicate=None, limit: int | None = None, offset: int = 0, includes: bool = True) -> DataFrame:
    """The whole read as one lazy plan."""
    df = plan_source(catalog, entity, config)
    if predicate is not None:
        df = plan_filter(catalog, entity, df, predicate)
    df = config.after(df)
    df = plan_sorted(catalog, entity, df, config, limit, offset)
    return include(catalog, entity, df, config.properties, limit) if includes else df


def page_offset(index: int, size: int) -> int:
    if index < FIRST_PAGE or size <= 0:
        raise ValueError("page index must not be negative and page size must be positive")
    return (index - FIRST_PAGE) * size
