"""Repositories: the read groups and write operations of one entity, each read with a lazy ``*_df`` twin."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.config import ReadConfig, configured
from tessera.plans.entity import Entity
from tessera.plans.planner import Scope, page_offset, plan
from tessera.plans.ranks import ahead, named, ordering, same, sort_keys, total, with_rank
from tessera.plans.spec import Row as RowProxy

from .uow import MultipleResultsError, UnitOfWork


@dataclass(frozen=True)
class Page:
    """One page of a result and how many rows there are in all."""

    items: DataFrame
    total: int
    index: int
    size: int


@contextmanager
def tagged(spark, tag: str | None):
    """Jobs started in the block carry the tag and show it as their description."""
    if tag is None:
        yield
        return
    sc = spark.sparkContext
    safe = tag.replace(",", " ")
    sc.addJobTag(safe)
    sc.setJobDescription(tag)
    try:
        yield
    finally:
        sc.removeJobTag(safe)
        sc.setJobDescription(None)


class Repository:
    """Reads and writes of one entity; predicates are specifications, functions of the row, columns or SQL text."""

    def __init__(self, catalog, entity: Entity, uow: UnitOfWork | None = None):
        self.catalog, self.entity, self.uow = catalog, entity, uow
        self.spark = catalog.spark

    def __enter__(self) -> Repository:
        return self

    def __exit__(self, *_) -> None:
        self.dispose()

    def dispose(self) -> None:
        if self.uow is not None:
            self.uow.dispose()

    @property
    def unit_of_work(self) -> UnitOfWork:
        if self.uow is None:
            raise RuntimeError("this repository is read-only")
        return self.uow

    # plans

    def _plan(self, config, predicate=None, limit=None, offset=0, includes=True) -> DataFrame:
        return plan(self.catalog, self.entity, configured(ReadConfig, config), predicate, limit, offset, includes)

    def _mapped(self, config, predicate, columns, limit=None) -> DataFrame:
        """Projection after sort and cut, so columns that only sort keys need are pruned from the output."""
        df = self._plan(config, predicate, limit)
        if callable(columns):
            columns = columns(RowProxy(Scope(self.catalog, self.entity), self.entity))
        columns = columns if isinstance(columns, (list, tuple)) else [columns]
        return df.select(*columns)

    def _rows(self, df: DataFrame, config) -> list:
        """The rows; of a unit of work, unless reads are not to be tracked, as items whose edits the next commit saves."""
        made = configured(ReadConfig, config)
        version = self.uow.snapshot() if self.uow is not None else None
        with tagged(self.spark, made.tag):
            rows = df.collect()
        if self.uow is None or made.no_tracking or not self.entity.key or not set(self.entity.key) <= set(df.columns):
            return rows
        return [self.uow.tracked(self.entity.name, r, version) for r in rows]

    def _one(self, df: DataFrame, config):
        rows = self._rows(df, config)
        return rows[0] if rows else None

    # all, filtered, mapped

    def get_all_df(self, config=None) -> DataFrame:
        return self._plan(config)

    def get_all(self, config=None) -> list:
        return self._rows(self.get_all_df(config), config)

    def get_filtered_df(self, predicate, config=None) -> DataFrame:
        return self._plan(config, predicate)

    def get_filtered(self, predicate, config=None) -> list:
        return self._rows(self.get_filtered_df(predicate, config), config)

    all_matching_df, all_matching = get_filtered_df, get_filtered

    def get_mapped_df(self, predicate, columns, config=None) -> DataFrame:
        return self._mapped(config, predicate, columns)

    def get_mapped(self, predicate, columns, config=None) -> list:
        with tagged(self.spark, configured(ReadConfig, config).tag):
            return self.get_mapped_df(predicate, columns, config).collect()

    # by key

    def get_df(self, key, config=None) -> DataFrame:
        if not self.entity.key:
            raise ValueError(f"{self.entity.name} has no key")
        values = key if isinstance(key, (tuple, list)) else (key,)
        if len(values) != len(self.entity.key):
            raise ValueError(f"the key of {self.entity.name} is {self.entity.key}")
        condition = F.lit(True)
        for k, v in zip(self.entity.key, values, strict=True):
            condition = condition & F.col(f"`{k}`").eqNullSafe(F.lit(v))
        return self._plan(config, condition)

    def get(self, key, config=None):
        """The row with the key, or None."""
        return self._one(self.get_df(key, config).limit(1), config)

    # counts and tests

    def count_df(self, predicate=None, config=None) -> DataFrame:
        return self._plan(config, predicate, includes=False).agg(F.count(F.lit(1)).alias("n"))

    def count(self, predicate=None, config=None) -> int:
        with tagged(self.spark, configured(ReadConfig, config).tag):
            return self.count_df(predicate, config).first()["n"]

    def any_df(self, predicate=None, config=None) -> DataFrame:
        return self._plan(config, predicate, includes=False).limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def any(self, predicate=None, config=None) -> bool:
        with tagged(self.spark, configured(ReadConfig, config).tag):
            return not self._plan(config, predicate, includes=False).isEmpty()

    def _against(self, predicate):
        from tessera.plans.spec import as_column

        return lambda row: ~F.coalesce(as_column(predicate, row), F.lit(False))

    def all_df(self, predicate, config=None) -> DataFrame:
        """Whether every row satisfies the predicate: true without rows, and null is not satisfied."""
        return self._plan(config, self._against(predicate), includes=False).limit(1).agg((F.count(F.lit(1)) == 0).alias("result"))

    def all(self, predicate, config=None) -> bool:
        with tagged(self.spark, configured(ReadConfig, config).tag):
            return self._plan(config, self._against(predicate), includes=False).isEmpty()

    # first, single, pages

    def get_first_df(self, predicate, config=None) -> DataFrame:
        return self._plan(config, predicate, 1)

    def get_first(self, predicate, config=None):
        return self._one(self.get_first_df(predicate, config), config)

    def get_first_mapped_df(self, predicate, columns, config=None) -> DataFrame:
        return self._mapped(config, predicate, columns, 1)

    def get_first_mapped(self, predicate, columns, config=None):
        with tagged(self.spark, configured(ReadConfig, config).tag):
            rows = self.get_first_mapped_df(predicate, columns, config).collect()
        return rows[0] if rows else None

    def get_single_df(self, predicate, config=None) -> DataFrame:
        return self._plan(config, predicate, 2)

    def get_single(self, predicate, config=None):
        """The only row that satisfies the predicate, None without one; ``MultipleResultsError`` with more."""
        rows = self._rows(self.get_single_df(predicate, config), config)
        if len(rows) > 1:
            raise MultipleResultsError(f"more than one row of {self.entity.name}")
        return rows[0] if rows else None

    def get_paged_df(self, *args, config=None) -> DataFrame:
        """``(limit)``, ``(predicate, limit)``, ``(index, size)`` or ``(predicate, index, size)``; pages count from 0."""
        predicate = None
        if args and not (isinstance(args[0], int) and not isinstance(args[0], bool)):
            predicate, args = args[0], args[1:]
        if len(args) == 1:
            if args[0] <= 0:
                raise ValueError("the limit must be positive")
            return self._plan(config, predicate, args[0])
        index, size = args
        return self._plan(config, predicate, size, page_offset(index, size))

    def get_paged(self, *args, config=None) -> list:
        return self._rows(self.get_paged_df(*args, config=config), config)

    def find_page(self, predicate, index: int, size: int, config=None) -> Page:
        """One page and the count of all rows that satisfy the predicate, both under the same configuration."""
        return Page(self.get_paged_df(predicate, index, size, config=config), self.count(predicate, config), index, size)

    # writes

    def add(self, item) -> None:
        self.unit_of_work.add(self.entity.name, item)

    def modify(self, item) -> None:
        self.unit_of_work.modify(self.entity.name, item)

    def merge(self, persisted, current) -> None:
        self.unit_of_work.merge(self.entity.name, persisted, current)

    def remove(self, item) -> None:
        self.unit_of_work.remove(self.entity.name, item)

    def track_item(self, item):
        return self.unit_of_work.attach(self.entity.name, item)

    def delete_many(self, predicate) -> int:
        return self.unit_of_work.delete_many(self.entity.name, predicate)

    def update_many(self, predicate, values: dict) -> int:
        return self.unit_of_work.update_many(self.entity.name, predicate, values)


class EntitySet:
    """A table handle whose ``df`` composes any DataFrame operator, with the set's own changes and query operators."""

    def __init__(self, repository: Repository, df: DataFrame | None = None):
        self.repository = repository
        self.df = repository.get_all_df() if df is None else df

    def _with(self, df: DataFrame) -> EntitySet:
        return EntitySet(self.repository, df)

    def execute(self):
        """Rows one at a time."""
        return self.df.toLocalIterator()

    def find(self, key):
        return self.repository.get(key)

    def insert(self, item) -> None:
        self.repository.add(item)

    def delete_many(self, predicate) -> int:
        return self.repository.delete_many(predicate)

    def update_many(self, predicate, values: dict) -> int:
        return self.repository.update_many(predicate, values)

    # query operators that DataFrames lack under one name

    def where(self, predicate) -> EntitySet:
        from tessera.plans.planner import plan_filter

        return self._with(plan_filter(self.repository.catalog, self.repository.entity, self.df, predicate))

    def order_by(self, *keys: Column) -> EntitySet:
        return self._with(self.df.orderBy(*keys))

    def skip(self, n: int) -> EntitySet:
        return self._with(self.df.offset(n))

    def take(self, n: int) -> EntitySet:
        return self._with(self.df.limit(n))

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    def select_many(self, array: str | Column) -> DataFrame:
        """A row for each element of an array column; structs become columns."""
        out = self.df.select(F.explode(array).alias("value"))
        return out.select("value.*") if out.schema["value"].dataType.typeName() == "struct" else out

    def distinct(self) -> EntitySet:
        return self._with(self.df.distinct())

    def distinct_by(self, *keys: str) -> EntitySet:
        return self._with(self.df.dropDuplicates(list(keys)))

    def concat(self, other: EntitySet | DataFrame) -> EntitySet:
        return self._with(self.df.unionByName(_df(other)))

    def union(self, other) -> EntitySet:
        return self._with(self.df.unionByName(_df(other)).distinct())

    def union_by(self, other, *keys: str) -> EntitySet:
        """Rows of both with distinct keys; those of this set come first."""
        mine = self.df.dropDuplicates(list(keys))
        return self._with(mine.unionByName(_df(other).dropDuplicates(list(keys)).join(mine, list(keys), "left_anti").select(*mine.columns)))

    def intersect(self, other) -> EntitySet:
        return self._with(self.df.intersect(_df(other).select(*self.df.columns)))

    def except_(self, other) -> EntitySet:
        return self._with(self.df.subtract(_df(other).select(*self.df.columns)))

    def intersect_by(self, keys: DataFrame, *on: str) -> EntitySet:
        return self._with(self.df.join(keys, list(on), "left_semi").dropDuplicates(list(on)))

    def except_by(self, keys: DataFrame, *on: str) -> EntitySet:
        return self._with(self.df.join(keys, list(on), "left_anti").dropDuplicates(list(on)))

    # Sort keys of the following are column names, columns with or without a direction, or ``Sort`` objects; nulls come
    # first ascending and last descending, and rows with equal keys come in the order of all their columns.

    def take_while(self, predicate: Column, *order) -> EntitySet:
        """Rows before the first, in the order given, that fails the predicate."""
        return self._before_first(predicate, order, True)

    def skip_while(self, predicate: Column, *order) -> EntitySet:
        return self._before_first(predicate, order, False)

    def _before_first(self, predicate: Column, order, before: bool) -> EntitySet:
        """The first failing row is one top-1, then every row is compared with it: no global window."""
        keys = total(self.df, order)
        marked, names = named(self.df, keys)
        failing = marked.where(~F.coalesce(predicate, F.lit(False))).orderBy(*ordering(keys)).limit(1)
        first = failing.agg(F.first(F.struct(*names)).alias("__first"))  # one row, null if none fails
        rows = marked.crossJoin(F.broadcast(first))
        is_ahead = F.col("__first").isNull() | ahead(names, "__first", keys)
        return self._with(rows.where(is_ahead if before else ~is_ahead).select(*self.df.columns))

    def take_last(self, n: int, *order) -> EntitySet:
        """The last ``n`` rows of the order given, in that order."""
        keys = total(self.df, order)
        return self._with(self.df.orderBy(*ordering(keys, backwards=True)).limit(n).orderBy(*ordering(keys)))

    def skip_last(self, n: int, *order) -> EntitySet:
        """All but the last ``n`` rows of the order given: those ahead of the first of these, and equal rows that are left."""
        keys = total(self.df, order)
        marked, names = named(self.df, keys)
        last = marked.orderBy(*ordering(keys, backwards=True)).limit(n)
        first = last.orderBy(*ordering(keys)).limit(1).agg(F.first(F.struct(*names)).alias("__first"))
        rows = marked.crossJoin(F.broadcast(first)).where("__first is not null" if n else "true")
        if n == 0:
            return self._with(self.df)
        equal = rows.where(same(names, "__first"))
        gone = last.crossJoin(F.broadcast(first)).where(same(names, "__first")).agg(F.count(F.lit(1)).alias("__gone"))
        number = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))  # copies of one row
        left = equal.withColumn("__n", number).crossJoin(F.broadcast(gone)).where("__n > __gone")
        columns = self.df.columns
        return self._with(rows.where(ahead(names, "__first", keys)).select(*columns).unionByName(left.select(*columns)))

    def reverse(self, *order) -> EntitySet:
        return self._with(self.df.orderBy(*ordering(sort_keys(self.df, order), backwards=True)))

    def join(self, other, on, how: str = "inner") -> DataFrame:
        return self.df.join(_df(other), on, how)

    def group_join(self, other, on: list[str], name: str) -> DataFrame:
        """Each row with the array of the other's rows of equal keys, empty if there are none."""
        right = _df(other)
        grouped = right.groupBy(*on).agg(F.collect_list(F.struct(*right.columns)).alias(name))
        return self.df.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))

    def group_by(self, *keys):
        return self.df.groupBy(*keys)

    def count(self) -> int:
        return self.df.count()

    def sum(self, column):
        return self.df.agg(F.sum(column)).first()[0]

    def average(self, column):
        return self.df.agg(F.avg(column)).first()[0]

    def min(self, column):
        return self.df.agg(F.min(column)).first()[0]

    def max(self, column):
        return self.df.agg(F.max(column)).first()[0]

    def aggregate(self, *expressions: Column):
        """A fold, as aggregate expressions that partitions can combine."""
        return self.df.agg(*expressions).first()

    def any(self, predicate=None) -> bool:
        return not (self if predicate is None else self.where(predicate)).df.isEmpty()

    def all(self, predicate: Column) -> bool:
        return self.df.where(~F.coalesce(predicate, F.lit(False))).isEmpty()

    def contains(self, item: dict) -> bool:
        df = self.df
        for k, v in item.items():
            df = df.where(F.col(k).eqNullSafe(F.lit(v)))
        return not df.isEmpty()

    def sequence_equal(self, other) -> bool:
        """Same rows, as often (order is not part of a set)."""
        a, b = self.df, _df(other).select(*self.df.columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def first(self, *order):
        rows = (self.df.orderBy(*order) if order else self.df).limit(1).collect()
        return rows[0] if rows else None

    def last(self, *order):
        rows = self.reverse(*order).df.limit(1).collect()
        return rows[0] if rows else None

    def single(self):
        rows = self.df.limit(2).collect()
        if len(rows) > 1:
            raise MultipleResultsError("more than one row")
        return rows[0] if rows else None

    def element_at(self, n: int, *order):
        rows = self.df.orderBy(*order).offset(n).limit(1).collect()
        return rows[0] if rows else None

    def append(self, item: dict) -> EntitySet:
        row = self.df.sparkSession.createDataFrame([tuple(item.get(c) for c in self.df.columns)], self.df.schema)
        return self._with(self.df.unionByName(row))

    def prepend(self, item: dict) -> EntitySet:
        return self._with(self._with(self.df.limit(0)).append(item).df.unionByName(self.df))

    def default_if_empty(self, item: dict) -> EntitySet:
        """The rows, or one of ``item`` if there are none."""
        row = self.df.sparkSession.createDataFrame([tuple(item.get(c) for c in self.df.columns)], self.df.schema)
        n = self.df.limit(1).agg(F.count(F.lit(1)).alias("__n"))
        return self._with(self.df.unionByName(row.crossJoin(F.broadcast(n)).where("__n = 0").drop("__n")))

    def cast(self, **types: str) -> EntitySet:
        return self._with(self.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def of_type(self, column: str, kind: str) -> EntitySet:
        """Rows whose column can be read as ``kind``, and reads so."""
        value = F.expr(f"try_cast(`{column}` as {kind})")
        return self._with(self.df.where(value.isNotNull()).withColumn(column, value))

    def zip(self, other, key: str, other_key: str) -> DataFrame:
        """Rows of both side by side by rank of their sort keys; ranks are numbered by range, never in one task."""
        a = with_rank(self.df, key, "__rank")
        b = with_rank(_df(other), other_key, "__rank")
        return a.join(b, "__rank").drop("__rank")

    def chunk(self, size: int, key: str) -> DataFrame:
        """Rows with ``chunk``, the number of the run of ``size`` rows that they are in, by sort key."""
        return with_rank(self.df, key, "__rank").withColumn("chunk", F.floor(F.col("__rank") / size)).drop("__rank")


def _df(x) -> DataFrame:
    return x.df if isinstance(x, EntitySet) else x
