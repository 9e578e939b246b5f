"""Unit of work: tracked changes, bulk changes, commits, transactions, loads, migrations."""

from __future__ import annotations

import copy
import datetime as dt
import inspect
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.plans.config import SaveOptions, configured
from tessera.plans.entity import MANY, ONE, Entity
from tessera.plans.planner import plan_filter
from tessera.plans.spec import Row as RowProxy
from tessera.plans.spec import as_column
from tessera.plans.planner import Scope
from tessera.sources.catalog import Catalog
from tessera.sources.guard import go_on
from tessera.sources.store import ConflictError, SnapshotStore, plain, without

from .items import Item, as_dict

INSERT, UPSERT, DELETE = "insert", "upsert", "delete"
#: Keys of a commit that are broadcast at most.
BROADCAST_KEYS = 100_000


class MultipleResultsError(Exception):
    """More than one row where one was asked for."""


class DuplicateKeyError(ConflictError):
    """A row is to be added whose key another row has."""


@dataclass
class Changes:
    """Pending changes of one entity.  Rows to add are held by key, or by a place of their own without one."""

    inserts: dict[object, dict] = field(default_factory=dict)
    upserts: dict[tuple, dict] = field(default_factory=dict)
    deletes: set[tuple] = field(default_factory=set)
    #: Attached dicts and edited items, with what they held before.
    watched: dict[int, tuple[object, dict]] = field(default_factory=dict)

    def count(self) -> int:
        return len(self.inserts) + len(self.upserts) + len(self.deletes)


@dataclass
class Transaction:
    """A staged commit that several units of work may share: new state by entity on top of a base version."""

    store: SnapshotStore
    base: int
    staged: dict[str, dict] = field(default_factory=dict)
    done: bool = False

    def groups(self, entity: str) -> list[dict]:
        return self.staged[entity]["groups"] if entity in self.staged else self.store.groups(entity, self.base)

    def read(self, entity: str) -> DataFrame:
        return self.store.load(self.groups(entity), self.store.schema(entity))


class TransactionCatalog(Catalog):
    """Reads inside an open transaction see what it has staged."""

    def __init__(self, uow: UnitOfWork):
        super().__init__(uow.spark, list(uow.entities.values()), store=uow.store)
        self.uow = uow

    def read(self, name: str) -> DataFrame:
        self.entity(name)
        t = self.uow.get_transaction()
        return t.read(name) if t is not None else self.store.read(name)


class UnitOfWork:
    """Tracks changes against a snapshot store until ``commit``; reads see committed data only."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, entities: list[Entity]):
        self.spark, self.store = spark, store
        self.entities = {e.name: e for e in entities}
        self.changes: dict[str, Changes] = {}
        self.base: int | None = None
        self._transaction: Transaction | None = None
        self._began_it = False
        self.catalog = TransactionCatalog(self)

    def __enter__(self) -> UnitOfWork:
        return self

    def __exit__(self, *_) -> None:
        self.dispose()

    def dispose(self) -> None:
        """Drop pending changes; a transaction that this unit of work began is rolled back, one that it joined is left."""
        self.rollback_changes()
        t = self._transaction
        if t is not None and self._began_it and not t.done:
            self.rollback_transaction()
        self._transaction = None

    # repositories and sets

    def repository(self, name: str):
        from .repository import Repository

        return Repository(self.catalog, self.catalog.entity(name), self)

    queryable_repository = repository

    def async_repository(self, name: str):
        from .aio import AsyncRepository

        return AsyncRepository(self.repository(name))

    def create_set(self, name: str):
        from .repository import EntitySet

        return EntitySet(self.repository(name))

    def executor(self):
        from .sql import SqlExecutor

        return SqlExecutor(self)

    # tracked changes

    def _of(self, name: str) -> Changes:
        if self.base is None:
            self.base = self.store.version()
        return self.changes.setdefault(name, Changes())

    def key_of(self, name: str, item) -> tuple:
        e = self.catalog.entity(name)
        if not e.key:
            raise ValueError(f"{name} has no key")
        row = as_dict(item)
        return tuple(row[k] for k in e.key)

    def add(self, name: str, item) -> None:
        """A row to insert; of a row that is to be deleted, its replacement."""
        c, row = self._of(name), as_dict(item)
        if not self.catalog.entity(name).key:
            c.inserts[object()] = row
            return
        key = self.key_of(name, row)
        if key in c.inserts or key in c.upserts:
            raise DuplicateKeyError(f"a row of {name} with the key {key} is pending")
        if key in c.deletes:
            c.deletes.discard(key)
            c.upserts[key] = row
        else:
            c.inserts[key] = row

    def modify(self, name: str, item) -> None:
        """New values of a row, stored or still to be inserted."""
        key, c = self.key_of(name, item), self._of(name)
        c.deletes.discard(key)
        (c.inserts if key in c.inserts else c.upserts)[key] = as_dict(item)

    set_modified = modify

    def merge(self, name: str, persisted, current) -> None:
        """Current values under the key of the persisted row."""
        row = {**as_dict(persisted), **as_dict(current)}
        row.update(zip(self.catalog.entity(name).key, self.key_of(name, persisted), strict=True))
        self.modify(name, row)

    apply_current_values = merge

    def remove(self, name: str, item) -> None:
        """A row to delete; one that is only to be inserted is not inserted."""
        key, c = self.key_of(name, item), self._of(name)
        c.upserts.pop(key, None)
        if c.inserts.pop(key, None) is None:
            c.deletes.add(key)

    def attach(self, name: str, item):
        """Watch an item: a dict whose values differ at the next commit is saved; of a row an editable item is returned."""
        self.key_of(name, item)
        if isinstance(item, Row):
            return self.tracked(name, item)
        if not isinstance(item, Item):
            self._of(name).watched[id(item)] = (item, copy.deepcopy(as_dict(item)))
        return item

    track_item = attach

    def tracked(self, name: str, row: Row, version: int | None = None) -> Item:
        """A row as an item whose first edit makes it a pending change; ``version``: the snapshot that it was read from."""

        def edited(item: Item, _: str) -> None:
            began = self.base
            c = self._of(name)
            self.base = min(x for x in (began, item._version, self.base) if x is not None)
            c.watched.setdefault(id(item), (item, copy.deepcopy(item.asDict())))

        return Item(dict(zip(row.__fields__, row, strict=True)), edited, self.snapshot() if version is None else version)

    def snapshot(self) -> int:
        """The version that reads see."""
        t = self.get_transaction()
        return t.base if t is not None else self.store.version()

    def _collect_edits(self) -> None:
        """Watched items that were edited as pending changes, unless they are to be changed or deleted otherwise."""
        for name, c in self.changes.items():
            for item, before in list(c.watched.values()):
                row, key = as_dict(item), self.key_of(name, before)
                if row == before or key in c.deletes or key in c.upserts:
                    continue
                if self.key_of(name, row) != key:
                    raise ValueError(f"the key of a row of {name} was edited")
                self.modify(name, row)

    def rollback_changes(self) -> None:
        self.changes, self.base = {}, None

    # commits

    def commit(self, options=None) -> int:
        """Publish pending changes; ``ConflictError`` if a touched row changed or went since they began."""
        return self._commit(configured(SaveOptions, options), client_wins=False)

    def commit_and_refresh_changes(self, options=None) -> int:
        """Publish pending changes over whatever was committed meanwhile; rows that are gone are passed over."""
        return self._commit(configured(SaveOptions, options), client_wins=True)

    def _commit(self, options: SaveOptions, client_wins: bool) -> int:
        self._collect_edits()
        pending = {n: c for n, c in self.changes.items() if c.count()}
        if not pending:
            self.rollback_changes()
            return 0
        began = self.base
        while True:
            t = self.get_transaction()
            latest = self.snapshot()
            if not client_wins and latest != began:
                for name, c in pending.items():
                    self._check_untouched(name, c, began, latest)
            states, total = {}, 0
            for name, c in pending.items():
                states[name], n = self._apply(name, c, latest, options, client_wins)
                total += n
            if t is not None:
                t.staged.update(states)
                break
            try:
                self.store.publish(latest, states)
                break
            except ConflictError:
                continue
        self.rollback_changes()
        return total

    def _keys(self, name: str, keys) -> DataFrame:
        e = self.catalog.entity(name)
        schema = self.store.schema(name)
        from pyspark.sql.types import StructType

        return self.spark.createDataFrame([tuple(k) for k in keys], StructType([schema[k] for k in e.key]))

    def _check_untouched(self, name: str, c: Changes, began: int, latest: int) -> None:
        keys = [*c.upserts, *c.deletes]
        if not keys:
            return
        wanted = self._keys(name, keys)
        e = self.catalog.entity(name)
        before = self.store.read(name, began).join(wanted, list(e.key), "left_semi")
        after = self.store.read(name, latest).join(wanted, list(e.key), "left_semi")
        if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
            raise ConflictError(f"rows of {name} changed since version {began}")

    def _groups(self, name: str, version: int) -> list[dict]:
        t = self.get_transaction()
        return t.groups(name) if t is not None else self.store.groups(name, version)

    def _rows(self, name: str, rows: list[dict], options: SaveOptions, created: bool) -> DataFrame:
        e, schema = self.catalog.entity(name), self.store.schema(name)
        unknown = {k for r in rows for k in r} - set(schema.names) - set(e.navigations)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        df = self.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)
        return self._audited(e, df, options, created)

    @staticmethod
    def _audited(e: Entity, df: DataFrame, options: SaveOptions, created: bool) -> DataFrame:
        """Audit columns that the table has get user and time; the table's schema stays as it is."""
        if not options.audit:
            return df
        now = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None))
        marks = [(e.updated_by, F.lit(options.user)), (e.updated_at, now)]
        if created:
            marks += [(e.created_by, F.lit(options.user)), (e.created_at, now)]
        for column, value in marks:
            if column in df.columns:
                df = df.withColumn(column, value.cast(df.schema[column].dataType))
        return df

    def _apply(self, name: str, c: Changes, version: int, options: SaveOptions, client_wins: bool) -> tuple[dict, int]:
        """New state of an entity: files without touched rows are kept, the others rewritten."""
        e, schema = self.catalog.entity(name), self.store.schema(name)
        groups = self._groups(name, version)
        fresh, total, on = [], len(c.inserts), list(e.key)
        touched = [*c.upserts, *c.deletes]
        asked = touched + (list(c.inserts) if on else [])
        if asked:
            keys = self._keys(name, asked)
            keys = F.broadcast(keys) if len(asked) <= BROADCAST_KEYS else keys
            hit = self.store.load(groups, schema).withColumn("__file", F.input_file_name()).join(keys, on, "left_semi")
            found = hit.select("__file", *on).collect()
            there = {tuple(r[k] for k in on) for r in found}
            if on and (twice := [k for k in c.inserts if k in there]):
                raise DuplicateKeyError(f"rows of {name} exist already: {twice[:5]}")
            missing = [k for k in touched if k not in there]
            if missing and not client_wins:
                raise ConflictError(f"rows of {name} are gone: {missing[:5]}")
            upserts = [r for k, r in c.upserts.items() if k in there]
            total += len(there)
            if files := sorted({r["__file"] for r in found}):
                groups = without(groups, files)
                fresh.append(self._files(files, schema).join(keys, on, "left_anti").select(*schema.names))
            if upserts:
                fresh.append(self._rows(name, upserts, options, False))
        if c.inserts:
            fresh.append(self._rows(name, list(c.inserts.values()), options, True))
        if fresh:
            df = fresh[0]
            for x in fresh[1:]:
                df = df.unionByName(x)
            groups = [*groups, self.store.write(name, df)]
        return {"groups": groups, "schema": schema.jsonValue()}, total

    def _files(self, files: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[plain(f) for f in files])

    def _unique(self, name: str, groups: list[dict], added: DataFrame | None = None) -> None:
        """``DuplicateKeyError`` if two rows have one key; with ``added``, of which one is among these rows."""
        on = list(self.catalog.entity(name).key)
        if not on:
            return
        rows = self.store.load(groups, self.store.schema(name)).select(*on)
        if added is None:
            twice = rows
        else:
            wanted = added.select(*on)
            twice = wanted.unionByName(rows.join(wanted, on, "left_semi"))
        if not twice.groupBy(*on).count().where("count > 1").isEmpty():
            raise DuplicateKeyError(f"rows of {name} with equal keys")

    # bulk changes

    def delete_many(self, name: str, predicate) -> int:
        """Delete the rows for which the predicate is true, at once (inside the open transaction, if any)."""
        return self._bulk(name, predicate, None)

    def update_many(self, name: str, predicate, values: dict) -> int:
        """Set columns of the rows for which the predicate is true; values are columns, SQL texts' columns or literals."""
        unknown = set(values) - set(self.store.schema(name).names)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        return self._bulk(name, predicate, values)

    def _bulk(self, name: str, predicate, values: dict | None) -> int:
        e, schema = self.catalog.entity(name), self.store.schema(name)

        def marked(df: DataFrame) -> DataFrame:
            scope = Scope(self.catalog, e)
            condition = as_column(predicate, RowProxy(scope, e))
            return scope.join(df).withColumn("__hit", F.coalesce(condition, F.lit(False)))

        while True:
            go_on()
            t, version = self.get_transaction(), self.snapshot()
            groups = self._groups(name, version)
            per_file = marked(self.store.load(groups, schema).withColumn("__file", F.input_file_name())).where("__hit").groupBy("__file").count().collect()
            n = sum(r["count"] for r in per_file)
            if n == 0:
                return 0
            files = sorted(r["__file"] for r in per_file)
            rows = marked(self._files(files, schema))
            if values is None:
                rows = rows.where("not __hit").select(*schema.names)
            else:
                proxy = RowProxy(Scope(self.catalog, e), e)
                made = {k: v(proxy) if callable(v) and not hasattr(v, "_jc") else v for k, v in values.items()}
                rows = rows.select(*[F.when(F.col("__hit"), made[f.name] if hasattr(made[f.name], "cast") else F.lit(made[f.name])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in made else F.col(f.name) for f in schema])
            groups = [*without(groups, files), self.store.write(name, rows)]
            if values is not None and set(values) & set(e.key):
                self._unique(name, groups)
            if self._put(t, version, {name: {"groups": groups, "schema": schema.jsonValue()}}):
                return n

    def _put(self, t: Transaction | None, version: int, state: dict) -> bool:
        """Into the open transaction, or published; False if another commit came first."""
        if t is not None:
            go_on()
            t.staged.update(state)
            return True
        try:
            self.store.publish(version, state)
            return True
        except ConflictError:
            return False

    def insert_many(self, name: str, rows: DataFrame) -> int:
        """Append rows of a query, at once."""
        schema = self.store.schema(name)
        group = self.store.write(name, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
        new = self.store.load([group], schema)
        n = new.count()
        while True:
            go_on()
            t, version = self.get_transaction(), self.snapshot()
            groups = self._groups(name, version)
            self._unique(name, groups, new)
            if self._put(t, version, {name: {"groups": [*groups, group], "schema": schema.jsonValue()}}):
                return n

    # transactions

    @property
    def transaction(self) -> Transaction | None:
        return self.get_transaction()

    def begin_transaction(self) -> Transaction:
        if self.get_transaction() is not None:
            raise RuntimeError("a transaction is open")
        self._transaction, self._began_it = Transaction(self.store, self.store.version()), True
        return self._transaction

    def commit_transaction(self) -> None:
        """Publish what the transaction has staged; on a conflict it stays open, to be rolled back."""
        t = self._open()
        if t.staged:
            self.store.publish(t.base, t.staged)
        t.done, self._transaction = True, None

    def rollback_transaction(self) -> None:
        t = self._open()
        t.staged.clear()
        t.done, self._transaction = True, None

    def _open(self) -> Transaction:
        t = self.get_transaction()
        if t is None:
            raise RuntimeError("no transaction is open")
        return t

    def get_transaction(self) -> Transaction | None:
        """The open transaction; ``RuntimeError`` once another unit of work has ended the one that this joined."""
        if self._transaction is not None and self._transaction.done:
            raise RuntimeError("the transaction has ended; use_transaction(None) leaves it")
        return self._transaction

    def use_transaction(self, transaction: Transaction | None) -> None:
        """Join a transaction that another unit of work began, or leave it (None)."""
        if transaction is not None and transaction.done:
            raise RuntimeError("the transaction has ended")
        if transaction is not None and transaction.store is not self.store and transaction.store.root != self.store.root:
            raise ValueError("the transaction is of another store")
        self._transaction, self._began_it = transaction, False

    @contextmanager
    def scoped_transaction(self):
        """Commit at the end of the block; roll back if it raises or the commit fails."""
        self.begin_transaction()
        try:
            yield self
            self.commit_transaction()
        except BaseException:
            if self._transaction is not None and not self._transaction.done:
                self.rollback_transaction()
            raise

    def execute_transaction(self, action):
        """``action(self)`` in a transaction of its own; coroutine functions belong to the asynchronous form."""
        with self.scoped_transaction():
            result = action(self)
            if inspect.isawaitable(result):
                getattr(result, "close", lambda: None)()
                raise TypeError("an asynchronous action needs the asynchronous unit of work")
            return result

    # explicit loads

    def load_property_df(self, name: str, item, navigation: str) -> DataFrame:
        return self._load(name, item, navigation, ONE)

    def load_property(self, name: str, item, navigation: str):
        """The row that a to-one navigation of ``item`` leads to, or None."""
        rows = self.load_property_df(name, item, navigation).limit(1).collect()
        return rows[0] if rows else None

    def load_collection_df(self, name: str, item, navigation: str, predicate=None) -> DataFrame:
        df = self._load(name, item, navigation, MANY)
        target = self.catalog.entity(self.catalog.entity(name).navigation(navigation).target)
        return df if predicate is None else plan_filter(self.catalog, target, df, predicate)

    def load_collection(self, name: str, item, navigation: str, predicate=None) -> list:
        return self.load_collection_df(name, item, navigation, predicate).collect()

    def _load(self, name: str, item, navigation: str, kind: str) -> DataFrame:
        nav = self.catalog.entity(name).navigation(navigation)
        if nav.kind != kind:
            raise ValueError(f"{navigation} is a to-{nav.kind} navigation")
        row, df = as_dict(item), self.catalog.read(nav.target)
        for own, target in nav.on:
            df = df.where(F.col(target) == F.lit(row[own]))
        return df

    def reload(self, name: str, item):
        """The row as it is stored now; pending changes of it are dropped."""
        key = self.key_of(name, item)
        if name in self.changes:
            c = self.changes[name]
            c.upserts.pop(key, None)
            c.deletes.discard(key)
            c.watched = {i: (x, b) for i, (x, b) in c.watched.items() if self.key_of(name, b) != key}
        return self.repository(name).get(key if len(key) > 1 else key[0])

    # migrations

    def get_pending_migrations(self, known: list | None = None) -> list[str]:
        """Titles of the migrations (all registered ones, or those given) that have not run, in order of their dates."""
        from .migrations import REGISTRY

        applied = set(self.store.manifest(self.store.version())["ledger"])
        return [m.title for m in sorted(REGISTRY if known is None else known, key=lambda m: (m.when, m.title)) if m.title not in applied]

    def update_database(self, known: list | None = None) -> list[str]:
        """Run pending migrations in order of their dates; each is recorded when it has run."""
        from .migrations import REGISTRY

        done = []
        by_title = {m.title: m for m in (REGISTRY if known is None else known)}
        for title in self.get_pending_migrations(known):
            by_title[title].action(self)
            while True:
                version = self.store.version()
                ledger = self.store.manifest(version)["ledger"]
                try:
                    self.store.publish(version, {}, [*ledger, title])
                    break
                except ConflictError:
                    continue
            done.append(title)
        return done
