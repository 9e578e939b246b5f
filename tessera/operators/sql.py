"""SQL text against the entities: queries, commands, functions and procedures, with tag and timeout."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.config import SqlConfig, configured
from tessera.sources.guard import Call, running
from tessera.sources.sqltext import bind, parse_command

PROCEDURES: dict[str, Callable] = {}


def procedure(name: str):
    """Register the decorated ``f(uow, *positional, **named) -> int`` as a stored procedure."""

    def mark(action: Callable) -> Callable:
        PROCEDURES[name] = action
        return action

    return mark


class SqlExecutor:
    """Runs SQL of a unit of work; transactions are those of the unit of work."""

    def __init__(self, uow):
        self.uow, self.spark, self.catalog = uow, uow.spark, uow.catalog
        for name in ("begin_transaction", "commit_transaction", "rollback_transaction", "execute_transaction", "get_transaction", "use_transaction"):
            setattr(self, name, getattr(uow, name))

    @contextmanager
    def _running(self, config: SqlConfig):
        """Jobs of the block carry the call's tag; after the timeout a timer cancels them and bars further ones and commits."""
        sc = self.spark.sparkContext
        own = f"sql-{uuid.uuid4().hex}"
        tags = [own] + ([config.tag.replace(",", " ")] if config.tag else [])
        for t in tags:
            sc.addJobTag(t)
        late, call = threading.Event(), Call()

        def cancel() -> None:
            call.stop()
            late.set()
            sc.cancelJobsWithTag(own)

        timer = threading.Timer(config.timeout, cancel) if config.timeout else None
        if timer:
            timer.start()
        try:
            with running(call):
                yield
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"the call took more than {config.timeout} s") from e
            raise
        finally:
            if timer:
                timer.cancel()
            for t in tags:
                sc.removeJobTag(t)

    def _frame(self, sql: str, config: SqlConfig) -> DataFrame:
        text, args = bind(sql, config.positional, config.named)
        return self.catalog.sql(text, args)

    def execute_query_df(self, sql: str, config=None) -> DataFrame:
        return self._frame(sql, configured(SqlConfig, config))

    def execute_query(self, sql: str, config=None) -> list:
        made = configured(SqlConfig, config)
        with self._running(made):
            return self._frame(sql, made).collect()

    def execute_raw_sql(self, sql: str, mapper: Callable, config=None) -> list:
        """Each row through ``mapper`` on the driver, one at a time."""
        made = configured(SqlConfig, config)
        with self._running(made):
            return [mapper(r) for r in self._frame(sql, made).toLocalIterator()]

    def execute_raw_sql_df(self, sql: str, mapper: Callable, schema: str, config=None) -> DataFrame:
        """Each row through ``mapper`` (dict to dict) on the executors, in batches."""
        import pandas as pd

        def run(batches):
            for b in batches:
                yield pd.DataFrame([mapper(r) for r in b.to_dict("records")])

        return self.execute_query_df(sql, config).mapInPandas(run, schema)

    def execute_command(self, sql: str, config=None) -> int:
        """Rows that an INSERT, UPDATE or DELETE changed, or that a query returns."""
        made = configured(SqlConfig, config)
        text, args = bind(sql, made.positional, made.named)
        c = parse_command(text)
        expr = lambda s: self._expression(s, args)
        with self._running(made):
            if c.kind == "query":
                return self.catalog.sql(c.query, args).count()
            if c.kind == "delete":
                return self.uow.delete_many(c.table, expr(c.where) if c.where else F.lit(True))
            if c.kind == "update":
                return self.uow.update_many(c.table, expr(c.where) if c.where else F.lit(True), {k: expr(v) for k, v in c.assignments})
            rows = self.catalog.sql(c.query, args)
            names = self.uow.store.schema(c.table).names
            columns = list(c.columns) or names
            if len(columns) != len(rows.columns):
                raise ValueError("an INSERT needs a value for each of its columns")
            rows = rows.toDF(*columns)
            return self.uow.insert_many(c.table, rows.select(*[F.col(n) if n in columns else F.lit(None).alias(n) for n in names]))

    execute_non_query = execute_command

    @staticmethod
    def _expression(text: str, args: dict):
        """A column of SQL text with its parameters put in as literals, outside quotes."""
        def put(m):
            if m[1] is not None or m[2] not in args:
                return m[0]
            v = args[m[2]]
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, (int, float)):
                return repr(v)
            text = str(v).replace("\\", "\\\\").replace("'", "\\'")
            kind = type(v).__name__
            return f"{ {'date': 'DATE ', 'datetime': 'TIMESTAMP_NTZ '}.get(kind, '') }'{text}'"

        return F.expr(re.sub(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(?<!:):(\w+)", put, text))

    def execute_function_df(self, name: str, config=None, table: bool = False) -> DataFrame:
        """``SELECT name(args) AS result`` or, of a table function, its rows."""
        if not all(p.isidentifier() for p in name.split(".")):
            raise ValueError(f"not a function name: {name!r}")
        made = configured(SqlConfig, config)
        marks = [f":p{i}" for i in range(len(made.positional))] + [f"{k} => :{k}" for k in made.named]
        args = {f"p{i}": v for i, v in enumerate(made.positional)} | made.named
        call = f"{name}({', '.join(marks)})"
        return self.catalog.sql(f"SELECT * FROM {call}" if table else f"SELECT {call} AS result", args)

    def execute_function(self, name: str, config=None, table: bool = False):
        """The value of a scalar function, or the rows of a table function."""
        made = configured(SqlConfig, config)
        with self._running(made):
            rows = self.execute_function_df(name, made, table).collect()
        return rows if table else rows[0]["result"]

    def execute_procedure(self, name: str, config=None) -> int:
        """Rows that a registered procedure changed."""
        made = configured(SqlConfig, config)
        if name not in PROCEDURES:
            raise KeyError(f"no procedure {name!r}")
        with self._running(made):
            return PROCEDURES[name](self.uow, *made.positional, **made.named)
