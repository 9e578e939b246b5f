"""Commits, conflicts, bulk changes, transactions, audit, migrations, SQL, coroutines, GUIDs."""

import asyncio
import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.ident import EPOCH_TICKS, is_guid, sequential_guid, sequential_guid_column, time_order
from tessera.operators import migrations
from tessera.operators.aio import Async, AsyncSqlExecutor
from tessera.operators.sql import SqlExecutor
from tessera.operators.uow import DuplicateKeyError, UnitOfWork
from tessera.plans.config import ParamValue, SaveOptions, SqlConfig
from tessera.plans.entity import Entity
from tessera.queries import unit
from tessera.sources.sqltext import bind, parse_command
from tessera.sources.store import ConflictError, SnapshotStore


def seeded(spark, tmp_path, rows, schema="id int, x int", files=2):
    path = f"file://{tmp_path}/seed"
    spark.createDataFrame(rows, schema).repartitionByRange(files, "id").write.parquet(path)
    return SnapshotStore(spark, f"file://{tmp_path}/store", {"t": path})


def uow(spark, store):
    return UnitOfWork(spark, store, [Entity("t", ("id",))])


def content(u):
    return sorted(tuple(r) for r in u.catalog.read("t").collect())


def test_commit_counts_and_keeps_untouched_files(spark, tmp_path):
    store = seeded(spark, tmp_path, [(i, 0) for i in range(10)])
    u = uow(spark, store)
    before = set(store.files("t", 0))
    u.modify("t", {"id": 1, "x": 5})
    u.remove("t", {"id": 2})
    u.add("t", {"id": 10, "x": 1})
    assert u.commit() == 3 and u.commit() == 0
    assert content(u) == sorted([(i, 5 if i == 1 else 0) for i in range(10) if i != 2] + [(10, 1)])
    assert len(before & set(store.files("t", 1))) == 1 and len(content(uow(spark, SnapshotStore(spark, store.root + "x", store.seeds)))) == 10


def test_many_keys_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    """Beyond the broadcast bound a commit gives the same."""
    monkeypatch.setattr("tessera.operators.uow.BROADCAST_KEYS", 0)
    u = uow(spark, seeded(spark, tmp_path, [(i, 0) for i in range(10)]))
    u.modify("t", {"id": 1, "x": 5})
    u.remove("t", {"id": 2})
    u.add("t", {"id": 10, "x": 1})
    assert u.commit() == 3 and content(u) == sorted([(i, 5 if i == 1 else 0) for i in range(10) if i != 2] + [(10, 1)])


def test_conflict_client_wins_and_gone_rows(spark, tmp_path):
    store = seeded(spark, tmp_path, [(1, 0), (2, 0)])
    a, b, c = (uow(spark, store) for _ in range(3))
    for u, x in ((a, 1), (b, 2)):
        u.modify("t", {"id": 1, "x": x})
    c.modify("t", {"id": 2, "x": 9})
    assert a.commit() == 1
    with pytest.raises(ConflictError):
        b.commit()
    assert b.commit_and_refresh_changes() == 1 and c.commit() == 1
    assert content(a) == [(1, 2), (2, 9)]
    a.remove("t", {"id": 7})
    with pytest.raises(ConflictError):
        a.commit()
    assert a.commit_and_refresh_changes() == 0


def test_bulk_null_predicates_change_nothing(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 5), (2, None), (3, -1)]))
    assert u.update_many("t", "x > 0", {"x": F.col("x") + 1}) == 1
    assert u.delete_many("t", "x < 0") == 1 and u.delete_many("t", "x < -9") == 0
    assert content(u) == [(1, 6), (2, None)]
    assert u.delete_many("t", F.lit(True)) == 2 and content(u) == []
    with pytest.raises(ValueError):
        u.update_many("t", "x > 0", {"nope": 1})


def test_reads_do_not_see_pending_and_rollback_is_identity(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0)]))
    u.add("t", {"id": 2, "x": 0})
    assert content(u) == [(1, 0)]
    u.rollback_changes()
    assert u.commit() == 0 and u.store.version() == 0


def test_transactions(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    with pytest.raises(RuntimeError):
        with u.scoped_transaction():
            u.delete_many("t", "id = 1")
            assert content(u) == [(2, 0)]
            raise RuntimeError
    assert content(u) == [(1, 0), (2, 0)]
    handle = u.begin_transaction()
    other = uow(spark, u.store)
    other.use_transaction(handle)
    other.add("t", {"id": 3, "x": 0})
    other.commit()
    u.delete_many("t", "id = 1")
    assert u.get_transaction() is handle
    u.commit_transaction()
    assert content(u) == [(2, 0), (3, 0)] and u.store.version() == 1


def test_audit(spark, tmp_path):
    store = seeded(spark, tmp_path, [(1, 0, None, None, None, None)], "id int, x int, updated_by string, updated_at timestamp_ntz, created_by string, created_at timestamp_ntz")
    u = uow(spark, store)
    u.modify("t", {"id": 1, "x": 1})
    u.add("t", {"id": 2, "x": 2})
    u.commit(lambda o: o.with_audit_metadata("me"))
    one, two = u.catalog.read("t").orderBy("id").collect()
    assert one.updated_by == "me" and one.created_by is None and two.created_by == "me" and isinstance(two.created_at, dt.datetime)
    assert SaveOptions().user_id() is None and not SaveOptions().is_audit_metadata()


def test_manifest_race_has_one_winner(spark, tmp_path):
    store = seeded(spark, tmp_path, [(1, 0)])
    store.publish(0, {})
    with pytest.raises(ConflictError):
        store.publish(0, {})
    assert not [n for n in os.listdir(tmp_path / "store" / "_manifest") if n.startswith(".")]


def test_manifest_through_the_file_system_interface(spark, tmp_path):
    store = seeded(spark, tmp_path, [(1, 0)])
    store.local = False
    assert store.version() == 0 and store.publish(0, {}, ["a"]) == 1 and store.manifest(1)["ledger"] == ["a"]
    with pytest.raises(ConflictError):
        store.publish(0, {})


def test_reload_and_loads(spark, sf):
    u = unit(spark, sf)
    item = u.repository("customer").get(42)
    u.modify("customer", {**item.asDict(), "c_name": "other"})
    assert u.reload("customer", item) == item and u.commit() == 0
    assert u.load_property("customer", item, "nation").n_nationkey == item.c_nationkey
    assert len(u.load_collection("customer", item, "orders")) >= 1
    with pytest.raises(ValueError):
        u.load_property("customer", item, "orders")


def test_migrations_run_in_order_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(migrations, "REGISTRY", [])
    ran = []
    migrations.migration("second", 2024, 2, 1)(lambda u: ran.append(2))
    migrations.migration("first", 2024, 1, 1)(lambda u: ran.append(1))
    u = uow(spark, seeded(spark, tmp_path, [(1, 0)]))
    assert u.get_pending_migrations() == ["first", "second"]
    u.update_database()
    assert ran == [1, 2] and u.get_pending_migrations() == [] and u.update_database() == []


def test_sql_parameters(spark, sf):
    assert bind("SELECT {1}, {0}, {1}, '{0}' -- {3}", [1, 2], {}) == ("SELECT :p1, :p0, :p1, '{0}' -- {3}", {"p0": 1, "p1": 2})
    c = SqlConfig().with_parameters(5, 5)
    assert c.positional == [5, 5] and SqlConfig().with_parameters(1).with_parameters(None, 2).positional == [None, 2]
    c.with_parameters(ParamValue.create("a", 1), ParamValue.create("a", None))
    assert c.named == {"a": None} and c.positional == [5, 5]
    with pytest.raises(ValueError):
        SqlConfig().with_parameters(None)
    with pytest.raises(IndexError):
        bind("{2}", [1], {})
    rows = SqlExecutor(unit(spark, sf)).execute_raw_sql("SELECT n_name, {0} AS x FROM nation WHERE n_nationkey = {1}", lambda r: (r.n_name, r.x), SqlConfig().with_parameters(None, 3))
    assert len(rows) == 1 and rows[0][1] is None


def test_commands(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 5)]))
    ex = u.executor()
    assert ex.execute_command("INSERT INTO t VALUES (3, 7), (4, NULL)") == 2
    assert ex.execute_command("INSERT INTO t (id) SELECT id + 10 FROM t WHERE id = {0}", SqlConfig().with_parameters(1)) == 1
    assert ex.execute_non_query("UPDATE t SET x = x + {0} WHERE x >= {1}", SqlConfig().with_parameters(1, 5)) == 2
    assert ex.execute_command("DELETE FROM t WHERE id = 4") == 1 and ex.execute_command("SELECT * FROM t") == 4
    assert content(u) == [(1, 0), (2, 6), (3, 8), (11, None)]
    for bad in ("DROP TABLE t", "MERGE INTO t USING s ON 1 = 1"):
        with pytest.raises(ValueError):
            ex.execute_command(bad)
    assert parse_command("DELETE FROM t WHERE a IN (SELECT b FROM s WHERE c)").where == "a IN (SELECT b FROM s WHERE c)"


def test_functions_and_timeout(spark, sf):
    ex = unit(spark, sf).executor()
    assert ex.execute_function("abs", SqlConfig().with_parameters(-3)) == 3
    with pytest.raises(ValueError):
        ex.execute_function("abs(1); drop")
    with pytest.raises(TimeoutError):
        ex.execute_query("SELECT count(*) FROM range(100000000) a JOIN range(100000000) b ON a.id % 7 = b.id % 7 AND a.id * b.id % 11 = 3", SqlConfig().with_command_timeout(1))


def test_coroutines(spark, sf):
    u = unit(spark, sf)

    async def both():
        r = u.async_repository("nation")
        n, row = await asyncio.gather(r.count(), r.get(3))
        slow = asyncio.create_task(AsyncSqlExecutor(u.executor()).execute_query("SELECT count(*) FROM range(100000000) a JOIN range(100000000) b ON a.id % 7 = b.id % 7 AND a.id * b.id % 11 = 3"))
        await asyncio.sleep(1)
        slow.cancel()
        with pytest.raises(asyncio.CancelledError):
            await slow
        return n, row, await r.any("n_nationkey = 1")

    assert asyncio.run(both())[0] == 25


def test_guids(spark):
    t = EPOCH_TICKS + 0x1234
    g = sequential_guid(t)
    h = f"{t:016x}"
    assert g[14] == "c" and g[19:23] == h[12:] and g[24:] == h[:12]
    df = spark.range(50).select("id", sequential_guid_column(F.lit(EPOCH_TICKS) + F.col("id") * 70000).alias("g"))
    rows = df.orderBy(*time_order(F.col("g"))).collect()
    assert [r.id for r in rows] == list(range(50)) and len({r.g for r in rows}) == 50
    assert df.where(is_guid(F.col("g"))).count() == 50
    assert spark.createDataFrame([("x",), ("{" + g + "}",), (g + "‌",)], "g string").where(is_guid(F.col("g"))).count() == 1


def test_inserts_and_changes_of_one_item_in_any_order(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    u.add("t", {"id": 3, "x": 1})
    u.modify("t", {"id": 3, "x": 2})
    u.add("t", {"id": 4, "x": 1})
    u.remove("t", {"id": 4})
    u.remove("t", {"id": 1})
    u.add("t", {"id": 1, "x": 9})
    assert u.commit() == 2 and content(u) == [(1, 9), (2, 0), (3, 2)]


def test_keys_stay_unique(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    u.add("t", {"id": 3, "x": 0})
    with pytest.raises(DuplicateKeyError):
        u.add("t", {"id": 3, "x": 1})
    u.rollback_changes()
    u.add("t", {"id": 1, "x": 1})
    for commit in (u.commit, u.commit_and_refresh_changes):
        with pytest.raises(DuplicateKeyError):
            commit()
    u.rollback_changes()
    with pytest.raises(DuplicateKeyError):
        u.insert_many("t", spark.createDataFrame([(5, 0), (5, 1)], "id int, x int"))
    with pytest.raises(DuplicateKeyError):
        u.executor().execute_command("INSERT INTO t VALUES (2, 7)")
    with pytest.raises(DuplicateKeyError):
        u.update_many("t", "true", {"id": 1})
    assert content(u) == [(1, 0), (2, 0)] and u.store.version() == 0


def test_edits_of_tracked_items_are_saved(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0), (3, 0)]))
    one, two = u.repository("t").get(1), u.repository("t").get(2)
    one.x = 5
    own = {"id": 3, "x": 0}
    u.attach("t", own)
    assert u.commit() == 1 and content(u)[0] == (1, 5)
    own["x"] = 8
    assert u.commit() == 0  # no longer watched
    two["x"] = 7
    u.rollback_changes()
    assert u.commit() == 0
    two.x = 6
    u.attach("t", own)
    own["x"] = 9
    assert u.commit() == 2 and content(u) == [(1, 5), (2, 6), (3, 9)]
    with pytest.raises(AttributeError):
        two.nothing = 1
    two.id = 9
    with pytest.raises(ValueError):
        u.commit()


def test_edit_of_a_row_that_changed_since_it_was_read(spark, tmp_path):
    store = seeded(spark, tmp_path, [(1, 0), (2, 0)])
    a, b = uow(spark, store), uow(spark, store)
    item = a.repository("t").get(1)
    b.update_many("t", "id = 1", {"x": 3})
    item.x = 4
    with pytest.raises(ConflictError):
        a.commit()
    assert a.commit_and_refresh_changes() == 1 and content(b) == [(1, 4), (2, 0)]


def test_ended_transactions_take_no_writes(spark, tmp_path):
    a = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    b = uow(spark, a.store)
    handle = a.begin_transaction()
    b.use_transaction(handle)
    a.delete_many("t", "id = 2")
    a.commit_transaction()
    b.add("t", {"id": 5, "x": 0})
    for call in (lambda: b.delete_many("t", "id = 1"), b.commit_transaction, b.rollback_transaction, b.commit, lambda: b.catalog.read("t"), lambda: uow(spark, a.store).use_transaction(handle)):
        with pytest.raises(RuntimeError):
            call()
    b.use_transaction(None)
    assert b.commit() == 1 and content(b) == [(1, 0), (5, 0)]


def test_joined_transactions_survive_dispose(spark, tmp_path):
    a = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    b = uow(spark, a.store)
    b.use_transaction(a.begin_transaction())
    b.delete_many("t", "id = 1")
    b.dispose()
    a.commit_transaction()
    assert content(a) == [(2, 0)]


def test_scope_closes_after_a_conflict(spark, tmp_path):
    a = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    with pytest.raises(ConflictError):
        with a.scoped_transaction():
            a.delete_many("t", "id = 1")
            uow(spark, a.store).delete_many("t", "id = 2")
    assert a.get_transaction() is None and content(a) == [(1, 0)]


def test_asynchronous_actions(spark, tmp_path):
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0), (3, 0)]))

    async def drop(x):
        return await x.delete_many("t", "id = 1")

    async def fail(x):
        await x.delete_many("t", "id = 2")
        raise KeyError("no")

    with pytest.raises(TypeError):
        u.execute_transaction(drop)
    assert content(u) == [(1, 0), (2, 0), (3, 0)]
    assert asyncio.run(AsyncSqlExecutor(u.executor()).execute_transaction(lambda x: Async(u).delete_many("t", "id = 3"))) == 1
    assert asyncio.run(Async(u).execute_transaction(drop)) == 1
    with pytest.raises(KeyError):
        asyncio.run(Async(u).execute_transaction(fail))
    assert content(u) == [(2, 0)] and u.get_transaction() is None


@pytest.mark.parametrize("how", ["timeout", "cancel"])
def test_nothing_is_published_after_a_stop(spark, tmp_path, how, monkeypatch):
    """The call is stopped between its jobs: what it would have written doesn't take effect."""
    u = uow(spark, seeded(spark, tmp_path, [(1, 0), (2, 0)]))
    write = SnapshotStore.write

    def slowly(self, *a):
        time.sleep(2.5)
        return write(self, *a)

    monkeypatch.setattr(SnapshotStore, "write", slowly)
    if how == "timeout":
        with pytest.raises(TimeoutError):
            u.executor().execute_command("DELETE FROM t WHERE id = 1", SqlConfig().with_command_timeout(1.5))
    else:

        async def run():
            task = asyncio.create_task(Async(u).delete_many("t", "id = 1"))
            await asyncio.sleep(1.5)
            task.cancel()
            with pytest.raises(asyncio.CancelledError):
                await task

        asyncio.run(run())
    time.sleep(3)
    assert u.store.version() == 0


def test_views_are_the_calls_own(spark, sf):
    spark.range(3).createOrReplaceTempView("region")
    try:
        u = unit(spark, sf)
        later = u.executor().execute_query_df("SELECT r_name FROM region WHERE r_name <> 'nation'")
        u.delete_many("region", "r_regionkey = 0")
        assert u.executor().execute_command("SELECT * FROM region") == 4 and later.count() == 5
        assert spark.table("region").columns == ["id"] and not spark.catalog.tableExists("nation")
    finally:
        spark.catalog.dropTempView("region")


def test_command_grammar():
    c = parse_command("/* x */ UPDATE t AS a SET a.x = a.y + 1, z = \"a.b, where\" WHERE a.id = 3 AND s = 'a.q' -- end")
    assert c.table == "t" and c.assignments == (("x", "y + 1"), ("z", '"a.b, where"')) and c.where == "id = 3 AND s = 'a.q'"
    c = parse_command("DELETE FROM t a WHERE a.id IN (1, 2)")
    assert c.table == "t" and c.where == "id IN (1, 2)" and parse_command("delete from t").where is None
    assert parse_command("UPDATE t SET t.x = 1").assignments == (("x", "1"),)


def test_manifest_does_not_list_files(spark, tmp_path):
    store = seeded(spark, tmp_path, [(i, 0) for i in range(40)], files=8)
    u = uow(spark, store)
    u.add("t", {"id": 99, "x": 1})
    u.commit()
    assert [g["gone"] for g in store.groups("t", 1)] == [[], []]
    u.delete_many("t", "id = 3")
    first = store.groups("t", 2)[0]
    seed = [f for f in store.files("t", 2) if "/seed/" in f]
    assert len(first["gone"]) == 1 and len(seed) == 7 and len(content(u)) == 40
    u.delete_many("t", "true")
    assert content(u) == []
