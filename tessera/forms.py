"""More of the query catalogue: sets, commits and transactions in full, and the eager and asynchronous forms of reads."""

from __future__ import annotations

import asyncio
import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.ident import EPOCH_TICKS, is_guid, sequential_guid, sequential_guid_column, time_order
from tessera.operators import migrations
from tessera.operators.repository import EntitySet
from tessera.operators.uow import UnitOfWork
from tessera.plans.config import ReadConfig, Sort, SqlConfig
from tessera.plans.entity import Entity
from tessera.queries import InDebt, by, query, repo, unit


def rows(spark, found, schema: str):
    """Rows that a call returned, as a frame again."""
    return spark.createDataFrame([tuple(r) for r in found], schema)


REGION, NATION, SUPPLIER = "r_regionkey int, r_name string", "n_nationkey int, n_name string, n_regionkey int", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"

# sets


@query("SELECT * FROM supplier WHERE s_acctbal > 5000")
def set_execute(spark, d):
    return rows(spark, unit(spark, d).create_set("supplier").where("s_acctbal > 5000").execute(), SUPPLIER)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def set_find(spark, d):
    found = unit(spark, d).create_set("part").find(7)
    return rows(spark, [(found.p_partkey, found.p_name)], "p_partkey long, p_name string")


@query("SELECT * FROM region UNION ALL SELECT CAST(50 AS INTEGER), 'INSERTED'")
def set_insert(spark, d):
    u = unit(spark, d)
    u.create_set("region").insert({"r_regionkey": 50, "r_name": "INSERTED"})
    u.commit()
    return u.catalog.read("region")


@query("SELECT * FROM supplier WHERE NOT coalesce(s_nationkey = 3, false)")
def set_delete_many(spark, d):
    u = unit(spark, d)
    u.create_set("supplier").delete_many("s_nationkey = 3")
    return u.catalog.read("supplier")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'IN DEBT' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def set_update_many(spark, d):
    u = unit(spark, d)
    u.create_set("supplier").update_many(lambda s: s.s_acctbal < 0, {"s_name": "IN DEBT"})
    return u.catalog.read("supplier")


@query("SELECT DISTINCT c_nationkey FROM customer")
def linq_distinct_by(spark, d):
    return unit(spark, d).create_set("customer").distinct_by("c_nationkey").select("c_nationkey")


@query("SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_regionkey FROM nation")
def linq_union_by(spark, d):
    nations = unit(spark, d).create_set("nation")
    return nations.where("n_nationkey < 5").union_by(nations, "n_regionkey").select(F.col("n_regionkey").alias("k"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def linq_intersect_by(spark, d):
    u = unit(spark, d)
    keys = u.create_set("customer").where(InDebt()).select(F.col("c_custkey").alias("o_custkey"))
    return u.create_set("orders").intersect_by(keys, "o_custkey").select("o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def linq_except_by(spark, d):
    u = unit(spark, d)
    keys = u.create_set("customer").where(InDebt()).select(F.col("c_custkey").alias("o_custkey"))
    return u.create_set("orders").except_by(keys, "o_custkey").select("o_custkey")


@query("WITH f AS (SELECT c_acctbal AS b, c_custkey AS k FROM customer WHERE NOT c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1) SELECT c.* FROM customer c, f WHERE c.c_acctbal > f.b OR (c.c_acctbal = f.b AND c.c_custkey < f.k)")
def linq_take_while(spark, d):
    return unit(spark, d).create_set("customer").take_while(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal").desc(), "c_custkey").df


@query("WITH f AS (SELECT min(o_orderkey) AS k FROM orders WHERE NOT o_orderkey < 1000) SELECT o.* FROM orders o, f WHERE o.o_orderkey >= f.k")
def linq_skip_while(spark, d):
    return unit(spark, d).create_set("orders").skip_while(F.col("o_orderkey") < 1000, "o_orderkey").df


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15")
def linq_take_last(spark, d):
    return unit(spark, d).create_set("orders").take_last(15, "o_totalprice", "o_orderkey").df


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 20)")
def linq_skip_last(spark, d):
    return unit(spark, d).create_set("customer").skip_last(20, Sort("c_acctbal", True), "c_custkey").df


@query("SELECT o_orderkey, l.l_linenumber, l.l_quantity FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def linq_select_many(spark, d):
    u = unit(spark, d)
    orders = u.repository("orders").get_filtered_df("o_orderstatus = 'P'", ReadConfig().with_properties("lineitems"))
    flat = EntitySet(u.repository("orders"), orders.select(F.transform("lineitems", lambda x: F.struct("o_orderkey", x.l_linenumber.alias("l_linenumber"), x.l_quantity.alias("l_quantity"))).alias("xs")))
    return flat.select_many("xs")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def linq_join(spark, d):
    u = unit(spark, d)
    nations = EntitySet(u.repository("nation"), u.create_set("nation").select("n_name", F.col("n_regionkey").alias("r_regionkey")))
    return nations.join(u.create_set("region"), "r_regionkey").select("n_name", "r_name")


@query("SELECT r_regionkey, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 12 GROUP BY r_regionkey")
def linq_group_join(spark, d):
    u = unit(spark, d)
    nations = u.create_set("nation").where("n_nationkey > 12").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    return u.create_set("region").group_join(nations, ["r_regionkey"], "own").select("r_regionkey", F.size("own").cast("long").alias("nations"))


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS total, avg(p_retailprice) AS mean, min(p_size)::BIGINT AS low, max(p_size)::BIGINT AS high, (SELECT count(DISTINCT p_brand) FROM part) AS brands FROM part")
def linq_aggregates(spark, d):
    parts = unit(spark, d).create_set("part")
    one = (parts.count(), parts.sum("p_size"), parts.average("p_retailprice"), parts.min("p_size"), parts.max("p_size"), parts.aggregate(F.count_distinct("p_brand"))[0])
    return rows(spark, [one], "n long, total long, mean double, low long, high long, brands long")


@query("SELECT (SELECT count(*) > 0 FROM orders WHERE o_totalprice > 400000) AS some, (SELECT bool_and(o_totalprice > 0) FROM orders) AS every, (SELECT count(*) > 0 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 77) AS has, true AS equal")
def linq_tests(spark, d):
    u = unit(spark, d)
    orders, nations = u.create_set("orders"), u.create_set("nation")
    split = nations.where("n_nationkey < 9").concat(nations.where("n_nationkey >= 9"))
    one = (orders.any("o_totalprice > 400000"), orders.all(F.col("o_totalprice") > 0), nations.contains({"n_nationkey": 3, "n_regionkey": 77}), nations.sequence_equal(split))
    return rows(spark, [one], "some boolean, every boolean, has boolean, equal boolean")


@query("(SELECT 'first' AS what, c_custkey AS k FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) UNION ALL (SELECT 'last', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1) UNION ALL (SELECT 'single', c_custkey FROM customer WHERE c_custkey = 11) UNION ALL (SELECT 'at', c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1 OFFSET 30)")
def linq_elements(spark, d):
    c, order = unit(spark, d).create_set("customer"), ("c_acctbal", "c_custkey")
    found = [("first", c.first(*order)), ("last", c.last(*order)), ("single", c.where("c_custkey = 11").single()), ("at", c.element_at(30, *order))]
    return rows(spark, [(what, r.c_custkey) for what, r in found], "what string, k long")


@query("SELECT TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS k, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders WHERE o_orderstatus = 'P'")
def linq_of_type_cast(spark, d):
    u = unit(spark, d)
    first = u.create_set("orders").where("o_orderstatus = 'P'").select(F.substring("o_orderpriority", 1, 1).alias("k"), "o_custkey")
    return EntitySet(u.repository("orders"), first).of_type("k", "int").cast(o_custkey="string").df


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS i FROM supplier) SELECT n_name, s_name FROM a JOIN b USING (i)")
def linq_zip(spark, d):
    u = unit(spark, d)
    names = EntitySet(u.repository("nation"), u.create_set("nation").select("n_name"))
    return names.zip(u.create_set("supplier").select("s_name"), "n_name", "s_name")


@query("WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk FROM orders) SELECT chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM r GROUP BY chunk")
def linq_chunk(spark, d):
    chunks = unit(spark, d).create_set("orders").chunk(100, "o_orderkey")
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT * FROM region UNION ALL SELECT CAST(70 AS INTEGER), 'LAST' UNION ALL SELECT CAST(71 AS INTEGER), 'FIRST' UNION ALL SELECT CAST(72 AS INTEGER), 'NONE'")
def linq_append_prepend(spark, d):
    regions = unit(spark, d).create_set("region")
    default = regions.where("r_regionkey < 0").default_if_empty({"r_regionkey": 72, "r_name": "NONE"})
    return regions.append({"r_regionkey": 70, "r_name": "LAST"}).prepend({"r_regionkey": 71, "r_name": "FIRST"}).concat(default).df


# units of work


@query("SELECT * FROM region UNION ALL SELECT CAST(60 AS INTEGER), 'SECOND THOUGHT'")
def add_modify_commit(spark, d):
    u = unit(spark, d)
    regions = u.repository("region")
    regions.add({"r_regionkey": 60, "r_name": "NEW"})
    regions.modify({"r_regionkey": 60, "r_name": "SECOND THOUGHT"})
    u.commit()
    return u.catalog.read("region")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'REPLACED' ELSE r_name END AS r_name FROM region")
def add_remove_commit(spark, d):
    u = unit(spark, d)
    regions = u.repository("region")
    regions.add({"r_regionkey": 61, "r_name": "NEVER"})
    regions.remove({"r_regionkey": 61})
    regions.remove({"r_regionkey": 2})
    regions.add({"r_regionkey": 2, "r_name": "REPLACED"})
    u.commit()
    return u.catalog.read("region")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 4 THEN 'EDITED' WHEN 5 THEN 'ATTACHED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def attach_edit_commit(spark, d):
    u = unit(spark, d)
    read = u.repository("nation").get(4)
    read.n_name = "EDITED"
    own = u.repository("nation").get(5, ReadConfig().with_no_tracking()).asDict()
    u.attach("nation", own)
    own["n_name"] = "ATTACHED"
    u.commit()
    return u.catalog.read("nation")


@query("SELECT count(*) AS saved, 'NATION_4' AS kept FROM nation WHERE false")
def no_tracking_edit(spark, d):
    u = unit(spark, d)
    own = u.repository("nation").get(4, ReadConfig().with_no_tracking().with_tag("read only")).asDict()
    own["n_name"] = "NOT SAVED"
    return rows(spark, [(u.commit(), u.repository("nation").get(4).n_name)], "saved long, kept string")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (4, 30) THEN 'auditor' ELSE n_name END AS n_name, n_regionkey FROM (SELECT * FROM nation UNION ALL SELECT CAST(30 AS INTEGER), 'x', CAST(1 AS INTEGER))")
def commit_with_options(spark, d):
    u = unit(spark, d)
    u = UnitOfWork(spark, u.store, [Entity("nation", ("n_nationkey",), updated_by="n_name")])
    u.modify("nation", {"n_nationkey": 4, "n_name": "plain", "n_regionkey": int(u.repository("nation").get(4).n_regionkey)})
    u.add("nation", {"n_nationkey": 30, "n_name": "plain", "n_regionkey": 1})
    u.commit(lambda o: o.with_audit_metadata("auditor"))
    return u.catalog.read("nation")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'auditor' ELSE r_name END AS r_name FROM region")
def client_wins_with_options(spark, d):
    store, described = unit(spark, d).store, [Entity("region", ("r_regionkey",), updated_by="r_name")]
    one, two = UnitOfWork(spark, store, described), UnitOfWork(spark, store, described)
    for u in (one, two):
        u.modify("region", {"r_regionkey": 1, "r_name": "plain"})
    one.commit()
    two.commit_and_refresh_changes(lambda o: o.with_audit_metadata("auditor"))
    return two.catalog.read("region")


@query("SELECT (SELECT count(*) FROM nation) AS plain, (SELECT count(*) FROM nation) AS queryable, (SELECT count(*) FROM nation) AS asynchronous, (SELECT count(*) FROM region) AS executed")
def factories(spark, d):
    u = unit(spark, d)
    counts = (u.repository("nation").count(), u.queryable_repository("nation").count(), asyncio.run(u.async_repository("nation").count()), u.executor().execute_command("SELECT * FROM region"))
    return rows(spark, [counts], "plain long, queryable long, asynchronous long, executed long")


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (1, 2)")
def join_transaction(spark, d):
    one = unit(spark, d)
    two = unit(spark, d, one.store)
    one.begin_transaction()
    two.use_transaction(one.get_transaction())
    two.remove("supplier", {"s_suppkey": 1})
    two.commit()
    one.delete_many("supplier", "s_suppkey = 2")
    one.commit_transaction()
    two.use_transaction(None)
    return two.catalog.read("supplier")


@query("SELECT * FROM supplier WHERE s_suppkey <> 3")
def async_transaction(spark, d):
    from tessera.operators.aio import AsyncUnitOfWork

    u = unit(spark, d)

    async def action(x):
        await x.delete_many("supplier", "s_suppkey = 3")

    asyncio.run(AsyncUnitOfWork(u).execute_transaction(action))
    return u.catalog.read("supplier")


@query("SELECT * FROM region")
def dispose(spark, d):
    with unit(spark, d) as u:
        u.add("region", {"r_regionkey": 90, "r_name": "GONE"})
        u.begin_transaction()
        u.delete_many("region", "r_regionkey = 1")
    return unit(spark, d, u.store).catalog.read("region")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 6")
def reload(spark, d):
    u = unit(spark, d)
    item = u.repository("nation").get(6)
    item.n_name = "DROPPED"
    found = u.reload("nation", item)
    u.commit()
    return rows(spark, [(found.n_nationkey, found.n_name)], "n_nationkey int, n_name string")


@query("SELECT 'pending' AS what, 2 AS n UNION ALL SELECT 'applied', 2 UNION ALL SELECT 'left', 0 UNION ALL SELECT 'rows', (SELECT count(*)::INTEGER + 1 FROM region)")
def migrations_run(spark, d):
    u = unit(spark, d)
    own = [
        migrations.Migration("no region 0", dt.datetime(2024, 1, 1), lambda x: x.delete_many("region", "r_regionkey = 0")),
        migrations.Migration("two regions", dt.datetime(2024, 2, 1), lambda x: x.insert_many("region", spark.createDataFrame([(80, "A"), (81, "B")], REGION))),
    ]
    pending = len(u.get_pending_migrations(own))
    found = [("pending", pending), ("applied", len(u.update_database(own))), ("left", len(u.get_pending_migrations(own))), ("rows", u.repository("region").count())]
    return rows(spark, found, "what string, n int")


# SQL, tags, limits of time


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name <> 'say \"hi\"' AND s_suppkey <> 4")
def execute_command_alias(spark, d):
    u = unit(spark, d)
    u.executor().execute_command("-- a comment\nDELETE FROM supplier AS s WHERE s.s_suppkey = {0} /* one */ OR s.s_name = \"where\"", SqlConfig().with_parameters(4))
    return u.catalog.read("supplier").select("s_suppkey", "s_name")


@query("SELECT true AS timed_out, count(*) AS left_rows FROM part")
def command_timeout(spark, d):
    u = unit(spark, d)
    try:
        slow = "DELETE FROM part WHERE p_size > 0 AND reduce(sequence(1, 2000000), 0, (a, x) -> (a + x) % 1000003) >= 0 AND reduce(sequence(1, 3000000), 0, (a, x) -> (a + x + p_size) % 1000003) >= 0"
        u.executor().execute_command(slow, SqlConfig().with_command_timeout(1))
        late = False
    except TimeoutError:
        late = True
    return rows(spark, [(late, u.repository("part").count())], "timed_out boolean, left_rows long")


@query("SELECT true AS cancelled, count(*) AS left_rows FROM part")
def cancelled_command(spark, d):
    from tessera.operators.aio import AsyncSqlExecutor

    u = unit(spark, d)

    async def run() -> bool:
        slow = asyncio.create_task(AsyncSqlExecutor(u.executor()).execute_command("DELETE FROM part WHERE reduce(sequence(1, 3000000), 0, (a, x) -> (a + x + p_size) % 1000003) >= 0"))
        await asyncio.sleep(0.3)
        slow.cancel()
        try:
            await slow
        except asyncio.CancelledError:
            return True
        return False

    return rows(spark, [(asyncio.run(run()), u.repository("part").count())], "cancelled boolean, left_rows long")


# eager and asynchronous forms

READS = """
SELECT 'all' AS what, count(*) AS n FROM nation UNION ALL SELECT 'get', 3 UNION ALL SELECT 'filtered', count(*) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'mapped', count(*) FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'first', min(n_nationkey) FROM nation WHERE n_regionkey = 3
UNION ALL SELECT 'first_mapped', max(n_nationkey) FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'single', 7 UNION ALL SELECT 'paged', 4
UNION ALL SELECT 'count', count(*) FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'any', 1 UNION ALL SELECT 'all_true', 1
"""


def reads_of(call):
    """(name, arguments) of each read, and what is told of its result."""
    down = by(Sort("n_nationkey", True)).with_tag("reads")
    return [
        ("all", call("get_all"), len), ("get", call("get", 3), lambda r: r.n_nationkey), ("filtered", call("get_filtered", "n_regionkey = 1"), len),
        ("mapped", call("get_mapped", "n_regionkey = 2", "n_name"), len), ("first", call("get_first", "n_regionkey = 3"), lambda r: r.n_nationkey),
        ("first_mapped", call("get_first_mapped", "n_regionkey = 3", "n_nationkey", down), lambda r: r.n_nationkey), ("single", call("get_single", "n_nationkey = 7"), lambda r: r.n_nationkey),
        ("paged", call("get_paged", 1, 4), len), ("count", call("count", "n_regionkey = 4"), int), ("any", call("any", "n_regionkey = 0"), int), ("all_true", call("all", "n_nationkey >= 0"), int),
    ]


@query(READS)
def eager_reads(spark, d):
    r = repo(spark, d, "nation")
    return rows(spark, [(what, tell(got)) for what, got, tell in reads_of(lambda name, *a: getattr(r, name)(*a))], "what string, n long")


@query(READS)
def async_reads(spark, d):
    r = unit(spark, d).async_repository("nation")

    async def run():
        asked = reads_of(lambda name, *a: getattr(r, name)(*a))
        got = await asyncio.gather(*(x for _, x, _ in asked))
        return [(what, tell(g)) for (what, _, tell), g in zip(asked, got, strict=True)]

    return rows(spark, asyncio.run(run()), "what string, n long")


@query("SELECT count(*) AS total, (SELECT count(*) FROM (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' LIMIT 10)) AS items FROM customer WHERE c_mktsegment = 'BUILDING'")
def find_page_total(spark, d):
    page = repo(spark, d, "customer", customer=lambda c: c.c_acctbal >= 0).find_page("c_mktsegment = 'BUILDING'", 0, 10, ReadConfig().without_query_filters())
    return rows(spark, [(page.total, page.items.count())], "total long, items long")


@query("SELECT 1 + (SELECT count(*) FROM (SELECT 1 FROM customer LIMIT 100)) AS guids, 1 + (SELECT count(*) FROM (SELECT 1 FROM customer LIMIT 100)) AS valid, true AS ordered")
def guids(spark, d):
    ticks = F.lit(EPOCH_TICKS) + F.col("c_custkey") * 70000
    made = repo(spark, d, "customer").get_mapped_df("c_custkey < 100", lambda c: [c.c_custkey, sequential_guid_column(ticks).alias("g")])
    found = made.orderBy(*time_order(F.col("g"))).collect()
    all_of = spark.createDataFrame([(r.g,) for r in found] + [(sequential_guid(),), ("{not a guid}",)], "g string")
    return rows(spark, [(len({r.g for r in found}) + 1, all_of.where(is_guid(F.col("g"))).count(), [r.c_custkey for r in found] == sorted(r.c_custkey for r in found))], "guids long, valid long, ordered boolean")
