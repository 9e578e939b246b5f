"""The query catalogue: every read, write and SQL operator over the synthetic tables, with DuckDB SQL for each."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import catalog, entities
from tessera.operators.repository import EntitySet, Repository
from tessera.operators.sql import procedure
from tessera.operators.uow import UnitOfWork
from tessera.plans.config import ParamValue, ReadConfig, Sort, SqlConfig
from tessera.plans.spec import Specification, Where
from tessera.sources.store import SnapshotStore

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def mark(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return mark


def repo(spark: SparkSession, sf_dir: str, name: str, **filters) -> Repository:
    c = catalog(spark, sf_dir, **filters)
    return Repository(c, c.entity(name))


def store_root(spark: SparkSession) -> str:
    """A new folder for snapshots: in the shared folder of the cluster, else, on one machine only, a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="tessera-store-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def unit(spark: SparkSession, sf_dir: str, store: SnapshotStore | None = None) -> UnitOfWork:
    """A unit of work over the tables; nothing is written to their folder."""
    made = entities()
    store = store or SnapshotStore(spark, store_root(spark), {e.name: f"{sf_dir}/{e.name}.parquet" for e in made})
    return UnitOfWork(spark, store, made)


class InDebt(Specification):
    def satisfied_by(self, row):
        return row.c_acctbal < 0


class OrderOrSegment(Specification):
    """Order priority or customer segment starts with a text."""

    def __init__(self, priority: str, segment: str):
        self.priority, self.segment = priority, segment

    def satisfied_by(self, row):
        return row.o_orderpriority.startswith(self.priority) | row.customer.c_mktsegment.startswith(self.segment)


def flat(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Fields of an included struct as columns named after both."""
    return df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in columns])


def by(*keys) -> ReadConfig:
    return ReadConfig().with_sorting(*keys)


@query("SELECT * FROM nation")
def get_all(spark, d):
    return repo(spark, d, "nation").get_all_df()


@query("SELECT * FROM customer WHERE c_custkey = 42")
def get_by_key(spark, d):
    return repo(spark, d, "customer").get_df(42)


@query("SELECT * FROM part WHERE p_partkey = 7")
def find_by_key(spark, d):
    return EntitySet(repo(spark, d, "part")).repository.get_df(7)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def get_filtered(spark, d):
    return repo(spark, d, "orders").get_filtered_df(lambda o: (o.o_orderstatus == "F") & (o.o_totalprice > 100000))


@query("SELECT c.* FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment LIKE 'A%' OR n.n_name LIKE 'NATION_1%'")
def all_matching_nav(spark, d):
    return repo(spark, d, "customer").all_matching_df(Where(lambda c: c.c_mktsegment.startswith("A")) | Where(lambda c: c.nation.n_name.like("NATION_1%")))


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, d):
    return repo(spark, d, "lineitem").count_df()


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal < 0")
def count_spec(spark, d):
    return repo(spark, d, "customer").count_df(InDebt())


@query("SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 10")
def count_filter(spark, d):
    return repo(spark, d, "events").count_df("event_type = 'purchase' AND value > 10")


@query("SELECT count(*) > 0 AS result FROM orders")
def any_all(spark, d):
    return repo(spark, d, "orders").any_df()


@query("SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice < 0")
def any_filter(spark, d):
    return repo(spark, d, "orders").any_df(lambda o: o.o_totalprice < 0)


@query("SELECT count(*) > 0 AS result FROM customer WHERE c_acctbal < 0")
def any_spec(spark, d):
    return repo(spark, d, "customer").any_df(InDebt())


@query("SELECT coalesce(bool_and(coalesce(o_totalprice > 0, false)), true) AS result FROM orders")
def all_filter(spark, d):
    return repo(spark, d, "orders").all_df(lambda o: o.o_totalprice > 0)


@query("SELECT coalesce(bool_and(coalesce(c_acctbal > 0, false)), true) AS result FROM customer")
def all_spec(spark, d):
    return repo(spark, d, "customer").all_df(Where(lambda c: c.c_acctbal > 0))


@query("SELECT coalesce(bool_and(coalesce(c_acctbal > 0, false)), true) AS result FROM customer WHERE c_custkey < 0")
def all_empty(spark, d):
    return repo(spark, d, "customer").all_df(lambda c: c.c_acctbal > 0, ReadConfig().with_before_customization(lambda df: df.where("c_custkey < 0")))


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderpriority = '1-URGENT'")
def get_mapped_filter(spark, d):
    return repo(spark, d, "orders").get_mapped_df(lambda o: o.o_orderpriority == "1-URGENT", lambda o: [o.o_orderkey, (o.o_totalprice * 2).alias("doubled")])


@query("SELECT c_custkey, upper(c_name) AS name_upper FROM customer WHERE c_acctbal < 0")
def get_mapped_spec(spark, d):
    return repo(spark, d, "customer").get_mapped_df(InDebt(), lambda c: [c.c_custkey, F.upper(c.c_name).alias("name_upper")])


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def get_first_filter(spark, d):
    return repo(spark, d, "orders").get_first_df("o_orderstatus = 'O'", by(Sort("o_totalprice", True)))


@query("SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 1")
def get_first_spec(spark, d):
    return repo(spark, d, "customer").get_first_df(InDebt(), by("c_acctbal"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def get_first_mapped_filter(spark, d):
    return repo(spark, d, "orders").get_first_mapped_df("o_orderstatus = 'P'", ["o_orderkey", "o_totalprice"], by(Sort("o_totalprice", True)))


@query("SELECT c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 1")
def get_first_mapped_spec(spark, d):
    return repo(spark, d, "customer").get_first_mapped_df(InDebt(), "c_name", by("c_acctbal"))


@query("SELECT * FROM region WHERE r_regionkey = 3")
def get_single_filter(spark, d):
    return repo(spark, d, "region").get_single_df("r_regionkey = 3")


@query("SELECT * FROM supplier WHERE s_suppkey = 5")
def get_single_spec(spark, d):
    return repo(spark, d, "supplier").get_single_df(Where(lambda s: s.s_suppkey == 5))


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def get_paged_limit(spark, d):
    return repo(spark, d, "customer").get_paged_df(25, config=by(Sort("c_acctbal", True)))


@query("SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def get_paged_limit_spec(spark, d):
    return repo(spark, d, "customer").get_paged_df(InDebt(), 10)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def get_paged_limit_filter(spark, d):
    return repo(spark, d, "orders").get_paged_df("o_orderstatus = 'F'", 10, config=by(Sort("o_totalprice", True)))


@query("SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def get_paged(spark, d):
    return repo(spark, d, "part").get_paged_df(2, 20, config=by(Sort("p_retailprice", True)))


@query("SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10 OFFSET 10")
def get_paged_spec(spark, d):
    return repo(spark, d, "customer").get_paged_df(InDebt(), 1, 10)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def get_paged_filter(spark, d):
    return repo(spark, d, "orders").get_paged_df("o_orderstatus = 'F'", 2, 50, config=by("o_orderdate"))


@query("SELECT * FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 30")
def multi_sort(spark, d):
    return repo(spark, d, "supplier").get_paged_df(30, config=by("s_nationkey", Sort("s_acctbal", True)))


@query("SELECT o.*, c.c_name AS customer_c_name, c.c_mktsegment AS customer_c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def include_one(spark, d):
    return flat(repo(spark, d, "orders").get_all_df(ReadConfig().with_properties("customer")), "customer", "c_name", "c_mktsegment")


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS lineitems_n, CAST(coalesce(sum(l.l_linenumber), 0) AS BIGINT) AS linenumber_sum FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def include_many(spark, d):
    df = repo(spark, d, "orders").get_all_df(ReadConfig().with_properties("lineitems"))
    total = F.aggregate("lineitems.l_linenumber", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("o_orderkey", F.size("lineitems").cast("long").alias("lineitems_n"), total.alias("linenumber_sum"))


@query("SELECT d.doc_id, d.lang, l.quality AS label_quality, l.toxic AS label_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def include_one_optional(spark, d):
    df = flat(repo(spark, d, "documents").get_all_df(ReadConfig().with_properties("label")), "label", "quality", "toxic")
    return df.select("doc_id", "lang", "label_quality", "label_toxic")


@query("SELECT * FROM conversations WHERE conv_id = 1 AND turn = 1")
def get_by_composite_key(spark, d):
    return repo(spark, d, "conversations").get_df((1, 1))


@query("SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def nav_to_many_any(spark, d):
    return repo(spark, d, "orders").get_filtered_df(lambda o: o.lineitems.none())


@query("SELECT o.*, c.c_name AS customer_c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority LIKE '1%' OR c.c_mktsegment LIKE 'B%' ORDER BY o.o_orderdate, o.o_orderkey LIMIT 20 OFFSET 20")
def find_page(spark, d):
    page = repo(spark, d, "orders").get_paged_df(OrderOrSegment("1", "B"), 1, 20, config=by("o_orderdate").with_properties("customer"))
    return flat(page, "customer", "c_name")


@query("SELECT count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority LIKE '1%' OR c.c_mktsegment LIKE 'B%'")
def find_total(spark, d):
    return repo(spark, d, "orders").count_df(OrderOrSegment("1", "B"))


@query("SELECT n.* FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = 42")
def load_property(spark, d):
    u = unit(spark, d)
    return u.load_property_df("customer", u.repository("customer").get(42), "nation")


@query("SELECT * FROM orders WHERE o_custkey = 42 AND o_totalprice > 50000")
def load_collection(spark, d):
    u = unit(spark, d)
    return u.load_collection_df("customer", u.repository("customer").get(42), "orders", lambda o: o.o_totalprice > 50000)


@query("SELECT DISTINCT * FROM customer WHERE c_nationkey < 10 AND c_acctbal > 0")
def before_after_hooks(spark, d):
    config = ReadConfig().with_before_customization(lambda df: df.where("c_nationkey < 10")).with_after_customization(lambda df: df.distinct())
    return repo(spark, d, "customer").get_filtered_df("c_acctbal > 0", config)


@query("SELECT * FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def query_filter_on(spark, d):
    return repo(spark, d, "customer", customer=lambda c: c.c_acctbal >= 0).get_filtered_df("c_mktsegment = 'BUILDING'")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def query_filter_off(spark, d):
    return repo(spark, d, "customer", customer=lambda c: c.c_acctbal >= 0).get_filtered_df("c_mktsegment = 'BUILDING'", ReadConfig().without_query_filters())


@query("SELECT * FROM (SELECT * FROM part WHERE p_size > 10) AS t WHERE p_retailprice > 950")
def from_sql_raw(spark, d):
    return repo(spark, d, "part").get_filtered_df("p_retailprice > 950", ReadConfig().from_sql_raw("SELECT * FROM part WHERE p_size > 10"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 1400")
def execute_query_positional(spark, d):
    return unit(spark, d).executor().execute_query_df("SELECT c_custkey, c_name FROM customer WHERE c_custkey > {0}", SqlConfig().with_parameters(1400))


@query("SELECT 5 AS a, 5 AS b")
def execute_query_dup_params(spark, d):
    return unit(spark, d).executor().execute_query_df("SELECT {1} AS a, {0} AS b", SqlConfig().with_parameters(5, 5))


@query("SELECT * FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'O'")
def execute_query_named(spark, d):
    config = SqlConfig().with_parameters(ParamValue.create("cust", 42), ParamValue.create("status", "O"))
    return unit(spark, d).executor().execute_query_df("SELECT * FROM orders WHERE o_custkey = :cust AND o_orderstatus = :status", config)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def execute_function_table(spark, d):
    u = unit(spark, d)
    u.catalog.read("customer").createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION customers_of(nation INT) RETURNS TABLE(c_custkey BIGINT, c_name STRING) RETURN SELECT c_custkey, c_name FROM customer WHERE c_nationkey = nation")
    return u.executor().execute_function_df("customers_of", SqlConfig().with_parameters(3), table=True)


@query("SELECT * FROM region UNION ALL SELECT CAST(99 AS INTEGER), 'NEW'")
def add_commit(spark, d):
    u = unit(spark, d)
    u.repository("region").add({"r_regionkey": 99, "r_name": "NEW"})
    u.commit()
    return u.catalog.read("region")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS r_name FROM region")
def modify_commit(spark, d):
    u = unit(spark, d)
    regions = u.repository("region")
    regions.merge(regions.get(2), {"r_name": "CHANGED"})
    u.commit()
    return u.catalog.read("region")


@query("SELECT * FROM nation WHERE n_nationkey <> 7")
def remove_commit(spark, d):
    u = unit(spark, d)
    nations = u.repository("nation")
    nations.remove(nations.get(7))
    u.commit()
    return u.catalog.read("nation")


@query("SELECT * FROM region")
def rollback(spark, d):
    u = unit(spark, d)
    u.repository("region").add({"r_regionkey": 99, "r_name": "NEW"})
    u.rollback_changes()
    u.commit()
    return u.catalog.read("region")


@query("SELECT * FROM orders WHERE NOT coalesce(o_totalprice < 100000, false)")
def delete_many(spark, d):
    u = unit(spark, d)
    u.repository("orders").delete_many(lambda o: o.o_totalprice < 100000)
    return u.catalog.read("orders")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_many(spark, d):
    u = unit(spark, d)
    u.repository("customer").update_many("c_mktsegment = 'BUILDING'", {"c_acctbal": F.col("c_acctbal") + 100})
    return u.catalog.read("customer")


@query("SELECT * FROM supplier WHERE s_acctbal > 5000")
def create_set_execute(spark, d):
    return unit(spark, d).create_set("supplier").where("s_acctbal > 5000").df


@query("SELECT n_nationkey, lower(n_name) AS name_lower FROM nation")
def execute_raw_sql_map(spark, d):
    made = unit(spark, d).executor()
    return made.execute_raw_sql_df("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= {0}", lambda r: {"n_nationkey": r["n_nationkey"], "name_lower": r["n_name"].lower()}, "n_nationkey int, name_lower string", SqlConfig().with_parameters(0))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def starts_with(spark, d):
    return repo(spark, d, "part").get_mapped_df(lambda p: p.p_name.startswith("red"), ["p_partkey", "p_name"])


@query("SELECT * FROM supplier WHERE s_nationkey = 3")
def tagged_no_tracking(spark, d):
    return repo(spark, d, "supplier").get_filtered_df("s_nationkey = 3", ReadConfig().with_tag("suppliers").with_no_tracking())


@query("SELECT * FROM part WHERE NOT coalesce(p_size > 25, false)")
def execute_command_delete(spark, d):
    u = unit(spark, d)
    u.executor().execute_command("DELETE FROM part WHERE p_size > {0}", SqlConfig().with_parameters(25))
    return u.catalog.read("part")


@procedure("double_balances")
def double_balances(uow, factor):
    return uow.update_many("supplier", F.lit(True), {"s_acctbal": F.col("s_acctbal") * factor})


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def execute_procedure_update(spark, d):
    u = unit(spark, d)
    u.executor().execute_procedure("double_balances", SqlConfig().with_parameters(2))
    return u.catalog.read("supplier")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def attach_set_modified(spark, d):
    u = unit(spark, d)
    item = u.repository("nation").get(4)
    u.attach("nation", item)
    u.set_modified("nation", {**item.asDict(), "n_name": "RENAMED"})
    u.commit()
    return u.catalog.read("nation")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'SECOND' ELSE r_name END AS r_name FROM region")
def client_wins_commit(spark, d):
    one = unit(spark, d)
    two = unit(spark, d, one.store)
    for u, name in ((one, "FIRST"), (two, "SECOND")):
        u.modify("region", {"r_regionkey": 1, "r_name": name})
    one.commit()
    two.commit_and_refresh_changes()
    return two.catalog.read("region")


@query("SELECT * FROM supplier WHERE s_suppkey <> 9")
def transaction_commit(spark, d):
    u = unit(spark, d)
    u.execute_transaction(lambda x: x.delete_many("supplier", "s_suppkey = 9"))
    return u.catalog.read("supplier")


@query("SELECT * FROM supplier")
def transaction_rollback(spark, d):
    u = unit(spark, d)
    u.begin_transaction()
    u.delete_many("supplier", "s_suppkey = 9")
    u.rollback_transaction()
    return u.catalog.read("supplier")


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
def linq_group_by(spark, d):
    return unit(spark, d).create_set("orders").group_by("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
def linq_union(spark, d):
    u = unit(spark, d)
    return EntitySet(u.repository("nation"), u.create_set("nation").select(F.col("n_regionkey").alias("k"))).union(u.create_set("region").select(F.col("r_regionkey").alias("k"))).df


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000")
def linq_except(spark, d):
    u = unit(spark, d)
    keys = EntitySet(u.repository("customer"), u.create_set("customer").select(F.col("c_custkey").alias("k")))
    return keys.except_(u.create_set("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))).df


@query("SELECT c.* FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
def linq_semi_join(spark, d):
    return repo(spark, d, "customer").get_filtered_df(lambda c: c.orders.any(lambda o: o.o_totalprice > 100000))


from tessera import forms  # noqa: E402, F401 - registers the rest of the catalogue
