"""Null logic, ties, first and single, pages, includes, plans."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.model import catalog
from tessera.operators.repository import EntitySet, Repository
from tessera.operators.uow import MultipleResultsError
from tessera.plans.config import ReadConfig, Sort
from tessera.plans.entity import MANY, ONE, Entity, Navigation
from tessera.plans.spec import Where
from tessera.sources.catalog import Catalog


def of(spark, rows, schema, key=("id",), **tables):
    c = Catalog(spark, [])
    navs = tables.pop("navs", {})
    e = Entity("t", key, navs)
    c.register(e, lambda s: s.createDataFrame(rows, schema))
    for name, (r, sch) in tables.items():
        c.register(Entity(name), lambda s, r=r, sch=sch: s.createDataFrame(r, sch))
    return Repository(c, e)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_predicates_are_not_satisfied(spark):
    r = of(spark, [(1, 5), (2, None), (3, -1)], "id int, x int")
    assert r.count("x > 0") == 1 and r.any("x > 0") and not r.all("x > 0")
    assert not of(spark, [(1, 5), (2, None)], "id int, x int").all("x > 0")
    assert not of(spark, [(1, None)], "id int, x int").any("x > 0")
    assert r.count(~Where(lambda t: t.x > 0)) == 1


def test_empty(spark):
    r = of(spark, [], "id int, x int")
    assert r.all("x > 0") and not r.any() and r.count() == 0 and r.get_first("x > 0") is None and r.get_single("x > 0") is None


def test_single_and_first(spark):
    r = of(spark, [(2, 1), (1, 1), (3, 2)], "id int, x int")
    assert r.get_first("x = 1").id == 1
    assert r.get_first("x > 0", ReadConfig().with_sorting(Sort("x", True))).id == 3
    assert r.get_single("x = 2").id == 3
    with pytest.raises(MultipleResultsError):
        r.get_single("x = 1")
    assert r.get(2).x == 1 and r.get(9) is None


def test_keyless_ties_are_cut_the_same(spark):
    r = of(spark, [(1, "b"), (1, "a"), (1, "c")], "x int, y string", key=())
    assert [t.y for t in r.get_paged(2, config=ReadConfig().with_sorting("x"))] == ["a", "b"]
    with pytest.raises(ValueError):
        r.get(1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=12), size=st.integers(1, 5), down=st.booleans())
def test_pages_concatenate_to_the_sorted_whole(spark, xs, size, down):
    r = of(spark, list(enumerate(xs)), "id int, x int")
    config = ReadConfig().with_sorting(Sort("x", down))
    pages = [t.id for i in range(len(xs) // size + 1) for t in r.get_paged(i, size, config=config)]
    known = [i for i, x in sorted(((i, x) for i, x in enumerate(xs) if x is not None), key=lambda p: (-p[1] if down else p[1], p[0]))]
    nulls = [i for i, x in enumerate(xs) if x is None]
    assert pages == (known + nulls if down else nulls + known)


def test_page_arguments(spark):
    r = of(spark, [(1, 1)], "id int, x int")
    for bad in ((-1, 5), (0, 0), (0,)):
        with pytest.raises(ValueError):
            r.get_paged_df(*bad)


def person(spark):
    navs = {"user": Navigation("u", ONE, (("user_id", "id"),)), "a": Navigation("a", MANY, (("id", "pid"),)), "b": Navigation("b", MANY, (("id", "pid"),))}
    return of(
        spark, [(1, "x"), (2, None), (3, "gone")], "id int, user_id string", navs=navs,
        u=([("x", "ann")], "id string, name string"), a=([(1, 1), (1, 2)], "pid int, v int"), b=([(1, 7), (1, 8), (1, 9), (2, 5)], "pid int, v int"),
    )


def test_includes_keep_parents(spark):
    got = {r.id: r for r in person(spark).get_all(ReadConfig().with_properties("user", "a", "b"))}
    assert len(got) == 3 and got[1].user.name == "ann" and got[2].user is None and got[3].user is None
    assert [x.v for x in got[1].a] == [1, 2] and [x.v for x in got[1].b] == [7, 8, 9] and got[3].b == []


def test_navigation_predicates(spark):
    r = person(spark)
    assert [x.id for x in r.get_filtered(lambda p: p.user.name.startswith("a"))] == [1]
    assert sorted(x.id for x in r.get_filtered(lambda p: p.b.any(lambda t: t.v < 6) | p.a.any())) == [1, 2]
    assert [x.id for x in r.get_filtered(lambda p: p.b.none())] == [3]
    with pytest.raises(KeyError):
        r.get_all_df(ReadConfig().with_properties("nothing"))


def test_null_options_raise():
    for call in (lambda c: c.with_properties(None), lambda c: c.with_sorting(None), lambda c: c.with_tag(None), lambda c: c.with_before_customization(None)):
        with pytest.raises(ValueError):
            call(ReadConfig())
    assert ReadConfig().from_sql_raw(None).sql is None


def test_pushdown_and_top_k(spark, sf):
    c = catalog(spark, sf)
    r = Repository(c, c.entity("customer"))
    text = plan_of(r.get_mapped_df("c_custkey = 7", ["c_custkey"]))
    assert "EqualTo(c_custkey,7)" in text and "ReadSchema: struct<c_custkey:bigint>" in text
    assert "TakeOrderedAndProject" in plan_of(r.get_paged_df(1, 10, config=ReadConfig().with_sorting("c_acctbal")))
    assert "Join" not in plan_of(r.count_df())


def test_pages_and_tests_of_related_rows_join_little(spark, sf):
    """A page's to-many rows are reduced by its keys before they are shuffled; conjuncts are semi and anti joins."""
    c = catalog(spark, sf)
    orders = Repository(c, c.entity("orders"))
    text = plan_of(orders.get_paged_df(0, 20, config=ReadConfig().with_properties("lineitems")))
    assert text.index("ObjectHashAggregate") < text.index("LeftSemi")
    got = {r.o_orderkey: len(r.lineitems) for r in orders.get_paged(0, 20, config=ReadConfig().with_properties("lineitems"))}
    full = {r.o_orderkey: len(r.lineitems) for r in orders.get_all(ReadConfig().with_properties("lineitems"))}
    assert len(got) == 20 and got == {k: full[k] for k in got}
    some, none = orders.get_filtered_df(lambda o: (o.o_totalprice > 0) & o.lineitems.any(lambda x: x.l_quantity > 40)), orders.get_filtered_df(lambda o: o.lineitems.none())
    assert "LeftSemi" in plan_of(some) and "LeftAnti" in plan_of(none)
    either = orders.get_filtered_df(lambda o: o.lineitems.any(lambda x: x.l_quantity > 40) | o.lineitems.none())
    twice = orders.get_filtered_df(lambda o: (t := o.lineitems.none()) & (t | (o.o_totalprice > 0)))
    both = orders.get_filtered_df(Where(lambda o: o.lineitems.any()) & Where(lambda o: o.lineitems.none()))
    assert either.count() == some.count() + none.count() and twice.count() == none.count() and both.count() == 0


def test_page_with_total(spark, sf):
    c = catalog(spark, sf)
    page = Repository(c, c.entity("orders")).find_page("o_orderstatus = 'F'", 0, 5)
    assert page.items.count() == 5 and page.total > 5


def test_order_of_the_ends(spark):
    """Descending keys, nulls, ties and equal rows at the cut."""
    rows = [(3, "c"), (1, "a"), (1, "a"), (None, "n"), (2, "b"), (2, "x"), (1, "a")]
    s = EntitySet(of(spark, rows, "x int, y string", key=()))
    got = lambda e: [tuple(r) for r in e.df.collect()]
    assert got(s.take_last(2, "x")) == [(2, "x"), (3, "c")] and got(s.take_last(2, F.col("x").desc())) == [(1, "a"), (None, "n")]
    assert sorted(got(s.skip_last(5, Sort("x"), "y")), key=repr) == [(1, "a"), (None, "n")]
    assert sorted(got(s.skip_last(2, F.col("x").desc())), key=repr) == [(1, "a"), (1, "a"), (2, "b"), (2, "x"), (3, "c")]
    assert s.skip_last(0, "x").count() == 7 and s.skip_last(9, "x").count() == 0
    assert sorted(got(s.take_while(F.col("y") != "x", F.col("x").desc()))) == [(2, "b"), (3, "c")]
    assert sorted(got(s.skip_while(F.col("y") != "x", F.col("x").desc())), key=repr) == [(1, "a"), (1, "a"), (1, "a"), (2, "x"), (None, "n")]
    assert s.take_while(F.lit(True), "x").count() == 7 and s.skip_while(F.lit(True), "x").count() == 0
    assert s.last("x").x == 3 and got(s.reverse(F.col("x").desc()))[0] == (None, "n")
    assert got(s.where("x = 3").prepend({"x": 0, "y": "p"})) == [(0, "p"), (3, "c")]
    names = EntitySet(of(spark, [(f"k{i:03d}", i) for i in range(300)], "k string, i int", key=("k",)))
    assert {r.i for r in names.chunk(100, "k").where("chunk = 1").collect()} == set(range(100, 200))


def test_set_operators(spark):
    s = EntitySet(of(spark, [(i, i % 3) for i in range(10)], "id int, x int"))
    assert s.skip(2).take(3).count() == 3 and s.distinct_by("x").count() == 3 and s.sum("id") == 45 and s.average("x") == 0.9
    assert sorted(r.id for r in s.take_while(F.col("id") < 4, F.col("id")).execute()) == [0, 1, 2, 3]
    assert sorted(r.id for r in s.skip_while(F.col("id") < 7, F.col("id")).execute()) == [7, 8, 9]
    assert sorted(r.id for r in s.take_last(2, F.col("id")).execute()) == [8, 9] and s.last("id").id == 9 and s.element_at(3, "id").id == 3
    assert s.skip_last(8, F.col("id")).count() == 2 and s.contains({"id": 3, "x": 0}) and not s.contains({"id": 3, "x": 1})
    assert s.sequence_equal(s.where("id < 5").concat(s.where("id >= 5"))) and s.append({"id": 10, "x": 1}).count() == 11
    assert s.union_by(s, "x").count() == 3 and s.where("id < 0").default_if_empty({"id": -1, "x": 0}).count() == 1
    assert {r.chunk for r in s.chunk(4, "id").collect()} == {0, 1, 2}
    assert s.group_join(s.where("id = 1").select("x", F.col("id").alias("other")), ["x"], "g").where("size(g) > 0").count() == 3
    zipped = s.zip(s.select((F.col("id") * 10).alias("k")), "id", "k").collect()
    assert len(zipped) == 10 and all(r.k == r.id * 10 for r in zipped)
