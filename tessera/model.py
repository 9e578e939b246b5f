"""Descriptors of the tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.plans.entity import MANY, ONE, Entity, Navigation
from tessera.sources.catalog import Catalog


def to_one(target: str, own: str, key: str) -> Navigation:
    return Navigation(target, ONE, ((own, key),))


def to_many(target: str, key: str, foreign: str) -> Navigation:
    return Navigation(target, MANY, ((key, foreign),))


def entities(**filters) -> list[Entity]:
    """All tables; ``filters`` gives default predicates by entity name."""
    made = [
        Entity("region", ("r_regionkey",)),
        Entity("nation", ("n_nationkey",), {"region": to_one("region", "n_regionkey", "r_regionkey")}),
        Entity("customer", ("c_custkey",), {"nation": to_one("nation", "c_nationkey", "n_nationkey"), "orders": to_many("orders", "c_custkey", "o_custkey")}, filters.get("customer")),
        Entity("supplier", ("s_suppkey",), {"nation": to_one("nation", "s_nationkey", "n_nationkey")}),
        Entity("part", ("p_partkey",)),
        Entity("orders", ("o_orderkey",), {"customer": to_one("customer", "o_custkey", "c_custkey"), "lineitems": to_many("lineitem", "o_orderkey", "l_orderkey")}),
        Entity("lineitem", (), {"part": to_one("part", "l_partkey", "p_partkey"), "supplier": to_one("supplier", "l_suppkey", "s_suppkey")}),
        Entity("events", ("event_id",), {"customer": to_one("customer", "user_id", "c_custkey")}),
        Entity("documents", ("doc_id",), {"label": to_one("labels", "doc_id", "doc_id")}),
        Entity("labels", ("doc_id",)),
        Entity("pages", ("page_id",)),
        Entity("benchmark", ("item_id",)),
        Entity("embeddings", ("vec_id",)),
        Entity("conversations", ("conv_id", "turn")),
    ]
    return made


def catalog(spark: SparkSession, sf_dir: str, **filters) -> Catalog:
    return Catalog(spark, entities(**filters), folder=sf_dir)
