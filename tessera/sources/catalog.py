"""Entities by name, read from a folder of Parquet tables or a version of a snapshot store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.entity import Entity

from .sqltext import PARTS
from .store import SnapshotStore


class Catalog:
    """Resolves entity names; ``registered`` sources are DataFrame factories for anything Spark can read."""

    def __init__(self, spark: SparkSession, entities: list[Entity], folder: str | None = None, store: SnapshotStore | None = None, version: int | None = None):
        self.spark, self.folder, self.store, self.version = spark, folder, store, version
        self.entities = {e.name: e for e in entities}
        self.registered: dict[str, object] = {}

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise KeyError(f"no entity {name!r}")
        return self.entities[name]

    def register(self, entity: Entity, factory) -> None:
        """Add an entity whose rows come from ``factory(spark) -> DataFrame``."""
        self.entities[entity.name] = entity
        self.registered[entity.name] = factory

    def read(self, name: str) -> DataFrame:
        self.entity(name)
        if name in self.registered:
            return self.registered[name](self.spark)
        if self.store is not None:
            return self.store.read(name, self.version)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, args=None) -> DataFrame:
        """Spark SQL over the entities, each as a view of its name.

        Views live in a copy of the session that only this call sees, so neither the caller's views nor those of
        other calls are touched.
        """
        spark = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        words = {w.lower() for w in re.findall(r"\w+", PARTS.sub(lambda m: m[0] if m[0][0] == "`" else " ", text))}
        for name in self.entities:
            if name.lower() in words:
                rows = self.read(name)._jdf.queryExecution().analyzed()
                spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows).createOrReplaceTempView(name)
        return spark.sql(text, args=args) if args else spark.sql(text)
