"""Sort keys of any direction, comparison with one row, and row numbers, without gathering a table in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import Sort

#: Ranges that a table is numbered in, and keys that are looked at to find them, about.
RANGES = 256
SAMPLE = 20_000


def sort_keys(df: DataFrame, order) -> list[tuple[Column, bool, bool]]:
    """(expression, descending, nulls first) of column names, ``Sort`` objects and columns with or without a direction."""
    jvm = df.sparkSession.sparkContext._jvm
    out = []
    for o in order:
        if isinstance(o, Sort):
            out.append((F.col(f"`{o.column}`") if isinstance(o.column, str) else o.column, o.descending, not o.descending))
            continue
        c = F.col(f"`{o}`") if isinstance(o, str) else o
        node = c._jc.node()
        if node.getClass().getSimpleName() == "SortOrder":
            down = "Descending" in node.sortDirection().toString()
            out.append((Column(jvm.org.apache.spark.sql.Column(node.child())), down, "NullsFirst" in node.nullOrdering().toString()))
        else:
            out.append((c, False, True))
    return out


def total(df: DataFrame, order) -> list[tuple[Column, bool, bool]]:
    """The sort keys, then all columns, so that only equal rows tie."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return sort_keys(df, order) + [(F.col(f"`{c}`"), False, True) for c in plain]


def ordering(keys, backwards: bool = False) -> list[Column]:
    out = []
    for c, down, nulls_first in keys:
        down, first = down != backwards, nulls_first != backwards
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def named(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """``df`` with its sort keys as columns."""
    names = [f"__k{i}" for i in range(len(keys))]
    return df.select("*", *[c.alias(n) for n, (c, _, _) in zip(names, keys, strict=True)]), names


def ahead(names: list[str], other: str, keys) -> Column:
    """Whether a row with key columns ``names`` comes before the row whose keys are in the struct ``other``."""

    def one(n: str, down: bool, nulls_first: bool) -> Column:
        mine, its = F.col(n), F.col(f"{other}.{n}")
        less = F.coalesce(mine > its if down else mine < its, F.lit(False))
        null = mine.isNull() & its.isNotNull() if nulls_first else mine.isNotNull() & its.isNull()
        return less | null

    steps = [(one(n, d, f), F.col(n).eqNullSafe(F.col(f"{other}.{n}"))) for n, (_, d, f) in zip(names, keys, strict=True)]
    return reduce(lambda later, step: step[0] | (step[1] & later), reversed(steps), F.lit(False))


def same(names: list[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{other}.{n}")) for n in names])


def with_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: the number, from 0, of each row in the order of a sort key without ties, of any type.

    Rows are put in ranges of the key, by the keys of a bounded sample that a hash chooses, numbered within each, and
    each range starts at the count of the rows before it.
    """
    some = max(1, df.count() // SAMPLE)
    seen = sorted(r[0] for r in df.where((F.pmod(F.xxhash64(key), F.lit(some)) == 0) & F.col(key).isNotNull()).select(key).collect())
    bounds = sorted({seen[len(seen) * i // RANGES] for i in range(1, RANGES)}) if seen else []
    kind = df.schema[key].dataType
    literal = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    ranged = df.withColumn("__range", F.size(F.filter(literal, lambda b: b < F.col(key))))
    counts = ranged.groupBy("__range").count()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    order = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first())
    numbered = ranged.withColumn("__n", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__n")).drop("__range", "__start", "__n")
