"""Helpers that the operators share: staged tables, heavy keys, seeded hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; long documents make larger batches a memory risk.
BATCH_ROWS = 256
#: A key is hot with more than such a share of all rows, and with so many rows at least.
HOT_KEYS, HOT_LEAST = 20_000, 256
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine (tests) a local folder is made where ``spark.checkpoint.dir`` is unset.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed at the end of the ``scratch`` block or when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    if (own := _scratch.get()) is not None:
        own.append(path)
    return path


#: Folders that the innermost ``scratch`` block has made.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Folders made in the block are removed at its end, but for those that ``keep`` (the block's value) was called on.

    ``keep(staged(...))`` keeps the folder made last; it belongs to the block around, if any.
    """
    outer, own, kept = _scratch.get(), [], []
    token = _scratch.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(own.pop())
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in own:
            remove(spark, path)
        if outer is not None:
            outer.extend(kept)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_folder``; a stopped session makes this a no-op."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    Lost executors cost nothing that is staged, and several consumers do not recompute it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(big: DataFrame, small: DataFrame, on: str, rows: int, spread: Column, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row for each value of ``on`` and ``_count``, the rows of ``big`` with it.

    Values with more than a ``HOT_KEYS``-th of all ``rows`` are split by the hash ``spread``; there are at most ``HOT_KEYS`` of
    them, so what is broadcast is bounded, and the copies of their rows in ``small`` are as few.
    """
    part = max(HOT_LEAST, rows // HOT_KEYS)
    parts = F.ceil(F.col("_count") / part).cast("int")
    hot = small.where(F.col("_count") > part).select(on, parts.alias("_parts"))
    left = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("_count")
    return left.join(copies, [on, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once a session, so that no installation is needed."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-src-")
    name = f"{folder}/{top.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in top.rglob("*.py"):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(name)
    sc._tessera_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Ready for Python operators: ship the package, bound the rows of an Arrow batch."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64).copy()
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(spark_schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string, so workers build batches of the declared types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spark_schema))
