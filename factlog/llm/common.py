"""What the operators share: reading tables, tables in the shared folder, row packing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checkpoints

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that a Python worker holds at a time in jobs that write a table.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in BATCHES if spark.conf.isModifiable(k)}
    for k in before:
        spark.conf.set(k, BATCHES[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free() -> None:
    """Memory that this process no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives memory back to the system when its partition ends: workers live on and serve other stages."""

    @wraps(run)
    def inner(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            free()

    del inner.__wrapped__  # type hints are those of inner
    return inner


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """checkpoints.stored(), with small batches for Python workers."""
    with small_batches(df.sparkSession):
        return checkpoints.stored(df, name, compression)


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of df in one struct, so that names added beside it clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "_row", **instead: Column) -> DataFrame:
    """The packed columns again; instead: columns that replace packed ones of the same name."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col(name)[c].alias(c) for c in columns])


#: Parts into which spread_join deals the rows of every key.
SPREAD = 8


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one short row for a key, on key, inner or left: the rows of each key are dealt out, every right row repeated SPREAD times."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SPREAD)])))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


#: Rows of a few numbers, no more of which are sent to every task instead of dealing out both sides of a join.
SENT = 1 << 18


def few(df: DataFrame) -> bool:
    """df: a table that is written, whose rows Parquet has counted."""
    return df.count() <= SENT


def looked_up(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """spread_join() with a written table; where that is small nothing is dealt out."""
    return left.join(F.broadcast(right), key, how) if few(right) else spread_join(left, right, key, how)


#: Keys with more than this share of the rows, and so many rows, are hot, at most 1 / HOT_KEYS of them; their rows are dealt out in KEY_SALTS parts.
HOT_KEYS, LEAST_HOT, KEY_SALTS = 1 / 1000, 64, 32


def hot_keys(of: DataFrame, key: str) -> DataFrame:
    """_k: the hot keys of a table."""
    counts = of.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    return counts.join(F.broadcast(total), (F.col("_c") > F.col("_t") * HOT_KEYS) & (F.col("_c") >= LEAST_HOT)).select(F.col(key).alias("_k"))


def dealt(left: DataFrame, hot: DataFrame, key: str, by: list[str]) -> DataFrame:
    """left with a _salt: rows of hot keys are dealt out by a hash of these columns."""
    salt = F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(KEY_SALTS))).otherwise(F.lit(0)).cast("int")
    return left.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").withColumn("_salt", salt).drop("_k")


def repeated(right: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """right with every _salt that its keys may have."""
    salts = hot.select("_k", F.explode(F.sequence(F.lit(0), F.lit(KEY_SALTS - 1))).alias("_s"))
    return right.join(F.broadcast(salts), F.col(key) == F.col("_k"), "left").withColumn("_salt", F.coalesce("_s", F.lit(0))).drop("_k", "_s")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for a key, on key, inner or left: rows of hot keys are dealt out, and their right rows repeated."""
    hot = hot_keys(left, key)
    return dealt(left, hot, key, left.columns).join(repeated(right, hot, key), [key, "_salt"], how).drop("_salt")
