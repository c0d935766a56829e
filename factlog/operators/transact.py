"""Transactions as Spark jobs: a table of datoms becomes events of the log, all or none.

Datoms have e (id) or temp (a name, for an entity to be found or made) or lookup_a and lookup_v (an identity attribute and its
value, as text), then a, the value columns, and retract. All are resolved with joins against the current state, so that a
transaction may hold any number of datoms; what breaks a rule is found by a query over all of them and nothing is written.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..sources.attributes import ValueType
from ..sources.log import TRANSACTIONS, VALUES, FactLog

DATOMS = "seq bigint, e bigint, temp string, lookup_a string, lookup_v string, a string, " + ", ".join(f"{t.column} {t.sql}" for t in ValueType) + ", retract boolean"
PARTS = 64


class TransactError(ValueError):
    """A transaction that breaks a rule; seq is the first datom that does."""

    def __init__(self, seq: int, what: str):
        super().__init__(f"datom {seq}: {what}")
        self.seq = seq


class Transacted(NamedTuple):
    """log: with the transaction; temp_ids: temp, e; tx, tx_time; datoms: its history rows, with the retractions that new single values brought."""

    log: FactLog
    temp_ids: DataFrame
    tx: int
    tx_time: int
    datoms: DataFrame


def _text() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in VALUES])


def _refuse(*checks: tuple[DataFrame, str]) -> None:
    """One job: the first datom (seq) of all that break a rule."""
    bad = reduce(DataFrame.union, [df.select(F.col("seq").cast("bigint").alias("seq"), F.lit(what).alias("what")) for df, what in checks])
    first = bad.agg(F.min(F.struct("seq", "what")).alias("r")).first()["r"]
    if first is not None:
        raise TransactError(first["seq"], first["what"])


def transact(log: FactLog, datoms: DataFrame, tx_time: int, valid_from: int | None = None, enforce_unique: bool = False) -> Transacted:
    """The log with one more transaction, and what it did. Without datoms the transaction still has a number and a time.

    Asserted identity values find their entities first; names that find none get new ids after all ids so far. A new value of a
    single-valued attribute retracts the old one. The log is given back as it was when an error is raised.
    """
    registry = log.registry
    known = {a.ident: a for a in registry}
    identities = [a.ident for a in known.values() if a.identity]
    datoms = datoms.withColumn("retract", F.coalesce("retract", F.lit(False)))

    typed = F.lit(False)
    for a in known.values():
        typed = typed | ((F.col("a") == a.ident) & F.col(a.type.column).isNotNull())
    forms = F.col("e").isNotNull().cast("int") + F.col("temp").isNotNull().cast("int") + F.col("lookup_a").isNotNull().cast("int")
    _refuse(
        (datoms.filter(~F.coalesce(F.col("a").isin(list(known)), F.lit(False))), "unknown attribute"),
        (datoms.filter(F.col("a").isin(list(known)) & ~typed), "the value has another type than the attribute"),
        (datoms.filter(forms != 1), "an entity is an id, a temporary name or a lookup"),
        (datoms.filter(F.col("lookup_a").isNotNull() & ~F.col("lookup_a").isin(identities)), "a lookup needs an identity attribute"),
    )

    # identity values that the datoms name, and who holds them
    looked = datoms.filter("lookup_a is not null").select("seq", F.col("lookup_a").alias("_a"), F.col("lookup_v").alias("_v"))
    claimed = datoms.filter(F.col("a").isin(identities) & ~F.col("retract")).select("seq", "temp", F.col("a").alias("_a"), _text().alias("_v"))
    named = looked.select("_a", "_v").union(claimed.select("_a", "_v")).distinct()
    holders = log.now().facts(identities or [""]).select(F.col("a").alias("_a"), _text().alias("_v"), F.col("e").alias("_e"))
    held = checkpointed(holders.join(named, ["_a", "_v"], "left_semi"))

    claims = claimed.filter("temp is not null").join(held.withColumnRenamed("_e", "old"), ["_a", "_v"], "left")
    per_temp = claims.groupBy("temp").agg(F.min("old").alias("old"), F.max("old").alias("other"), F.max("seq").alias("seq"))
    _refuse(
        (looked.join(held, ["_a", "_v"], "left_anti"), "the lookup finds no entity"),
        (per_temp.filter("old != other"), "the name stands for two entities"),
    )

    # names that assert one identity value are one entity: the least name stands for them
    leads = claims.withColumn("lead", F.min("temp").over(Window.partitionBy("_a", "_v"))).groupBy("temp").agg(F.min("lead").alias("lead"))
    temps = datoms.select("temp").filter("temp is not null").distinct().join(leads, "temp", "left").withColumn("lead", F.coalesce("lead", "temp"))
    temps = temps.join(per_temp.select("temp", "old"), "temp", "left")
    by_lead = temps.groupBy("lead").agg(F.max("old").alias("old"))
    fresh = by_lead.filter("old is null").withColumn("part", F.pmod(F.xxhash64("lead"), F.lit(PARTS)))
    # ids in a row without one sort of all names: a count of each part, then a number within it
    counts = fresh.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")
    refs = F.max(F.greatest("e", "v_ref")).alias("m")
    tops = log.history.agg(refs).union(datoms.agg(refs)).agg(F.coalesce(F.max("m"), F.lit(0)).alias("top"))
    fresh = fresh.join(F.broadcast(counts), "part").crossJoin(F.broadcast(tops))  # one row
    fresh = fresh.withColumn("made", F.row_number().over(Window.partitionBy("part").orderBy("lead")) + F.col("before") + F.col("top"))
    ids = temps.join(by_lead.withColumnRenamed("old", "found"), "lead").join(fresh.select("lead", "made"), "lead", "left")
    ids = checkpointed(ids.select("temp", F.coalesce("found", "made").alias("id")))

    rows = datoms.withColumnRenamed("e", "given").join(ids, "temp", "left")
    by_lookup = (F.col("lookup_a") == F.col("_a")) & (F.col("lookup_v") == F.col("_v"))
    rows = rows.join(held.withColumnRenamed("_e", "looked"), by_lookup, "left").drop("_a", "_v").withColumn("e", F.coalesce("given", "id", "looked"))
    asserted = rows.filter(~F.col("retract")).select("seq", "e", F.col("a").alias("_a"), _text().alias("_v"))
    checks = [(asserted.filter(F.col("_a").isin(identities)).join(held, ["_a", "_v"]).filter("_e != e"), "another entity holds the identity value")]
    if enforce_unique and (unique := [a.ident for a in known.values() if a.unique]):
        owned = log.now().facts(unique).select(F.col("a").alias("_a"), _text().alias("_v"), F.col("e").alias("_e"))
        checks.append((asserted.join(owned, ["_a", "_v"]).filter("_e != e"), "another entity holds the unique value"))
    _refuse(*checks)

    tx = (log.times().agg(F.max("tx")).first()[0] or 0) + 1
    events = rows.select(
        "e", "a", *VALUES, F.lit(tx).cast("bigint").alias("tx"), F.col("seq").alias("op"), (~F.col("retract")).alias("added"),
        F.lit(tx_time).cast("bigint").alias("tx_time"), F.lit(tx_time if valid_from is None else valid_from).cast("bigint").alias("valid_from"),
    )
    made = log.resolved(events)
    now = datoms.sparkSession.createDataFrame([(tx, tx_time)], TRANSACTIONS)
    return Transacted(log.with_transactions(log.times()).appended(made, now), ids.select("temp", F.col("id").alias("e")), tx, tx_time, made)
