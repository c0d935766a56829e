"""The fact log: an append-only history of assertions and retractions in two timelines, and its views.

History rows are e, a (ident), one typed value column, tx, op (order within tx), added, tx_time, valid_from, valid_to (ms).
A view is what queries read: the current state, the state as of a transaction, the facts valid at a time, or both.
In a transaction's view the last event of each (e, a, v) by (tx, op) decides whether it holds.

The current state is a table of its own beside the history: queries of it, and new events, which need what holds so far, don't
read the history. A log that was made from a history alone derives it from that. Transactions are rows of a third table,
so that one without events has a number and a time as well.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .attributes import Attribute, Cardinality, Registry, ValueType

VALUES = [t.column for t in ValueType]
SCHEMA = (
    "e bigint, a string, " + ", ".join(f"{t.column} {t.sql}" for t in ValueType) + ", tx bigint, op bigint, added boolean, tx_time bigint, valid_from bigint, valid_to bigint"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
STATE = "e bigint, a string, " + ", ".join(f"{t.column} {t.sql}" for t in ValueType) + ", tx bigint"
TRANSACTIONS = "tx bigint, tx_time bigint"
FOREVER = 2**63 - 1


def value_of(type: ValueType, value: Column) -> list[Column]:
    """The value columns of a fact: one has the value, the rest are null. Instants keep milliseconds."""
    if type is ValueType.INST:
        value = F.date_trunc("millisecond", value)
    return [(value if t is type else F.lit(None)).cast(t.sql).alias(t.column) for t in ValueType]


def same_fact(with_value: bool = True) -> list[str]:
    return ["e", "a", *(VALUES if with_value else [])]


def last_events(events: DataFrame) -> DataFrame:
    """The fact's columns and last (tx, op, added): the event of each fact that decides."""
    return events.groupBy(*same_fact()).agg(F.max(F.struct("tx", "op", "added")).alias("last"))


def by_fact(events: DataFrame) -> DataFrame:
    """Rows by entity and attribute, in as many parts as shuffles have: mostly null, they compress so well that parts merged by their size would be too large when sorted."""
    return events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "e", "a")


def newer(state: DataFrame, events: DataFrame) -> DataFrame:
    """A state (e, a, values, tx) after events that are later."""
    last = last_events(events)
    touched = last.select(*[F.col(c).alias(f"_{c}") for c in same_fact()])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same_fact()])
    return state.join(touched, same, "left_anti").unionByName(last.filter("last.added").select(*same_fact(), "last.tx"))


@dataclass(frozen=True)
class FactLog:
    """A log and the view taken of it; views are made by as_of() and valid_at(), which combine."""

    history: DataFrame
    registry: Registry
    tx: int | None = None
    valid: int | None = None
    intervals: bool = False
    #: e, a, value columns, tx of what holds now; None: as the history says
    current: DataFrame | None = None
    #: tx, tx_time; None: those of the history
    transactions: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession, registry: Registry) -> FactLog:
        return FactLog(spark.createDataFrame([], SCHEMA), registry, current=spark.createDataFrame([], STATE), transactions=spark.createDataFrame([], TRANSACTIONS))

    def checkpointed(self) -> FactLog:
        """The same log with its tables written to the checkpoint folder: what led to them is not computed again."""
        kept = {k: checkpointed(df) for k, df in (("history", self.history), ("current", self.current), ("transactions", self.transactions)) if df is not None}
        return replace(self, **kept)

    def now(self) -> FactLog:
        """The view of the current state."""
        return replace(self, tx=None, valid=None)

    def times(self) -> DataFrame:
        """tx, tx_time of all transactions."""
        return self.history.groupBy("tx").agg(F.max("tx_time").alias("tx_time")) if self.transactions is None else self.transactions

    def with_transactions(self, transactions: DataFrame) -> FactLog:
        return replace(self, transactions=transactions)

    # views

    def as_of(self, tx: int) -> FactLog:
        """The state as of a transaction; 0 is the current state."""
        return replace(self, tx=tx or None)

    def as_of_time(self, ms: int) -> FactLog | None:
        """The state as of the last transaction at or before a time; None if there is none."""
        last = self.times().filter(F.col("tx_time") <= ms).agg(F.max("tx")).first()[0]
        return None if last is None else self.as_of(last)

    def valid_at(self, ms: int, intervals: bool = False) -> FactLog:
        """The facts asserted as valid at a time. intervals: an assertion ends where the next event of its fact begins, and of a single-valued attribute where the next assertion does."""
        return replace(self, valid=ms, intervals=intervals)

    def facts(self, idents: list[str] | None = None) -> DataFrame:
        """e, a, value columns, tx of the facts that hold in this view. Attributes filter the scan before anything is grouped."""
        kept = self.current is not None and self.tx is None and self.valid is None
        rows = self.current if kept else self.history
        rows = rows if idents is None else rows.filter(F.col("a").isin(idents))
        if kept:
            return rows.select(*same_fact(), "tx")
        if self.tx is not None:
            rows = rows.filter(F.col("tx") <= self.tx)
        if self.valid is not None:
            return self._valid(rows)
        return last_events(rows).filter("last.added").select(*same_fact(), "last.tx")

    def _valid(self, rows: DataFrame) -> DataFrame:
        if self.intervals:
            one = [a.ident for a in self.registry if a.cardinality is Cardinality.ONE]
            order = ["valid_from", "tx", "op", "added"]  # a replaced value is retracted with the new one's assertion, before it
            later = Window.partitionBy("e", "a").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
            replaced = F.when(F.col("a").isin(one), F.min(F.when(F.col("added"), F.col("valid_from"))).over(later))
            again = F.lead("valid_from").over(Window.partitionBy(*same_fact()).orderBy(*order))
            rows = rows.withColumn("valid_to", F.least("valid_to", replaced, again))
        holds = F.col("added") & (F.col("valid_from") <= self.valid) & (F.coalesce("valid_to", F.lit(FOREVER)) > self.valid)
        return rows.filter(holds).groupBy(*same_fact()).agg(F.max("tx").alias("tx"))

    # what queries read

    def group_of(self, ident: str) -> str:
        """Single-valued attributes of one entity are read in one scan, each many-valued one in its own."""
        return "" if self.registry[ident].cardinality is Cardinality.ONE and self.valid is None else ident

    def key_of(self, group: str, n: int) -> tuple[str, ...]:
        """The columns of a scan of n attributes that tell its rows apart, if known."""
        if self.valid is None and not group:
            return ("e",)
        return ("e", "v0") if n == 1 else ()

    def scan(self, group: str, idents: list[str]) -> DataFrame:
        """e, tx and one column v0, v1, ... for each of the attributes, of the entities that have them all: one aggregation, no join."""
        different = list(dict.fromkeys(idents))
        rows = self.facts(different)
        if len(different) == 1:
            v = self.registry[different[0]].type.column
            return rows.select("e", *[F.col(v).alias(f"v{k}") for k in range(len(idents))], "tx")
        each = [F.max(F.when(F.col("a") == i, F.col(self.registry[i].type.column))).alias(f"w{k}") for k, i in enumerate(different)]
        wide = rows.groupBy("e").agg(*each, F.max("tx").alias("tx")).filter(" and ".join(f"w{k} is not null" for k in range(len(different))))
        return wide.select("e", *[F.col(f"w{different.index(i)}").alias(f"v{k}") for k, i in enumerate(idents)], "tx")

    def scan_any(self) -> DataFrame:
        """e, a, v (as text), tx of all facts."""
        text = F.coalesce(*[F.col(t.column).cast("string") for t in ValueType])
        return self.facts().select(F.col("e").cast("string").alias("e"), "a", text.alias("v"), "tx")

    # writing

    def resolved(self, events: DataFrame) -> DataFrame:
        """History rows of a table of events, many transactions at once: e, a, value columns, tx, op, added, tx_time, valid_from.

        A new value of a single-valued attribute retracts the one that held before it, with the same tx and op. What holds is what was
        asserted last, unless a retraction named it since; retractions of other values change nothing. Of events of one transaction that
        differ in op alone the last counts. This path needs one scan and one window for any number of transactions; events must be later than the log.
        """
        one = [a.ident for a in self.registry if a.cardinality is Cardinality.ONE]
        same = [*same_fact(), "tx", "added"]
        events = by_fact(events).groupBy(*same).agg(F.max(F.struct("op", "tx_time", "valid_from")).alias("r"))
        events = events.select(*same_fact(), "tx", "r.op", "added", "r.tx_time", "r.valid_from", F.lit(None).cast("bigint").alias("valid_to"))
        if not one:
            return events.select(*COLUMNS)
        mine = events.filter(F.col("a").isin(one)).withColumn("is_new", F.lit(True))
        started = self.now().facts(one).join(mine.select("e", "a").distinct(), ["e", "a"], "left_semi")
        started = started.withColumns({"op": F.lit(-1).cast("bigint"), "added": F.lit(True), "is_new": F.lit(False), **{c: F.lit(None).cast("bigint") for c in ("tx_time", "valid_from", "valid_to")}})
        before = Window.partitionBy("e", "a").orderBy("tx", "op").rowsBetween(Window.unboundedPreceding, -1)
        value = F.struct(*VALUES)
        known = mine.unionByName(started).withColumn("_held", F.last(F.when(F.col("added"), value), ignorenulls=True).over(before))
        counts = F.col("added") | F.col("_held").eqNullSafe(value)
        known = known.withColumn("old", F.last(F.when(counts, F.struct("added", *VALUES)), ignorenulls=True).over(before))
        replaced = known.filter(F.col("is_new") & F.col("added") & F.col("old.added"))
        gone = replaced.select("e", "a", *[F.col(f"old.{c}").alias(c) for c in VALUES], "tx", "op", F.lit(False).alias("added"), "tx_time", "valid_from", "valid_to")
        return events.select(*COLUMNS).unionByName(gone)

    def with_events(self, events: DataFrame) -> FactLog:
        """The log with a table of events, as resolved() takes them."""
        return self.appended(self.resolved(events), many=True)

    def appended(self, rows: DataFrame, transactions: DataFrame | None = None, many: bool = False) -> FactLog:
        """The log with more rows of history, and transactions if not theirs; many: the rows may be as many as the log's."""
        times = self.transactions
        if times is not None:
            times = times.unionByName(rows.groupBy("tx").agg(F.max("tx_time").alias("tx_time")) if transactions is None else transactions)
        state = None if self.current is None else newer(self.current, by_fact(rows) if many else rows)
        return replace(self, history=self.history.select(*COLUMNS).unionByName(rows), current=state, transactions=times)

    def define(self, attribute: Attribute) -> FactLog:
        self.registry.define(attribute)
        return self

    def save(self, path: str, cold_path: str | None = None) -> FactLog:
        """Writes the transactions that path doesn't hold yet, and gives the log that is stored there.

        Their history goes under cold_path (or path), into a folder named by the first of them, so that a save that failed replaces itself
        when it is repeated; of the current state under path only attributes that they touch are written. Both are kept by attribute, sorted by entity in each
        file, so that scans prune them. The row of a transaction is written last: what has none isn't read. There is one writer.
        """
        spark, cold = self.history.sparkSession, cold_path or path
        last = _last(stored_transactions(spark, path))
        by = lambda df: df.repartition("a", F.pmod(F.xxhash64("e"), F.lit(32))).sortWithinPartitions("a", "e")
        times = self.times().filter(F.col("tx") > last)
        if not times.isEmpty():
            fresh = self.history.filter(F.col("tx") > last)
            touched = [r["a"] for r in fresh.select("a").distinct().collect()]  # attributes of the schema
            by(fresh).write.mode("overwrite").partitionBy("a").parquet(f"{cold}/history/since={last + 1}")
            # a row without entity keeps the folder of an attribute whose facts are all gone
            held = self.now().facts(touched).unionByName(spark.createDataFrame([(a,) for a in touched], "a string"), allowMissingColumns=True)
            by(held).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("a").parquet(f"{path}/current")
            times.coalesce(1).write.mode("append").parquet(f"{path}/transactions")
        self.registry.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")
        return FactLog.load(spark, path, cold_path)

    @staticmethod
    def load(spark: SparkSession, path: str, cold_path: str | None = None) -> FactLog:
        """The log at path. Queries of the current state read its table, other views the history."""
        registry = Registry.from_df(spark.read.parquet(f"{path}/attributes"))
        times = stored_transactions(spark, path)
        last = _last(times)
        if not last:
            return FactLog.empty(spark, registry)
        history = spark.read.schema(SCHEMA).parquet(f"{cold_path or path}/history").select(*COLUMNS).filter(F.col("tx") <= last)
        current = spark.read.schema(STATE).parquet(f"{path}/current").filter("e is not null")
        return FactLog(history, registry, current=current, transactions=times)

    @staticmethod
    def open(spark: SparkSession, path: str, registry: Registry, cold_path: str | None = None) -> FactLog:
        """The log at path, with these attributes as well, or an empty one where there is none yet."""
        try:
            log = FactLog.load(spark, path, cold_path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return FactLog.empty(spark, registry)
        for a in registry:
            log.registry.define(a)
        return log


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stored_transactions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TRANSACTIONS).parquet(f"{path}/transactions")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], TRANSACTIONS)


def _last(transactions: DataFrame) -> int:
    return transactions.agg(F.max("tx")).first()[0] or 0
