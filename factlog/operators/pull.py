"""Pull: facts shaped into one row per entity, for any number of entities at once.

A level of the shape is one scan and one aggregation of the facts of all entities asked for at that level, whatever the number of its
branches; the next level's entities are those that its references name. Nested shapes are joined on from below. Single values come as
columns, many values as sorted arrays, nested entities as structs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..sources.attributes import Cardinality, Registry, ValueType
from ..sources.log import FactLog

DEPTH = 16


@dataclass(frozen=True)
class Spec:
    """An attribute to pull, under a name of its own if given, with the shape of what it refers to. nested is ignored for other values."""

    ident: str
    alias: str | None = None
    nested: tuple[Spec, ...] = ()

    @property
    def name(self) -> str:
        return self.alias or self.ident


def everything(registry: Registry, levels: int = 1) -> list[Spec]:
    """The wildcard: all attributes, and of what references name all attributes again, for so many levels; then references stay ids."""
    below = tuple(everything(registry, levels - 1)) if levels > 1 else ()
    return [Spec(a.ident, nested=below if a.type is ValueType.REF else ()) for a in registry]


def pull(source: FactLog, entities: DataFrame, specs: list[Spec] | None = None, depth: int = DEPTH, levels: int = 1) -> DataFrame:
    """db_id and a column for each attribute, for every row of entities (one column of ids, kept as it is, repeats too).

    specs None: everything(), for so many levels. Unknown attributes are skipped. An entity without facts has nulls; beyond depth levels a
    reference stays an id.
    """
    (key,) = entities.columns
    specs = everything(source.registry, levels) if specs is None else specs
    asked = entities.select(F.col(key).alias("db_id"))
    tables, level, ids, branches = [], _known(source.registry, specs), asked.distinct(), 1
    while level:
        follow = [s for s in level if _follows(source.registry, s) and len(tables) + 1 < depth]
        shaped = _shaped(source, ids, sorted({s.ident for s in level}))
        shaped = checkpointed(shaped) if follow or branches > 1 else shaped  # read again for the next level's ids and by every branch
        tables.append(shaped)
        refs = [_refs(source.registry, shaped, ident).select(F.col("_ref").alias("db_id")) for ident in sorted({s.ident for s in follow})]
        branches = len(follow)
        level = _known(source.registry, [n for s in follow for n in s.nested])
        if refs:
            ids = refs[0]
            for r in refs[1:]:
                ids = ids.union(r)
            ids = ids.distinct()
    return _assembled(source.registry, asked, _known(source.registry, specs), tables)


def in_order(log: FactLog, ids: Iterable[int], specs: list[Spec] | None = None, **options) -> DataFrame:
    """pull() of a list of ids, in its order, repeats too."""
    asked = log.history.sparkSession.createDataFrame(list(enumerate(ids)), "_place long, _asked long")
    found = pull(log, asked.select("_asked").distinct(), specs, **options)
    return asked.join(found, F.col("_asked") == F.col("db_id")).orderBy("_place").select(*[F.col(f"`{c}`") for c in found.columns])


def _known(registry: Registry, specs: Iterable[Spec]) -> list[Spec]:
    return [s for s in specs if s.ident in registry]


def _follows(registry: Registry, s: Spec) -> bool:
    return bool(_known(registry, s.nested)) and registry[s.ident].type is ValueType.REF


def _shaped(source: FactLog, ids: DataFrame, idents: list[str]) -> DataFrame:
    """_e and a column named by each attribute, of those of the entities that have one of them."""
    rows = source.facts(idents).join(ids, F.col("e") == F.col("db_id"), "left_semi")
    columns = []
    for ident in idents:
        a = source.registry[ident]
        v = F.when(F.col("a") == ident, F.col(a.type.column))
        columns.append((F.sort_array(F.collect_set(v)) if a.cardinality is Cardinality.MANY else F.max(v)).alias(ident))
    return rows.groupBy(F.col("e").alias("_e")).agg(*columns)


def _refs(registry: Registry, shaped: DataFrame, ident: str) -> DataFrame:
    """_e, _ref: the entities that a reference names."""
    value = F.col(f"`{ident}`")
    if registry[ident].cardinality is Cardinality.MANY:
        return shaped.select("_e", F.explode(value).alias("_ref"))
    return shaped.select("_e", value.alias("_ref")).filter("_ref is not null")


def _assembled(registry: Registry, asked: DataFrame, specs: list[Spec], tables: list[DataFrame]) -> DataFrame:
    """db_id and the columns of specs, for every row of asked, from the tables of this level and those below."""
    if not specs:
        return asked
    shaped = tables[0].select("_e", *[F.col(f"`{i}`").alias(f"p{k}") for k, i in enumerate(dict.fromkeys(s.ident for s in specs))])
    place = {i: f"p{k}" for k, i in enumerate(dict.fromkeys(s.ident for s in specs))}
    out = asked.join(shaped, F.col("db_id") == F.col("_e"), "left").drop("_e")
    names = []
    for k, s in enumerate(specs):
        many, value = registry[s.ident].cardinality is Cardinality.MANY, F.col(place[s.ident])
        if _follows(registry, s) and len(tables) > 1:
            each = _refs(registry, tables[0], s.ident)
            below = _assembled(registry, each.select(F.col("_ref").alias("db_id")).distinct(), _known(registry, s.nested), tables[1:])
            below = below.select(F.col("db_id").alias("_k"), F.struct(*[F.col(f"`{c}`") for c in below.columns]).alias("_x"))
            if many:
                lists = each.join(below, F.col("_ref") == F.col("_k")).groupBy(F.col("_e").alias("_k")).agg(F.sort_array(F.collect_list(F.struct(F.col("_ref").alias("_o"), "_x"))).alias("_xs"))
                out = out.join(lists.select("_k", F.transform("_xs", lambda x: x["_x"]).alias(f"n{k}")), F.col("db_id") == F.col("_k"), "left").drop("_k")
            else:
                out = out.join(below.withColumnRenamed("_x", f"n{k}"), value == F.col("_k"), "left").drop("_k")
            value = F.col(f"n{k}")
        elif many:
            value = F.when(F.size(value) > 0, value)
        names.append(value.alias(s.name))
    return out.select("db_id", *names)
