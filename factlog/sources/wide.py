"""Ordinary tables as facts, without copying them: the key column is the entity, every other column an attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import Attribute, Registry, ValueType


class WideTables:
    """tables: name -> (DataFrame, key). A key is a column that tells rows apart; None stands for a hash of the whole row; a tuple for a hash of those columns.

    A null cell is no fact. Attributes are named :table/column.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame, str | tuple[str, ...] | None]]):
        self.tables = tables
        self.registry = Registry()
        for name, (df, _) in tables.items():
            for f in df.schema.fields:
                try:
                    self.registry.define(Attribute(f":{name}/{f.name}", ValueType.of(f.dataType)))
                except ValueError:
                    continue  # arrays and the like are no values

    def group_of(self, ident: str) -> str:
        """Patterns of one entity and one group are read in one scan."""
        self.registry[ident]
        return ident[1:].partition("/")[0]

    def key_of(self, group: str, n: int) -> tuple[str, ...]:
        """The columns of a scan of n attributes that tell its rows apart, if known."""
        return ("e",) if isinstance(self.tables[group][1], str) else ()

    def entity(self, group: str) -> Column:
        df, key = self.tables[group]
        if isinstance(key, str):
            return F.col(key)
        return F.xxhash64(*(key or df.columns))

    def scan(self, group: str, idents: list[str]) -> DataFrame:
        """e, tx and one column v0, v1, ... for each of the attributes, of the entities that have them all."""
        df, _ = self.tables[group]
        columns = [ident.partition("/")[2] for ident in idents]
        for c in dict.fromkeys(columns):
            df = df.filter(F.col(c).isNotNull())
        cast = [F.col(c).cast(self.registry[i].type.sql).alias(f"v{k}") for k, (c, i) in enumerate(zip(columns, idents))]
        return df.select(self.entity(group).alias("e"), *cast, F.lit(0).cast("bigint").alias("tx"))

    def scan_any(self) -> DataFrame:
        """e, a (ident), v (as text), tx of all facts."""
        out = None
        for name, (df, _) in self.tables.items():
            idents = [a.ident for a in self.registry if a.ident.startswith(f":{name}/")]
            pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.col(i.partition("/")[2]).cast(self.registry[i].type.sql).cast("string").alias("v")) for i in idents])
            one = df.select(self.entity(name).cast("string").alias("e"), F.explode(pairs).alias("p")).select("e", "p.a", "p.v", F.lit(0).cast("bigint").alias("tx")).filter("v is not null")
            out = one if out is None else out.unionByName(one)
        return out
