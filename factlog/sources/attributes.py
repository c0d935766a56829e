"""Attribute declarations and their registry."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ValueType(Enum):
    """Value types with the log's column that holds them and the Spark type a query sees."""

    INT = ("v_int", "bigint")
    STRING = ("v_text", "string")
    FLOAT = ("v_float", "double")
    BOOL = ("v_bool", "boolean")
    REF = ("v_ref", "bigint")
    BYTES = ("v_bytes", "binary")
    INST = ("v_inst", "timestamp")

    @property
    def column(self) -> str:
        return self.value[0]

    @property
    def sql(self) -> str:
        return self.value[1]

    @staticmethod
    def of(kind: T.DataType) -> ValueType:
        """The value type of a table's column."""
        for types, out in (((T.BooleanType,), ValueType.BOOL), ((T.IntegralType,), ValueType.INT), ((T.FractionalType,), ValueType.FLOAT), ((T.StringType,), ValueType.STRING), ((T.TimestampType, T.TimestampNTZType), ValueType.INST), ((T.BinaryType,), ValueType.BYTES)):
            if isinstance(kind, types):
                return out
        raise ValueError(f"{kind.simpleString()} is no value type")


class Cardinality(Enum):
    ONE = 1
    MANY = 2


@dataclass(frozen=True)
class Attribute:
    ident: str
    type: ValueType
    cardinality: Cardinality = Cardinality.ONE
    indexed: bool = False
    unique: bool = False
    identity: bool = False
    component: bool = False


class Registry:
    """Attributes by ident. A definition may be repeated but not changed."""

    def __init__(self, *attributes: Attribute):
        self._known: dict[str, Attribute] = {}
        for a in attributes:
            self.define(a)

    def define(self, attribute: Attribute) -> Attribute:
        known = self._known.setdefault(attribute.ident, attribute)
        if known != attribute:
            raise ValueError(f"{attribute.ident} is defined differently: {known}")
        return known

    def __getitem__(self, ident: str) -> Attribute:
        if ident not in self._known:
            raise ValueError(f"unknown attribute: {ident}")
        return self._known[ident]

    def __contains__(self, ident: str) -> bool:
        return ident in self._known

    def __iter__(self):
        return iter(self._known.values())

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [json.dumps({**asdict(a), "type": a.type.name, "cardinality": a.cardinality.name}) for a in self]
        return spark.createDataFrame([(r,) for r in rows], "definition string")

    @staticmethod
    def from_df(rows: DataFrame) -> Registry:
        """One row for each attribute of the schema, not data, comes to the driver."""
        found = [json.loads(r[0]) for r in rows.collect()]
        return Registry(*[Attribute(**{**r, "type": ValueType[r["type"]], "cardinality": Cardinality[r["cardinality"]]}) for r in found])
