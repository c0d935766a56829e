"""Comparisons and user-defined functions of query clauses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The comparisons of filter clauses; more than two operands compare in a chain.
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
#: Aggregates of find clauses, over the bag of bindings.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count-distinct": F.count_distinct}


@dataclass
class Functions:
    """Named functions for filter and binding clauses; a later registration of a name replaces the earlier one."""

    known: dict[str, tuple[Callable[..., Column], int]] = field(default_factory=dict)

    def register(self, name: str, fn: Callable, returns: T.DataType | str = "boolean", n_args: int = -1, deterministic: bool = True) -> None:
        """A Python function of single values, row by row; register_column or register_pandas are faster. n_args -1: any number."""

        def build(*args: Column) -> Column:
            udf = F.udf(fn, returns, useArrow=True)
            return (udf if deterministic else udf.asNondeterministic())(*args)

        self.known[name] = (build, n_args)

    def register_pandas(self, name: str, fn: Callable, returns: T.DataType | str = "boolean", n_args: int = -1) -> None:
        """A function of pandas Series, run on Arrow batches."""

        def batch(*args: pd.Series) -> pd.Series:
            return fn(*args)

        self.known[name] = (lambda *args: F.pandas_udf(batch, returns)(*args), n_args)

    def register_column(self, name: str, build: Callable[..., Column], n_args: int = -1) -> None:
        """A function that builds a Column from Columns: it stays in the JVM and is optimized with the query."""
        self.known[name] = (build, n_args)

    def apply(self, name: str, args: list[Column]) -> Column:
        if name not in self.known:
            raise ValueError(f"unknown function: {name}")
        build, n = self.known[name]
        if n >= 0 and n != len(args):
            raise ValueError(f"{name} takes {n} arguments, not {len(args)}")
        return build(*args)


def truth(value: Column, kind: T.DataType) -> Column:
    """A function's value as a condition: a number holds unless it is 0, null never holds."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    raise ValueError(f"a condition can't be a {kind.simpleString()}")
