"""Clauses over facts, composed into DataFrames.

A pattern is a tuple (entity, attribute, value[, tx]); names that begin with "?" are variables, "_" matches anything,
anything else is a constant. Patterns that share variables join on them. What is composed here is an ordinary DataFrame: the
order and kind of joins, pushdown and pruning are Catalyst's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import AGGREGATES, COMPARE, Functions, truth
from ..sources.attributes import ValueType


def is_var(x: Any) -> bool:
    return isinstance(x, str) and x.startswith("?") and len(x) > 1


@dataclass(frozen=True)
class Compare:
    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    out: str | None = None


@dataclass(frozen=True)
class Not:
    clauses: tuple


@dataclass(frozen=True)
class Or:
    branches: tuple


@dataclass(frozen=True)
class Rule:
    name: str
    args: tuple


def compare(op: str, *args: Any) -> Compare:
    """a op b, or a chain of comparisons."""
    if op not in COMPARE or len(args) < 2:
        raise ValueError(f"no comparison: {op} {args}")
    return Compare(op, args)


def call(name: str, *args: Any, out: str | None = None) -> Call:
    """A registered function as a condition, or with out as a value: bound to out, or compared with it where it is bound."""
    return Call(name, args, out)


def not_(*clauses: Any) -> Not:
    """No binding of the clauses agrees on the variables shared with the rest."""
    return Not(clauses)


def or_(*branches: Any) -> Or:
    """Any branch holds: a clause, or a list of clauses that hold together. Variables that are used outside are bound by all branches; others are a branch's own."""
    return Or(tuple(tuple(b) if isinstance(b, list) else (b,) for b in branches))


def rule(name: str, *args: Any) -> Rule:
    return Rule(name, args)


def variables(clause: Any) -> set[str]:
    if isinstance(clause, tuple):
        return {x for x in clause if is_var(x)}
    if isinstance(clause, (Compare, Rule)):
        return {x for x in clause.args if is_var(x)}
    if isinstance(clause, Call):
        return {x for x in (*clause.args, clause.out) if is_var(x)}
    if isinstance(clause, Not):
        return set().union(*map(variables, clause.clauses))
    return set.intersection(*[set().union(*map(variables, b)) for b in clause.branches])


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def natural(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all shared variables; of integers with doubles on their values, of the text of values of any kind with values on their text.

    Where one side of an inner join has text, the other side's values stay.
    """
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.crossJoin(right) if how == "inner" else left.join(right.select(F.lit(1).alias("_any")).limit(1), F.lit(True), how)
    place = {c: f"_r{k}" for k, c in enumerate(right.columns) if c in shared}
    renamed = right.select(*[col(c).alias(place.get(c, c)) if c in place else col(c) for c in right.columns])
    is_text = lambda df, c: isinstance(df.schema[c].dataType, T.StringType)
    on, typed = [], {}
    for c, r in place.items():
        x, y = col(c), F.col(r)
        if is_text(left, c) != is_text(right, c):
            typed |= {c: r} if is_text(left, c) else {}
            x, y = x.cast("string"), y.cast("string")
        on.append(x == y)
    out = left.join(renamed, reduce(lambda a, b: a & b, on), how)
    if how != "inner":
        return out
    return out.select(*[F.col(typed[c]).alias(c) if c in typed else col(c) for c in out.columns if c not in place.values()])


#: Joins of many rows with many that make more pairs than this are dealt out: of the side with the largest group so many rows of a group meet the other side's in a task.
MANY_PAIRS, GROUP_ROWS, MOST_TASKS = 100_000_000, 16_384, 8192


def dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """natural() of two sides that both repeat the shared variables' values. Few values would give few tasks, of pairs that grow with the square of the tables.

    So the groups of one side are divided, with the rows of the other side repeated for each part, into tasks whose number grows with that side.
    """
    shared = [c for c in left.columns if c in right.columns]
    count = lambda df, n: df.groupBy(*map(col, shared)).agg(F.count(F.lit(1)).alias(n))
    groups = natural(count(left, "_l"), count(right, "_r"))
    pairs, n, most_left, most_right = groups.agg(F.sum(F.col("_l") * F.col("_r").cast("double")), F.count(F.lit(1)), F.max("_l"), F.max("_r")).first()
    parts = -(-max(most_left or 0, most_right or 0) // GROUP_ROWS)
    if (pairs or 0) <= MANY_PAIRS or parts < 2:
        return natural(left, right)
    row = lambda df: F.pmod(F.xxhash64(*map(col, df.columns)), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    salts = (row(left), every) if most_left >= most_right else (every, row(right))
    tasks = min(2 * n * parts, MOST_TASKS)
    left, right = (df.withColumn("_salt", s).repartition(tasks, *map(col, shared), "_salt") for df, s in zip((left, right), salts))
    return natural(left, right.hint("merge")).drop("_salt")


def _held(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of all facts that rows ask for: the facts are streamed past the distinct values asked for, not sorted, and never broadcast."""
    asked = rows.select(*map(col, facts.columns)).distinct()
    return natural(facts, asked, "left_semi").distinct().hint("merge")


def constant(x: Any, kind: ValueType | None = None) -> Column:
    if x is None:
        raise ValueError("null is no value")
    if kind is not None:
        fits = {ValueType.INT: (int,), ValueType.REF: (int,), ValueType.FLOAT: (int, float), ValueType.STRING: (str,), ValueType.BOOL: (bool,), ValueType.BYTES: (bytes, bytearray)}.get(kind)
        if fits and (not isinstance(x, fits) or isinstance(x, bool) != (kind is ValueType.BOOL)):
            raise ValueError(f"{x!r} is no {kind.name.lower()}")
    return F.lit(x)


@dataclass(frozen=True)
class Part:
    """Bindings; key: variables that tell its rows apart, if known; is_set: repeats of its rows don't count and are still there; all_facts: of a free attribute."""

    df: DataFrame
    key: frozenset[str] | None = None
    is_set: bool = False
    all_facts: bool = False

    def distinct(self) -> Part:
        return Part(self.df.distinct(), frozenset(self.df.columns))


@dataclass
class Query:
    """where clauses and find elements over a source (WideTables or a FactLog view).

    find: variables, and pairs (aggregate, variable). Without aggregates the result is a set of rows; aggregates work on the bag of
    bindings, grouped by the plain variables. order: variables, or pairs (variable, "desc"), also such that aren't found.
    params: variables with given values. rules: relations by name, of columns c0, c1, ...
    """

    source: Any
    find: list
    where: list
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    params: dict[str, Any] = field(default_factory=dict)
    functions: Functions = field(default_factory=Functions)
    rules: dict[str, DataFrame] = field(default_factory=dict)

    def _given(self, x: Any) -> Any:
        return self.params.get(x, x) if is_var(x) else x

    # patterns

    def _patterns(self, patterns: list[tuple]) -> list[Part]:
        """One part for each scan; patterns of one entity that one scan can serve are read together."""
        groups: dict[tuple, list[tuple]] = {}
        out = []
        for k, p in enumerate(patterns):
            if not 2 <= len(p) <= 4:
                raise ValueError(f"a pattern has 2 to 4 elements: {p}")
            e, a, v, tx = (*map(self._given, p), "_", "_")[:4]
            if is_var(a) or a == "_":
                out.append(Part(self._any(e, a, v, tx), all_facts=True))
                continue
            own = k if tx != "_" else None  # a bound transaction is that of one fact, not of the group
            groups.setdefault((e if e != "_" else ("_", k), self.source.group_of(a), own), []).append((a, v, tx))
        for (e, group, _), rows in groups.items():
            df = self.source.scan(group, [a for a, _, _ in rows])
            terms = [(e, "e", None)] + [(v, f"v{k}", self.source.registry[a].type) for k, (a, v, _) in enumerate(rows)] + [(rows[0][2], "tx", None)]
            keys = [t for t, c, _ in terms if c in self.source.key_of(group, len(rows))]
            whole = self.source.key_of(group, len(rows)) and not any(t == "_" or isinstance(t, tuple) for t in keys)
            out.append(Part(self._bound(df, terms), frozenset(t for t in keys if is_var(t)) if whole else None))
        return out

    def _any(self, e: Any, a: Any, v: Any, tx: Any) -> DataFrame:
        """A pattern whose attribute is free: entities and values of all kinds come as text."""
        text = lambda x: x if is_var(x) or x == "_" else str(x).lower() if isinstance(x, bool) else str(x)
        return self._bound(self.source.scan_any(), [(text(e), "e", None), (a, "a", None), (text(v), "v", None), (tx, "tx", None)])

    @staticmethod
    def _bound(df: DataFrame, terms: list[tuple]) -> DataFrame:
        columns: dict[str, str] = {}
        for term, c, kind in terms:
            if isinstance(term, tuple) or term == "_":
                continue
            if not is_var(term):
                df = df.filter(F.col(c) == constant(term, kind))
            elif term in columns:
                df = df.filter(F.col(c) == F.col(columns[term]))
            else:
                columns[term] = c
        return df.select(*[F.col(c).alias(name) for name, c in columns.items()] or [F.lit(1).alias("_held")])

    # clauses

    def bindings(self, clauses: Iterable[Any], outer: DataFrame | None = None, wanted: set[str] | None = None) -> DataFrame:
        """All bindings; with wanted, a set of bindings of those variables and of such as clauses share is enough."""
        return self._bindings(clauses, outer, wanted).df

    def _bindings(self, clauses: Iterable[Any], outer: DataFrame | None = None, wanted: set[str] | None = None) -> Part:
        clauses = list(clauses)
        parts = self._patterns([c for c in clauses if isinstance(c, tuple)])
        for c in clauses:
            if isinstance(c, Or):
                elsewhere = [variables(x) for x in clauses if x is not c] + [{x if is_var(x) else x[1] for x in self.find}, {o if is_var(o) else o[0] for o in self.order}]
                parts.append(Part(df := self._or(c, set().union(*elsewhere)), frozenset(df.columns)))
            elif isinstance(c, Rule):
                if c.name not in self.rules:
                    raise ValueError(f"unknown rule: {c.name}")
                df = self.rules[c.name]
                if len(df.columns) != len(c.args):
                    raise ValueError(f"{c.name} has {len(df.columns)} columns")
                parts.append(Part(self._bound(df, [(self._given(x), f"c{k}", None) for k, x in enumerate(c.args)])))
        if not parts and outer is None:
            raise ValueError("a query needs patterns")
        if wanted is not None and len(parts) > 1:
            parts = self._reduced(parts, wanted.union(*[variables(x) for c in clauses if not isinstance(c, tuple) for x in (c.clauses if isinstance(c, Not) else (c,))]))
        now, parts = (Part(outer), parts) if outer is not None else (parts[0], parts[1:])
        while parts:  # a part that shares a variable next, so that products come last; one that brings nothing new first
            mine = set(now.df.columns) - {"_held"}
            within = lambda p: wanted is not None and set(p.df.columns) <= mine
            k = next((k for k, p in enumerate(parts) if within(p)), None)
            if k is None:
                k = next((k for k, p in enumerate(parts) if set(p.df.columns) & mine), 0)
            nxt = parts.pop(k)
            theirs = set(nxt.df.columns) - {"_held"}
            if theirs and within(nxt):
                held = _held(now.df, nxt.df) if nxt.all_facts else nxt.df
                now = Part(natural(now.df.drop("_held"), held, "left_semi"), now.key, now.is_set)
            elif theirs and mine:
                now, nxt = (p.distinct() if p.is_set else p for p in (now, nxt))
                key = None if now.key is None or nxt.key is None else now.key | nxt.key
                shared = mine & theirs
                many = key is not None and not now.key <= shared and not nxt.key <= shared
                now = Part((dealt if many else natural)(now.df.drop("_held"), nxt.df.drop("_held")), key)
            elif mine:
                now = Part(now.df.join(nxt.df.limit(1), F.lit(True), "left_semi"), now.key, now.is_set)
            else:
                now = Part(nxt.df.join(now.df.limit(1), F.lit(True), "left_semi"), nxt.key, nxt.is_set)
        now, key = now.df, now.key
        todo = [c for c in clauses if isinstance(c, (Compare, Call))]
        while todo:
            ready = next((c for c in todo if all(x in now.columns or not is_var(x) for x in map(self._given, c.args))), None)
            if ready is None:
                raise ValueError(f"unbound variables in {todo}")
            todo.remove(ready)
            now = self._test(now, ready)
        for c in clauses:
            if isinstance(c, Not):
                now = self._not(now, c)
        return Part(now, key)

    @staticmethod
    def _reduced(parts: list[Part], used: set[str]) -> list[Part]:
        """Variables of one part alone that nothing uses go before the join, and with them the repeats that they told apart.

        Parts that lost some, or whose variables another has, come last: they may bring nothing but a condition by then.
        """
        times = Counter(c for p in parts for c in p.df.columns)
        out = []
        for p in parts:
            kept = [c for c in p.df.columns if c in used or times[c] > 1]
            out.append(Part(p.df.select(*map(col, kept)), None, True, p.all_facts) if 0 < len(kept) < len(p.df.columns) else p)
        return sorted(out, key=lambda p: (p.is_set, any(set(p.df.columns) < set(q.df.columns) for q in out)))

    def _column(self, x: Any) -> Column:
        x = self._given(x)
        return col(x) if is_var(x) else constant(x)

    def _test(self, df: DataFrame, c: Compare | Call) -> DataFrame:
        if isinstance(c, Compare):
            kinds = {type(df.schema[x].dataType).__name__ if is_var(x) else {"str": "StringType"}.get(type(x).__name__, "other") for x in map(self._given, c.args)}
            if "StringType" in kinds and len(kinds) > 1 and not kinds <= {"StringType", "TimestampType"}:
                raise ValueError(f"text and other values can't be compared: {c}")
            args = list(map(self._column, c.args))
            return df.filter(reduce(lambda a, b: a & b, [COMPARE[c.op](x, y) for x, y in zip(args, args[1:])]))
        value = self.functions.apply(c.name, list(map(self._column, c.args)))
        if c.out is None:
            return df.filter(truth(value, df.select(value.alias("x")).schema["x"].dataType))
        out = self._given(c.out)
        return df.filter(self._column(out) == value) if not is_var(out) or out in df.columns else df.withColumn(out, value)

    def _or(self, c: Or, used: set[str]) -> DataFrame:
        free = [{x for x in set().union(*map(variables, b)) if is_var(self._given(x))} for b in c.branches]
        if partly := (set.union(*free) - set.intersection(*free)) & used:
            raise ValueError(f"not all branches bind {sorted(partly)}: {c}")
        names = sorted(set.intersection(*free))
        if (one := self._either(c)) is not None:
            return one.select(*map(col, names)).distinct() if names else one
        branches = [self.bindings(b) for b in c.branches]
        return reduce(lambda a, b: a.unionByName(b), [b.select(*map(col, names)) for b in branches]).distinct()

    def _either(self, c: Or) -> DataFrame | None:
        """Branches that are one pattern with different constants are one scan."""
        if not all(len(b) == 1 and isinstance(b[0], tuple) and len(b[0]) == 3 for b in c.branches):
            return None
        patterns = [tuple(map(self._given, b[0])) for b in c.branches]
        (e, a, _), values = patterns[0], [p[2] for p in patterns]
        if any(p[:2] != (e, a) for p in patterns) or a == "_" or is_var(a) or any(x == "_" or is_var(x) for x in values):
            return None
        df = self.source.scan(self.source.group_of(a), [a])
        kind = self.source.registry[a].type
        return self._bound(df.filter(F.col("v0").isin([constant(x, kind) for x in values])), [(e, "e", None)])

    def _not(self, df: DataFrame, c: Not) -> DataFrame:
        """Clauses with patterns stand for themselves; comparisons with outer variables see the outer bindings."""
        inner = set().union(*[variables(x) for x in c.clauses if isinstance(x, (tuple, Or, Rule))])
        free = set().union(*[variables(x) for x in c.clauses if isinstance(x, (Compare, Call))]) - inner
        shared = [x for x in df.columns if x in set().union(*map(variables, c.clauses))]
        if free & set(df.columns):
            held = self.bindings(c.clauses, df.select(*map(col, shared)).distinct())
        else:
            held = self.bindings(c.clauses)
        return natural(df, held.select(*[col(x) for x in shared if x in held.columns] or [F.lit(1).alias("_held")]).distinct(), "left_anti")

    # results

    def run(self) -> DataFrame:
        ordered = {o if isinstance(o, str) else o[0] for o in self.order}
        whole = any(not is_var(x) for x in self.find)  # aggregates count every binding
        found = self._bindings(self.where, wanted=None if whole else {*self.find, *ordered})
        df = found.df
        plain, names, aggregates = [], [], []
        for x in self.find:
            if is_var(x):
                if x not in df.columns and x not in self.params:
                    raise ValueError(f"unbound variable in find: {x}")
                df = df if x in df.columns else df.withColumn(x, F.lit(self.params[x]))
                plain.append(x)
                names.append(x)
            else:
                name, var = x
                if name not in AGGREGATES:
                    raise ValueError(f"unknown aggregate: {name}")
                label = name if name not in names else f"{name}_{sum(n.split('_')[0] == name for n in names) + 1}"
                aggregates.append(AGGREGATES[name](col(var)).alias(label))
                names.append(label)
        keys = [(o, False) if isinstance(o, str) else (o[0], o[1] in ("desc", ":desc")) for o in self.order]
        hidden = [(k, d) for k, d in keys if k not in names]
        if aggregates:
            if hidden:
                raise ValueError(f"ordered by what is neither grouped nor found: {hidden}")
            out = df.groupBy(*map(col, plain)).agg(*aggregates) if plain else df.agg(*aggregates)
        elif hidden:
            out = df.groupBy(*map(col, plain)).agg(*[(F.max if d else F.min)(col(k)).alias(k) for k, d in hidden])
        else:
            out = df.select(*map(col, dict.fromkeys(plain)))
            out = out if found.key is not None and found.key <= set(plain) else out.distinct()
        if keys:
            out = out.orderBy(*[col(k).desc() if d else col(k).asc() for k, d in keys])
        if self.offset:
            out = out.offset(self.offset)
        if self.limit is not None:
            out = out.limit(self.limit)
        return out.select(*map(col, names))
