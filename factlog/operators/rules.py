"""Recursive rules: semi-naive fixpoints over DataFrames.

Rules that depend on each other are computed together, those they need first. In each round every rule body is joined
once for each of its recursive calls, with the rows that the last round added standing for that call, the rows before
them for calls to its left and all rows for calls to its right; what is new goes on. Each round is written to the
shared folder, so that lineage stays short and a lost executor costs one round. Relations of a recursion are never broadcast.

Where every rule has one recursive call (or the one rule says that a relation is transitive) and the step from the call's row to the
head's leads from each row to one at most, or to each row from one at most, the step is squared in each round: chains of n steps take
log n rounds, the squares hold no more rows than the step, and each row of a tree's closure is derived once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import stored
from ..plans.query import Call, Not, Or, Query, Rule, col, constant, is_var, variables


@dataclass(frozen=True)
class Defined:
    """A rule: a name, its arguments (variables or constants) and the clauses that make it hold. Rules of one name add up."""

    name: str
    args: tuple
    where: tuple


def _calls(clauses: tuple, negated: bool = False) -> list[tuple[str, bool]]:
    out = []
    for c in clauses:
        if isinstance(c, Rule):
            out.append((c.name, negated))
        elif isinstance(c, Not):
            out += _calls(c.clauses, True)
        elif isinstance(c, Or):
            out += [x for b in c.branches for x in _calls(b, negated)]
    return out


def strata(rules: list[Defined]) -> list[set[str]]:
    """Names in the order of computation, those that depend on each other together. A rule may not depend on its own negation."""
    names = {r.name for r in rules}
    reach = {n: {c for r in rules if r.name == n for c, _ in _calls(r.where)} & names for n in names}
    for _ in names:
        reach = {n: s | {y for x in s for y in reach[x]} for n, s in reach.items()}
    for r in rules:
        for c, negated in _calls(r.where):
            if negated and r.name in reach.get(c, ()) | {c}:
                raise ValueError(f"{r.name} depends on its own negation")
    groups = {frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in names}
    return [set(g) for g in sorted(groups, key=lambda g: (len(set().union(*[reach[n] for n in g]) | g), sorted(g)))]


def _body(query: Query, r: Defined) -> DataFrame:
    df = query.bindings(r.where)
    for x in r.args:
        if x == "_" or is_var(x) and x not in df.columns:
            raise ValueError(f"{r.name}: {x} isn't bound")
    return df.select(*[(col(x) if is_var(x) else constant(x)).alias(f"c{k}") for k, x in enumerate(r.args)])


@dataclass(frozen=True)
class Step:
    """How rows of a recursive group follow from each other: f0, f1, ... (a row's columns at moved places) lead to t0, t1, ...; other columns stay.

    Rows of several relations lie in one table, with the number of theirs in a column before.
    """

    df: DataFrame
    moved: list[str]
    stays: list[str]

    @property
    def ends(self) -> tuple[list[str], list[str]]:
        return [f"f{k}" for k in range(len(self.moved))], [f"t{k}" for k in range(len(self.moved))]

    def is_function(self) -> bool:
        """Whether each row leads to one at most, or each comes from one at most: of its powers the same holds."""
        return any(self.df.groupBy(*end).count().filter("count > 1").isEmpty() for end in self.ends)

    def after(self, rows: DataFrame) -> DataFrame:
        fs, ts = self.ends
        both = rows.join(self.df.hint("merge"), reduce(and_, [F.col(c) == F.col(f) for c, f in zip(self.moved, fs)]))
        return both.select(*[F.col(dict(zip(self.moved, ts)).get(c, c)).alias(c) for c in rows.columns])

    def squared(self) -> Step:
        fs, ts = self.ends
        on = self.df.select(*[F.col(f).alias(f"_{f}") for f in fs], *[F.col(t).alias(f"_{t}") for t in ts]).hint("merge")
        both = self.df.join(on, reduce(and_, [F.col(t) == F.col(f"_{f}") for t, f in zip(ts, fs)]))
        return Step(stored(both.select(*fs, *[F.col(f"_{t}").alias(t) for t in ts]).distinct(), "rule-steps"), self.moved, self.stays)


def _is_transitive(r: Defined) -> bool:
    """Whether a rule says r(x, z) where r(x, y) and r(y, z)."""
    if len(r.where) != 2 or any(not isinstance(c, Rule) or c.name != r.name or len(c.args) != 2 for c in r.where):
        return False
    (x, y), (again, z) = (c.args for c in r.where)
    return r.args == (x, z) and y == again and len({x, y, z}) == 3 and all(map(is_var, (x, y, z)))


def _step(recursive: list[Defined], numbers: dict[str, int], start: DataFrame, query: Query) -> Step | None:
    """The step of linear rules, or of the one rule that makes a relation transitive; None: not of that form, or of other types than the rows."""
    names = [c for c in start.columns if c != "_p"]
    if query.params or any(len(r.args) != len(names) for r in recursive):
        return None
    if len(recursive) == 1 and len(numbers) == 1 and _is_transitive(recursive[0]):
        return Step(start.select(F.col("c1").alias("f0"), F.col("c0").alias("t0")), ["c0"], ["c1"])
    linear = []
    for r in recursive:
        calls = [c for c in r.where if isinstance(c, Rule) and c.name in numbers]
        if len(calls) != 1 or len(calls[0].args) != len(names) or len([n for n, _ in _calls(r.where) if n in numbers]) != 1:
            return None
        linear.append((r, calls[0], tuple(c for c in r.where if c is not calls[0])))
    once = lambda x, r, c, rest: is_var(x) and r.args.count(x) == c.args.count(x) == 1 and not any(x in _mentioned(d) for d in rest)
    stays = [k for k in range(len(names)) if all(r.args[k] == c.args[k] and once(r.args[k], r, c, rest) for r, c, rest in linear)]
    moved = [k for k in range(len(names)) if k not in stays]
    steps = []
    for r, c, rest in linear:
        bound = set().union(*[variables(d) for d in rest if isinstance(d, (tuple, Or, Rule))], *[{d.out} for d in rest if isinstance(d, Call) and d.out])
        ends = [c.args[k] for k in moved], [r.args[k] for k in moved]
        if not moved or not any(isinstance(d, (tuple, Or, Rule)) for d in rest) or any(x == "_" or is_var(x) and x not in bound for end in ends for x in end):
            return None
        df = query.bindings(rest)
        if any(is_var(x) and x not in df.columns for end in ends for x in end):
            return None
        numbered = [[F.lit(numbers[n])] if len(numbers) > 1 else [] for n in (c.name, r.name)]
        columns = [n + [col(x) if is_var(x) else constant(x) for x in end] for n, end in zip(numbered, ends)]
        steps.append(df.select(*[v.alias(f"{side}{k}") for side, end in zip("ft", columns) for k, v in enumerate(end)]))
    places = (["_p"] if len(numbers) > 1 else []) + [names[k] for k in moved]
    types = [start.schema[c].dataType for c in places]
    if any([f.dataType for f in df.schema] != types * 2 for df in steps):
        return None
    return Step(reduce(lambda a, b: a.unionByName(b), steps).distinct(), places, [names[k] for k in stays])


def _mentioned(clause: Any) -> set[str]:
    """All variables of a clause, those of single branches too."""
    return set().union(*[_mentioned(d) for b in clause.branches for d in b]) if isinstance(clause, Or) else set().union(*map(_mentioned, clause.clauses)) if isinstance(clause, Not) else variables(clause)


def _squaring(group: set[str], start: dict[str, list[DataFrame]], recursive: list[Defined], query: Query, most_rounds: int) -> dict[str, DataFrame] | None:
    """The relations of a group by squaring its step, or None where that isn't possible, or might make more rows than the relations have."""
    numbers = {n: k for k, n in enumerate(sorted(group))}
    first = [df.select(*([F.lit(numbers[n]).alias("_p")] if len(group) > 1 else []), *df.columns) for n in sorted(group) for df in start[n]]
    if len({len(df.columns) for df in first}) > 1:
        return None
    base = reduce(lambda a, b: a.unionByName(b), first).distinct()
    step = _step(recursive, numbers, base, query)
    if step is None:
        return None
    rows = [stored(base, "rule-rows")]
    step = Step(stored(step.df, "rule-steps"), step.moved, step.stays)
    if not step.is_function():
        return None
    for _ in range(most_rounds):
        every = reduce(lambda a, b: a.unionByName(b), rows)
        held = every.select(*[F.col(c).alias(f"_{c}") for c in every.columns]).hint("merge")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in every.columns])
        new = stored(step.after(every).distinct().join(held, same, "left_anti"), "rule-rows")
        if new.isEmpty():
            return {n: every.filter(F.col("_p") == k).drop("_p") if len(group) > 1 else every for n, k in numbers.items()}
        rows.append(new)
        step = step.squared()
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def evaluate(rules: list[Defined], source: Any, most_rounds: int = 10_000, **options: Any) -> dict[str, DataFrame]:
    """The relations of all rules, with columns c0, c1, ..."""
    if any(len({len(r.args) for r in rules if r.name == s.name}) > 1 for s in rules):
        raise ValueError("rules of one name have one number of arguments")
    done: dict[str, DataFrame] = {}
    for group in strata(rules):
        mine = [r for r in rules if r.name in group]
        recursive = [r for r in mine if any(c in group for c, _ in _calls(r.where))]
        query = Query(source, [], [], rules=done, **options)
        start = {n: [_body(query, r) for r in mine if r.name == n and r not in recursive] for n in group}
        if recursive and any(start.values()) and (found := _squaring(group, start, recursive, query, most_rounds)) is not None:
            done |= found
            continue
        if any(not start[n] for n in group):
            empty = {n: start[n][0].limit(0) for n in group if start[n]}
            if not empty:
                raise ValueError(f"no rule of {group} is without recursion")
            some = next(iter(empty.values()))
            for n in group:
                start[n] = start[n] or [some.select(*some.columns[: len(next(r.args for r in mine if r.name == n))])]
        union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs).distinct()
        new = {n: union(start[n]) for n in group}
        if recursive:
            new = {n: stored(df, "rule-rows") for n, df in new.items()}
        old = {n: df.limit(0) for n, df in new.items()}
        every = dict(new)
        for _ in range(most_rounds):
            if not recursive or all(df.isEmpty() for df in new.values()):
                break
            found: dict[str, list[DataFrame]] = {n: [] for n in group}
            for r in recursive:
                places = [k for k, c in enumerate(r.where) if isinstance(c, Rule) and c.name in group]
                if len(places) != sum(c in group for c, _ in _calls(r.where)):
                    raise ValueError(f"{r.name}: recursive calls stand at the top of a rule's clauses")
                for at in places:
                    named, where = dict(done), list(r.where)
                    for k in places:
                        call = r.where[k]
                        kind, rows = ("new", new) if k == at else ("old", old) if k < at else ("every", every)
                        named[f"{call.name}/{kind}"] = rows[call.name].hint("merge")
                        where[k] = Rule(f"{call.name}/{kind}", call.args)
                    found[r.name].append(_body(Query(source, [], [], rules=named, **options), Defined(r.name, r.args, tuple(where))))
            old = every
            new = {n: stored(union(found[n]).join(every[n].hint("merge"), every[n].columns, "left_anti"), "rule-rows") if found[n] else every[n].limit(0) for n in group}
            every = {n: every[n].unionByName(new[n]) for n in group}  # of tables that are written
        else:
            raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
        done |= every
    return done
