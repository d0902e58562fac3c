"""Groundings of action schemas over tables of typed objects: a multiway join that static facts prune.

An action has typed parameters and static preconditions, relations between some of them. The
product of the pools is never formed: every step is an equi-join as long as any relation is connected
to what is bound. Of the orders that allow it, the one is taken whose steps make the fewest rows, by the
relations' rows and different values: two relations that share a parameter of few values (places)
would make the square of their rows, if nothing else tied them first. Each relation is first
reduced to objects of its parameters' pools. A parameter that no relation names comes last, when
everything else is pruned; its product with the rest is then part of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schema:
    """params: (name, type); static: (relation, the parameters of its columns in order); agents: those that must differ."""

    name: str
    params: tuple[tuple[str, str], ...]
    static: tuple[tuple[str, tuple[str, ...]], ...] = ()
    agents: tuple[str, ...] = field(default=())


def _relation(facts: DataFrame, args: tuple[str, ...], types: dict[str, str], pools: dict[str, DataFrame]) -> DataFrame:
    """The facts under the parameters' names, of objects in their pools alone."""
    if len(args) != len(facts.columns):
        raise ValueError(f"a relation of {len(facts.columns)} columns has {len(args)} arguments")
    first = {a: args.index(a) for a in args}  # a parameter may stand twice
    named = facts.toDF(*[f"_{i}" for i in range(len(args))])
    for i, a in enumerate(args):
        if first[a] != i:
            named = named.where(F.col(f"_{i}") == F.col(f"_{first[a]}"))
    named = named.select(*[F.col(f"_{i}").alias(a) for a, i in first.items()]).distinct()
    for a in first:
        pool = pools[types[a]]
        named = named.join(pool.select(F.col(pool.columns[0]).alias(a)), a, "left_semi")
    return named


def join_order(static: tuple[tuple[str, tuple[str, ...]], ...], rows: dict[str, int], values: dict[str, tuple[int, ...]] | None = None) -> list[int]:
    """The places of the relations in the order of their joins. values: how many different ones each column of a relation has.

    Without values: from the smallest relation on, what shares most bound parameters.
    """
    if values:
        starts = [_cheapest(static, rows, values, i) for i in range(len(static))]
        return min(starts, key=lambda x: (x[0], x[1]))[1] if starts else []
    left, bound, order = list(range(len(static))), set(), []
    while left:
        shared = {i: len(bound & set(static[i][1])) for i in left}
        # filters come first, then what is connected, then the smallest
        best = min(left, key=lambda i: (-(set(static[i][1]) <= bound), -shared[i], rows[static[i][0]], i))
        left.remove(best)
        bound |= set(static[best][1])
        order.append(best)
    return order


def _cheapest(static: tuple[tuple[str, tuple[str, ...]], ...], rows: dict[str, int], values: dict[str, tuple[int, ...]], start: int) -> tuple[float, list[int]]:
    """(rows of all steps, order) from a relation on, each time with the connected one of which the fewest rows are expected."""
    of = lambda i: dict(zip(static[i][1], values[static[i][0]], strict=True))
    size, bound, order, left = float(rows[static[start][0]]), of(start), [start], [i for i in range(len(static)) if i != start]
    total = size
    while left:
        expected = {}
        for i in left:
            n, own = size * rows[static[i][0]], of(i)
            for a in own.keys() & bound.keys():
                n /= max(1, own[a], bound[a])
            expected[i] = min(n, size) if own.keys() <= bound.keys() else n
        best = min(left, key=lambda i: (not (bound.keys() & set(static[i][1])), expected[i], i))
        size = expected[best]
        total += size
        for a, n in of(best).items():
            bound[a] = min(bound.get(a, n), n)
        left.remove(best)
        order.append(best)
    return total, order


def _measured(facts: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows of a relation, and some number of different values of each column."""
    seen = facts.agg(F.count("*"), *[F.approx_count_distinct(F.col(c)) for c in facts.columns]).first()
    return seen[0], tuple(seen[1:])


def ground(schema: Schema, pools: dict[str, DataFrame], facts: dict[str, DataFrame], rows: dict[str, int] | None = None) -> DataFrame:
    """One row for each grounding, a column for each parameter. rows: sizes of the relations, counted if not given, and their values too."""
    types = dict(schema.params)
    seen = {} if rows else {r: _measured(facts[r]) for r in {r for r, _ in schema.static}}
    rows, values = rows or {r: n for r, (n, _) in seen.items()}, {r: v for r, (_, v) in seen.items()}
    bound: DataFrame | None = None

    def distinct_agents(df: DataFrame, new: set[str]) -> DataFrame:
        for a, b in combinations(schema.agents, 2):
            if {a, b} <= set(df.columns) and {a, b} & new:
                df = df.where(F.col(a) != F.col(b))
        return df

    for i in join_order(schema.static, rows, values):
        name, args = schema.static[i]
        relation = _relation(facts[name], args, types, pools)
        had = set(bound.columns) if bound is not None else set()
        on = [a for a in relation.columns if a in had]
        if bound is None:
            bound = relation
        elif not on:
            bound = bound.crossJoin(relation)  # nothing ties them: their product is part of the result
        else:
            bound = bound.join(relation, on, "left_semi" if len(on) == len(relation.columns) else "inner")
        bound = distinct_agents(bound, set(relation.columns) - had)
    for name, kind in schema.params:
        if bound is None or name not in bound.columns:
            pool = pools[kind]
            pool = pool.select(F.col(pool.columns[0]).alias(name)).distinct()
            bound = pool if bound is None else bound.crossJoin(pool)
            bound = distinct_agents(bound, {name})
    return bound.select(*types)
