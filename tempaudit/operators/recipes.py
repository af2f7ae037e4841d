"""Several sets of per-run measures from one ordered pass over the samples.

A recipe says what a verdict needs of a run: rounds of ordered columns, each of which may use those before it, and
aggregates over the finished rows.  ``measure`` works out any number of recipes together.  Rows may be tagged with the recipe that
concerns them; scans of one kind then share a column, whose expression is chosen by the tag, so that the work per
row is that of the longest recipe and not of all of them.  Everything keeps the partitioning by run: one
exchange, whatever the number of states and recipes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.operators.timeline import Scan, Timeline, following, last_seen, prev, seconds

#: Aggregates of the whole run that rows may carry; ``median`` is the exact interpolated one.
WHOLE = {"min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True)
class Whole:
    """A value of the whole run as a column of its rows."""

    kind: str
    expr: Column


@dataclass(frozen=True)
class Round:
    """Scans and whole-run values over the columns there are, then row-local columns over those as well."""

    ordered: dict[str, Scan | Whole] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Rules:
    """A verdict as expressions over a recipe's measures."""

    status: Column
    codes: list[Column]
    texts: list[Column]
    extra: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    """Names of columns are the recipe's own: ``prefix`` keeps recipes of one pass apart."""

    prefix: str
    rounds: list[Round]
    measures: dict[str, Column]
    rules: Callable[[Callable[[str], Column]], Rules] | None = None

    def measured(self, name: str) -> Column:
        return F.col(self.prefix + name)


def stretch_rounds(state: Column, p: str, name: str = "") -> list[Round]:
    """Rounds that mark the stretches of equal ``state`` (never null).

    They leave ``first`` and ``last`` (at a stretch's first and last row) and ``from`` (the instant it began); at its last row
    a stretch has lasted ``lasted(p, name)`` seconds.
    """
    was, will, here = f"{p}{name}was", f"{p}{name}will", f"{p}{name}state"
    return [
        Round({}, {here: state}),
        Round({was: prev(here), will: following(here)}, {
            f"{p}{name}first": ~F.col(was).eqNullSafe(F.col(here)), f"{p}{name}last": ~F.col(will).eqNullSafe(F.col(here))}),
        Round({f"{p}{name}from": last_seen(F.when(F.col(f"{p}{name}first"), F.col("us")))}),
    ]


def lasted(p: str, name: str = "") -> Column:
    return seconds(F.col("us"), F.col(f"{p}{name}from"))


def longest_stretch(p: str, name: str = "") -> Column:
    """Seconds of the run's longest stretch of a true state; 0 without one."""
    held = F.col(f"{p}{name}state") & F.col(f"{p}{name}last")
    return F.coalesce(F.max(F.when(held, lasted(p, name))), F.lit(0.0))


def together(*lists: list[Round]) -> list[Round]:
    """The lists of rounds side by side: the first rounds as one, then the second ones, and so on."""
    out = []
    for i in range(max(map(len, lists))):
        rounds = [x[i] for x in lists if i < len(x)]
        out.append(Round({k: v for r in rounds for k, v in r.ordered.items()}, {k: v for r in rounds for k, v in r.columns.items()}))
    return out


def after(start: Round, rest: list[Round]) -> list[Round]:
    """``rest`` with its first round's columns worked out after those of ``start``, in the same round."""
    return [Round(start.ordered | rest[0].ordered, start.columns | rest[0].columns), *rest[1:]]


def _slots(line: Timeline, round_of: dict[str, Round], tag: str | None) -> tuple[dict[str, Scan | Whole], dict[str, Column]]:
    """Shared ordered columns of a round, and each recipe's names for them."""
    if tag is None:
        (only,) = round_of.values()
        return dict(only.ordered), {}
    shared: dict[tuple, dict[str, Column]] = {}
    names: dict[str, Column] = {}
    for recipe, r in round_of.items():
        used: dict[tuple, int] = {}
        kinds = line.df.select(*[x.expr.alias(n) for n, x in r.ordered.items()]).schema if r.ordered else []
        for (name, x), kind in zip(r.ordered.items(), kinds):
            group = (type(x), x.kind, kind.dataType.simpleString())
            slot = (*group, used.setdefault(group, 0))
            used[group] += 1
            shared.setdefault(slot, {})[recipe] = x.expr
            names[name] = slot
    ordered, column = {}, {slot: f"_shared{len(round_of)}_{i}" for i, slot in enumerate(shared)}
    for slot, exprs in shared.items():
        chosen = reduce(lambda c, kv: c.when(F.col(tag) == kv[0], kv[1]), exprs.items(), F.when(F.lit(False), None))
        ordered[column[slot]] = slot[0](slot[1], chosen)
    return ordered, {name: F.col(column[slot]) for name, slot in names.items()}


def _ordered(line: Timeline, wanted: dict[str, Scan | Whole]) -> Timeline:
    scans = {n: x for n, x in wanted.items() if isinstance(x, Scan)}
    whole = {n: WHOLE[x.kind](x.expr) for n, x in wanted.items() if isinstance(x, Whole) and x.kind != "median"}
    line = line.scan(**scans) if scans else line
    line = line.attach(**whole) if whole else line
    for n, x in wanted.items():
        if isinstance(x, Whole) and x.kind == "median":
            line = line.attach_quantile(x.expr, 0.5, n)
    return line


def measure(tl: Timeline, recipes: dict[str, Recipe], tag: str | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per run with the measures of all recipes, each under its recipe's prefix.

    ``tag`` names the column that says which recipe a run's rows are for; the measures of the others are then meaningless.
    Without it there must be one recipe.  ``carry`` are further aggregates.
    """
    line = tl
    for i in range(max(len(r.rounds) for r in recipes.values())):
        round_of = {name: r.rounds[i] for name, r in recipes.items() if i < len(r.rounds)}
        ordered, names = _slots(line, round_of, tag)
        line = _ordered(line, ordered)
        line = line.with_columns(**names).dropping(*ordered) if names else line
        # a column may use those named before it
        for r in round_of.values():
            for name, c in r.columns.items():
                line = line.with_columns(**{name: c})
    aggs = [c.alias(r.prefix + n) for r in recipes.values() for n, c in r.measures.items()]
    return line.per_run(*aggs, *[c.alias(n) for n, c in (carry or {}).items()])
