"""Exact order statistics of whole columns without sorting them.

A rank is located with mergeable quantile sketches: the sketch brackets the wanted value, one
counting pass proves the bracket, and only rows inside it stay in play. The bracket shrinks by
three orders of magnitude per round, so a trillion rows need two rounds. Equal values are counted
before anything is ranked, so a value held by a third of all rows is one row of the last step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import double_sql, inline_sql, literal_sql
from churnlake.session import staged

SMALL = 1_000_000
ACCURACY = 10_000
LONGS = (-(2**63), 2**63 - 1)


@dataclass(frozen=True)
class Statistic:
    """The value at a rank, with the number of rows below it and equal to it."""

    value: Any
    less: int
    equal: int


@dataclass(frozen=True)
class _Bracket:
    """The open interval (low, high) of one series that still hides some wanted ranks."""

    column: str
    ranks: tuple[int, ...]
    low: Any
    high: Any
    below: int
    count: int

    @property
    def anchor(self) -> Any:
        """A known value near the hidden ones; long integers are sketched relative to it, because
        the sketch holds doubles."""
        return self.low if self.low is not None else self.high if self.high is not None else 0

    def inside(self) -> str:
        tests = [f"{self.column} IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{self.column} > {literal_sql(self.low)}")
        if self.high is not None:
            tests.append(f"{self.column} < {literal_sql(self.high)}")
        return "(" + " AND ".join(tests) + ")"


def series_counts(df: DataFrame, series: Mapping[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(expr).alias(f"c{i}") for i, expr in enumerate(series.values())]).first()
    return {name: row[i] for i, name in enumerate(series)}


def order_statistics(
    df: DataFrame,
    series: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]] | Callable[[str, int], Sequence[int]],
    counts: Mapping[str, int] | None = None,
    small: int = SMALL,
) -> dict[tuple[str, int], Statistic]:
    """Exact values at 0-based ranks of numeric series (expressions over ``df``; NULLs ignored)."""
    names = {name: f"s{i}" for i, name in enumerate(series)}
    data = df.select(*[series[name].alias(column) for name, column in names.items()])
    if counts is None:
        counts = series_counts(df, series)
    brackets = []
    for name, column in names.items():
        wanted = ranks(name, counts[name]) if callable(ranks) else ranks.get(name, ())
        wanted = tuple(sorted(set(wanted)))
        if wanted and not 0 <= wanted[0] <= wanted[-1] < counts[name]:
            raise ValueError(f"rank outside 0..{counts[name] - 1} for {name}")
        if wanted:
            brackets.append(_Bracket(column, wanted, None, None, 0, counts[name]))

    found: dict[tuple[str, int], Statistic] = {}
    while any(b.count > small for b in brackets):
        solved, brackets = _narrow(data, brackets, small)
        found.update(solved)
        if brackets:
            data = staged(data.where(" OR ".join(b.inside() for b in brackets)), "bracket")
    found.update(_finish(data, brackets))
    by_column = {column: name for name, column in names.items()}
    return {(by_column[column], rank): stat for (column, rank), stat in found.items()}


def _narrow(data: DataFrame, brackets: list[_Bracket], small: int):
    big = [replace(b, ranks=(r,)) for b in brackets if b.count > small for r in b.ranks]
    kept = [b for b in brackets if b.count <= small]
    wide = {f.name for f in data.schema.fields if f.dataType.simpleString() == "bigint"}
    sketches = []
    for i, b in enumerate(big):
        position = b.ranks[0] - b.below
        slack = 2 * b.count / ACCURACY + 1
        bounds = [max(0.0, (position - slack) / b.count), min(1.0, (position + slack + 1) / b.count)]
        value = b.column
        if value in wide:
            value = f"coalesce(try_subtract({value}, {literal_sql(b.anchor)}), 0L)"
        ends = ", ".join(double_sql(p) for p in bounds)
        case = f"CASE WHEN {b.inside()} THEN {value} END"
        sketches.append(F.expr(f"percentile_approx({case}, array({ends}), {ACCURACY}) AS b{i}"))
    row = data.agg(*sketches).first()
    limits = [
        [max(LONGS[0], min(LONGS[1], v + b.anchor)) for v in row[i]] if b.column in wide else row[i]
        for i, b in enumerate(big)
    ]

    tallies = []
    for i, b in enumerate(big):
        low, high = (literal_sql(v) for v in limits[i])
        v, inside = b.column, b.inside()
        tests = {
            "lt": f"{v} < {low}",
            "lo": f"{v} = {low}",
            "in": f"{v} > {low} AND {v} < {high}",
            "hi": f"{v} = {high} AND {v} > {low}",
        }
        tallies += [F.expr(f"count_if({inside} AND {test}) AS {name}{i}") for name, test in tests.items()]
    tally = data.agg(*tallies).first()

    solved: dict[tuple[str, int], Statistic] = {}
    for i, b in enumerate(big):
        low, high = limits[i]
        rank = b.ranks[0]
        start = b.below
        pieces = [
            (tally[f"lt{i}"], None, (b.low, low)),
            (tally[f"lo{i}"], low, None),
            (tally[f"in{i}"], None, (low, high)),
            (tally[f"hi{i}"], high, None),
            (None, None, (high, b.high)),
        ]
        for size, value, interval in pieces:
            size = b.below + b.count - start if size is None else size
            if rank < start + size:
                if interval is None:
                    solved[(b.column, rank)] = Statistic(value, start, size)
                else:
                    kept.append(_Bracket(b.column, (rank,), *interval, start, size))
                break
            start += size
    return solved, kept


def _finish(data: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], Statistic]:
    """Rank the few distinct values left in each bracket; at most ``small`` rows per bracket."""
    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    found: dict[tuple[str, int], Statistic] = {}
    for kind in sorted({types[b.column] for b in brackets}):
        group = [b for b in brackets if types[b.column] == kind]
        rows = [{"k": str(i), "v": f"CASE WHEN {b.inside()} THEN {b.column} END"} for i, b in enumerate(group)]
        tied = data.select(inline_sql(rows)).where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
        wanted = " OR ".join(
            f"(k = {i} AND upto > {rank - b.below}L AND upto - n <= {rank - b.below}L)"
            for i, b in enumerate(group)
            for rank in b.ranks
        )
        for row in tied.withColumn("upto", upto).where(wanted).collect():
            b = group[row["k"]]
            less = b.below + row["upto"] - row["n"]
            for rank in b.ranks:
                if less <= rank < less + row["n"]:
                    found[(b.column, rank)] = Statistic(row["v"], less, row["n"])
    return found


def exact_quantiles(
    df: DataFrame,
    series: Mapping[str, Column],
    probs: Sequence[float],
    counts: Mapping[str, int] | None = None,
    small: int = SMALL,
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles; NULL for a series without values."""
    if counts is None:
        counts = series_counts(df, series)

    def places(name: str, n: int) -> list[int]:
        if n == 0:
            return []
        spots = [p * (n - 1) for p in probs]
        return [math.floor(s) for s in spots] + [math.ceil(s) for s in spots]

    stats = order_statistics(df, series, places, counts, small)
    result: dict[tuple[str, float], float | None] = {}
    for name in series:
        for p in probs:
            if counts[name] == 0:
                result[(name, p)] = None
                continue
            spot = p * (counts[name] - 1)
            low = float(stats[(name, math.floor(spot))].value)
            high = float(stats[(name, math.ceil(spot))].value)
            result[(name, p)] = low + (high - low) * (spot - math.floor(spot))
    return result


@dataclass(frozen=True)
class Cut:
    """The row at a rank of the order (primary, tiebreak); a None tiebreak means no other row ties."""

    primary: Any
    tiebreak: Any

    def at_or_after(self, primary: Column, tiebreak: Column) -> Column:
        beyond = primary > F.lit(self.primary)
        tied = primary == F.lit(self.primary)
        if self.tiebreak is not None:
            tied = tied & (tiebreak >= F.lit(self.tiebreak))
        return beyond | tied


def row_cuts(
    df: DataFrame,
    series: Mapping[str, Column],
    tiebreak: Column,
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    small: int = SMALL,
) -> dict[tuple[str, int], Cut]:
    """The rows at given ranks of each series, ties broken by a unique column.

    With these cuts, "which chunk does a row fall in" is a comparison with constants: no sort, no
    shuffle of the rows themselves.
    """
    stats = order_statistics(df, series, ranks, counts, small)
    tied = {key: s for key, s in stats.items() if s.equal > 1}
    ties = {f"{name}|{rank}": F.when(series[name] == F.lit(s.value), tiebreak) for (name, rank), s in tied.items()}
    places = {f"{name}|{rank}": [rank - s.less] for (name, rank), s in tied.items()}
    sizes = {f"{name}|{rank}": s.equal for (name, rank), s in tied.items()}
    broken = order_statistics(df, ties, places, sizes, small) if ties else {}
    cuts = {}
    for (name, rank), s in stats.items():
        inner = broken.get((f"{name}|{rank}", rank - s.less))
        cuts[(name, rank)] = Cut(s.value, inner.value if inner else None)
    return cuts
