"""Exact interpolated quantiles over a value-frequency table of any size."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A column with at most this many distinct values is finished by one aggregate.
GROUP_LIMIT = 1_000_000
BINS = 64                 # splitter intervals per search round
WIDTH_BINS = 1024
SORTED_ROWS = 100_000      # columns up to this long are not binned


@dataclass(frozen=True)
class Extent:
    """Rows and value range of one column."""

    n: int
    low: float
    high: float


def exact_quantiles(freq: DataFrame, extents: dict[int, Extent], probs: list[float],
                    names: list[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per column_id: unique_count and one linearly interpolated quantile per
    probability.

    ``freq`` is (column_id, value double, n), one row per distinct value. A column of at
    most ``group_limit`` rows is ranked directly. Of a larger one each wanted rank is first
    enclosed by counting values between splitters, round by round, until the enclosing
    interval holds that few values."""
    bounded = {c: e for c, e in extents.items() if e.n <= group_limit}
    rest = [c for c in extents if c not in bounded]
    if not rest:
        return _rank_directly(freq, bounded, probs, names)
    counts = {r.column_id: r.distinct_values for r in
              freq.where(F.col("column_id").isin(rest)).groupBy("column_id").agg(
                  F.count(F.lit(1)).alias("distinct_values")).collect()}
    bounded |= {c: extents[c] for c, d in counts.items() if d <= group_limit}
    out = _rank_directly(freq, bounded, probs, names)
    many = {c: d for c, d in counts.items() if c not in bounded}
    if not many:
        return out
    found = _rank_by_search(freq, many, extents, probs, group_limit)
    schema = "column_id int, unique_count bigint, " + ", ".join(f"{n} double" for n in names)
    rows = [(c, d, *[found[c, i] for i in range(len(probs))]) for c, d in many.items()]
    return out.unionByName(freq.sparkSession.createDataFrame(rows, schema))


def _rank_directly(freq: DataFrame, extents: dict[int, Extent], probs: list[float],
                   names: list[str]) -> DataFrame:
    """Quantiles of columns whose distinct values fit one group: short columns are sorted
    whole, of others only the values around the wanted ranks."""
    short = {c: e for c, e in extents.items() if e.n <= SORTED_ROWS}
    binned = {c: e for c, e in extents.items() if c not in short}
    parts = [rank(_with_extent(freq, chosen), probs)
             for rank, chosen in ((_rank_sorted, short), (_rank_in_bins, binned)) if chosen]
    if not parts:
        parts = [_rank_sorted(_with_extent(freq, {}), probs)]
    return _interpolate(reduce(DataFrame.unionByName, parts), probs, names)


def _with_extent(freq: DataFrame, extents: dict[int, Extent]) -> DataFrame:
    """Frequencies of these columns with their last rank and value range."""
    table = freq.sparkSession.createDataFrame(
        [(c, e.n - 1, e.low, e.high) for c, e in extents.items()],
        "column_id int, last bigint, low double, high double")
    return freq.join(F.broadcast(table), "column_id")


def _rank_sorted(own: DataFrame, probs: list[float]) -> DataFrame:
    """(column_id, value, last, upto, values): rows up to each value, distinct values."""
    running = Window.partitionBy("column_id").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    return own.select("column_id", "value", "last", F.sum("n").over(running).alias("upto"),
                      F.row_number().over(running).cast("bigint").alias("values"))


def _rank_in_bins(own: DataFrame, probs: list[float]) -> DataFrame:
    """The same for the values in the equal-width bins that hold a wanted rank; the other
    values are counted per bin, neither shuffled again nor sorted."""
    binned = own.selectExpr(
        "column_id", "value", "n", "last",
        f"""CASE WHEN high > low AND high - low < double('Infinity') THEN least(
            {WIDTH_BINS - 1}, int((value - low) / (high - low) * {WIDTH_BINS})) ELSE 0 END
            AS bin""")
    column = Window.partitionBy("column_id")
    upto = F.sum("n").over(column.orderBy("bin"))
    wanted = " OR ".join(
        f"(before <= {f}(last * {p!r}D) AND upto > {f}(last * {p!r}D))"
        for p in probs for f in ("floor", "ceil"))
    bins = (binned.groupBy("column_id", "bin").agg(
                F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"),
                F.max("last").alias("last"))
            .select("column_id", "bin", "last", upto.alias("upto"),
                    (upto - F.col("n")).alias("before"),
                    F.sum("values").over(column).alias("values"))
            .where(wanted).select("column_id", "bin", "before", "values"))
    in_bin = Window.partitionBy("column_id", "bin").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    return binned.join(F.broadcast(bins), ["column_id", "bin"]).select(
        "column_id", "value", "last",
        (F.sum("n").over(in_bin) + F.col("before")).alias("upto"), "values")


def _interpolate(ranked: DataFrame, probs: list[float], names: list[str]) -> DataFrame:
    at = []
    for i, p in enumerate(probs):
        at += [f"min(CASE WHEN upto > floor(last * {p!r}D) THEN value END) AS low{i}",
               f"min(CASE WHEN upto > ceil(last * {p!r}D) THEN value END) AS high{i}",
               f"max(last * {p!r}D - floor(last * {p!r}D)) AS part{i}"]
    return ranked.groupBy("column_id").agg(
        F.max("values").alias("unique_count"), *[F.expr(x) for x in at]).selectExpr(
        "column_id", "unique_count",
        *[f"low{i} + (high{i} - low{i}) * part{i} AS {n}" for i, n in enumerate(names)])


@dataclass
class _Bracket:
    """Interval of values known to hold a wanted rank."""

    column_id: int
    part: int            # which probability
    rank: float          # zero-based, fractional
    low: float
    high: float
    below: int           # rows under the interval
    distinct_values: int


def _rank_by_search(freq: DataFrame, columns: dict[int, int], extents: dict[int, Extent],
                    probs: list[float], group_limit: int) -> dict[tuple[int, int], float]:
    """Values at all wanted ranks. Every round handles all columns at once: splitters of
    the open intervals, then exact counts between them; only counts reach the driver."""
    brackets = [_Bracket(c, i, p * (extents[c].n - 1), extents[c].low, extents[c].high, 0, d)
                for c, d in columns.items() for i, p in enumerate(probs)]
    wide = [b for b in brackets if b.distinct_values > group_limit]
    while wide:
        probes = [i / BINS for i in range(1, BINS)]
        edges = {(r.column_id, r.part): r.edges for r in _inside(freq, wide).groupBy(
            "column_id", "part").agg(
                F.percentile_approx("value", probes, 10 * BINS).alias("edges")).collect()}
        counted: dict[tuple[int, int], list] = {}
        for r in (_inside(freq, wide, edges)
                  .groupBy("column_id", "part", _bin(0, BINS - 1).alias("bin"))
                  .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"),
                       F.min("value").alias("low"), F.max("value").alias("high")).collect()):
            counted.setdefault((r.column_id, r.part), []).append(r)
        still = []
        for b in wide:
            before = b.distinct_values
            _narrow(b, sorted(counted[b.column_id, b.part], key=lambda r: r.bin))
            if group_limit < b.distinct_values < before:
                still.append(b)
        wide = still
    return _finish(freq, brackets)


def _narrow(b: _Bracket, bins: list) -> None:
    """Keep the bins that hold the two order statistics around the rank."""
    seen, kept, start = b.below, [], b.below
    for r in bins:
        if seen <= math.ceil(b.rank) and seen + r.n > math.floor(b.rank):
            if not kept:
                start = seen
            kept.append(r)
        seen += r.n
    b.below, b.low, b.high = start, kept[0].low, kept[-1].high
    b.distinct_values = sum(r.distinct_values for r in kept)


def _inside(freq: DataFrame, brackets: list[_Bracket], edges=None) -> DataFrame:
    """Frequencies within the intervals. The broadcast side has one row per interval."""
    rows = [(b.column_id, b.part, b.low, b.high, b.below, b.rank,
             (edges or {}).get((b.column_id, b.part))) for b in brackets]
    table = freq.sparkSession.createDataFrame(
        rows, "column_id int, part int, low double, high double, below bigint, "
              "rank double, edges array<double>")
    return freq.join(F.broadcast(table), "column_id").where("value BETWEEN low AND high")


def _bin(first: int, last: int):
    """Number of edges below the value, by halving."""
    if first == last:
        return F.lit(first)
    mid = (first + last) // 2
    return F.when(F.col("value") <= F.col("edges")[mid], _bin(first, mid)).otherwise(
        _bin(mid + 1, last))


def _finish(freq: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    running = Window.partitionBy("column_id", "part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = _inside(freq, brackets).select(
        "column_id", "part", "value", "rank",
        (F.sum("n").over(running) + F.col("below")).alias("upto"))
    rows = ranked.groupBy("column_id", "part").agg(
        F.expr("min(CASE WHEN upto > floor(rank) THEN value END)").alias("low"),
        F.expr("min(CASE WHEN upto > ceil(rank) THEN value END)").alias("high"),
        F.expr("max(rank - floor(rank))").alias("share")).collect()
    return {(r.column_id, r.part): r.low + (r.high - r.low) * r.share for r in rows}
