"""Exact ranks and order statistics without a single-task sort.

A window without a partition key, or ``percentile`` over a whole column, sends every row
to one task. Here the value range is cut into *buckets* at approximate quantiles:

* bucket ``2k`` holds the rows equal to cut ``k``. All of them share one rank, so the
  bucket needs no sort and may be spread over any number of tasks. A value that fills a
  third of the table always becomes a cut, hence such a bucket.
* bucket ``2k + 1`` holds the rows strictly between cut ``k`` and the next. It is small by
  the error bound of the approximate quantiles.

Bucket sizes (at most two per cut) go to the driver, whose running sum gives each bucket
its first rank. Approximation only decides where the cuts lie; results are exact.

Up to ``CELL_ROWS`` rows no cuts are made and one task sorts the column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine.session import stage

CELL_ROWS = 1_000_000
MAX_CUTS = 4096
SAMPLE_PER_CUT = 100
BROADCAST_KEYS = 100_000
#: Rows of each column that are sampled, on average, to bracket its positions; tasks sort them.
BRACKET_SAMPLE = 20_000

Fraction = tuple[int, int]


def cut_points(df: DataFrame, value: str, rows: int, cell_rows: int = CELL_ROWS) -> list[float]:
    """Ascending distinct values that split ``rows`` values into cells of about ``cell_rows``."""
    wanted = min(-(-rows // cell_rows) - 1, MAX_CUTS)
    if wanted < 1:
        return []
    return _sampled_cuts(df.select(F.col(value).alias("v")).where(F.col("v").isNotNull()), rows, wanted)


def _sampled_cuts(data: DataFrame, rows: int, wanted: int) -> list[float]:
    """Quantiles of a random sample of about SAMPLE_PER_CUT rows per cut: all that the driver sees of the column.

    No sketch of the whole column is merged in one task. The sample only decides where cuts lie, so ranks do not
    depend on it; a value in a third of the rows is a third of any sample and becomes a cut.
    """
    share = min(1.0, SAMPLE_PER_CUT * (wanted + 1) / max(rows, 1))
    sample = sorted(r["v"] for r in data.sample(False, share, 7).collect())
    return sorted({sample[len(sample) * i // (wanted + 1)] for i in range(1, wanted + 1)}) if sample else []


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Add the bucket number of ``value`` (NULL for NULL)."""
    if not cuts:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.lit(1)))
    splits = [float("-inf"), *cuts, float("inf")]
    raw = f"{out}__below"
    sliced = Bucketizer(splits=splits, inputCol=value, outputCol=raw, handleInvalid="keep").transform(df)
    below = F.col(raw).cast("int")
    at_cut = F.col(value) == F.get(F.array(*[F.lit(c) for c in cuts]), below - 1)
    return sliced.withColumn(out, 2 * below + F.when(at_cut, 0).otherwise(1)).drop(raw)


def average_rank(
    df: DataFrame, value: str, out: str, spread_by: Sequence[str], cell_rows: int = CELL_ROWS, rows: int | None = None
) -> DataFrame:
    """Add the 1-based rank of ``value``, ties sharing their mean rank; NULL stays NULL.

    ``value`` is a double column, ``spread_by`` names columns that tell tied rows apart.
    """
    if rows is None:
        rows = df.agg(F.count(value)).first()[0]
    missing = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    df = df.where(F.col(value).isNotNull())
    cuts = cut_points(df, value, rows, cell_rows)
    cut = with_bucket(df, value, cuts, "__bucket")
    bucket = F.col("__bucket")
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(len(cuts) + 1))
    cut = cut.withColumn("__lane", F.when(bucket % 2 == 0, spread).otherwise(F.lit(0)))
    by_value = Window.partitionBy("__bucket", "__lane").orderBy(value)
    ties = F.count(F.lit(1)).over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
    inner = F.rank().over(by_value) + (ties - 1) / 2
    if cuts:
        sizes = {r["__bucket"]: r["n"] for r in cut.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        size = [sizes.get(b, 0) for b in range(2 * len(cuts) + 2)]
        before = _running(size)
        start = F.get(F.array(*[F.lit(float(b)) for b in before]), bucket)
        tied = F.get(F.array(*[F.lit(float(s)) for s in size]), bucket)
        rank = F.when(bucket % 2 == 0, start + (tied + 1) / 2).otherwise(start + inner)
    else:
        rank = inner
    return cut.withColumn(out, rank.cast("double")).drop("__bucket", "__lane").unionByName(missing)


def _running(sizes: Sequence[int]) -> list[int]:
    total, before = 0, []
    for size in sizes:
        before.append(total)
        total += size
    return before


def percent_rank(
    df: DataFrame, value: str, out: str, spread_by: Sequence[str], cell_rows: int = CELL_ROWS, rows: int | None = None
) -> DataFrame:
    """Average rank as a percentage of the number of non-NULL values."""
    if rows is None:
        rows = df.agg(F.count(value)).first()[0]
    ranked = average_rank(df, value, "__rank", spread_by, cell_rows, rows)
    return ranked.withColumn(out, F.col("__rank") / F.lit(float(max(rows, 1))) * 100).drop("__rank")


class _Gap(NamedTuple):
    """An open interval of a column's values, the rows before it and in it, and the positions sought there."""

    column: str
    low: object
    high: object
    before: int
    rows: int
    positions: tuple[int, ...]

    def holds(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > F.lit(self.low))
        if self.high is not None:
            inside = inside & (value < F.lit(self.high))
        return inside


def select_at(
    df: DataFrame, wanted: dict[str, Sequence[int]], rows: dict[str, int], cell_rows: int = CELL_ROWS
) -> dict[str, dict[int, tuple]]:
    """Per column ``{position: (value, rows before it, rows equal to it)}`` for 0-based positions among the non-NULL values.

    Selection after Floyd and Rivest, for all columns at once and for any type that sorts (one type for all columns). A
    bounded sample brackets each position; one aggregate counts the rows below and at the ends of the brackets, which are
    exact new bounds whether or not they hold the position. Only when at most ``cell_rows`` rows are left between the bounds
    of a position are the values there counted.
    """
    found: dict[str, dict[int, tuple]] = {c: {} for c in wanted}
    gaps = [_Gap(c, None, None, 0, rows[c], tuple(sorted(set(p)))) for c, p in wanted.items() if rows[c] and len(p)]
    round_ = 0
    while gaps:
        small, large = [g for g in gaps if g.rows <= cell_rows], [g for g in gaps if g.rows > cell_rows]
        if small:
            _pick(df, small, found)
        gaps = _narrow(df, large, found, round_) if large else []
        round_ += 1
    return found


def values_at(
    df: DataFrame, value: str, positions: Sequence[int], rows: int, cell_rows: int = CELL_ROWS
) -> dict[int, float]:
    """The values at 0-based ``positions`` of the ascending order of the non-NULL values."""
    found = select_at(df.select(value), {value: positions}, {value: rows}, cell_rows)[value]
    return {p: v for p, (v, _, _) in found.items()}


def _in_gaps(df: DataFrame, gaps: Sequence[_Gap]) -> DataFrame:
    """(gap, v) for each value that lies in a gap of its column; a row without one explodes to nothing.

    No filter spans the columns: of one over n renamed columns the optimizer derives 2^n equal constraints in the driver.
    """
    marked = [F.when(g.holds(F.col(g.column)), F.struct(F.lit(i).alias("gap"), F.col(g.column).alias("v"))) for i, g in enumerate(gaps)]
    if len({g.column for g in gaps}) == 1:
        return df.select(F.coalesce(*marked).alias("hit")).where(F.col("hit").isNotNull()).select("hit.gap", "hit.v")
    hits = F.filter(F.array(*marked), lambda hit: hit.isNotNull())
    return df.select(F.explode(hits).alias("hit")).select("hit.gap", "hit.v")


def _pick(df: DataFrame, gaps: Sequence[_Gap], found: dict[str, dict[int, tuple]]) -> None:
    counted = _in_gaps(df, gaps).groupBy("gap", "v").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy("gap").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("end", end)
    begin = F.col("end") - F.col("n")
    sought = [(i, p, p - g.before) for i, g in enumerate(gaps) for p in g.positions]
    hits = [(F.col("gap") == i) & (begin <= here) & (F.col("end") > here) for i, _, here in sought]
    for r in counted.where(reduce(lambda a, b: a | b, hits)).collect():
        for i, p, here in sought:
            if r["gap"] == i and r["end"] - r["n"] <= here < r["end"]:
                found[gaps[i].column][p] = (r["v"], gaps[i].before + r["end"] - r["n"], r["n"])


def _brackets(sampled: DataFrame, gaps: Sequence[_Gap]) -> list[list]:
    """Per gap, ends of intervals around the places that its positions should have in the sorted sample of it.

    The samples grow with the number of columns, so tasks sort them, one for each gap; the driver gets the ends.
    """
    here = F.get(F.array(*[F.array(*[F.lit(p - g.before).cast("bigint") for p in g.positions]) for g in gaps]), F.col("gap"))
    rows = F.get(F.array(*[F.lit(g.rows).cast("bigint") for g in gaps]), F.col("gap"))
    sample, n = F.col("sample"), F.size("sample")
    reach = F.floor(2 * F.sqrt(n))
    places = F.flatten(F.transform(here, lambda p: F.array(F.floor(p * n / rows) - reach, F.floor(p * n / rows) + reach)))
    inside = F.filter(places, lambda i: (i >= 0) & (i < n))
    inside = F.when(F.size(inside) > 0, inside).otherwise(F.array(F.floor(n / 2)))
    ends = F.when(n < 8, sample).otherwise(F.transform(inside, lambda i: F.get(sample, i.cast("int"))))
    found: list[list] = [[] for _ in gaps]
    for r in sampled.groupBy("gap").agg(F.sort_array(F.collect_list("v")).alias("sample")).select("gap", ends.alias("ends")).collect():
        found[r["gap"]] = sorted(set(r["ends"]))
    return found


def _narrow(df: DataFrame, gaps: Sequence[_Gap], found: dict[str, dict[int, tuple]], seed: int) -> list[_Gap]:
    share = min(1.0, BRACKET_SAMPLE * len(gaps) / sum(g.rows for g in gaps))
    ends = _brackets(_in_gaps(df, gaps).sample(False, share, 7 + seed), gaps)
    counts = []
    for i, (g, cuts) in enumerate(zip(gaps, ends)):
        value, inside = F.col(g.column), g.holds(F.col(g.column))
        for k, cut in enumerate(cuts):
            counts += [F.count_if(inside & (value < F.lit(cut))).alias(f"below_{i}_{k}"), F.count_if(inside & (value <= F.lit(cut))).alias(f"upto_{i}_{k}")]
    counted = df.agg(*counts).first() if counts else None
    narrower = []
    for i, (g, cuts) in enumerate(zip(gaps, ends)):
        low, start = g.low, g.before
        for k, cut in enumerate([*cuts, None]):
            below = g.before + (g.rows if cut is None else counted[f"below_{i}_{k}"])
            upto = below if cut is None else g.before + counted[f"upto_{i}_{k}"]
            between = tuple(p for p in g.positions if start <= p < below)
            if between:
                narrower.append(_Gap(g.column, low, g.high if cut is None else cut, start, below - start, between))
            found[g.column].update({p: (cut, below, upto - below) for p in g.positions if below <= p < upto})
            low, start = cut, upto
    return narrower


def quantiles(
    df: DataFrame, value: str, fractions: Sequence[Fraction], rows: int | None = None, cell_rows: int = CELL_ROWS
) -> list[float | None]:
    """Exact linearly interpolated quantiles of a whole column.

    A fraction is a pair ``(k, q)`` for k/q. Positions are computed in integers, so a
    quantile that is a data point is that data point to the last bit.
    """
    if rows is None:
        rows = df.agg(F.count(value)).first()[0]
    if not rows:
        return [None] * len(fractions)
    spots = [divmod(k * (rows - 1), q) for k, q in fractions]
    wanted = [p for p, _ in spots] + [p + 1 for p, rest in spots if rest]
    at = values_at(df, value, wanted, rows, cell_rows)
    return [
        at[p] + (at[p + 1] - at[p]) * (rest / q) if rest else at[p] for (p, rest), (_, q) in zip(spots, fractions)
    ]


def column_quantiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[Fraction], cell_rows: int = CELL_ROWS
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several numeric columns, all of them in the same passes.

    A first pass counts the values of each column. Up to ``cell_rows`` rows one aggregate takes all quantiles; beyond
    that ``select_at`` narrows all positions together, so no pass turns rows into one row per column.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    names = doubles.columns
    counts = doubles.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    if max(counts.values(), default=0) <= cell_rows:
        shares = [F.percentile(n, [k / q for k, q in fractions]).alias(n) for n in names]
        found = doubles.agg(*shares).first()
        return {c: list(found[n]) if found[n] is not None else [None] * len(fractions) for c, n in zip(columns, names)}
    spots = {n: [divmod(k * (counts[n] - 1), q) for k, q in fractions] if counts[n] else [] for n in names}
    wanted = {n: [p for p, _ in s] + [p + 1 for p, rest in s if rest] for n, s in spots.items()}
    at = select_at(doubles, wanted, counts, cell_rows)
    result = {}
    for c, n in zip(columns, names):
        value = {p: v for p, (v, _, _) in at[n].items()}
        between = [value[p] + (value[p + 1] - value[p]) * (rest / q) if rest else value[p] for (p, rest), (_, q) in zip(spots[n], fractions)]
        result[c] = between or [None] * len(fractions)
    return result


def row_positions(df: DataFrame, keys: Sequence[str], rows: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``keys``, which identify rows, with ``position``: 0-based in the order by ``keys``; NULLs come first.

    Rows are divided at cut points of the first key, and rows tied at a cut, if they are many, at cut points of the second. Each
    part is sorted on its own and offset by the rows of the parts before it, of which there are at most a few per cut.
    """
    slim = df.select(*keys)
    if rows <= cell_rows:
        order = Window.partitionBy(F.lit(0)).orderBy(*keys)
        return slim.withColumn("position", F.row_number().over(order).cast("bigint") - 1)
    numeric = isinstance(slim.schema[keys[0]].dataType, T.NumericType)
    divided = with_bucket(slim, keys[0], cut_points(slim, keys[0], rows, cell_rows), "__bucket") if numeric else slim.withColumn("__bucket", F.lit(0))
    divided = divided.withColumn("__bucket", F.coalesce("__bucket", F.lit(-1)))
    sizes = _sizes(divided, "__bucket")
    tied = {b: n for (b,), n in sizes.items() if n > cell_rows and (b < 0 or b % 2 == 0)}  # -1 are NULLs
    inner = keys[1] if numeric and len(keys) > 1 else keys[0]
    cell = F.lit(0)
    if tied:
        share = min(1.0, SAMPLE_PER_CUT * sum(-(-n // cell_rows) for n in tied.values()) / sum(tied.values()))
        picked = divided.where(F.col("__bucket").isin(list(tied)) & F.col(inner).isNotNull()).select("__bucket", F.col(inner).alias("k")).sample(False, share, 7)
        samples: dict[int, list] = {}
        for r in picked.collect():
            samples.setdefault(r["__bucket"], []).append(r["k"])
        for bucket, sample in samples.items():
            sample.sort()
            parts = min(-(-tied[bucket] // cell_rows), MAX_CUTS)
            cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)})
            if cuts:
                within = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(inner)))
                cell = F.when(F.col("__bucket") == bucket, F.when(F.col(inner).isNotNull(), within).otherwise(0)).otherwise(cell)
    divided = divided.withColumn("__cell", cell)
    sizes = _sizes(divided, "__bucket", "__cell")
    cells: dict[int, int] = {}
    for b, c in sizes:
        cells[b] = max(cells.get(b, 0), c + 1)
    buckets = range(-1, max(cells, default=0) + 1)
    first_cell = _running([cells.get(b, 0) for b in buckets])
    before = _running([sizes.get((b, c), 0) for b in buckets for c in range(cells.get(b, 0))])
    at = F.get(F.array(*[F.lit(n) for n in first_cell]), F.col("__bucket") + 1) + F.col("__cell")
    start = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]), at)
    number = F.row_number().over(Window.partitionBy("__bucket", "__cell").orderBy(*keys))
    return divided.select(*keys, (start + number - 1).alias("position"))


def _sizes(df: DataFrame, *group: str) -> dict[tuple, int]:
    return {tuple(r[g] for g in group): r["n"] for r in df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()}


def rows_at(df: DataFrame, keys: Sequence[str], positions: Sequence[int], rows: int, cell_rows: int = CELL_ROWS):
    """The key tuples at 0-based ``positions`` of the order by ``keys``, which identify rows and are not NULL.

    Nothing is sorted as a whole: the first key's value at a position is selected, then the second's among the rows
    that share it, and so on.
    """
    if rows <= cell_rows:
        placed = row_positions(df, keys, rows, cell_rows).where(F.col("position").isin(list(positions)))
        return {r["position"]: tuple(r[k] for k in keys) for r in placed.collect()}
    groups = {(): (rows, {p: p for p in positions})}  # leading key values -> (rows, {position: position among them})
    for key in keys:
        deeper: dict[tuple, tuple[int, dict[int, int]]] = {}
        for prefix, (size, sought) in groups.items():
            same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, prefix)], F.lit(True))
            found = select_at(df.where(same).select(key), {key: list(sought.values())}, {key: size}, cell_rows)[key]
            for p, here in sought.items():
                value, begin, ties = found[here]
                deeper.setdefault((*prefix, value), (ties, {}))[1][p] = here - begin
        groups = deeper
    return {p: prefix for prefix, (_, sought) in groups.items() for p in sought}


def not_after(keys: Sequence[str], bound: Sequence) -> Column:
    """True where the key tuple sorts at or before ``bound``."""
    result = F.lit(True)
    for key, limit in reversed(list(zip(keys, bound))):
        result = (F.col(key) < F.lit(limit)) | ((F.col(key) == F.lit(limit)) & result)
    return result


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    fractions: dict[str, Fraction],
    sizes: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact quantiles per group, one output column per entry of ``fractions``.

    Where no group has more than ``cell_rows`` rows, the built-in ``percentile`` keeps the
    values of one group in memory. Rows of larger groups are counted per (group, value)
    and sorted per (group, value bucket), so that no task sorts more than a bucket.
    ``sizes`` (group columns and ``rows``) saves the pass that finds the large groups.
    """
    group = list(group)
    data = df.select(*group, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    if sizes is None:
        sizes = data.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > cell_rows).select(*group, "rows")
    found = large.agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")).first()
    if not found["groups"]:
        return _small_group_quantiles(data, group, fractions)

    names = [f"__{g}" for g in group]
    keys = stage(large.select(*[F.col(g).alias(n) for g, n in zip(group, names)]), "large-groups")
    if found["groups"] <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)])
    others = _small_group_quantiles(data.join(keys, same, "left_anti"), group, fractions)

    data = data.join(keys, same, "left_semi")
    cuts = cut_points(data, "__v", found["rows"], cell_rows)
    cells = with_bucket(data, "__v", cuts, "__bucket").groupBy(*group, "__bucket", "__v")
    cells = cells.agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group).orderBy("__bucket")
    parts = cells.groupBy(*group, "__bucket").agg(F.sum("__n").alias("__size"))
    parts = parts.select(
        *[F.col(g).alias(n) for g, n in zip(group, names)],
        F.col("__bucket").alias("__b"),
        (F.sum("__size").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__start"),
        F.sum("__size")
        .over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("__rows"),
    )
    if found["groups"] * (2 * len(cuts) + 1) <= BROADCAST_KEYS:
        parts = F.broadcast(parts)
    placed = cells.join(parts, same & (F.col("__bucket") == F.col("__b")))
    inner = Window.partitionBy(*group, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__end", F.col("__start") + F.sum("__n").over(inner))
    begin, end = F.col("__end") - F.col("__n"), F.col("__end")
    picks = []
    for name, (k, q) in fractions.items():
        scaled = F.lit(k).cast("bigint") * (F.col("__rows") - 1)
        rest = F.pmod(scaled, F.lit(q))
        low = ((scaled - rest) / q).cast("bigint")
        high = low + F.when(rest > 0, 1).otherwise(0)
        picks += [
            F.max(F.when((begin <= low) & (low < end), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when((begin <= high) & (high < end), F.col("__v"))).alias(f"__hi_{name}"),
            F.max(rest / q).alias(f"__rest_{name}"),
        ]
    picked = placed.groupBy(*group).agg(*picks)
    split = picked.select(
        *group,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__rest_{n}")).alias(n)
            for n in fractions
        ],
    )
    return others.unionByName(split)


def _small_group_quantiles(data: DataFrame, group: list[str], fractions: dict[str, Fraction]) -> DataFrame:
    """All fractions from one buffer of values per group."""
    shares = F.percentile("__v", [k / q for k, q in fractions.values()]).alias("__shares")
    found = data.groupBy(*group).agg(shares)
    return found.select(*group, *[F.get("__shares", F.lit(i)).alias(n) for i, n in enumerate(fractions)])


def grouped_medians(
    df: DataFrame, group: Sequence[str], columns: Sequence[str], cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Medians of several columns per group in one pass, as ``<column>_median``."""
    group = list(group)
    long = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        group, list(columns), "__measure", "__value"
    )
    medians = grouped_quantiles(long, [*group, "__measure"], "__value", {"median": (1, 2)}, cell_rows=cell_rows)
    return medians.groupBy(*group).agg(
        *[F.max(F.when(F.col("__measure") == c, F.col("median"))).alias(f"{c}_median") for c in columns]
    )
