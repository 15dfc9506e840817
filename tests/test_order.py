"""Ranks and order statistics against pandas, with cells small enough to force splitting."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cvengine.operators import order

CELLS = [1_000_000, 50, 7]


def sample(kind, n=600):
    rng = random.Random(kind)
    if kind == "spread":
        return [rng.uniform(-1e4, 1e4) for _ in range(n)]
    if kind == "third_equal":
        return [0.0 if rng.random() < 0.4 else float(rng.randint(-50, 50)) for _ in range(n)]
    if kind == "constant":
        return [4.5] * n
    return [None if rng.random() < 0.3 else float(rng.randint(1, 400)) for _ in range(n)]


KINDS = ["spread", "third_equal", "constant", "nulls"]


def frame(spark, values):
    rows = [(f"id{i:05d}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, v double").repartition(5)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cell_rows", CELLS)
def test_percent_rank(spark, kind, cell_rows):
    values = sample(kind)
    got = order.percent_rank(frame(spark, values), "v", "r", ["id"], cell_rows).orderBy("id").toPandas()["r"]
    want = pd.Series(values, dtype="float64").rank(pct=True) * 100
    pd.testing.assert_series_equal(got.astype("float64"), want, check_names=False)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cell_rows", CELLS)
def test_quantiles(spark, kind, cell_rows):
    values = sample(kind)
    fractions = [(0, 5), (1, 5), (2, 5), (1, 2), (95, 100), (999, 1000), (5, 5)]
    got = order.quantiles(frame(spark, values), "v", fractions, cell_rows=cell_rows)
    want = pd.Series(values, dtype="float64").quantile([k / q for k, q in fractions]).tolist()
    assert got == pytest.approx(want)


@pytest.mark.parametrize("cell_rows", CELLS)
def test_rows_at_with_long_ties(spark, cell_rows):
    values = sample("third_equal")
    df = frame(spark, values)
    expect = sorted((v, f"id{i:05d}") for i, v in enumerate(values))
    spots = [0, 1, 119, 300, 450, 599]
    got = order.rows_at(df, ["v", "id"], spots, len(values), cell_rows)
    assert got == {p: expect[p] for p in spots}
    assert df.where(order.not_after(["v", "id"], expect[300])).count() == 301


@pytest.mark.parametrize("cell_rows", CELLS)
def test_grouped_quantiles_with_one_large_group(spark, cell_rows):
    rng = random.Random(3)
    rows = [("big" if rng.random() < 0.5 else f"g{rng.randint(0, 40)}", float(rng.randint(0, 90))) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = order.grouped_quantiles(df, ["g"], "v", {"p25": (1, 4), "mid": (1, 2)}, cell_rows=cell_rows)
    got = got.orderBy("g").toPandas().set_index("g")
    want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].quantile([0.25, 0.5]).unstack()
    assert got["p25"].tolist() == pytest.approx(want[0.25].tolist())
    assert got["mid"].tolist() == pytest.approx(want[0.5].tolist())


def test_large_group_never_shares_one_window_cell(spark):
    df = frame(spark, [float(i % 3 == 0) * 7 + (i % 3 != 0) * i for i in range(900)])
    cuts = order.cut_points(df, "v", 900, 50)
    cells = order.with_bucket(df, "v", cuts, "b").where(F.col("b") % 2 == 1).groupBy("b").count()
    assert 7.0 in cuts
    assert cells.agg(F.max("count")).first()[0] <= 100


def test_empty_column(spark):
    df = spark.createDataFrame([("a", None)], "id string, v double")
    assert order.quantiles(df, "v", [(1, 2)]) == [None]
    assert order.percent_rank(df, "v", "r", ["id"]).first()["r"] is None


@pytest.mark.parametrize("cell_rows", [1_000_000, 60, 9])
def test_quantiles_of_many_columns(spark, cell_rows):
    columns = {kind: sample(kind) for kind in KINDS}
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"{k} double" for k in [*KINDS, "empty"])).repartition(6)
    fractions = [(0, 1), (1, 4), (1, 2), (999, 1000), (1, 1)]
    got = order.column_quantiles(df, [*KINDS, "empty"], fractions, cell_rows)
    for kind in KINDS:
        want = pd.Series(columns[kind], dtype="float64").quantile([k / q for k, q in fractions]).tolist()
        assert got[kind] == pytest.approx(want)
    assert got["empty"] == [None] * 5


@pytest.mark.parametrize("cell_rows", [500, 40, 6])
def test_selection_of_strings(spark, cell_rows):
    rng = random.Random(8)
    words = sorted(rng.choice(["a", "b", "ba", "zz"]) if rng.random() < 0.6 else f"w{rng.randint(0, 300)}" for _ in range(700))
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    found = order.select_at(df, {"w": [0, 5, 350, 699]}, {"w": 700}, cell_rows)["w"]
    assert found == {p: (words[p], words.index(words[p]), words.count(words[p])) for p in (0, 5, 350, 699)}


@pytest.mark.parametrize("cell_rows", [10_000, 60, 11])
def test_row_positions(spark, cell_rows):
    values = sample("third_equal")
    df = frame(spark, values).unionAll(spark.createDataFrame([("none", None), ("nothing", None)], "id string, v double"))
    placed = order.row_positions(df, ["v", "id"], len(values) + 2, cell_rows)
    want = sorted([(v is not None, v or 0, i) for v, i in [(None, "none"), (None, "nothing"), *((v, f"id{i:05d}") for i, v in enumerate(values))]])
    assert [r["id"] for r in placed.orderBy("position").collect()] == [w[2] for w in want]
    assert [r["position"] for r in placed.orderBy("position").collect()] == list(range(len(want)))


def test_selection_sorts_no_table(spark):
    """No range partitioning and no one-task sort of the data: only counts and the few rows between brackets."""
    df = frame(spark, sample("spread"))
    seen = []
    whole = order.Window.partitionBy
    try:
        order.Window.partitionBy = staticmethod(lambda *c: seen.append(c) or whole(*c))
        order.rows_at(df, ["v", "id"], [10, 500], 600, 50)
    finally:
        order.Window.partitionBy = whole
    assert set(seen) == {("gap",)}


def test_optimizer_derives_no_constraints_from_gaps(spark):
    """Of a filter that spanned 12 renamed columns the optimizer derived some 2^12 constraints in the driver."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(50).select(*[F.col("id").cast("double").alias(n) for n in names])
    gaps = [order._Gap(n, None, None, 0, 50, (24,)) for n in names]
    hits = order._in_gaps(df, gaps)
    assert hits._jdf.queryExecution().optimizedPlan().constraints().size() < 20
    assert hits.groupBy("gap").count().collect() and hits.count() == 12 * 50


def test_medians_of_as_many_columns_as_a_rollup_has(spark):
    """33 columns of more rows than a cell has: before, planning took gigabytes of the driver."""
    rng = random.Random(5)
    columns = {f"c{i}": [None if rng.random() < 0.1 else float(rng.randint(0, 10 ** (i % 7))) for _ in range(300)] for i in range(33)}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    got = order.column_quantiles(df, list(columns), [(1, 2)], cell_rows=100)
    assert {c: v[0] for c, v in got.items()} == {c: pytest.approx(pd.Series(v).median()) for c, v in columns.items()}


def test_driver_gets_the_ends_of_brackets_not_the_sample(spark):
    rng = random.Random(6)
    values = {0: [rng.randint(0, 400) / 4 for _ in range(900)], 1: [3.0] * 200, 2: [float(i) for i in range(7)], 4: [float(i) for i in range(40)]}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rng.shuffle(rows)
    positions = {0: (2, 450, 451, 899), 1: (100,), 2: (3, 5), 3: (9,), 4: (1020,)}
    gaps = [order._Gap("v", None, None, 1000 * (g == 4), 900 if g == 0 else 200, p) for g, p in positions.items()]
    got = order._brackets(spark.createDataFrame(rows, "gap int, v double").repartition(3), gaps)
    for g, gap in enumerate(gaps):
        sample, ends = sorted(values.get(g, [])), set()
        reach = int(2 * len(sample) ** 0.5)
        for p in gap.positions:
            at = (p - gap.before) * len(sample) // gap.rows
            ends |= {sample[i] for i in (at - reach, at + reach) if 0 <= i < len(sample)}
        assert got[g] == (sample if len(sample) < 8 else sorted(ends) or [sample[len(sample) // 2]])
    assert len(got[0]) <= 8 and got[1] == [3.0] and got[2] == values[2] and got[3] == [] and got[4]
