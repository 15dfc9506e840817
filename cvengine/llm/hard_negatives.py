"""Hard negatives by threshold joins: inverted lists without the dimensions a norm bound covers, thresholds lowered until windows fill."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cvengine.llm.blocks import block_count
from cvengine.llm.common import stage, table

#: Rows of a block, and anchors of a part, at most; a block meets a part in one task.
BLOCK_ROWS = 16_384
#: Rows whose scores choose the first thresholds, those of least id hash.
SAMPLE_ROWS = 4096
#: Dimensions that are accumulated between two prunings, and anchors that are accumulated together.
CHUNK = 16
STRIP = 256
#: Below this share of open pairs these are finished one by one.
SPARSE = 0.05
#: No bound below or above.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ANCHOR, _FOUND = ["row", "label", "v", "width"], "window long, vec_id long, score long"


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products, row by row, of whole numbers held in doubles."""
    bound = np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1))
    if not bound.size or bound.max() < 1 << 53:  # every partial sum is exact
        return (left * right).sum(axis=1).astype(np.int64)
    products = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(left, right)]
    return np.array(products, dtype=np.int64)


def threshold_join(anchors: np.ndarray, floors: np.ndarray, rows: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with a score of ``floors[anchor]`` or more that ``allowed(anchors)`` admits.

    After Anastasiu & Karypis, "L2AP" (2014). Dimensions are ordered by weight. A row is in the inverted lists of its heavy
    dimensions only: the light ones before them are left out as long as the product of their norm with that of any anchor's stays
    below the anchor's threshold. Lists are accumulated from the heaviest dimension down; after each few, pairs end whose partial
    score and the product of the norms of what is left stay below the threshold. Survivors are computed in full.
    """
    order = np.argsort((anchors * anchors).sum(axis=0) * (rows * rows).sum(axis=0), kind="stable")
    anchors, rows = anchors[:, order], rows[:, order]
    width = order.size
    anchor_norms = np.hstack([np.zeros((len(anchors), 1)), np.sqrt(np.cumsum(anchors * anchors, axis=1))])
    row_norms = np.hstack([np.zeros((len(rows), 1)), np.sqrt(np.cumsum(rows * rows, axis=1))])
    floor = floors.astype(np.float64)
    if len(floor) and floor.min() > 0:
        reach = (anchor_norms / floor[:, None]).max(axis=0)
        left_out = ((row_norms * reach * (1 + 1e-9)) < 1).sum(axis=1) - 1
    else:
        left_out = np.zeros(len(rows), np.int64)
    left_out = np.clip(left_out, 0, width)
    by_length = np.argsort(left_out, kind="stable")
    rows, row_norms, left_out = rows[by_length], row_norms[by_length], left_out[by_length]
    lists = np.where(np.arange(width) < left_out[:, None], 0.0, rows)
    out = []
    for start in range(0, len(anchors), STRIP):
        strip = slice(start, start + STRIP)
        part = np.zeros((len(anchors[strip]), len(rows)))
        admitted = allowed(strip, by_length)
        slack = 1e-9 * anchor_norms[strip, -1:] * row_norms[None, :, -1] + 0.5
        for low in range((width - 1) // CHUNK * CHUNK, -1, -CHUNK):
            listed = int(np.searchsorted(left_out, min(width, low + CHUNK), "left"))
            part[:, :listed] += anchors[strip, low : low + CHUNK] @ lists[:listed, low : low + CHUNK].T
            rest = np.maximum(low, left_out)
            bound = part + anchor_norms[strip][:, rest] * row_norms[np.arange(len(rows)), rest] + slack
            open_ = (bound >= floor[strip, None]) & admitted
            if open_.mean() < SPARSE:
                break
        at, to = np.nonzero(open_)
        for some in np.array_split(np.arange(at.size), max(1, at.size * width // (1 << 22))):
            scores = exact_scores(anchors[strip][at[some]], rows[to[some]])
            enough = scores >= floors[strip][at[some]]
            out.append((at[some][enough] + start, by_length[to[some]][enough], scores[enough]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _filled(same: bool, top: int, scale: int):
    """Per window the first ``top`` rows of a block, by score and smaller id, between its bounds."""

    def numbers(vectors: pd.Series) -> np.ndarray:
        return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale)

    def fill(windows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"window": [], "vec_id": [], "score": []})
        if not len(windows) or not len(rows) or not rows["width"].iat[0]:
            return nothing
        windows = windows.sort_values(["row", "window"], ignore_index=True)
        names, first, of = np.unique(windows["row"].to_numpy(np.int64), return_index=True, return_inverse=True)
        anchors = windows.iloc[first]
        labels, own = anchors["label"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        ids, numbers_ = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
        floors = windows["floor"].to_numpy(np.int64)
        lowest = np.full(names.size, HIGHEST)
        np.minimum.at(lowest, of, floors)

        def allowed(strip: slice, order: np.ndarray) -> np.ndarray:
            alike = labels[strip, None] == own[order][None, :]
            return (alike & (names[strip, None] != numbers_[order][None, :])) if same else ~alike

        at, to, scores = threshold_join(numbers(anchors["v"]), lowest, numbers(rows["v"]), allowed)
        order = np.lexsort((numbers_[to], ids[to], -scores, at))
        at, to, scores = at[order], to[order], scores[order]
        edges = np.searchsorted(at, np.arange(names.size + 1))
        out = []
        for window, anchor, upper, floor in zip(windows["window"], of, windows["upper"], floors):
            mine = slice(edges[anchor], edges[anchor + 1])
            begin = int(np.searchsorted(-scores[mine], -upper, "left"))
            taken = slice(edges[anchor] + begin, min(edges[anchor + 1], edges[anchor] + begin + top))
            good = scores[taken] >= floor
            out.append((np.full(good.sum(), window), ids[to[taken]][good], scores[taken][good]))
        if not out:
            return nothing
        return pd.DataFrame(dict(zip(["window", "vec_id", "score"], map(np.concatenate, zip(*out)))))

    return fill


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each window; partial results are cut before they are shuffled."""
    order = Window.partitionBy("window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _join(windows: DataFrame, rows: DataFrame, sizes: DataFrame, same: bool, top: int, scale: int) -> DataFrame:
    """Every window with every block of rows of its width; ``sizes`` has the number of blocks and of window parts per width."""
    dealt = rows.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "row"), "blocks").cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = windows.join(sizes, "width").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "row"), "parts").cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["width", "part", "block"]
    left = asked.select(*unit, "window", "row", "label", "v", "upper", "floor")
    right = dealt.select(*unit, "row", "vec_id", "label", "v")
    met = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(_filled(same, top, scale), _FOUND)
    return stage(_best(met, top).select("window", "vec_id", "score", "rank"), "windows")


def fill_windows(windows: DataFrame, rows: DataFrame, sizes: DataFrame, n_rows: int, same: bool, top: int, scale: int) -> DataFrame:
    """(window, vec_id, score, rank): the first ``top`` rows of the anchor's label (``same``), or of others, in each window.

    A window lies between ``limit`` and ``upper``. Scores with a bounded sample of rows choose a first threshold that about twice as
    many rows pass as are needed. Windows that it does not fill get the lower one that ``top`` sampled rows pass, and at last
    ``limit``; each round compares the open windows with all rows.
    """
    sample = stage(rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE_ROWS), "sampled")
    seen = min(n_rows, SAMPLE_ROWS)
    near = min(top, math.ceil(top * seen / max(1, n_rows)) + 1)
    one = sizes.withColumn("blocks", F.lit(1))
    tried = _join(windows.withColumn("floor", F.col("limit")), sample, one, same, top, scale)
    marks = tried.groupBy("window").agg(
        F.max(F.when(F.col("rank") == near, F.col("score"))).alias("near"), F.max(F.when(F.col("rank") == top, F.col("score"))).alias("all")
    )
    open_ = stage(windows.join(marks, "window", "left"), "open")
    done = []
    for threshold in (F.coalesce("near", "all", "limit"), F.coalesce("all", "limit"), F.col("limit")):
        asked = open_.withColumn("floor", F.greatest(threshold, F.col("limit")))
        found = _join(asked, rows, sizes, same, top, scale)
        counts = found.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
        state = asked.join(counts, "window", "left").withColumn("filled", (F.coalesce("n", F.lit(0)) >= top) | (F.col("floor") <= F.col("limit")))
        state = stage(state, "open")
        done.append(found.join(state.where("filled").select("window"), "window"))
        open_ = state.where("not filled").drop("n", "filled", "floor")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionAll, done)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Components become floor(scale * x), x as double; scores are their inner products, exact whole numbers. Higher scores come
    first, ties by smaller id. Positives are an anchor's first ``positives`` other rows of its label; negatives the first ``negatives``
    rows of other labels with 80 % to 100 % of the positive's score, so there are none for a negative one.

    Rows without id or label, NULL vectors and those with NULL or non-finite components take no part. Vectors are only
    compared with those of their length; empty ones score nothing. Each of several rows of one id is a row, and an anchor, of its own.
    Scores that pass 64 bits are an error. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    named = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    part = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = stage(part.withColumns({"row": F.monotonically_increasing_id(), "width": F.size("v")}), "vectors")
    n = rows.count()
    counted = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("asking"))
    blocks, parts = block_count(spark, F.col("n"), BLOCK_ROWS), F.ceil(F.col("asking") / F.lit(BLOCK_ROWS)).cast("int")
    sizes = stage(counted.where("asking > 0").select("width", blocks.alias("blocks"), parts.alias("parts")), "sizes")

    anchors = rows.where("anchor").select(*_ANCHOR, F.col("vec_id").alias("anchor_id"))
    asked = anchors.select(F.col("row").alias("window"), *_ANCHOR, F.lit(HIGHEST).alias("upper"), F.lit(LOWEST).alias("limit"))
    near = fill_windows(asked, rows, sizes, n, True, positives, scale)
    near = stage(near.select(F.col("window").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")

    # windows of equal bounds are one
    bounds = near.where("positive_score >= 0").select("row", F.col("positive_score").alias("upper")).distinct()
    bounds = stage(bounds.withColumn("window", F.monotonically_increasing_id()), "bounds")
    limit = F.expr("upper - (upper div 5)").alias("limit")
    windows = bounds.join(anchors, "row").select("window", *_ANCHOR, "upper", limit)
    found = fill_windows(windows, rows, sizes, n, False, negatives, scale)
    negative = found.join(bounds, "window").select(
        "row", F.col("upper").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    joined = near.join(negative, ["row", "positive_score"]).join(anchors.select("row", "anchor_id"), "row")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label moves on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


CHECK_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS nr
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.nr AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.nr <> b.nr WHERE a.vec_id % 100 = 0 AND len(a.e) = len(b.e) AND len(a.e) > 0
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE alike
    QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
