"""Nearest neighbours by cosine from a forest of sorted hash strings with variable prefix lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cvengine.llm.blocks import block_count
from cvengine.llm.common import stage, table
from cvengine.llm.embedding_dedup import unit_rows, usable

TREES = 12
#: Bits of a hash string.
DEPTH = 40
#: Rows of a block at most, each with a string in every tree.
BLOCK_ROWS = 32_768
#: Up to so many vectors of a length are all compared with its queries.
FEW_ROWS = 1000
#: Share of a block among the candidates of a strip of queries from which all its products are computed at once.
DENSE = 0.05
#: Queries whose exact neighbours are computed to choose how far to ascend; those of least hash.
SAMPLE_QUERIES = 128
#: Share of the sample's true neighbours that must be among the candidates.
RECALL = 0.97
#: Queries that meet an array at once.
QUERY_ROWS = 8192
QUERY_STRIP = 128


def planes(dimension: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, TREES * DEPTH))


def hash_strings(units: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Per vector and tree the signs along DEPTH random planes, as a number whose leading bits are the string's prefix."""
    bits = (units @ normals > 0).reshape(len(units), TREES, DEPTH)
    return bits @ (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of hash strings: DEPTH less the bits up to the highest that differs."""
    return DEPTH - np.frexp((a ^ b).astype(np.float64))[1]


def _best(scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of candidates that may be among the ``top``, with room for the last digit of a product."""
    if scores.size > top:
        edge = np.partition(scores, scores.size - top)[scores.size - top] - 1e-9
        return np.flatnonzero(scores >= edge)
    return np.arange(scores.size)


def _wanted(rows: DataFrame, normals: np.ndarray, top: int) -> int:
    """How many candidates make an ascent stop, so that RECALL of the true neighbours of the sample queries are among them.

    Their exact neighbours and the number of candidates at each prefix length are computed in one pass over all rows, batch by
    batch; only ``top`` rows and DEPTH + 1 counts per batch and query leave a task, and these are merged before they are shuffled.
    """
    sample = rows.where("asks").orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE_QUERIES).select("row", "vector", "codes").toPandas()
    if sample.empty:
        return 0
    codes, units, own = np.stack(sample["codes"].to_numpy()), unit_rows(sample["vector"]), sample["row"].to_numpy()

    def probe(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors, strings, ids = unit_rows(batch["vector"]), np.stack(batch["codes"].to_numpy()), batch["row"].to_numpy()
            scores = units @ vectors.T
            for q in range(len(own)):
                scores[q, ids == own[q]] = -2
                shared = common_prefix(strings, codes[q])
                near = np.argsort(-scores[q], kind="stable")[:top]
                near = near[scores[q, near] > -2]
                levels = shared[near].max(axis=1).tolist()
                yield pd.DataFrame({"q": q, "score": [*scores[q, near], -3.0], "level": [*levels, 0], "counts": [*[None] * len(levels), np.bincount(shared.ravel(), minlength=DEPTH + 1)]})

    seen = stage(rows.mapInPandas(probe, "q int, score double, level int, counts array<long>"), "sample")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    near = seen.where("counts is null").withColumn("place", place).where(F.col("place") <= top).select("q", "level").toPandas()
    sums = [F.sum(F.get("counts", i)).alias(f"h{i}") for i in range(DEPTH + 1)]
    counts = seen.where("counts is not null").groupBy("q").agg(*sums).toPandas().set_index("q").sort_index()
    if near.empty:
        return 0
    reached = np.cumsum(counts.to_numpy()[:, ::-1], axis=1)[:, ::-1]  # candidates at each level or deeper
    needed = reached[counts.index.get_indexer(near["q"]), near["level"]]
    return max(int(np.quantile(needed, RECALL)), TREES * (top + 1))


def _spans(strings: np.ndarray, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of a sorted array whose strings share ``level`` leading bits with each query."""
    rest = DEPTH - level
    low = (asked >> rest) << rest
    return np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << rest))


def _apart(df: DataFrame) -> DataFrame:
    """The same rows as columns of their own, for meeting another frame of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _counts(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Per query the rows of a block that share each number of leading bits with it, added up over the trees."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query": [], "counts": []})
    strings, asked = np.sort(np.stack(rows["codes"].to_numpy()), axis=0), np.stack(queries["codes"].to_numpy())
    counts = np.zeros((len(asked), DEPTH + 1), np.int64)
    for tree in range(TREES):
        for level in range(DEPTH + 1):
            low, high = _spans(strings[:, tree], asked[:, tree], np.full(len(asked), level))
            counts[:, level] += high - low
    return pd.DataFrame({"query": queries["row"], "counts": list(counts)})


def _nearest(top: int):
    """Per query the ``top`` nearest of its candidates in a block: the rows that share its level of leading bits in some tree."""

    def nearest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "row": [], "vec_id": [], "score": []})
        codes, units = np.stack(rows["codes"].to_numpy()), unit_rows(rows["vector"])
        numbers, ids = rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
        asked, wanted, own = np.stack(queries["codes"].to_numpy()), unit_rows(queries["vector"]), queries["row"].to_numpy(np.int64)
        order = np.argsort(codes, axis=0, kind="stable")
        level = queries["level"].to_numpy(np.int64)
        spans = [_spans(codes[order[:, t], t], asked[:, t], level) for t in range(TREES)]
        out = []
        for start in range(0, len(queries), QUERY_STRIP):
            strip = range(start, min(len(queries), start + QUERY_STRIP))
            met = np.zeros((len(strip), len(rows)), bool)
            for tree, (low, high) in enumerate(spans):
                for q in strip:
                    met[q - start, order[low[q] : high[q], tree]] = True
            met &= own[strip.start : strip.stop, None] != numbers[None, :]
            dense = met.mean() > DENSE
            scores = wanted[strip.start : strip.stop] @ units.T if dense else None
            for q in strip:
                at = np.flatnonzero(met[q - start])
                mine = scores[q - start, at] if dense else units[at] @ wanted[q]
                chosen = at[_best(mine, top)]
                # summed in one fixed order, so that equal vectors score alike in every block
                exact = (units[chosen] * wanted[q]).sum(axis=1)
                first = np.lexsort((numbers[chosen], ids[chosen], -exact))[:top]
                out.append((np.full(first.size, own[q]), numbers[chosen][first], ids[chosen][first], exact[first]))
        return pd.DataFrame(dict(zip(["query", "row", "vec_id", "score"], map(np.concatenate, zip(*out)))))

    return nearest


def search(
    vectors: DataFrame,
    is_query,
    top: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = 9,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows by cosine of each row for which ``is_query`` holds.

    An LSH forest (Bawa, Condie & Ganesan 2005): each tree is a sorted array of long hash strings. A query descends in all trees to
    its longest matching prefixes, then ascends level by level in all of them at once until enough strings share its
    prefixes; these rows are compared in double precision. How many are enough is learned from exact neighbours of
    SAMPLE_QUERIES queries, so that RECALL of them are found. Rows are dealt by a hash to blocks, each of which holds all trees of its
    rows; a query's prefix counts of all blocks are added up to choose its level, and the blocks then return their nearest
    candidates. So a vector is sent once, whatever prefix is hot, and compared with a query once.

    Nearest first, ties to the smaller id; fewer rows if there are fewer candidates. Every row is a candidate of its own, also one
    that repeats an id, even the query's; a query that occurs twice is answered twice. NULL vectors, zero vectors, those with NULL or
    non-finite components take no part, nor do rows without id. Vectors are compared with those of their length only, and
    with all of them where these are at most FEW_ROWS. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    wide = F.col(vector_column).cast("array<double>")
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), wide.alias("vector"))
    source = source.where(F.col("vec_id").isNotNull() & usable("vector"))
    source = source.withColumns({"row": F.monotonically_increasing_id(), "width": F.size("vector")})

    def sign(batches):
        drawn = {}
        for batch in batches:
            if not len(batch):
                continue
            codes = np.empty(len(batch), object)
            for width, part in batch.groupby("width")["vector"]:
                if width not in drawn:
                    drawn[width] = planes(int(width), seed)
                at = batch.index.get_indexer(part.index)
                for i, code in zip(at, hash_strings(unit_rows(part), drawn[width])):
                    codes[i] = code
            yield batch.assign(codes=codes)

    found = stage(source.mapInPandas(sign, "vec_id long, asks boolean, vector array<double>, row long, width int, codes array<long>"), "hash-strings")
    counted = found.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).where("asking > 0")
    # the many lengths of few vectors need no forest
    large = counted.where(F.col("n") > FEW_ROWS).collect()
    wanted = F.lit(None).cast("long")
    for r in large:
        enough = _wanted(found.where(F.col("width") == r["width"]), planes(r["width"], seed), top)
        wanted = F.when(F.col("width") == r["width"], F.lit(enough or None).cast("long")).otherwise(wanted)
    blocks, parts = block_count(spark, F.col("n"), BLOCK_ROWS), F.ceil(F.col("asking") / F.lit(QUERY_ROWS)).cast("int")
    sizes = stage(counted.select("width", blocks.alias("blocks"), parts.alias("parts"), wanted.alias("wanted")), "widths")

    unit = ["width", "block", "part"]
    own = F.pmod(F.xxhash64(F.lit(3), "row"), "blocks").cast("int").alias("block")
    asked = F.pmod(F.xxhash64(F.lit(5), "row"), "parts").cast("int").alias("part")
    dealt = found.join(sizes, "width").select("*", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = found.where("asks").join(sizes, "width").select("*", asked, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    # only lengths with a forest ascend; in the others every row is a candidate
    left = queries.where("wanted is not null").select(*unit, "row", "codes")
    right = dealt.where("wanted is not null").select(*unit, "codes").groupBy(*unit)
    counts = _apart(left).groupBy(*unit).cogroup(right).applyInPandas(_counts, "query long, counts array<long>")
    summed = counts.groupBy("query").agg(*[F.sum(F.get("counts", i)).alias(f"c{i}") for i in range(DEPTH + 1)])
    enough = [F.when(F.col(f"c{i}") >= F.col("wanted"), F.lit(i)) for i in range(DEPTH, 0, -1)]
    asking = found.where("asks").join(sizes, "width").select(F.col("row").alias("query"), "wanted")
    levels = stage(asking.join(summed, "query").select("query", F.coalesce(*enough, F.lit(0)).alias("level")), "levels")

    placed = queries.join(levels, queries["row"] == levels["query"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    left = _apart(placed.select(*unit, "row", "level", "codes", "vector")).groupBy(*unit)
    right = dealt.select(*unit, "row", "vec_id", "codes", "vector").groupBy(*unit)
    met = left.cogroup(right).applyInPandas(_nearest(top), "query long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = found.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)
