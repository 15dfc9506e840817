"""Near duplicates among embeddings: balanced codes of learned rotations, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.blocks import UNIT, forest, pair_mask, work_units
from cvengine.llm.common import stage, table
from cvengine.llm.components import connected_components

#: The rotations are fitted on at most so many distinct vectors, those of least hash, and bytes of them; all vectors are indexed.
FIT_ROWS, FIT_BYTES = 20_000, 64 << 20
ROTATION_ROUNDS = 30
#: Pairs at the cosine threshold that are made up from the sample to choose the number of tables, and the share that these may miss.
PLANTED, MISS = 4000, 0.003
#: Vectors that share the value of a whole substring on average.
BUCKET_ROWS = 64
BLOCK_ROWS = 2048
#: Buckets of a unit up to this size are compared together, larger ones strip by strip.
SMALL_BUCKET = 256
UNIT_ROWS = 32_768
#: Up to so many distinct vectors of a length are compared without tables.
FEW_ROWS = 1000
MAX_TABLES = 96


def usable(column: str = "embedding") -> Column:
    """Whether a vector has a direction: not NULL, not empty, not zero, every component finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one, in doubles; scaled first, so that no square over- or underflows."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Iterative quantisation (Gong & Lazebnik 2011): (projection, thresholds) of ``bits`` balanced bits.

    Principal directions, rotated so that signs lose as little as possible: in turns the signs are fixed and the
    rotation solves the Procrustes problem. Signs are taken around the sample's mean.
    """
    mean = sample.mean(axis=0)
    moved = sample - mean
    _, directions = np.linalg.eigh(moved.T @ moved)
    directions = directions[:, ::-1][:, :bits]
    scores = moved @ directions
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(ROTATION_ROUNDS):
        left, _, right = np.linalg.svd(np.sign(scores @ rotation).T @ scores)
        rotation = (left @ right).T
    projection = directions @ rotation
    return projection, mean @ projection


@dataclass
class Tables:
    """Codes of a length of vectors: one word of bits per rotation, cut into substrings, each the key of a table.

    Two vectors meet in a table if at most one bit of its substring differs: they then share the substring without that bit. Pairs
    whose whole codes differ in more than ``reach`` bits are not compared.
    """

    rotations: list[tuple[np.ndarray, np.ndarray]]
    bits: int
    tables: int
    reach: int = 0

    @property
    def per_word(self) -> int:
        return min(len(self.rotations[0][1]), 64) // self.bits

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Per vector one word per rotation."""
        used = self.per_word * self.bits
        weights = np.uint64(1) << np.arange(used, dtype=np.uint64)
        words = [((units @ p[:, :used] > cuts[:used]) * weights).sum(axis=1, dtype=np.uint64) for p, cuts in self.rotations]
        return np.stack(words, axis=1)

    def substring(self, codes: np.ndarray, at: int) -> np.ndarray:
        word, place = divmod(at, self.per_word)
        return (codes[..., word] >> np.uint64(place * self.bits)) & np.uint64((1 << self.bits) - 1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Per vector, table and bit of its substring the substring without that bit."""
        others = ~(np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        return np.concatenate([self.substring(codes, t)[:, None] & others for t in range(self.tables)], axis=1).astype(np.int64)

    def first_meeting(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of pairs that share the keys ``at``, whether it is the first they share."""
        table, bit = np.divmod(at, self.bits)
        differ = a ^ b
        first = np.ones(len(a), bool)
        for t in range(self.tables):
            part = self.substring(differ, t)
            first &= np.where(t < table, np.bitwise_count(part) > 1, (t > table) | (bit == 0) | (part != 0))
        return first


def substring_bits(rows: int, dimension: int) -> int:
    """Bits of a substring: buckets stay small as rows grow."""
    return min(dimension, 24, max(4, round(math.log2(max(1, rows / BUCKET_ROWS)))))


def planted_pairs(sample: np.ndarray, min_cosine: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of the sample with partners at the threshold: in any direction, and in directions in which vectors of the sample differ."""
    draw = np.random.default_rng(seed)
    left = sample[draw.integers(len(sample), size=PLANTED)]
    apart = sample[draw.integers(len(sample), size=PLANTED)] - sample[draw.integers(len(sample), size=PLANTED)]
    pairs = []
    for away in (draw.standard_normal(left.shape), apart + 1e-6 * draw.standard_normal(left.shape)):
        away = away - (away * left).sum(axis=1, keepdims=True) * left
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        pairs.append((left, min_cosine * left + math.sqrt(1 - min_cosine**2) * away))
    return pairs


def learn_tables(sample: np.ndarray, rows: int, min_cosine: float, seed: int) -> Tables:
    """As many tables, from as many rotations, as find all but MISS of the planted pairs; reach includes all but as many."""
    bits = substring_bits(rows, sample.shape[1])
    found = Tables([], bits, 0)
    pairs = planted_pairs(sample, min_cosine, seed)
    missed = [np.ones(len(left), bool) for left, _ in pairs]
    while found.tables < MAX_TABLES and max(m.mean() for m in missed) > MISS:
        if not found.rotations or found.tables == len(found.rotations) * found.per_word:
            found.rotations.append(learn_rotation(sample, min(sample.shape[1], 64), seed + len(found.rotations)))
            codes = [[found.codes(side) for side in pair] for pair in pairs]
        for miss, (a, b) in zip(missed, codes):
            miss &= np.bitwise_count(found.substring(a ^ b, found.tables)) > 1
        found.tables += 1
    distances = [np.bitwise_count(a ^ b).sum(axis=1) for a, b in codes]
    found.reach = int(max(np.quantile(d, 1 - MISS / 10) for d in distances))
    return found


def _coded(classes: DataFrame, learned: dict[int, Tables]) -> DataFrame:
    """(class, width, codes, keys); a length without tables has one key, shared by all."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby("width"):
                tables = learned.get(int(width))
                if tables is None:
                    codes, keys = np.zeros((len(part), 1), np.int64), np.zeros((len(part), 1), np.int64)
                else:
                    codes = tables.codes(unit_rows(part["vector"]))
                    keys = tables.keys(codes)
                yield pd.DataFrame({"class": part["class"], "width": part["width"], "codes": list(codes.view(np.int64)), "keys": list(keys)})

    return classes.select("class", "width", "vector").mapInPandas(add, "class long, width int, codes array<long>, keys array<long>")


def _near_codes(rows: pd.DataFrame, learned: dict[int, Tables]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, as positions, that share a bucket, have near codes and share no earlier key; rows are sorted by bucket."""
    width, at, key, own = (rows[c].to_numpy() for c in ("width", "at", "key", "__own"))
    codes = _words(rows["codes"])
    left, right = int(rows["__left"].iat[0]), int(rows["__right"].iat[0])

    widths = np.unique(width)
    reach = np.full(len(rows), 64 * codes.shape[1])
    for w in widths:
        if int(w) in learned:
            reach[width == w] = learned[int(w)].reach

    def first(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w in widths:
            some, tables = slice(None) if widths.size == 1 else width[i] == w, learned.get(int(w))
            a, b = i[some], j[some]
            if tables is not None and a.size:
                met = tables.first_meeting(codes[a], codes[b], at[a])
                a, b = a[met], b[met]
            yield a, b

    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (width[1:] != width[:-1])])
    sizes = np.diff(np.r_[starts, len(rows)])
    whole = left == right == -1  # else a block, or two, of one hot bucket
    end = np.repeat(np.where((sizes <= SMALL_BUCKET) & whole, starts + sizes, starts), sizes)
    place = np.arange(len(rows))
    for step in range(1, int(min(SMALL_BUCKET, sizes.max())) if whole else 0):
        differ = np.bitwise_count(codes[:-step] ^ codes[step:]).sum(axis=1, dtype=np.int16) if codes.shape[1] > 1 else np.bitwise_count(codes[:-step, 0] ^ codes[step:, 0])
        i = np.flatnonzero((place[step:] < end[:-step]) & (differ <= reach[:-step]))
        yield from first(i, i + step)
    for a, size in zip(starts, sizes):
        if size > SMALL_BUCKET or (size > 1 and not whole):
            for start in range(0, size, 512):
                strip, rest = slice(start, min(size, start + 512)), slice(start, size)
                mine, others = codes[a : a + size][strip], codes[a : a + size][rest]
                differ = sum(np.bitwise_count(mine[:, None, w] ^ others[None, :, w]).astype(np.int16) for w in range(codes.shape[1]))
                i, j = np.nonzero(pair_mask(left, right, own[a : a + size], strip, rest) & (differ <= reach[a]))
                for some in np.array_split(np.arange(i.size), max(1, i.size >> 18)):
                    yield from first(a + start + i[some], a + start + j[some])


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["width", "at", "key", "class"], ignore_index=True)


def _meeting(learned: dict[int, Tables]):
    """Per unit the (width, at, key, class) of rows with a near code in that bucket."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows, hit = _sorted(rows), np.zeros(len(rows), bool)
        for i, j in _near_codes(rows, learned):
            hit[i] = hit[j] = True
        return rows.loc[hit, ["width", "at", "key", "class"]]

    return meet


def _words(codes: pd.Series) -> np.ndarray:
    """Codes as rows of words; those of other lengths may have fewer and are filled with zeros."""
    sizes, flat = codes.map(len).to_numpy(), np.concatenate(codes.to_numpy())
    words = np.zeros((sizes.size, sizes.max()), np.int64)
    words[np.arange(words.shape[1]) < sizes[:, None]] = flat
    return words.view(np.uint64)


def _compare(min_cosine: float, learned: dict[int, Tables]):
    """Per unit: for each vector with links found here its links, counted with copies, and a spanning forest."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        ids, copies = rows["class"].to_numpy(), rows["copies"].to_numpy(np.int64)
        vectors, longest = _padded(rows["vector"])
        links, roots = np.zeros(len(rows), np.int64), np.arange(len(rows))
        held, size = [], 0

        def join() -> None:
            nonlocal roots, held, size
            kept = np.flatnonzero(roots != np.arange(len(rows)))
            roots = forest(len(rows), np.concatenate([kept, *(i for i, _ in held)]), np.concatenate([roots[kept], *(j for _, j in held)]))
            held, size = [], 0

        for i, j in _near_codes(rows, learned):
            for some in np.array_split(np.arange(i.size), max(1, i.size * longest >> 22)):
                near = some[(vectors[i[some]] * vectors[j[some]]).sum(axis=1) >= min_cosine]
                np.add.at(links, i[near], copies[j[near]])
                np.add.at(links, j[near], copies[i[near]])
                held.append((i[near], j[near]))
                size += near.size
            if size > 1 << 18:
                join()
        join()
        found = np.flatnonzero(links)
        return pd.DataFrame({"a": ids[found], "b": ids[roots[found]], "links": links[found]})

    return compare


def _padded(vectors: pd.Series) -> tuple[np.ndarray, int]:
    """Vectors of length one as rows, shorter ones filled with zeros, and the width."""
    widths = vectors.map(len).to_numpy()
    rows = np.zeros((len(vectors), widths.max()))
    for width in np.unique(widths):
        rows[widths == width, :width] = unit_rows(vectors[widths == width])
    return rows, rows.shape[1]


def _worked(entries: DataFrame) -> DataFrame:
    """Entries of buckets that hold two or more, with their unit of work."""
    bucket = ["width", "at", "key"]
    sizes = stage(entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    held = sizes.agg(F.sum("size")).first()[0] or 0
    return work_units(entries.join(sizes, bucket), bucket, "class", "size", BLOCK_ROWS, max(1, held // UNIT_ROWS))


def near_duplicates(
    vectors: DataFrame, min_cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 5
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``; other columns are ignored.

    Linked are vectors of cosine ``min_cosine`` or more, in double precision; pairs that are reported are exact, and of those at
    the threshold about MISS are missed, of closer ones fewer. Equal vectors are one class with a count, so copies are never
    paired. Codes come from learned rotations (iterative quantisation, bits cut at the mean). Substrings of the codes are the keys of the
    tables, each probed with one bit of difference. How many tables that takes is tried on pairs at the threshold made up from sampled
    vectors, so it holds where vectors lie around a common direction, which widens the angle between centred vectors. Only classes and
    codes go through the tables; vectors are fetched for those entries that have a near code in their bucket. Hot buckets are
    compared in pairs of blocks, each pair counts in the first bucket that it shares, and what leaves a block is sums
    and a spanning forest.

    Vectors are compared with those of their length only; where these are at most FEW_ROWS, with all. NULL vectors, zero vectors and those
    with NULL or non-finite components link with nothing and are their own component. Rows of a repeated vec_id are vectors of
    their own; a NULL vec_id is smallest only where there is no other, and is never kept. An empty table gives an
    empty result.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    wide = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    part = wide.withColumn("ok", F.coalesce(usable("vector"), F.lit(False)))
    grouped = part.where("ok").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(grouped.withColumns({"class": F.monotonically_increasing_id(), "width": F.size("vector")}), "vector-classes")
    learned = {}
    for width, n in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_ROWS).collect():
        most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * width)))
        sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("vector")).limit(most).select("vector").toPandas()["vector"]
        learned[width] = learn_tables(unit_rows(sample), n, min_cosine, seed)

    coded = stage(_coded(classes, learned), "codes")
    entries = coded.select("class", "width", "codes", F.posexplode("keys").alias("at", "key"))
    bucket = "width int, at int, key long, class long"
    met = stage(_worked(entries).groupBy(*UNIT).applyInPandas(_meeting(learned), bucket).distinct(), "met")
    details = coded.select("class", "codes").join(classes.select("class", "copies", "vector"), "class")
    compared = _worked(met.join(details, "class"))
    found = stage(compared.groupBy(*UNIT).applyInPandas(_compare(min_cosine, learned), "a long, b long, links long"), "found")

    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b"))
    first = classes.select("class", "first", "copies")
    placed = first.join(parts, first["class"] == parts["node"]).select("class", "component", "first")
    lowest = stage(placed.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    lowest = placed.join(lowest, "component").select(F.col("class").alias("node"), "lowest")
    summary = (
        classes.join(links, classes["class"] == links["a"], "left")
        .join(lowest, classes["class"] == lowest["node"], "left")
        .select(
            F.col("vector").alias("__vector"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("lowest", "first").alias("component_id"),
        )
    )
    summary = stage(summary, "vector-summary")
    linked = part.where("ok").join(summary, F.col("vector") == F.col("__vector")).select("vec_id", "n_links", "component_id")
    alone = part.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings`` at a cosine of 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.95)
