"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.blocks import UNIT, forest, pair_mask, work_units
from cvengine.llm.common import map_texts, numbered, stage, table
from cvengine.llm.components import connected_components

#: Rows of a bucket that are compared with each other at once.
BLOCK_ROWS = 2048
#: Shingles whose bits are counted at once.
BIT_CHUNK = 1 << 16
SEED = 42


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of its shingles' hashes have it.

    Words are runs without ASCII white space, A-Z in lower case; fewer words than a shingle make one shingle,
    none give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, count, BIT_CHUNK):
        stop = min(count, start + BIT_CHUNK)
        hashes = [digest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(start, stop)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32 if len(hashes) > 65_535 else np.uint16)
    packed = np.packbits(ones * 2 > count, bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fingerprint long) per row of ``documents``; the fingerprint is the unsigned value's two's complement."""
    def make():
        def work(texts: list) -> list[pa.Array]:
            values = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64)
            return [pa.array(values.view(np.int64))]

        return work

    return map_texts(documents.select("doc_id", "text"), "text", make, "fingerprint long")


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` of them set, the empty one first."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _segments(fingerprint_column: str) -> list[Column]:
    value = F.col(fingerprint_column)
    return [value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)]


def fingerprint_links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at ``max_distance`` bits or fewer.

    Of two such fingerprints, one 32-bit half differs in at most half of the bits. Both enumerate the small
    Hamming ball of half that radius around each of their halves, so their tables meet in a bucket. In a
    bucket complete distances are verified block by block, and what leaves it is a spanning forest of its
    links, never all pairs. Buckets where all fingerprints share one half other than the bucket's centre
    are skipped, since the bucket of that half itself compares them.
    """
    radius = -(-(max_distance // 2) // 2)
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(32, radius)]))
    tables = [
        distinct.select(F.lit(t).alias("t"), half.alias("half"), "fingerprint", masks.alias("mask"))
        for t, half in enumerate(_segments("fingerprint"))
    ]
    entries = tables[0].unionAll(tables[1]).select(
        (F.col("half").bitwiseXOR(F.col("mask")) * 2 + F.col("t")).alias("bucket"), "fingerprint", (F.col("mask") == 0).alias("centre"), "half"
    )
    sizes = (
        entries.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.min("half").alias("low"), F.max("half").alias("high"), F.max("centre").alias("centre"))
        .where("size > 1 and (low <> high or centre)")
        .select("bucket", "size")
    )
    sizes = stage(sizes, "bucket-sizes")
    members = entries.select("bucket", "fingerprint").join(sizes, "bucket")
    units = work_units(members, ["bucket"], "fingerprint", "size", BLOCK_ROWS, units=_units(sizes))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "fingerprint"], ignore_index=True)
        value = rows["fingerprint"].to_numpy(np.int64)
        own = rows["__own"].to_numpy()
        left, right = int(rows["__left"].iat[0]), int(rows["__right"].iat[0])
        buckets = rows["bucket"].to_numpy()
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        out = []
        for a, b in zip(starts, np.r_[starts[1:], value.size]):
            roots = _bucket_forest(value[a:b].view(np.uint64), own[a:b], left, right, max_distance)
            found = np.flatnonzero(roots != np.arange(b - a))
            out.append(np.stack([value[a:b][found], value[a:b][roots[found]]]))
        pairs = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]}).drop_duplicates()

    return units.groupBy(*UNIT).applyInPandas(link, "a long, b long")


def _units(sizes: DataFrame) -> int:
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return max(1, total // 20_000)


def _bucket_forest(value: np.ndarray, own: np.ndarray, left: int, right: int, max_distance: int) -> np.ndarray:
    """Roots within a bucket; it is compared in strips, so memory stays at a strip of one block."""
    n, strip = value.size, 1024
    links = []
    for start in range(0, n, strip):
        rows, columns = slice(start, min(n, start + strip)), slice(start, n)
        near = np.bitwise_count(value[rows, None] ^ value[None, columns]) <= max_distance
        at, to = np.nonzero(near & pair_mask(left, right, own, rows, columns))
        at, to = at + start, to + start
        roots = forest(n, at, to)  # keeps a strip's links to a tree at most
        kept = np.flatnonzero(roots != np.arange(n))
        links.append(np.stack([kept, roots[kept]]))
    both = np.concatenate(links, axis=1)
    return forest(n, both[0], both[1])


def near_duplicates(documents: DataFrame, shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``documents`` (doc_id, text; other columns are ignored).

    ``fingerprint`` is 16 lower-case hexadecimal digits; ``component_id`` is the smallest doc_id reachable over
    links of ``max_distance`` bits or fewer. Equal fingerprints are one class, so copies are never paired.
    NULL and empty texts have fingerprint zero and are linked like any other. A NULL doc_id is never the
    smallest while another exists; a component of NULL ids alone has a NULL id. Repeated rows come back as often
    as they occur; an empty table gives an empty result.
    """
    prints = stage(fingerprints(documents, shingle_words), "fingerprints")
    classes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    parts = connected_components(fingerprint_links(classes.select("fingerprint"), max_distance))
    placed = classes.join(parts, classes.fingerprint == parts.node).select("fingerprint", "component", "first")
    lowest = placed.groupBy("component").agg(F.min("first").alias("lowest"))
    moved = stage(placed.join(lowest, "component").select(F.col("fingerprint").alias("node"), "lowest"), "moved")
    named = classes.join(moved, classes.fingerprint == moved.node, "left").select(
        F.col("fingerprint").alias("node"), F.coalesce("lowest", "first").alias("component_id")
    )
    named = stage(named, "fingerprint-components")
    return prints.join(named, prints.fingerprint == named.node).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(documents: DataFrame, shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """``documents`` with one row of each group of near duplicates: that of the smallest doc_id.

    NULL ids come last; of rows that repeat a doc_id the first in the staged copy counts as smaller.
    """
    rows = numbered(documents)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    found = near_duplicates(rows.select(place.alias("doc_id"), "text"), shingle_words, max_distance)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("__kept"))
    return rows.join(kept, rows["__row"] == kept["__kept"]).select(*documents.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups at 4 bits or fewer, over shingles of 4 words."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_distance=4)
