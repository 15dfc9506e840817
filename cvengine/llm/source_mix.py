"""Sources brought to target weights by Poisson replication and a global shuffle. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.common import stage, table

#: A rate above this is split into equal parts that are drawn one by one; their sum has the same distribution.
PART_RATE = 16.0
#: Terms of the distribution that are summed up; above PART_RATE + 16 standard deviations nothing is left in a double.
TERMS = 80
#: Up to this many sources the table of rates is broadcast (each row has TERMS doubles: 13 MB at most).
BROADCAST_SOURCES = 20_000


def tempered_weights(counts: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): the weight of a source of n documents is n to the power ``exponent``."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("weight"))


def _uniform(seed: int, *key: Column) -> Column:
    """A number inside (0, 1), the same on every run: the first 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _cumulated(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, ... TERMS - 1."""
    term = F.exp(-rate)
    start = F.struct(term.alias("term"), F.array(term).alias("sums"))

    def extend(state: Column, j: Column) -> Column:
        nxt = state["term"] * rate / j
        return F.struct(nxt.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + nxt)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, extend, lambda state: state["sums"])


def replicate(documents: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 17, marks: bool = False) -> DataFrame:
    """``documents`` repeated so that sources have the given shares, in a global random order.

    ``weights`` has (source, weight); sources that it lacks, or to which it gives NULL or no positive weight, are left out.
    Without it, weights grow with the square root of a source's size. A source of share s (its weight over
    the sum of those of sources that occur) and n documents repeats each of them on average ``total`` * s / n times, ``total``
    being the number of documents unless given. How often a document occurs is the inverse Poisson distribution
    at a hash of its doc_id and ``seed`` (of its text, where doc_id is NULL); rows of one doc_id draw alike. Rates above
    PART_RATE are drawn in parts, so no distribution underflows and no row is exploded by a large count at once.
    NULL is a source of its own. An empty table gives an empty result. Copies are dealt to partitions and ordered in them by a
    hash of id and copy, which no source or document can make uneven. ``marks`` adds part, copy and the hash, ``shuffle_key``, in
    place of columns of those names; all other columns pass through. Several weights of a source add up.
    """
    counts = stage(documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source-counts")
    weights = tempered_weights(counts) if weights is None else weights
    weights = weights.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col("weight").cast("double")).alias("__weight")).where("__weight > 0")
    known = stage(counts.join(weights, F.col("source").eqNullSafe(F.col("__source"))).select("__source", "n", "__weight"), "source-weights")
    sources, size, mass = known.agg(F.count(F.lit(1)), F.sum("n"), F.sum("__weight")).first()
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    rate = F.lit(float(total)) * (F.col("__weight") / F.lit(mass or 1.0)) / F.col("n")
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_RATE)).cast("int")
    rates = known.select("__source", parts.alias("__parts"), _cumulated(rate / parts).alias("__sums"))
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    drawn = (
        documents.join(rates, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__own", own)
        .withColumn("__part", F.explode(F.sequence(F.lit(1), F.col("__parts"))))
        .withColumn("__u", _uniform(seed, F.lit("count"), F.col("__own"), F.col("__part")))
        .withColumn("__count", F.size(F.filter("__sums", lambda s: s <= F.col("__u"))))
        .drop("__sums", "__parts", "__u", "__source")
        .where("__count > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
        .withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "__own", "__part", "__copy")))
    )
    names = [F.col(c) for c in documents.columns if not marks or c not in ("part", "copy", "shuffle_key")]
    if marks:
        names += [F.col("__part").alias("part"), F.col("__copy").alias("copy"), F.col("__key").alias("shuffle_key")]
    return drawn.repartition("__key").sortWithinPartitions("__key").select(*names)


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the mix of square-root weights, with the part and copy that each row is and its place in the order."""
    mixed = replicate(table(spark, sf_dir, "documents"), seed=17, marks=True)
    return mixed.select("doc_id", "source", "part", "copy", "shuffle_key", F.md5("text").alias("text_md5"))


#: The CTEs of the check SQL, also used by the pipeline's; ``{source}`` has doc_id, text and source.
CHECK_STEPS = """
mix_counts AS (SELECT source, count(*) AS n FROM {source} GROUP BY source),
mix_mass AS (SELECT sum(sqrt(n)) AS mass, sum(n) AS total FROM mix_counts),
mix_rates AS (
  SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts
  FROM (SELECT source, CAST(total AS DOUBLE) * (sqrt(n) / mass) / n AS rate FROM mix_counts, mix_mass)),
mix_terms AS (
  SELECT source, parts, j, sum(exp(j * ln(rate / parts) - rate / parts - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS upto
  FROM mix_rates, (SELECT unnest(range(0, 80)) AS j)),
mix_sums AS (SELECT source, any_value(parts) AS parts, list(upto ORDER BY j) AS sums FROM mix_terms GROUP BY source),
mix_parts AS (
  SELECT d.*, s.sums, unnest(range(1, s.parts + 1)) AS part, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) AS own
  FROM {source} d JOIN mix_sums s ON d.source IS NOT DISTINCT FROM s.source),
mix_drawn AS (
  SELECT *, (('0x' || substr(md5('17|count|' || own || '|' || part), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM mix_parts),
mix_counted AS (SELECT *, len(list_filter(sums, lambda s: s <= u)) AS drawn FROM mix_drawn),
mix_copies AS (SELECT *, unnest(range(1, drawn + 1)) AS copy FROM mix_counted WHERE drawn > 0)
"""

CHECK_SQL = f"""
WITH {CHECK_STEPS.format(source="documents")}
SELECT doc_id, source, CAST(part AS INT) AS part, CAST(copy AS INT) AS copy,
       md5('17|order|' || own || '|' || part || '|' || copy) AS shuffle_key, md5(text) AS text_md5
FROM mix_copies
"""
