"""Repeated runs of lines, found by prefix doubling over line numbers of a suffix array; later copies go.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cvengine.llm.common import numbered, stage, table

#: A word, for the length of a run: a run of bytes without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that has a word: its row and doc_id, position among such lines, line number, words, identity.

    The identity is two 64-bit hashes of the line, so equal identities mean equal lines for any corpus size.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    worded = rows.select("__row", "doc_id", F.posexplode(F.filter(lines, lambda s: s["words"] > 0)).alias("pos", "s"))
    return worded.select(
        "__row", "doc_id", "pos", F.col("s.line").alias("line"), F.col("s.words").alias("words"), F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(7), "s.x").alias("h2")
    )


def _ranked(classes: DataFrame, *order: str) -> DataFrame:
    """Classes in their order with increasing ranks. Only distinct repeated classes are sorted, never their members."""
    return stage(classes.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _place() -> Column:
    """Where a run starts; the least of several is the first copy. NULL ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col("__row").alias("row"), F.col("pos").alias("pos"))


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of at least ``min_words`` words that start or end at each repeated line: (…, pos, size).

    A run of repeated lines with that many words is the union of the shortest such runs inside it, so
    these decide what is deleted. A run never spans a line that occurs once: such lines part the islands.
    """
    at = Window.partitionBy("__row").orderBy("pos")
    island = active.withColumn("island", F.col("pos") - F.row_number().over(at))
    key = ["__row", "island"]
    upto = F.sum("words").over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    island = island.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("words"))
    behind = Window.partitionBy(*key).orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    ahead = Window.partitionBy(*key).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    whole = Window.partitionBy(*key)
    island = (
        island.withColumn("before", F.max("pos").over(behind))
        .withColumn("first", F.min("pos").over(whole))
        .withColumn("after", F.min("pos").over(ahead))
        .withColumn("last", F.max("pos").over(whole))
        .withColumn("total", F.max("upto").over(whole))
    )
    forward_end = F.coalesce("after", F.when(F.col("total") - F.col("start") >= min_words, F.col("last") + 1))
    backward_start = F.coalesce(F.col("before") + 1, F.when(F.col("upto") >= min_words, F.col("first")))
    runs = F.array(
        F.struct(F.col("pos").alias("from"), (forward_end - F.col("pos")).alias("size")),
        F.struct(backward_start.alias("from"), (F.col("pos") - backward_start + 1).alias("size")),
    )
    return (
        island.select("__row", "doc_id", F.explode(F.array_distinct(runs)).alias("run"))
        .where("run.size is not null")
        .select("__row", "doc_id", F.col("run.from").alias("pos"), F.col("run.size").alias("size"))
        .distinct()
    )


def repeated_lines(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """(__row, line) of the lines that belong to a later copy of a repeated run of ``min_words`` words or more.

    Level k ranks the first 2^k lines of each suffix of the line sequences (one sequence per document; a run
    does not cross documents). Pairs of ranks of level k, 2^k lines apart, are the keys of level k + 1: those that
    occur once leave, the others are sorted and ranked anew, which is the suffix array cut to what repeats. The
    suffixes that share a rank pair covering a run are the longest-common-prefix interval of that run, and all but its
    least place are later copies. As every line counted has a word, runs to be told apart have at
    most ``min_words`` lines, so log2(min_words) levels find runs of any length: longer ones are unions of these.
    """
    lines = stage(_lines(rows), "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    active = stage(lines.join(_ranked(repeated, "h1", "h2"), ["h1", "h2"]).drop("h1", "h2"), "level")
    windows = stage(_windows(active, min_words), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    level = active.select("__row", "pos", "rank")
    later, step = [], 1
    while step <= longest:
        here = windows.where(F.col("size").between(step, 2 * step - 1))
        later.append(_later_copies(here, level, step))
        step *= 2
        if step <= longest:
            level = _doubled(level, step // 2)
    if not later:
        return active.select("__row", "line").limit(0)
    found = later[0]
    for part in later[1:]:
        found = found.unionAll(part)
    covered = found.select("__row", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    return covered.join(active.select("__row", "pos", "line"), ["__row", "pos"]).select("__row", "line")


def _doubled(level: DataFrame, half: int) -> DataFrame:
    """Ranks of twice as many lines, for the suffixes whose longer prefix still repeats."""
    second = level.select("__row", (F.col("pos") - half).alias("pos"), F.col("rank").alias("r2"))
    pairs = stage(level.withColumnRenamed("rank", "r1").join(second, ["__row", "pos"]), "rank-pairs")
    repeated = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return stage(pairs.join(_ranked(repeated, "r1", "r2"), ["r1", "r2"]).select("__row", "pos", "rank"), "level")


def _later_copies(windows: DataFrame, level: DataFrame, width: int) -> DataFrame:
    """The runs of ``width`` to 2 * ``width`` - 1 lines that occurred before; two overlapping ranks cover a run."""
    tail = level.select("__row", F.col("pos").alias("end"), F.col("rank").alias("r2"))
    keyed = (
        windows.withColumn("end", F.col("pos") + F.col("size") - width)
        .join(level.withColumnRenamed("rank", "r1"), ["__row", "pos"])
        .join(tail, ["__row", "end"])
        .select("__row", "doc_id", "pos", "size", "r1", "r2")
    )
    keyed = stage(keyed, "runs")
    key = ["size", "r1", "r2"]
    intervals = stage(keyed.groupBy(*key).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "intervals")
    return keyed.join(intervals, key).where(_place() != F.col("first")).select("__row", "pos", "size")


def dedup_lines(documents: DataFrame, min_words: int = 50, counts: bool = False) -> DataFrame:
    """``documents`` without the later copies of repeated line runs; needs the columns doc_id and text.

    A run is a sequence of lines, taken without the lines that hold no word; it counts if it has ``min_words`` words
    or more and occurs twice or more, in one document or several, overlapping or not. The copy of the smallest
    (doc_id, row, line) stays, NULL ids last; every line of the others goes, and all else stays as it was, lines
    without a word too. ``n_chars``, if there is such a column, is set to the new length. NULL texts stay NULL and empty ones empty;
    a document may end up empty, but no row is dropped. Of repeated rows the later ones lose what counts. Other
    columns pass through. ``counts`` adds ``n_lines`` and ``n_removed`` in place of columns of those names.
    """
    given = {f"__given_{i}": c for i, c in enumerate(documents.columns) if c not in ("doc_id", "text")}
    rows = numbered(documents.withColumnsRenamed({c: g for g, c in given.items()}))
    gone = repeated_lines(rows, min_words).groupBy("__row").agg(F.collect_set("line").alias("__gone"))
    gone = stage(gone, "removed-lines").withColumnRenamed("__row", "__at")
    joined = rows.join(gone, rows["__row"] == gone["__at"], "left")
    lines = F.split("text", "\n", -1)
    indexes = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.array_except(indexes, "__gone"), lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    joined = joined.withColumn("__kept", text)
    changed = {c: F.col(g) for g, c in given.items()} | {"doc_id": F.col("doc_id"), "text": F.col("__kept")}
    if "n_chars" in documents.columns:
        length = F.length("__kept").cast(documents.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__gone").isNull(), changed["n_chars"]).otherwise(length)
    out = [changed[c].alias(c) for c in documents.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        out += [
            F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"),
            F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).alias("n_removed"),
        ]
    return joined.select(*out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of line runs of 50 words, with their lines, those removed and the text's digest."""
    result = dedup_lines(table(spark, sf_dir, "documents"), min_words=50, counts=True)
    return result.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


#: The CTEs of the check SQL, also used by the pipeline's; ``{source}`` has doc_id and text.
CHECK_STEPS = r"""
ld_split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source}),
ld_all AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM ld_split),
ld_token AS (
  SELECT doc_id, line_no, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM ld_all) WHERE words > 0),
ld_sum AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM ld_token),
ld_window AS (
  SELECT a.doc_id, a.pos AS lo, min(b.pos) AS hi FROM ld_sum a JOIN ld_sum b
  ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.pos), a.pos FROM ld_sum a JOIN ld_sum b
  ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 49 AND a.pos AND a.upto - b.upto + b.words >= 50 GROUP BY ALL),
ld_content AS (
  SELECT w.doc_id, w.lo, w.hi, string_agg(t.line, chr(10) ORDER BY t.pos) AS content
  FROM ld_window w JOIN ld_token t ON w.doc_id = t.doc_id AND t.pos BETWEEN w.lo AND w.hi GROUP BY ALL),
ld_order AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS nth FROM ld_content),
ld_gone AS (
  SELECT DISTINCT t.doc_id, t.line_no FROM ld_order w JOIN ld_token t ON w.doc_id = t.doc_id AND t.pos BETWEEN w.lo AND w.hi WHERE w.nth > 1),
ld_kept AS (
  SELECT a.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed,
         coalesce(string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (g.doc_id IS NULL), '') AS text
  FROM ld_all a LEFT JOIN ld_gone g ON a.doc_id = g.doc_id AND a.line_no = g.line_no GROUP BY a.doc_id)
"""

CHECK_SQL = f"""
WITH {CHECK_STEPS.format(source="documents")}
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       length(k.text) AS n_chars, md5(k.text) AS text_md5
FROM documents d LEFT JOIN ld_kept k ON d.doc_id = k.doc_id
"""
