"""Classifiers by held-out accuracy, neighbour search against brute force, and odd inputs."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvengine.llm import common, neighbour_forest, quality, toxicity

SCORED = "doc_id long, text string, score double, extra string"
ODD = [(None, None, 1.0, "x"), (10**17 + 1, "", 2.0, "x"), (3, " \n", 3.0, "x"), (3, "word " * 60_000, 4.0, "x"), (4, "the the", 5.0, "x"), (4, "the the", 5.0, "x")]


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def check_scores(spark, module, fit):
    documents = spark.createDataFrame(ODD, SCORED)
    got = module.score(documents, fit).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((r[0] or 0) for r in ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert module.score(documents.limit(0), fit).count() == 0


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def accuracy(rows, labels, column, folds, fold):
    known = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    tested = [(r.predicted, known[r.doc_id]) for r in rows if r.doc_id in known and r.held_out]
    assert all(r.held_out == held(r.doc_id, folds, fold) for r in rows)
    return np.mean([p == y for p, y in tested]), tested


def test_toxicity(spark, larger):
    rows = toxicity.op2_toxicity(spark, larger).collect()
    right, tested = accuracy(rows, spark.read.parquet(f"{larger}/labels.parquet"), "toxic", 5, 0)
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.5) for r in rows)
    assert right >= 0.85  # a few dozen toxic rows to learn from


def test_subwords_share_misspellings():
    assert set(toxicity.subwords("stupid")) & set(toxicity.subwords("stupidd"))


def test_toxicity_odd_inputs(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1, 1, 0), (None, 1, 1), (41, None, None)], "doc_id long, quality int, toxic int")
    text = F.when(F.col("doc_id") % 2 == 1, F.lit("you rotten fool")).otherwise("a fine day")
    documents = spark.range(40).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("ids"), F.lit(1).alias("y"))
    model = toxicity.fit(documents.select("doc_id", "text"), labels)
    score = model.scorer()
    assert score("rotten fools") > 0.5 > score("fine days")
    check_scores(spark, toxicity, model)
    kept = toxicity.keep_clean(documents, model)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == set(range(0, 40, 2))
    assert 0 <= toxicity.fit(documents.select("doc_id", "text"), labels.limit(0)).scorer()("x") <= 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_repeated_documents_stay_within_the_bound(spark, module):
    """An id is one fitted row, however often it occurs; its text is the same whatever the order of the rows."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    text = F.concat(F.when(F.col("doc_id") % 2 == 1, F.lit("rotten fool ")).otherwise("fine day "), (F.col("id") % 3).cast("string"))
    documents = spark.range(3000).withColumn("doc_id", F.col("id") % 60).select("doc_id", text.alias("text"))
    found = common.labelled_texts(documents, labels, "toxic", 5, 0, 7).collect()
    assert len({r.doc_id for r in found}) == len(found) == 14
    assert sorted(found) == sorted(common.labelled_texts(documents.repartition(5), labels, "toxic", 5, 0, 7).collect())
    assert module.score(documents, module.fit(documents, labels, rows_per_class=7)).count() == 3000


def test_toxicity_entries_are_bounded(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    documents = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit("rotten fool")).otherwise("fine day").alias("text"))
    score = toxicity.fit(documents, labels, entries_per_class=200).scorer()
    assert score("rotten") > 0.5 > score("fine")


def test_quality(spark, larger):
    rows = quality.op6_quality(spark, larger).collect()
    right, tested = accuracy(rows, spark.read.parquet(f"{larger}/labels.parquet"), "quality", 4, 2)
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) for r in rows)
    assert right >= 0.9
    assert np.mean([p for p, y in tested if y == 1]) >= 0.95


def test_quality_odd_inputs(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    text = F.when(F.col("doc_id") % 2 == 1, F.lit("a plain and good sentence of words")).otherwise("$$ %% ## spam spam")
    documents = spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"))
    model = quality.fit(documents, labels)
    assert model.temperature > 0
    ids = quality._Ids()
    good, bad = model.scores(quality.pool(["a good sentence", "spam $$ ##"], model.vectors, ids))
    assert good > bad
    check_scores(spark, quality, model)
    check_scores(spark, quality, quality.fit(documents.limit(0), labels.limit(0)))


def test_word_vectors_add_up_over_partitions_and_slices(spark, monkeypatch):
    texts = [("one two three two one",), ("",), (None,), ("three " * 50 + "four",), ("five",)]
    documents = spark.createDataFrame(texts, "text string")
    places, signs = quality.index_vectors()
    sums = np.zeros(quality.BUCKETS * quality.DIMENSION)
    gap = np.zeros(quality.WINDOW, np.int64)
    for (t,) in texts:
        quality._add_contexts(sums, np.concatenate([gap, quality.token_ids(t, quality._Ids()), gap]), places, signs)
    sums = sums.reshape(quality.BUCKETS, -1)
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    own = np.zeros_like(want)
    np.put_along_axis(own, places, signs, axis=1)
    got = quality.word_vectors(documents.repartition(3))
    assert np.allclose(got, want + own / (2 * np.sqrt(quality.ONES)), atol=1e-6)
    assert np.allclose(quality.word_vectors(documents.coalesce(1)), got)


def sound(v):
    return v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, queries, top):
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and sound(v)]
    out = {}
    for i, u in good:
        if queries(i):
            found = {}
            for j, w in good:
                if j != i:
                    found[j] = max(found.get(j, -2), float(u @ w))
            out[i] = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:top]
    return out


def test_neighbours_recall(spark, sf, monkeypatch):
    monkeypatch.setattr(neighbour_forest, "FEW_ROWS", 0)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors = np.array([v for _, v in rows], float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in neighbour_forest.op9_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids if i % 50 == 0)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -2
        assert all(abs(scores[ids == i][0] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(ids[np.lexsort((ids, -scores))[:5]]))
    assert hits >= 0.9 * 5 * len(got)


@pytest.mark.parametrize("few", [1000, 0])
def test_neighbours_odd_inputs(spark, monkeypatch, few):
    """Repeated ids are rows of their own, lengths do not mix, and what has no direction takes no part."""
    monkeypatch.setattr(neighbour_forest, "FEW_ROWS", few)
    order = np.random.default_rng(4)
    centre = order.standard_normal(16)
    rows = [(i, order.standard_normal(16).tolist()) for i in range(1, 50)] + [(i, centre.tolist()) for i in range(200, 260)]
    rows += [(300, None), (350, [0.0] * 16), (301, [math.nan] * 16), (302, [None] * 16), (None, centre.tolist())]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [1.0, 2.0]), (402, [1.0, 2.0]), (450, [5.0]), (500, [3.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("row", F.lit(1))
    got = {}
    for r in neighbour_forest.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert set(got) == {200, 250, 400}
    assert sorted(got[200]) == [(k, 200 + k, 1.0) for k in range(1, 6)]
    assert sorted(got[400]) == [(1, 402, 1.0), (2, 402, 1.0), (3, 401, 0.8)]
    assert neighbour_forest.search(table.limit(0), F.lit(True)).count() == 0
    assert neighbour_forest.search(table, F.lit(False)).count() == 0


def test_neighbours_of_a_repeated_query(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbour_forest.search(table, F.col("vec_id") == 50).collect())
    near = round(math.sqrt(0.5), 6)
    assert got == [(50, 1, 3, near), (50, 1, 3, near), (50, 2, 50, 0.0), (50, 2, 50, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_neighbours_in_tiny_tables(spark, monkeypatch, n):
    monkeypatch.setattr(neighbour_forest, "FEW_ROWS", 0)
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>").repartition(n)
    got = neighbour_forest.search(table, F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(k, k) for k in range(1, n)]


def test_neighbours_with_many_blocks(spark, monkeypatch):
    """Many blocks and parts of the queries give the same kind of result."""
    monkeypatch.setattr(neighbour_forest, "BLOCK_ROWS", 60)
    monkeypatch.setattr(neighbour_forest, "FEW_ROWS", 0)
    monkeypatch.setattr(neighbour_forest, "QUERY_ROWS", 20)
    order = np.random.default_rng(5)
    centres = order.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.2 * order.standard_normal(16)).tolist()) for i in range(800)] + [(900 + i, order.standard_normal(16).tolist()) for i in range(6)]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    got = {}
    for r in neighbour_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(found) == 5 for found in got.values()) and set(got) == set(want)
    assert sum(len(found & {i for i, _ in want[q]}) for q, found in got.items()) >= 0.9 * 5 * len(got)
