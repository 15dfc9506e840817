"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvengine.llm.common import held_out, labelled_texts, map_texts, small_text_batches, stage, table

#: Words share this many vectors by hash, so the table of vectors has a fixed size (2 MB) however large the corpus.
BUCKETS = 1 << 14
DIMENSION = 32
#: Components of an index vector that are 1 or -1; all others are 0.
ONES = 4
WINDOW = 2
#: Tokens that are looked at together.
SLICE = 200_000
#: Rows of each label that are fitted at most.
ROWS_PER_CLASS = 4000
HIDDEN = 24
EPOCHS = 60
BATCH = 64
RATE = 0.005
DECAY = 1e-3
#: One in so many of the fitted rows only serves to choose the temperature.
CALIBRATION = 5
MEMORY = 500_000
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Ids(dict):
    """Bucket of a token, remembered; 0 is kept for gaps between documents."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[token] = 1 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        return value


def token_ids(text: str | None, ids: _Ids) -> np.ndarray:
    tokens = _TOKEN.findall((text or "").lower())
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places of its ONES components and their signs; bucket 0 is all zero."""
    order = np.random.default_rng(1)
    places = np.stack([order.permutation(DIMENSION)[:ONES] for _ in range(BUCKETS)])
    signs = order.choice([-1.0, 1.0], (BUCKETS, ONES))
    signs[0] = 0
    return places, signs


def _add_contexts(sums: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each token's row the index vectors of its neighbours within the window."""
    for distance in range(1, WINDOW + 1):
        for centre, near in ((ids[:-distance], ids[distance:]), (ids[distance:], ids[:-distance])):
            for k in range(ONES):
                sums += np.bincount(centre * DIMENSION + places[near, k], signs[near, k], sums.size)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Vectors of all buckets from the contexts of every token of every document.

    A task adds up its documents and hands on one row per bucket, which are summed by bucket in a shuffle;
    the driver gets the summed table, whose size is fixed. A vector is the direction of the contexts plus half the
    bucket's own index vector, so that words in alike contexts are alike but not the same.
    """
    small_text_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, signs), ids = index_vectors(), _Ids()
        sums, seen, held, size = np.zeros(BUCKETS * DIMENSION), False, [], 0
        gap = np.zeros(WINDOW, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = token_ids(text, ids)
                for at in range(0, found.size, SLICE):
                    # neighbours across a cut of a long text are seen from the later slice
                    held += [gap if at == 0 else found[at - WINDOW : at], found[at : at + SLICE]]
                    size += SLICE if found.size > SLICE else found.size
                    if size >= SLICE:
                        _add_contexts(sums, np.concatenate([*held, gap]), places, signs)
                        seen, held, size = True, [], 0
        if held:
            _add_contexts(sums, np.concatenate([*held, gap]), places, signs)
            seen = True
        if seen:
            rows = sums.astype(np.int64).reshape(BUCKETS, DIMENSION)
            used = np.flatnonzero(rows.any(axis=1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (used.size + 1) * DIMENSION, DIMENSION, dtype=np.int32)), pa.array(rows[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], names=["bucket", "v"])

    parts = documents.select("text").mapInArrow(run, "bucket int, v array<long>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.get("v", i)).alias(f"d{i}") for i in range(DIMENSION)])
    found = stage(summed, "word-vectors").toPandas().sort_values("bucket")
    vectors = np.zeros((BUCKETS, DIMENSION))
    vectors[found["bucket"].to_numpy(np.int64)] = found[[f"d{i}" for i in range(DIMENSION)]].to_numpy(np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    own = np.zeros_like(vectors)
    np.put_along_axis(own, places, signs, axis=1)
    return (vectors + own / (2 * np.sqrt(ONES))).astype(np.float32)


def pool(texts: list, vectors: np.ndarray, ids: _Ids) -> np.ndarray:
    """Per text the mean and the spread of its tokens' vectors, and of the likeness of neighbours; zeros without tokens."""
    found = [token_ids(t, ids) for t in texts]
    sizes = np.array([f.size for f in found])
    sums = np.zeros((len(texts), 2 * DIMENSION + 2))
    flat = np.concatenate([*found, np.zeros(1, np.int64)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    for at in range(0, owner.size, SLICE):
        stop = min(owner.size, at + SLICE)
        rows = vectors[flat[at : stop + 1]].astype(np.float64)
        same = np.r_[owner[at + 1 : stop + 1], -1][: stop - at] == owner[at:stop]
        alike = (rows[:-1] * rows[1:]).sum(axis=1) * same
        part = np.concatenate([rows[:-1], rows[:-1] ** 2, alike[:, None], same[:, None]], axis=1)
        starts = np.flatnonzero(np.r_[True, owner[at + 1 : stop] != owner[at : stop - 1]])
        np.add.at(sums, owner[at:stop][starts], np.add.reduceat(part, starts, axis=0))
    count = np.maximum(sizes, 1)[:, None]
    mean, square = sums[:, :DIMENSION] / count, sums[:, DIMENSION : 2 * DIMENSION] / count
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, spread, (sums[:, -2] / np.maximum(sums[:, -1], 1))[:, None]], axis=1)


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    shift: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        logits = _forward(self.layers, (pooled - self.centre) / self.scale)[1]
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature + self.shift, -500, 500)))

    def make(self) -> Callable[[list], list[pa.Array]]:
        ids = _Ids()
        return lambda texts: [pa.array(self.scores(pool(texts, self.vectors, ids)), pa.float64())]


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, bias, second, last = layers
    hidden = np.tanh(x @ first + bias)
    return hidden, hidden @ second + last


def _train(x: np.ndarray, y: np.ndarray, order: np.random.Generator) -> tuple:
    layers = [order.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), order.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    step, steps = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(y)), -(-len(y) // BATCH)):
            step += 1
            hidden, logits = _forward(layers, x[rows])
            error = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            gradient = [x[rows].T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum()]
            rate = RATE * (1 - step / (steps + 1))
            for i, g in enumerate(gradient):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def learn(pooled: np.ndarray, y: np.ndarray, vectors: np.ndarray, share: float, seed: int = 4) -> QualityModel:
    """Trains on four fifths of the rows and chooses the temperature on the rest by its log loss."""
    width = pooled.shape[1]
    if len(set(y.tolist())) < 2:
        layers = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(()))
        return QualityModel(vectors, np.zeros(width), np.ones(width), layers, 1.0, float(np.log(share / (1 - share))))
    order = np.random.default_rng(seed)
    centre, scale = pooled.mean(axis=0), pooled.std(axis=0) + 1e-6
    x = (pooled - centre) / scale
    kept = order.permutation(len(y)) % CALIBRATION == 0
    layers = _train(x[~kept], y[~kept], order)
    logits = _forward(layers, x[kept])[1]
    grid = np.geomspace(0.25, 20, 120)
    temperature = float(grid[np.argmin([_loss(logits / t, y[kept]) for t in grid])])
    fitted = y.mean()
    shift = np.log(share / (1 - share)) - np.log(fitted / (1 - fitted))
    return QualityModel(vectors, centre, scale, layers, temperature, float(shift))


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Word vectors of all documents, and a network of ``labels.quality`` outside the held-out fold.

    The network sees at most ``rows_per_class`` documents of each label, an id once however many rows have it; only their
    pooled vectors reach the driver. Without labels of both kinds scores are constant.
    """
    vectors = word_vectors(documents)
    texts = labelled_texts(documents, labels, "quality", FOLDS, FOLD, rows_per_class)

    def make():
        ids = _Ids()
        return lambda batch: [pa.array(list(pool(batch, vectors, ids)), pa.list_(pa.float64()))]

    rows = map_texts(texts, "text", make, "pooled array<double>").toPandas().sort_values("doc_id", kind="stable")
    share = labels.where(~held_out("doc_id", FOLDS, FOLD)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    share = min(max(share if share is not None else 0.5, 0.001), 0.999)
    pooled = np.stack(rows["pooled"].to_numpy()) if len(rows) else np.zeros((0, 2 * DIMENSION + 1))
    return learn(pooled, rows["y"].to_numpy(np.float64), vectors, share)


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) per row, over the whole text; NULL and empty texts get the score of a document without words.

    Repeated rows come back as often as they occur, NULL ids as NULL, an empty table as an empty result.
    """
    return map_texts(documents.select("doc_id", "text"), "text", model.make, "score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from those whose crc32(doc_id as text) mod 4 is not 2."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, fit(documents, labels))
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
